"""Fingerprints against plain set similarity."""

import hashlib

import numpy as np
from small import corpus, frame, shingles_of

from driftlens.llm import fingerprints


def similarity(a, b):
    a, b = (shingles_of((t or "").lower()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """Edited and next text of every row."""
    ids = sorted({i for i, _ in rows if i is not None})
    first = {i: min((t or "" for k, t in rows if k == i)) for i in ids}
    out = []
    for i, t in rows:
        t = t or ""
        after = first[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else first[ids[0]]
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + after[:half], after))
    return out


def test_against_sets(spark):
    rows = [r for r in corpus(12) if r[0] != 17] + [(None, "no id here at all, really not"), (None, "nor here"), (40, "b again"), (40, "a again")]
    want = plain(rows)
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(i), len(t), sha(e)) for i, t, e, _ in want)
    by = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    errors = [by[i, sha(e)]["near_edited"] - similarity(t, e) for i, t, e, _ in want]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    assert np.mean([abs(by[i, sha(e)]["near_next"] - similarity(t, a)) for i, t, e, a in want]) < 0.04
    same = {}
    for i, t, e, _ in want:
        same.setdefault(t, set()).add(by[i, sha(e)]["fingerprint"])
        assert len(by[i, sha(e)]["fingerprint"]) == fingerprints.BINS
    assert all(len(v) == 1 for v in same.values())


def test_one_and_none(spark):
    (r,) = fingerprints.fingerprint_documents(frame(spark, [(3, "a b c d e f g h i j")])).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c d ea b c d e"[:0] + b"a b c d e " + b"a b c d e").hexdigest()
    assert fingerprints.fingerprint_documents(frame(spark, [])).collect() == []


def test_sql_only(spark):
    plan = fingerprints.fingerprint_documents(frame(spark, corpus(12)[:20]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
