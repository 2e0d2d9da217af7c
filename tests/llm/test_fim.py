"""Boundary sets against plain positions, and cut texts against slicing."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from small import ODD_ROWS, corpus, frame

from driftlens.llm import boundaries, fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, lo, hi - lo, sha(out), sha(text)


def test_containers():
    rng = np.random.default_rng(3)
    long_run = np.zeros(boundaries.CHUNK, bool)
    long_run[100:60_000] = True
    few = np.zeros(boundaries.CHUNK, bool)
    few[rng.choice(boundaries.CHUNK, 500, replace=False)] = True
    cases = [long_run, few, rng.random(boundaries.CHUNK) < 0.4, np.ones(boundaries.CHUNK, bool), np.zeros(boundaries.CHUNK, bool), np.ones(7, bool)]
    kinds = set()
    for flags in cases + [np.concatenate(cases)]:
        s = boundaries.BoundarySet(flags)
        kinds |= {type(c).__name__ for c in s.containers}
        members = np.append(np.flatnonzero(flags), len(flags))
        assert len(s) == len(members)
        assert (s.select(np.arange(len(members))) == members).all()
        at = np.concatenate([rng.integers(0, len(flags) + 1, 2000), [0, len(flags)], members[:50]])
        assert (s.rank(at) == np.searchsorted(members, at)).all()
    assert kinds == {"ArrayContainer", "RunContainer", "BitmapContainer"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé漢🙂\n", max_size=40), min_size=1, max_size=8), st.randoms())
def test_offsets(texts, rng):
    import pyarrow as pa

    cuts = [np.array([rng.randint(0, len(t)) for t in texts]) for _ in range(2)]
    column = pa.array(["left out", *texts])[1:]
    for cut, got in zip(cuts, fim.byte_offsets(column, cuts), strict=True):
        assert got.tolist() == [len(t[:k].encode()) for t, k in zip(texts, cut, strict=True)]


def test_documents(spark):
    rng = random.Random(5)
    wide = ["".join(rng.choice("aé漢🙂 \n") for _ in range(n)) for n in (1, 2, 3, 70_000, 200_000)]
    texts = [t for _, t in corpus(2)] + wide + ["a<P>b", "<S>", "x<M>", "<P<S", "ends in <", "<", "S>", "\u0000 zero"] + ["é" * 9_000_000]
    rows = list(enumerate(texts)) + [(-7, "negative id"), (2**62, "large id"), *ODD_ROWS]
    got = fim.fill_in_middle_digests(frame(spark, rows)).collect()
    assert sorted(map(str, got)) and sorted(tuple(r) for r in got if r[0] is not None) == sorted(plain(*r) for r in rows if r[0] is not None)
    assert [tuple(r) for r in got if r[0] is None] == [plain(*r) for r in rows if r[0] is None]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and all(r["n"] is not None for r in got)
    assert fim.fill_in_middle_digests(frame(spark, [])).collect() == []


def test_parameters(spark):
    d = fim.fill_in_middle(frame(spark, corpus(4)), rearranged=100, suffix_first=100, sentinels=("[p]", "[s]", "[m]"))
    rows = d.withColumn("back", fim.restored(d["output"], d["form"], ("[p]", "[s]", "[m]"))).collect()
    texts = dict(corpus(4))
    assert all(r["back"] == (texts[r["doc_id"]] or "") for r in rows)
    assert {r["form"] for r in rows if texts[r["doc_id"]]} == {"spm"}
