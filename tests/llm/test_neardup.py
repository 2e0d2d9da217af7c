"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pytest
from small import ODD_ROWS, components, corpus, frame, sentence, shingles_of

from driftlens.llm import neardup


def plain(rows):
    named = [(i, t) for i, t in rows if i is not None]
    sets = [(i, shingles_of(t)) for i, t in named]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    group = components({i for i, _ in named}, links)
    return sorted([(i, len(shingles_of(t)), group.get(i), i is None or group[i] == i) for i, t in rows], key=str)


def found(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()], key=str)


def test_against_all_pairs(spark):
    rows = corpus(5) + ODD_ROWS
    want = plain(rows)
    assert sum(not r[3] for r in want) > 20
    assert found(neardup.near_duplicates(frame(spark, rows))) == want


@pytest.mark.parametrize("block", [512, 8])
def test_links_off_the_centre(spark, block, monkeypatch):
    """Many texts that share half of their words, so that they meet in buckets
    without being linked, and some linked pairs among them."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    passage = sentence(rng, 60)
    rows = []
    for i in range(0, 120, 2):
        own = sentence(rng, 45, 5000)
        rows += [(i, f"{passage} {own}"), (i + 1, f"{passage} {own} more")]
    rng.shuffle(rows)
    assert found(neardup.near_duplicates(frame(spark, rows))) == plain(rows)


def test_one_of_each(spark):
    docs = frame(spark, corpus(6))
    out = neardup.keep_one_of_each(docs)
    kept = [r[0] for r in plain(corpus(6)) if r[3]]
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(kept)


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_no_links(spark):
    assert found(neardup.near_duplicates(frame(spark, [(1, "alpha beta"), (2, None)]))) == [(1, 1, 1, True), (2, 0, 2, True)]


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (6, 40, 900):
        errors = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
            a, b = pool[: int(n * 1.1)], pool[int(n * 0.2) :][: int(n * 1.1)]
            sig = neardup.signatures([np.sort(a), np.sort(b)])
            errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.12


def test_every_bin_is_filled():
    one = neardup.signatures([np.array([7 << 40], np.uint64), np.zeros(0, np.uint64)])
    assert (one[0] == 7 << 40).all() and (one[1] == 0).all()


def test_short_texts(spark):
    """Three shared shingles of four."""
    one = "w69766 w84036 w54978 w27414 w86177 w29813 w92897"
    rows = [(1, one), (2, f"{one} w33605"), (3, f"{one} w33605 w1 w2 w3 w4")]
    assert found(neardup.near_duplicates(frame(spark, rows))) == plain(rows)


def test_around_the_sizes_of_both_kinds(spark):
    rng = random.Random(8)
    rows = []
    for i, n in enumerate([280, 290, 300, 370, 380, 384, 388, 392, 400, 500] * 3):
        base = sentence(rng, n + 4, 50_000)
        rows += [(3 * i, base), (3 * i + 1, f"{base} {sentence(rng, n // 4, 50_000)}"), (3 * i + 2, f"{base} {sentence(rng, n // 3, 50_000)}")]
    assert found(neardup.near_duplicates(frame(spark, rows))) == plain(rows)


def test_recall_at_the_threshold():
    """100,000 pairs at exactly 0.75, of 3 to 480 shared shingles: none is lost but for
    one in ten thousand at most (5e-6 expected)."""
    rng = np.random.default_rng(11)
    lost = 0
    for shared in [3] * 20 + [6] * 8 + [30] * 8 + [90] * 6 + [150] * 4 + [210] * 2 + [300, 480]:
        sets, extra = [], shared // 3
        for _ in range(2000):
            x = np.unique(rng.integers(1, 1 << 63, shared + extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            mine = rng.permutation(x)
            sets += [np.sort(mine[:shared]), x]
        small, few, wide, many = neardup.both_signatures(sets)
        kind = max(shared, len(sets[1])) >= neardup.WIDE
        assert (many if kind else few).all()
        sig = wide if kind else small
        low = (sig & np.uint64(0xFFFF)).astype(np.uint16)
        keys = neardup.band_keys(sig)
        met = (keys[::2] == keys[1::2]).any(axis=1) & ((low[::2] == low[1::2]).mean(axis=1) >= neardup.AGREEMENT)
        lost += int((~met).sum())
    assert lost <= 10, lost
