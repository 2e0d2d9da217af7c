"""Words and shingles of blocks against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from small import corpus, shingles_of, words_of

from driftlens.llm import textblock as tb


def check(texts):
    got_sets, got_words, distinct = [], [], []
    for b in tb.blocks(pa.array(texts, pa.string())):
        got_sets += tb.shingle_sets(b)
        got_words += np.diff(b.word_at).tolist()
        h, at = tb.shingle_hashes(b)
        distinct += tb.distinct_counts(h, at).tolist()
    assert got_words == [len(words_of(t)) for t in texts]
    want = [shingles_of(t) for t in texts]
    assert [len(s) for s in got_sets] == [len(s) for s in want] == distinct
    # equal hashes stand for equal shingles, over all texts
    assert len({int(x) for s in got_sets for x in s}) == len(set().union(*want)) if want else True
    for i in range(len(texts) - 1):
        assert len(np.intersect1d(got_sets[i], got_sets[i + 1])) == len(want[i] & want[i + 1])


def test_corpus():
    check([t for _, t in corpus()])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ \n\t\x0b\x1cé🙂", max_size=60), min_size=1, max_size=8))
def test_any_texts(texts):
    check(texts)


def test_words_across_windows(monkeypatch):
    monkeypatch.setattr(tb, "_WINDOW", 64)
    check(["x" * 500, "ab " * 300, "q" * 63 + " " + "q" * 64, " " * 200 + "end", "end"])


def test_no_texts():
    assert list(tb.blocks(pa.array([], pa.string()))) == []
