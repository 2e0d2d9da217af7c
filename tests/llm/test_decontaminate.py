"""Containment search against all pairs."""

import random

import pytest
from small import corpus, frame, sentence, shingles_of

from driftlens.llm import decontaminate


def fixture():
    rng = random.Random(11)
    rows = corpus(7)
    items = [(k, sentence(rng, n)) for k, n in enumerate([1, 3, 5, 6, 14, 30, 59, 200])] + [(90, None), (91, ""), (92, "one two")]
    texts = [t for _, t in items[2:8]]
    rows += [(1000 + k, f"{sentence(rng, 50)} {t} {sentence(rng, 40)}") for k, t in enumerate(texts)]
    rows += [(1100 + k, f"{sentence(rng, 5000)} {t.upper()}\n{sentence(rng, 4000)}") for k, t in enumerate(texts)]
    rows += [(1200 + k, " ".join(t.split()[: int(len(t.split()) * 0.85)])) for k, t in enumerate(texts)]
    rows += [(1300, items[1][1]), (1300, items[1][1])]
    return rows, items


def plain(rows, items):
    out = []
    for i, t in rows:
        s = shingles_of(t)
        for k, q in items:
            own = shingles_of(q)
            if own and len(s & own) >= 0.75 * len(own):
                out.append((i, k, len(s & own), len(own)))
    return sorted(out)


@pytest.mark.parametrize("item_bytes", [8 << 20, 400])
def test_against_all_pairs(spark, item_bytes):
    rows, items = fixture()
    found = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), item_bytes=item_bytes)
    want = plain(rows, items)
    assert len(want) > 15
    assert sorted((r["doc_id"], r["item_id"], r["shared"], r["n_item"]) for r in found.collect()) == want


def test_drop(spark):
    rows, items = fixture()
    docs = frame(spark, rows)
    out = decontaminate.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), item_bytes=2000)
    gone = {i for i, *_ in plain(rows, items)}
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in rows if i not in gone)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(frame(spark, corpus(8)[:5]), items).collect() == []
    assert decontaminate.find_leaks(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
