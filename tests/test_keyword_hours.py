"""Words by hour: what a task adds up, against a plain count."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlens.operators import trends as tr


@pytest.mark.parametrize("cells", [1, 12, 1 << 22])
def test_a_task_adds_up(monkeypatch, cells):
    """Few rows leave a task that has room; with little room sums are the same."""
    monkeypatch.setattr(tr, "CELLS", cells)
    rng, want, rows = np.random.default_rng(2), Counter(), []
    for _ in range(40):
        words = [f"w{i}" for i in rng.choice(9, rng.integers(1, 6), replace=False)]
        at = rng.choice(6, rng.integers(1, 5), replace=False).tolist()
        n = rng.integers(1, 4, len(at)).tolist()
        rows.append({"words": words, "at": at, "n": n})
        want.update({(w, h): 0 for w in words for h in at})
        for w in words:
            for h, k in zip(at, n, strict=True):
                want[w, h] += k
    schema = pa.schema([("words", pa.list_(pa.string())), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    out = [r for part in (rows[:15], rows[15:]) for r in [pa.RecordBatch.from_pylist(part, schema=schema)]]
    found = [r for b in tr._word_hours(iter(out)) for r in b.to_pylist()]
    got = Counter()
    for r in found:
        for h, k in zip(r["at"], r["n"], strict=True):
            got[r["keyword"], h] += k
    assert got == want and (len(found) == 9 or cells < 1 << 22)
    order = sorted(found, key=lambda r: r["keyword"])
    fields = pa.schema([("keyword", pa.string()), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    merged = [r for b in tr._one_row_a_word(pa.RecordBatch.from_pylist(order[i : i + 4], schema=fields) for i in range(0, len(order), 4)) for r in b.to_pylist()]
    assert {(r["keyword"], h): k for r in merged for h, k in zip(r["at"], r["n"], strict=True)} == want and len(merged) == 9


def test_words_do_not_meet_posts_as_rows(spark):
    """Only sums by word move; a post without a time or a text, and a text without words, are kept apart."""
    start = datetime(2024, 1, 1)
    posts = [(i % 5, None if i % 11 == 0 else start + timedelta(minutes=17 * i)) for i in range(200)] + [(9, start)]
    texts = [(0, "Alpha alpha, BETAS! gamma"), (1, "betas gamma?"), (2, "tiny"), (3, None), (4, "delta  delta epsilon")]
    p = spark.createDataFrame(posts, "doc_id long, created_at timestamp")
    t = spark.createDataFrame(texts, "doc_id long, text string")
    d = tr.keyword_hours(p, texts=t, text_id="doc_id")
    want = tr.keyword_hours(p.join(t, "doc_id"))
    assert sorted(map(str, d.collect())) == sorted(map(str, want.collect()))
    assert d.where("hour is null").count() > 0
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and d.agg(F.sum("n")).first()[0] == sum(n * 40 for n in (3, 2, 2))
