"""Held-out accuracy and odd inputs of the two classifiers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from small import ODD_ROWS, corpus, frame

from driftlens.llm import quality, toxicity

SF = "/root/testdata/sf0.1"  # some hundred labelled rows are held out
WAYS = [(quality.train_quality, quality.score_quality, "quality", 0.3), (toxicity.train_toxicity, toxicity.score_toxicity, "toxic", 0.5)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
@pytest.mark.parametrize("train, score, target, limit", WAYS)
def test_held_out(spark, train, score, target, limit):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(target).alias("y")).collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("y", "predicted", "score"))
    assert ((s >= 0) & (s <= 1)).all() and (p == (s >= limit)).all()
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5
    assert (y == p).mean() > 0.9 and auc > 0.85


@pytest.mark.parametrize("train, score, target, limit", WAYS)
def test_odd_inputs(spark, train, score, target, limit):
    docs = frame(spark, corpus(3) + ODD_ROWS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (3, 0, 0), (3, 1, 1), (None, 1, 1), (12345, 1, 0), (4, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    rows = score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit) for r in rows)
    assert score(frame(spark, []), model).collect() == []
    none = train(docs, labels.where("false"))
    want = quality.EMPTY_SCORE if target == "quality" else 0.0
    assert {r["score"] for r in score(docs, none).collect()} == {want}


def test_labels_do_not_leak(spark):
    """Scores depend on texts alone."""
    docs = frame(spark, corpus(3))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    moved = docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("lang", F.lit("xx"))
    for train, score, *_ in WAYS:
        model = train(docs, labels)
        a = sorted(r["score"] for r in score(docs, model).collect())
        assert a == sorted(r["score"] for r in score(moved, model).collect())


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_additive(x[:3000], y[:3000])
    assert (((model.score(x[3000:]) >= 0.5) == y[3000:]).mean()) > 0.9


def test_good_ones_stay(spark):
    docs = frame(spark, corpus(3))
    out = quality.keep_good(docs, quality.AdditiveModel(constant=1.0))
    assert out.columns == docs.columns and out.count() == docs.count()
    assert quality.keep_good(docs, quality.AdditiveModel(constant=0.0)).count() == 0
