"""Graphs that a task holds: the same results as by joins, in a number of jobs that does not grow with paths."""

import random
import uuid

import numpy as np
import pytest

from driftlens.operators import graph as gr
from driftlens.operators import paths

SCHEMA = "src string, dst string, weight double, kind string"


def made(spark, edges):
    return spark.createDataFrame([(a, b, float(w), "reply") for a, b, w in edges], SCHEMA)


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def chain(n):
    return [(f"v{i:03d}", f"v{i + 1:03d}", 0.5) for i in range(n - 1)]


def test_jobs_do_not_grow_with_paths(spark):
    """A chain has as many levels as nodes."""
    g = made(spark, chain(40))
    for way in (lambda: paths.weighted_betweenness(g, pivots=40), lambda: gr.sampled_betweenness(g, pivots=40)):
        out, n = jobs(spark, lambda: {r["account_id"]: r["betweenness"] for r in way().collect()})
        assert n < 60, n
        assert all(abs(out[f"v{i:03d}"] - i * (39 - i) / (39 * 38)) < 1e-12 for i in range(40))


@pytest.mark.parametrize("directed", [True, False])
def test_both_ways_are_one(spark, directed):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(24)]
    edges = [(*rng.sample(names, 2), rng.choice([0.3, 0.8, 0.9, 1.0, 1.1])) for _ in range(60)] + [("n00", "n00", 1.0), ("n01", "n02", 0.0)]
    g = made(spark, edges)
    found = [{r["account_id"]: r["betweenness"] for r in gr.sampled_betweenness(g, 9, directed=directed, room=room).collect()} for room in (None, 0)]
    if directed:
        found += [{r["account_id"]: r["betweenness"] for r in paths.weighted_betweenness(g, 9, room=room).collect()} for room in (None, 0)]
    for x, y in zip(found[::2], found[1::2], strict=True):
        assert x.keys() == y.keys() and max(x.values()) > 0 and all(abs(x[k] - y[k]) < 1e-12 for k in x)


def test_edges_in_pieces(monkeypatch):
    """Pieces of edges change nothing, nor does the way sums are made."""
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 40, 300) << 32 | rng.integers(0, 40, 300))
    edges = paths._Edges(np.searchsorted(key, np.arange(41) << 32), (key & 0x7FFFFFFF).astype(np.int32), rng.choice([0.1, 0.2, 0.3, 0.7], len(key)))
    whole = [f(edges, 0, 40)[0] for f in (paths._by_edges, paths._by_weight)]
    monkeypatch.setattr(paths, "_PIECE", 3)
    assert all(np.allclose(f(edges, 0, 40)[0], w) for f, w in zip((paths._by_edges, paths._by_weight), whole, strict=True))
    assert whole[0].max() > 0 and whole[1].max() > 0


def test_communities_in_few_jobs(spark):
    """All passes are one task, however many rounds they take; a node alone stays so."""
    g = made(spark, [*chain(200), ("alone", "alone", 2.0)])
    stats = []
    out, n = jobs(spark, lambda: {r["account_id"]: r["community"] for r in gr.communities(g, stats=stats).collect()})
    assert n < 60 and len(stats) > 2, (n, stats)
    assert out["alone"] == "alone" and 8 < len(set(out.values())) < 30
    assert all(out[x] == min(y for y in out if out[y] == out[x]) for x in out)


def test_passes_after_rounds(spark):
    """A graph too large for a task is finished in one once its communities are few."""
    edges = [(f"g{g}n{i}", f"g{g}n{j}", 1.0) for g in range(4) for i in range(6) for j in range(i)] + [(f"g{g}n0", f"g{(g + 1) % 4}n1", 0.2) for g in range(4)]
    out = {r["account_id"]: r["community"] for r in gr.communities(made(spark, edges), room=80).collect()}
    assert all(out[f"g{g}n{i}"] == f"g{g}n0" for g in range(4) for i in range(6))
