"""Average linkage against the sequential algorithm over all pairs."""

import random

import numpy as np
import pytest

from driftlens.operators import linkage


def plain(vectors, weights, min_sim):
    """Clusters as sets of places; the two nearest are merged while above the cut."""
    unit = np.asarray(vectors) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    copies = [i for i, w in enumerate(weights) for _ in range(w)]
    pair = unit[copies] @ unit[copies].T
    groups = [[k for k, i in enumerate(copies) if i == j] for j in range(len(vectors))]
    while len(groups) > 1:
        sims = [(pair[np.ix_(a, b)].mean(), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        s, x, y = max(sims, key=lambda t: t[0])
        if s <= min_sim:
            break
        groups[x] += groups.pop(y)
    return {frozenset(copies[k] for k in g) for g in groups}


def points(seed, n, dims=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(2, n // 8), dims))
    v = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, dims)) * 0.5
    return v, rng.integers(1, 4, n)


@pytest.mark.parametrize("seed", range(12))
def test_chains(seed):
    v, w = points(seed, random.Random(seed).choice([1, 2, 9, 40]))
    into = linkage.merged(v / np.linalg.norm(v, axis=1, keepdims=True), w, 0.65)
    got = {frozenset(np.flatnonzero(into == c).tolist()) for c in set(into.tolist())}
    assert got == plain(v, w, 0.65)


@pytest.mark.parametrize("local", [4096, 3])
def test_in_tasks_and_by_rounds(spark, local):
    """The same clusters when components are finished in a task and by rounds."""
    rows, want = [], set()
    for c, n in enumerate([45, 30, 1, 6]):
        v, w = points(100 + c, n)
        rows += [(f"c{c}", f"k{i:03d}", [float(x) for x in v[i]], int(w[i])) for i in range(n)]
        want |= {frozenset((f"c{c}", f"k{i:03d}") for i in g) for g in plain(v, w, 0.6)}
    stats = {}
    d = spark.createDataFrame(rows, "component string, key string, vector array<double>, weight long")
    got = linkage.average_clusters(d, 0.6, local=local, stats=stats).collect()
    by = {}
    for r in got:
        by.setdefault((r["component"], r["cluster"]), set()).add((r["component"], r["key"]))
        assert r["cluster"] <= r["key"]
    assert {frozenset(x) for x in by.values()} == want and len(got) == len(rows)
    assert (stats["rounds"] > 0) == (local == 3) and stats["rounds"] <= 12


def test_windows_of_posts(spark):
    """Clusters of posts: those of the sequential algorithm over all posts of a window."""
    from datetime import datetime, timedelta

    from driftlens.operators.topics import window_clusters

    rng, posts, vecs, want = random.Random(2), [], [], set()
    for window in range(2):
        v, _ = points(40 + window, 14)
        vecs += [(f"t{window}{i:02d}", [float(x) for x in v[i]]) for i in range(14)]
        w = [rng.randrange(1, 5) for _ in range(14)]
        for i in range(14):
            for c in range(w[i]):
                posts.append(("x", f"p{window}-{i}-{c}", datetime(2024, 1, 1) + timedelta(hours=25 * window + rng.random()), f"t{window}{i:02d}"))
        posts.append(("x", f"first{window}", datetime(2024, 1, 1) + timedelta(hours=24 * window), f"t{window}00"))
        w[0] += 1
        want |= {frozenset(f"t{window}{i:02d}" for i in g) for g in plain(v, w, 0.65) if sum(w[i] for i in g) >= 3}
    d = spark.createDataFrame(posts, "platform string, post_id string, created_at timestamp, topic_key string")
    got = window_clusters(d, spark.createDataFrame(vecs, "topic_key string, vector array<double>"), min_posts=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster"], set()).add(r["topic_key"])
    assert {frozenset(x) for x in by.values()} == want
