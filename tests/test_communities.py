"""Communities: rounds on hard shapes, and modularity against greedy merging."""

import random
from collections import defaultdict

from driftlens.operators import graph as gr


def graph_of(spark, edges):
    return spark.createDataFrame([(a, b, float(w), "reply") for a, b, w in edges], "src string, dst string, weight double, kind string")


def modularity(edges, label):
    inside, degree, m = defaultdict(float), defaultdict(float), 0.0
    for a, b, w in edges:
        if a != b:
            m += w
            degree[label[a]] += w
            degree[label[b]] += w
            inside[label[a]] += w * (label[a] == label[b])
    return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def greedy(edges):
    """Merge the two communities of the largest gain until none gains."""
    label = {x: x for a, b, _ in edges for x in (a, b)}
    while True:
        now, best = modularity(edges, label), None
        for a, b in {tuple(sorted((label[x], label[y]))) for x, y, _ in edges if label[x] != label[y]}:
            q = modularity(edges, {x: a if c == b else c for x, c in label.items()})
            if q > now + 1e-12 and (best is None or q > best[0]):
                best = (q, a, b)
        if best is None:
            return label
        label = {x: best[1] if c == best[2] else c for x, c in label.items()}


def found(spark, edges):
    stats = []
    out = {r["account_id"]: r["community"] for r in gr.communities(graph_of(spark, edges), stats=stats).collect()}
    return out, stats


def test_planted_groups(spark):
    rng = random.Random(6)
    edges = []
    for g in range(5):
        names = [f"g{g}n{i}" for i in range(8)]
        edges += [(a, b, rng.choice([1, 2])) for a in names for b in names if a < b and rng.random() < 0.6]
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    edges += [(rng.choice(names), rng.choice(names), 1) for _ in range(14)]
    label, _ = found(spark, edges)
    assert modularity(edges, label) >= modularity(edges, greedy(edges)) - 0.02
    assert all(label[x] == min(y for y in label if label[y] == label[x]) for x in label)


def test_star_and_path(spark):
    """A hub takes its leaves in few rounds, a path settles in few."""
    star = [(f"leaf{i:03d}", "hub", 1) for i in range(300)]
    label, stats = found(spark, star)
    assert len(set(label.values())) == 1 and sum(map(len, stats)) <= 8, stats
    path = [(f"v{i:03d}", f"v{i + 1:03d}", 1) for i in range(100)]
    label, stats = found(spark, path)
    assert modularity(path, label) > 0.8 and sum(map(len, stats)) <= 40, stats


def without_structure(seed, nodes, links):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(nodes)]
    return [(*rng.sample(names, 2), rng.choice([0.3, 0.8, 1.0])) for _ in range(links)]


def test_dense_graph_settles_in_few_rounds(spark):
    """Few communities of many links: rounds do not grow with the moves."""
    edges = without_structure(3, 120, 1500)
    label, stats = found(spark, edges)
    assert sum(map(len, stats)) <= 8, stats
    assert modularity(edges, label) >= modularity(edges, greedy(edges)) - 0.02


def test_sets_of_communities(spark):
    """Tasks that hold a part of the links end where no node gains either."""
    edges = without_structure(4, 30, 120) + [("hub", f"n{i:03d}", 0.3) for i in range(20)]
    out = {r["account_id"]: r["community"] for r in gr.communities(graph_of(spark, edges), room=120).collect()}
    now = modularity(edges, out)
    assert now >= modularity(edges, greedy(edges)) - 0.04
    links = gr.undirected(graph_of(spark, edges))
    two_m = links.agg({"weight": "sum"}).first()[0]
    label, moves = gr._local_moving(links, None, two_m, 1.0, 300, 120)
    at = {r["node"]: r["community"] for r in label.collect()}
    assert sum(moves) > 0
    for x in at:
        for c in set(at.values()):
            assert modularity(edges, {**at, x: c}) <= modularity(edges, at) + 1e-7
