"""Gaps, near duplicates, coordination and behaviour against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from driftlens.operators import behaviour as bh
from driftlens.operators import coordination as co
from driftlens.operators import gaps as gp
from driftlens.operators import links
from driftlens.session import cut_lineage


def frame(spark, rows):
    """(author, text, seconds)"""
    d = spark.createDataFrame([(f"p{i:05d}", a, t, float(s)) for i, (a, t, s) in enumerate(rows)], "post_id STRING, author_id STRING, text STRING, s DOUBLE")
    return d.select(F.lit("x").alias("platform"), "post_id", "author_id", "text", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("created_at"),
                    F.lit(None).cast("string").alias("origin_post_id"))


def stats(spark, times):
    d = frame(spark, [("a", "t", t) for t in times])
    return gp.gap_statistics(gp.inter_post_gaps(d, ["author_id"]), ["author_id"]).first()


def test_gap_statistics(spark):
    assert stats(spark, range(0, 6060, 60))["burstiness"] == -1.0
    assert stats(spark, range(0, 6060, 60))["gap_entropy"] < 0.5
    rng = np.random.default_rng(3)
    assert abs(stats(spark, np.cumsum(rng.exponential(100, 20000)))["burstiness"]) < 0.05


def test_scripted_and_organic_accounts(spark):
    scripted = [(f"s{i}", "same words here", k * 90 + i * 2) for i in range(10) for k in range(5)]
    organic = [(f"o{i}", f"reply number {i}", 10_000 + i * 400) for i in range(10)]
    posts = co.with_text_group(frame(spark, scripted + organic), links.text_groups(frame(spark, scripted + organic)))
    clusters = posts.select("platform", "post_id", F.lit("c").alias("cluster"))
    dup = co.cross_account_duplicates(posts.join(clusters, ["platform", "post_id"]))
    got = {r["account_id"]: r["score"] for r in co.score_accounts(co.account_features(posts, clusters, dup)).collect()}
    assert min(v for k, v in got.items() if k[0] == "s") >= 0.7
    assert max(v for k, v in got.items() if k[0] == "o") < 0.7


def test_self_repeats_are_not_duplicates(spark):
    d = frame(spark, [("a", "t", i) for i in range(4)] + [("b", "u", 9)]).withColumn("cluster", F.lit("c")).withColumn("text_group", F.col("text"))
    assert co.cross_account_duplicates(d).first()["dup_ratio"] == 0.0


def test_sync_partner_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{rng.integers(6)}", f"t{rng.integers(3)}", float(rng.integers(0, 40_000)) / 10) for _ in range(400)]
    d = frame(spark, rows)
    got = {r["post_id"]: r["has_partner"] for r in co.has_sync_partner(d, ["text"], 60).collect()}
    for i, (a, t, s) in enumerate(rows):
        assert got[f"p{i:05d}"] == any(t == u and a != b and abs(s - r) <= 60 for b, u, r in rows)


def test_duplicate_bursts_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"a{rng.integers(30)}", f"t{rng.integers(4)}", float(rng.integers(0, 9000))) for _ in range(500)]
    want = set()
    for _, text, end in rows:
        inside = {a for a, t, s in rows if t == text and end - 60 <= s <= end}
        want |= inside if len(inside) >= 3 else set()
    got = {r["account_id"] for r in bh.exact_duplicate_bursts(frame(spark, rows), 60, 3).collect()}
    assert got == want and got


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 200, (150, 2)) if a != b]
    edges += [(f"chain{i:02d}", f"chain{i + 1:02d}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in links.connected_components(spark.createDataFrame(edges, "src STRING, dst STRING")).collect()}
    assert got == {n: find(n) for n in list(parent)}


def test_near_groups(spark, monkeypatch):
    base = ["the dam has cracked evacuate the town at once", "petrol price rises again across the city today", "what a match from the team last night indeed"]
    rows = [(f"{b}-{i:02d}", t + (" please" if i % 2 else "") + ("!" * (i % 3))) for b, t in enumerate(base) for i in range(20)]
    vecs = cut_lineage(links.hash_embed(spark.createDataFrame(rows, "key STRING, text STRING"), "key"))
    for block in (1000, 7):
        monkeypatch.setattr(links, "BLOCK", block)
        groups = links.near_groups(vecs, 0.85).collect()
        by = {}
        for r in groups:
            by.setdefault(r["group"], set()).add(r["key"][0])
        assert all(len(v) == 1 for v in by.values()) and len(by) == 3
    pairs = links.similar_pairs(vecs, 0.999999)
    assert pairs.where("a >= b").count() == 0 and pairs.count() > 0


def test_every_planted_pair_is_grouped(spark, monkeypatch):
    """2,500 pairs with a cosine of 0.9 or more, all found, whatever the blocks."""
    monkeypatch.setattr(links, "BLOCK", 900)
    rng = np.random.default_rng(3)
    one = rng.standard_normal((2500, 48))
    two = one + 0.2 * rng.standard_normal(one.shape)
    rows = [(f"{i:05d}{side}", v.tolist()) for side, m in (("a", one), ("b", two)) for i, v in enumerate(m)]
    groups = links.near_groups(spark.createDataFrame(rows, "key STRING, vector ARRAY<FLOAT>"), 0.9).collect()
    by = {}
    for r in groups:
        by.setdefault(r["group"], set()).add(r["key"][:5])
    cosines = (one * two).sum(1) / np.linalg.norm(one, axis=1) / np.linalg.norm(two, axis=1)
    assert len(groups) == 5000 and (cosines >= 0.9).all() and len(by) == 2500 and all(len(v) == 1 for v in by.values())


def test_exact_median(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 501), "v": rng.exponential(50, 501)})
    got = {r["g"]: r["median"] for r in gp.exact_median(spark.createDataFrame(pdf), ["g"], "v").collect()}
    for g, v in pdf.groupby("g")["v"].median().items():
        assert abs(got[g] - v) < 1e-9


def test_planted_campaign(spark):
    rng = np.random.default_rng(4)
    campaign = [(f"bot{i}", "URGENT dam cracked share now #dam", 5000 + k * 90 + i * 2) for i in range(12) for k in range(4)]
    noise = [(f"u{i % 60}", f"ordinary message number {i} about things", float(s)) for i, s in enumerate(rng.integers(0, 86_400, 240))]
    posts = frame(spark, campaign + noise)
    assign = posts.select("platform", "post_id", F.lit(1).cast("bigint").alias("topic_id"))
    clusters, accounts = co.run_coordination(posts, assign, min_sim=None)
    assert clusters.count() == 1
    flagged = {r["account_id"] for r in accounts.where("score >= 0.7").collect()}
    assert flagged == {f"bot{i}" for i in range(12)}
