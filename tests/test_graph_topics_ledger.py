"""Graph, topics, bursts, forecasts, ledger, images, privacy."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.operators import bursts as bu
from driftlens.operators import demographics as dm
from driftlens.operators import evaluate as ev
from driftlens.operators import forecast as fc
from driftlens.operators import graph as gr
from driftlens.operators import ledger as lg
from driftlens.operators import lineage as ln
from driftlens.operators import situation
from driftlens.operators import topics as tp


def graph_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0, "reply", 0) for a, b in pairs], "src STRING, dst STRING, weight DOUBLE, kind STRING, t BIGINT").withColumn("ts", F.timestamp_seconds("t"))


def test_reach(spark):
    star = graph_of(spark, [(f"f{i}", "hub") for i in range(10)] + [("c", "b"), ("b", "a")])
    for hub in (10_000, 2):
        got = {r["account_id"]: r["reach"] for r in gr.two_hop_reach(star, hub_degree=hub).collect()}
        assert got["hub"] == 10 and got["a"] == 2 and got["c"] == 0


def test_hub_maps_equal_pairs(spark):
    rng = np.random.default_rng(0)
    g = graph_of(spark, {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (500, 2)) if a != b})
    assert sorted(gr.two_hop_reach(g, 10_000).collect()) == sorted(gr.two_hop_reach(g, 3).collect())


def test_bridge_of_two_cliques(spark):
    pairs = [(f"{s}{i}", f"{s}{j}") for s in "ab" for i in range(5) for j in range(5) if i < j] + [("a0", "bridge"), ("bridge", "b0")]
    g = graph_of(spark, pairs)
    c = gr.communities(g)
    label = {r["account_id"]: r["community"] for r in c.collect()}
    assert len({label[f"a{i}"] for i in range(5)}) == 1 and label["a1"] != label["b1"]
    top = gr.bridge_accounts(g, c, gr.sampled_betweenness(g, 300, directed=False)).collect()
    assert top[0]["account_id"] in ("bridge", "a0", "b0")
    exact = {r["account_id"]: r["betweenness"] for r in gr.sampled_betweenness(g, 300, directed=False).collect()}
    assert max(exact, key=exact.get) == "bridge"


def test_communities_end_at_their_criterion(spark):
    """No move of a node and no merge of two communities gains modularity."""
    n = 80
    label = {int(r["account_id"][1:]): r["community"] for r in gr.communities(graph_of(spark, [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(n - 1)])).collect()}
    m, links = n - 1, [(i, i + 1) for i in range(n - 1)]
    assert len(label) == n

    def modularity(of):
        degree = {}
        for a, b in links:
            for x in (a, b):
                degree[of[x]] = degree.get(of[x], 0) + 1
        return sum(of[a] == of[b] for a, b in links) / m - sum((d / (2 * m)) ** 2 for d in degree.values())

    reached = modularity(label)
    for a, b in links:
        if label[a] != label[b]:
            assert modularity({k: label[b] if c == label[a] else c for k, c in label.items()}) <= reached + 1e-6


def test_pagerank_sums_to_one(spark):
    g = graph_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    r = {x["account_id"]: x["pagerank"] for x in gr.pagerank(g).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["a"] > r["b"] > r["d"]


def bursts_of(spark, times, **options):
    d = spark.createDataFrame([(1, int(round(t * 1e6))) for t in times], "topic_id BIGINT, t BIGINT")
    rows = bu.kleinberg_bursts(d, **options).collect()
    return sorted((r["start"].timestamp(), r["end"].timestamp(), r["level"], round(r["weight"], 6)) for r in rows)


def test_bursts_are_the_cheapest_states(spark):
    """Every sequence of states of a short series is tried."""
    times = [0.0, 300.0, 310.0, 321.0, 600.0, 900.0]
    gaps, gamma = np.diff(times), 0.5
    mean = (times[-1] - times[0]) / len(times)
    k = max(2, math.ceil(math.log2((times[-1] - times[0]) / gaps.min())) + 1)
    rates = 2.0 ** np.arange(k) / mean
    cost = rates[None, :] * gaps[:, None] - np.log(rates)[None, :]
    climb = gamma * math.log(len(times))

    def price(states):
        steps = np.diff(np.array([0, *states]))
        return cost[np.arange(len(gaps)), list(states)].sum() + climb * steps[steps > 0].sum()

    best = min(itertools.product(range(k), repeat=len(gaps)), key=price)
    busy = [i for i, state in enumerate(best) if state]
    assert busy and busy == list(range(busy[0], busy[-1] + 1))
    (start, end, level, _), = bursts_of(spark, times, gamma=gamma, chunk=2)
    assert (start, end, level) == (times[busy[0]], times[busy[-1] + 1], max(best))


def test_bursts_in_chunks_equal_one_pass(spark):
    rng = np.random.default_rng(6)
    times = sorted(set(np.round(np.cumsum(rng.exponential(200, 300)), 3)) | set(np.round(20_000 + np.arange(60) * 3.0, 3)))
    got = bursts_of(spark, times, gamma=0.5, chunk=37, slot_seconds=3600)
    want = bursts_of(spark, times, gamma=0.5, chunk=10_000, slot_seconds=10**7)
    assert got == want and any(lv >= 1 for _, _, lv, _ in got)


def test_too_few_times(spark):
    d = spark.createDataFrame([(1, 0), (1, 5)], "topic_id BIGINT, t BIGINT")
    assert bu.kleinberg_bursts(d).count() == 0


def test_hawkes_recovers_parameters():
    rng = np.random.default_rng(11)
    mu, alpha, beta, span, t, events = 2.0, 1.2, 2.0, 300.0, 0.0, []
    while t < span:
        bound = mu + alpha * sum(math.exp(-beta * (t - e)) for e in events[-200:])
        t += rng.exponential(1 / bound)
        now = mu + alpha * sum(math.exp(-beta * (t - e)) for e in events[-200:])
        if t < span and rng.random() < now / bound:
            events.append(t)
    m, a, b = fc.fit_hawkes(np.array(events), np.ones(len(events), dtype=int), span)
    assert 0.35 < a / b < 0.85 and 1.0 < m < 3.2


def test_seasonal_forecast(spark):
    rows = [(1, 1_700_000_000 // 3600 * 3600 + h * 3600, int(10 + 8 * math.sin(2 * math.pi * h / 24))) for h in range(72)]
    s = spark.createDataFrame(rows, "topic_id BIGINT, t BIGINT, count_all BIGINT").withColumn("bucket_start", F.timestamp_seconds("t"))
    first = fc.gbr_forecast(s, horizon=1, trees=30, rate=0.2).first()
    assert abs(first["predicted"] - 10) < 3 and first["lower"] <= first["predicted"] <= first["upper"]


def test_topics_are_recovered(spark):
    a, b = "the dam near the river has cracked badly", "petrol prices are going up again in town"
    rows = [(f"p{d}{i:02d}", (a if i % 2 else b) + f" {'now' if i % 3 else 'today'}", d * 86_400 + i * 60) for d in range(2) for i in range(40)]
    posts = spark.createDataFrame(rows, "post_id STRING, text STRING, s BIGINT").select(F.lit("x").alias("platform"), "post_id", "text", F.timestamp_seconds("s").alias("created_at"))
    topics, assign = tp.run_topics(posts)
    assert topics.count() == 2 and assign.count() == 80
    assert {r["label"] for r in topics.collect()} == {"The dam near the river has cracked", "Petrol prices are going up again in"}


def records(spark, n):
    return spark.createDataFrame([(i + 1, "x", "live", f"2024-01-01T00:00:{i % 60:02d}", f'{{"n":{i}}}') for i in range(n)],
                                 "seq BIGINT, platform STRING, collector_id STRING, collected_at STRING, payload STRING")


def test_chain_and_proofs(spark):
    sealed = lg.seal_records(records(spark, 7)).cache()
    prev = "0" * 64
    for r in sealed.orderBy("seq").collect():
        rec = hashlib.sha256(r["payload_canonical"].encode()).hexdigest()
        entry = hashlib.sha256(f"{prev}{rec}{r['collected_at']}{r['collector_id']}{r['seq']}".encode()).hexdigest()
        assert (r["record_hash"], r["entry_hash"], r["prev_entry_hash"]) == (rec, entry, prev)
        prev = entry
    assert lg.verify_chain(sealed).first()["status"] == "PASS"
    cps = lg.merkle_roots(sealed, size=4).cache()
    assert [(r["first_seq"], r["last_seq"]) for r in cps.orderBy("id").collect()] == [(1, 4), (5, 7)]
    proofs = lg.inclusion_proofs(sealed, cps, sealed.select("seq"), size=4)
    ok = proofs.select(lg.verify_inclusion(F.col("entry_hash"), F.col("path"), F.col("merkle_root")).alias("v")).collect()
    assert len(ok) == 7 and all(r["v"] for r in ok)
    assert all(r["ok"] for r in lg.verify_checkpoints(sealed, cps, size=4).collect())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 5), st.integers(0, 6))
def test_any_change_is_located(spark, seq, position):
    sealed = lg.seal_records(records(spark, 5))
    p = F.col("payload_canonical")
    altered = F.concat(F.substring(p, 1, position), F.lit("~"), F.substring(p, position + 2, 100))
    bad = sealed.withColumn("payload_canonical", F.when(F.col("seq") == seq, altered).otherwise(p))
    r = lg.verify_chain(bad).first()
    assert (r["status"], r["first_bad_seq"]) == ("FAIL", seq)


def test_image_families(spark):
    pairs = spark.createDataFrame([("1", "2", 4), ("1", "3", 6), ("2", "3", 2), ("7", "8", 0)], "media_id_a STRING, media_id_b STRING, hamming INT")
    d = ln.image_families(pairs).collect()
    assert len({r["family"] for r in d}) == 2
    assert {r["media_id"]: r["hamming"] for r in d if r["original"] == "1" and not r["is_original"]} == {"2": 4, "3": 6}


def test_hash_search_is_exact(spark):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 2 ** 63, 60)]
    values = base + [b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 14), replace=False)) for b in base]
    hashes = sorted({f"{v:016x}" for v in values})
    want = {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1:] if bin(int(a, 16) ^ int(b, 16)).count("1") <= 10}
    d = spark.createDataFrame([(h,) for h in hashes], "phash STRING")
    assert {(r["a"], r["b"]) for r in ln.similar_hashes(d, 10).collect()} == want and want
    for bands in (3, 4, 11):
        assert {(r["a"], r["b"]) for r in ln.similar_hashes(d, 10, bands=bands).collect()} == want


def test_wide_distances_are_compared_in_blocks(spark, monkeypatch):
    """At 14 bits of 64 a hash has thousands of band neighbours; blocks need none of them."""
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2 ** 64, 150, dtype=np.uint64)]
    values = {*base, *(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 18), replace=False)) for b in base)}
    hashes = sorted({f"{v:016x}" for v in values} | {f"{base[0]:016X}", "0", "00"})
    want = {(a, b, d) for i, a in enumerate(hashes) for b in hashes[i + 1:] if (d := bin(int(a, 16) ^ int(b, 16)).count("1")) <= 14}
    frame = spark.createDataFrame([(h,) for h in hashes] + [(None,)], "phash STRING")
    banded = ln.similar_hashes(frame, 14, bands=4)
    assert "Broadcast" not in banded._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in banded.collect()} == want
    monkeypatch.setattr(ln, "_near_by_bands", None)
    monkeypatch.setattr(ln, "HASH_BLOCK", 64)
    assert sorted(tuple(r) for r in ln.similar_hashes(frame, 14).collect()) == sorted(want)


def test_bands_follow_the_number_of_hashes():
    """A thousand times the hashes, far less than a thousand times the work per hash."""
    plans = [ln.band_plan(10, n) for n in (10**3, 10**6, 10**9)]
    assert [p[0] for p in plans] == sorted((p[0] for p in plans), reverse=True) and plans[0][0] > plans[-1][0]
    assert plans[1][2] < 100 * plans[0][2] and plans[1][2] < 0.02 * 10**6 and plans[2][2] < 0.005 * 10**9


def test_release_and_privacy(spark):
    counts = spark.createDataFrame([("d", "a", 3), ("d", "b", 9), ("d", "c", 50), ("d", "e", 10)], "dimension STRING, bucket STRING, n BIGINT")
    released, withheld = dm.release_counts(counts, k=10, epsilon=1.0, seed=3)
    got = {r["bucket"]: r["count"] for r in released.collect()}
    assert set(got) == {"c", "e"} and min(got.values()) >= 10
    assert withheld.first()["suppressed_buckets"] == 2


def test_precision_and_sweep(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id INT")
    r = ev.precision_recall_f1(ids(1, 2, 3), ids(2, 3, 4)).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (2, 1, 1, 0.6667)
    pdf = pd.DataFrame({"label": "a", "score": [0.2, 0.4, 0.6, 0.8], "truth": [False, False, True, True]})
    assert ev.threshold_sweep(spark.createDataFrame(pdf)).first()["threshold"] == 0.5


def test_segments_notice_what_is_missing(spark):
    rows = [(i, "x", "c", "t", f"p{i}", (i - 1) // 4) for i in range(1, 13)]
    d = spark.createDataFrame(rows, "seq BIGINT, platform STRING, collector_id STRING, collected_at STRING, payload STRING, segment INT")
    sealed = lg.seal_records(d, chain="segment").cache()
    heads = lg.segment_heads(sealed).cache()

    def verdict(where, heads=heads):
        r = lg.verify_segments(sealed.where(where), heads).first()
        return r["status"], r["first_bad_seq"]

    assert verdict("true") == ("PASS", None)
    assert verdict("seq != 6") == ("FAIL", 6)
    assert verdict("seq != 8") == ("FAIL", 8)
    assert verdict("seq != 5") == ("FAIL", 5)
    assert verdict("segment != 1") == ("FAIL", 5)
    assert verdict("segment != 2") == ("FAIL", 9)
    assert verdict("segment != 1", heads.where("segment != 1")) == ("FAIL", 5)


def test_lineage_shuffles_and_writes_no_texts(spark):
    """Texts are read for the stance, and again only for the first posts that are shown."""
    rows = [("x", "1", "a", "they say so " + "long " * 100, "2024-01-01", None, "post"), ("x", "2", "b", "t2", "2024-01-02", "1", "repost"),
            ("reddit", "3", "c", "t3", "2024-01-03", "1", "repost"), ("reddit", "9", "d", "is it so?", "2024-01-04", None, "comment")]
    posts = spark.createDataFrame(rows, "platform STRING, post_id STRING, author_id STRING, text STRING, created_at STRING, origin_post_id STRING, kind STRING")
    assign = spark.createDataFrame([("x", "1", 5), ("x", "2", 5), ("reddit", "3", 5), ("reddit", "9", 5)], "platform STRING, post_id STRING, topic_id BIGINT")
    out = ln.topic_lineage(posts, assign)
    d = ln.classified(ln.lineage_posts(ln.with_stance(posts), assign))
    assert "text" not in d.columns and d.where("traced").count() == 3
    assert {(r["platform"], r["first_post_id"], r["n_posts"], r["text"]) for r in out["platforms"].collect()} == {
        ("x", "1", 2, rows[0][3][:280]), ("reddit", "3", 1, "t3")}
    assert [(r["src"], r["dst"]) for r in out["chains"].collect()] == [("1", "2"), ("1", "3")]
    assert out["summary"].first()["questioning"] == 1


def test_hot_topics_are_ranked_as_shown(spark):
    """Spikes that are shown as equal are ordered by topic, also where the list is cut."""
    columns = "topic_id BIGINT, label STRING, nature STRING, sector STRING, posts BIGINT, burst_level INT, coord_posts BIGINT, anx DOUBLE, anx_n BIGINT, anxiety_organic DOUBLE"
    table = spark.createDataFrame([(t, "l", "organic", "other", n, 0, 0, 1.0, 2, 0.5) for t, n in ((1, 1000), (2, 1001), (3, 999))], columns)
    series = spark.createDataFrame([(1, 50), (2, 50), (3, 50)], "topic_id BIGINT, count_all BIGINT")
    facts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "topic_id BIGINT, platform STRING")
    assert {r["topic_id"] for r in situation.hot_topics(table, series, 100.0, facts, n=2).collect()} == {1, 2}


def test_sectors_search_each_text_once(spark):
    """With texts apart from posts, hits count as often as posts use the text."""
    searched = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        searched.add(1)
        return text

    posts = spark.createDataFrame([("x", str(i), i % 2) for i in range(60)], "platform STRING, post_id STRING, text_id INT")
    texts = spark.createDataFrame([(0, "alpha alpha"), (1, "beta beta beta")], "text_id INT, text STRING")
    assign = posts.select("platform", "post_id", (F.col("post_id").cast("int") < 30).cast("int").alias("topic_id"))
    topics = spark.createDataFrame([(0, "alpha", ["alpha"]), (1, "none", ["none"])], "topic_id INT, label STRING, keywords ARRAY<STRING>")
    words = {"a": ["alpha"], "b": ["beta"]}
    want = {tuple(r) for r in situation.topic_sectors(topics, posts.join(texts, "text_id"), assign, words).collect()}
    got = situation.topic_sectors(topics, posts, assign, words, texts=texts.withColumn("text", seen("text")))
    assert {tuple(r) for r in got.collect()} == want == {(0, "b"), (1, "b")} and searched.value <= 2 * texts.count()


def test_keywords_split_each_text_once(spark):
    """With texts apart from posts, the counts per word and hour are the same."""
    from driftlens.operators import trends

    posts = spark.createDataFrame([(i, i % 2, 1_700_000_000 + 1200 * i) for i in range(9)], "post_id INT, text_id INT, t BIGINT").withColumn("created_at", F.timestamp_seconds("t"))
    texts = spark.createDataFrame([(0, "Market market, #rain rains!"), (1, "Market closed")], "text_id INT, text STRING")
    got = sorted(map(tuple, trends.keyword_hours(posts, texts=texts).collect()))
    assert got == sorted(map(tuple, trends.keyword_hours(posts.join(texts, "text_id")).collect())) and len(got) > 6


def test_texts_scored_in_place_equal_unique_scores(spark):
    """Rows of texts get the scores that grouping equal texts gives, and nothing is shuffled."""
    from driftlens.operators import emotions

    words = ["Panic now!!", "panic NOW!!", "", None, "  ", "so happy and proud", "@someone https://a.b", "HATE this"]
    posts = spark.createDataFrame([("x", str(i), t) for i, t in enumerate(words)], "platform STRING, post_id STRING, text STRING")
    got = emotions.score_texts(posts)
    want = emotions.score_unique_then_join(posts)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_digest_looks_up_texts_of_kept_posts_only(spark):
    from driftlens.operators import alerts

    posts = spark.createDataFrame([("x", str(i), i % 3, "post", 1_700_000_000 + i) for i in range(30)],
                                  "platform STRING, post_id STRING, text_id INT, kind STRING, t BIGINT").withColumn("created_at", F.timestamp_seconds("t"))
    texts = spark.createDataFrame([(0, "one <b>bold</b>"), (1, "two"), (2, "two")], "text_id INT, text STRING")
    assign = posts.select("platform", "post_id", (F.col("post_id").cast("int") % 2).alias("topic_id"))
    keyed = posts.join(texts.select("text_id", F.md5("text").alias("text_hash")), "text_id")
    got = sorted(map(tuple, alerts.digest_input(keyed, assign, texts=texts).collect()))
    assert got == sorted(map(tuple, alerts.digest_input(posts.join(texts, "text_id"), assign).collect())) and len(got) == 4


def test_views_without_texts_read_no_texts(spark):
    """Behaviour, links and emotions of posts never shuffle a text: it is not in their plans."""
    from driftlens.plans.catalog_behaviour import grouped
    from driftlens.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    for d in (v.behaviour_plan(), grouped(v), v.emotions):
        assert "documents.parquet" not in str([f.rsplit("/", 2) for f in d.inputFiles()])


def test_stance_from_cues_found_once_per_text(spark):
    from driftlens.functions.rules import stance, stance_cues, stance_from_cues

    words = ["is it so?", "zap it", "really", "pass on", "nothing", "", None, "why?\n", "really pass on zap"]
    cues = (["zap"], ["really"], ["pass on"])
    kinds = ["post", "reply", "comment", "forward", "other", None]
    d = spark.createDataFrame([(t, k) for t in words for k in kinds], "text STRING, kind STRING")
    texts = spark.createDataFrame([(t,) for t in words], "own STRING").select("own", stance_cues(F.col("own"), *cues).alias("c"))
    met = d.join(texts, F.col("text").eqNullSafe(F.col("own"))).select("text", "kind", stance_from_cues(F.col("c"), F.col("kind")).alias("s"))
    got = {(t, k): s for t, k, s in met.collect()}
    assert got == {(t, k): s for t, k, s in d.select("text", "kind", stance(F.col("text"), F.col("kind"), *cues)).collect()}
    assert got["is it so?", "reply"] == "questioning" and got["is it so?", "post"] == "spreading" and got["is it so?", None] == "reacting"
    assert got["really pass on zap", "post"] == "debunking" and got["pass on", "other"] == "spreading" and got[None, "comment"] == "reacting"


def test_lineage_queries_write_stances_once(spark):
    """Two queries of a session share one table of stances and one lineage, both without texts."""
    from driftlens import session
    from driftlens.plans.catalog_evidence import _classified
    from driftlens.plans.views import Views

    first, second = (_classified(Views(spark, "/root/testdata/sf0.001")) for _ in range(2))
    assert first.inputFiles() == second.inputFiles() and "text" not in first.columns
    assert sum(k[2] == "stances_cued" and k[1].endswith("sf0.001") for k in session._STAGES) == 1


def test_hubs_pass_no_more_rows_than_interactors(spark):
    """Sparse hubs: a fixed-size map per block of ids would outgrow the ids it holds."""
    g = graph_of(spark, {(f"n{i:03d}", f"hub{h}") for h in range(3) for i in range(h * 7, 400, 40)} | {("hub0", "top"), ("hub1", "top")})
    assert sorted(gr.two_hop_reach(g, 10_000).collect()) == sorted(gr.two_hop_reach(g, 3).collect())
    plan = gr.two_hop_reach(g, 3)._jdf.queryExecution().toString()
    assert "bit_or" in plan and "bitmap" not in plan


def test_windows_matched_together(spark, monkeypatch):
    """Many small windows take a few jobs, with the topics of one window at a time."""
    from driftlens.operators import topics as tp

    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 6))
    rows = [(w, f"c{c}", [float(x) for x in base[c] + rng.normal(scale=0.4, size=6)], c + 1 + w % 3) for w in range(5) for c in range(4)]
    d = spark.createDataFrame(rows, "window bigint, cluster string, vector array<double>, n bigint").selectExpr("*", "timestamp_seconds(window) as first_seen", "timestamp_seconds(window) as last_seen")

    def mapped(group):
        spark.sparkContext.setJobGroup(group, group)
        m, t = tp.match_across_windows(d, 0.7)
        out = sorted(map(tuple, m.collect())), {r["topic_id"]: [round(x, 9) for x in r["centroid"]] for r in t.collect()}
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    together, jobs = mapped("together")
    monkeypatch.setattr(tp, "TOGETHER", 0)
    alone, more = mapped("alone")
    assert together == alone and len(together[1]) > 2 and jobs < more / 2
