"""Interaction graph queries."""

from pyspark.sql import functions as F

from driftlens.operators import graph as gr
from driftlens.operators import paths as pt
from driftlens.plans.catalog import query, r6, sql_ts, ts
from driftlens.plans.views import Views, with_views

ROUNDS = 12


def organic_graph(v: Views):
    return gr.build_graph(v.edges, v.flagged)


_ORGANIC = """SELECT src_account AS src, dst_account AS dst, sum(weight) AS weight, min_by(kind, (ts, kind)) AS kind, min(ts) AS ts FROM v_edges e WHERE NOT starts_with(dst_account, 'post:')
    AND NOT EXISTS (SELECT 1 FROM v_flagged f WHERE f.platform = e.src_platform AND f.account_id = e.src_account)
    AND NOT EXISTS (SELECT 1 FROM v_flagged f WHERE f.platform = e.dst_platform AND f.account_id = e.dst_account) GROUP BY 1, 2"""


@query("n01_build_graph", with_views(["v_graph"], f"SELECT src, dst, round(weight, 6) AS weight, kind, {sql_ts('ts')} AS ts FROM v_graph"))
def _(v: Views):
    return gr.build_graph(v.edges).select("src", "dst", r6("weight").alias("weight"), "kind", ts("ts").alias("ts"))


@query("n01_build_graph_organic", with_views(["v_edges", "v_flagged"], f"SELECT src, dst, round(weight, 6) AS weight, kind, {sql_ts('ts')} AS ts FROM ({_ORGANIC})"))
def _(v: Views):
    return organic_graph(v).select("src", "dst", r6("weight").alias("weight"), "kind", ts("ts").alias("ts"))


def _pagerank_views(rounds: int) -> dict[str, str]:
    out = {
        "node": "SELECT src AS id FROM v_graph UNION SELECT dst FROM v_graph",
        "deg": "SELECT src AS id, sum(weight) AS total FROM v_graph GROUP BY 1",
        "share": "SELECT src, dst, weight / total AS s FROM v_graph JOIN deg ON id = src",
        "r0": "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM node) AS r FROM node",
    }
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        out[f"r{i}"] = f"""SELECT n.id, 0.15::DOUBLE / m.n + 0.85::DOUBLE * m.lost / m.n + 0.85::DOUBLE * coalesce(i.s, 0) AS r FROM node n,
          (SELECT (SELECT count(*) FROM node) AS n, (SELECT coalesce(sum(r), 0) FROM {p} WHERE id NOT IN (SELECT id FROM deg)) AS lost) m
          LEFT JOIN (SELECT dst, sum(s * r) AS s FROM share JOIN {p} ON id = src GROUP BY 1) i ON i.dst = n.id"""
    return out


def _materialized(sql: str) -> str:
    """Chained iterations must not be inlined into each other."""
    for i in range(ROUNDS + 1):
        sql = sql.replace(f"\nr{i} AS (", f"\nr{i} AS MATERIALIZED (")
    return sql


@query("n02_pagerank", _materialized(with_views(["v_graph"], f"SELECT id AS account_id, round(r, 7) AS pagerank FROM r{ROUNDS}", _pagerank_views(ROUNDS))))
def _(v: Views):
    return gr.pagerank(v.graph, rounds=ROUNDS, tolerance=0.0).select("account_id", F.round("pagerank", 7).alias("pagerank"))


@query("n02_pagerank_converged")
def _(v: Views):
    """To the operator's tolerance; ``n02_pagerank`` is the check of its rounds."""
    return gr.pagerank(v.graph).select("account_id", F.round("pagerank", 7).alias("pagerank"))


@query("n03_sampled_betweenness")
def _(v: Views):
    return gr.sampled_betweenness(v.graph).select("account_id", r6("betweenness").alias("betweenness"))


@query("n03_weighted_betweenness")
def _(v: Views):
    """Over paths whose length is the sum of weights, as influencers are ranked."""
    return pt.weighted_betweenness(v.graph).select("account_id", r6("betweenness").alias("betweenness"))


@query("n04_two_hop_reach", with_views(["v_graph"], """
    SELECT id AS account_id, coalesce(n, 0) AS reach FROM (SELECT src AS id FROM v_graph UNION SELECT dst FROM v_graph) LEFT JOIN (SELECT target AS id, count(DISTINCT who) AS n FROM
      (SELECT src AS who, dst AS target FROM v_graph UNION SELECT a.src, b.dst FROM v_graph a JOIN v_graph b ON b.src = a.dst) WHERE who <> target GROUP BY 1) USING (id)"""))
def _(v: Views):
    return gr.two_hop_reach(v.graph, hub_degree=90)


@query("n05_influence", with_views(["v_graph"], """
    SELECT account_id, round(0.5 * reach / max(reach) OVER () + 0.3 * p / max(p) OVER () + 0.2 * b / max(b) OVER (), 6) AS influence, CASE WHEN reach > out_n THEN 'originator' ELSE 'amplifier' END AS role
    FROM (SELECT id AS account_id, count(*) FILTER (side = 'in') AS reach, sum(w) AS p, count(*) AS b, count(*) FILTER (side = 'out') AS out_n
      FROM (SELECT dst AS id, 'in' AS side, weight AS w FROM v_graph UNION ALL SELECT src, 'out', weight FROM v_graph) GROUP BY 1)"""))
def _(v: Views):
    """Composition check on degree-based stand-ins for the three parts."""
    ends = v.graph.select(F.col("dst").alias("account_id"), F.lit(1).alias("i"), "weight").unionByName(v.graph.select(F.col("src").alias("account_id"), F.lit(0).alias("i"), "weight"))
    d = ends.groupBy("account_id").agg(F.sum("i").alias("reach"), F.sum("weight").alias("pagerank"), F.count("*").alias("betweenness"))
    out = gr.influence(v.graph, d.select("account_id", "reach"), d.select("account_id", "pagerank"), d.select("account_id", "betweenness"))
    return out.select("account_id", r6("influence").alias("influence"), "role")


@query("n05_influencers")
def _(v: Views):
    """The first twenty accounts by reach, PageRank and weighted betweenness."""
    g = v.graph
    d = gr.influence(g, gr.two_hop_reach(g), gr.pagerank(g), pt.weighted_betweenness(g))
    return gr.top_influencers(d).select("account_id", r6("influence").alias("influence"), "reach", "role")


@query("n06_communities")
def _(v: Views):
    return gr.communities(v.graph)


@query("n07_bridge_accounts")
def _(v: Views):
    return gr.bridge_accounts(v.graph, gr.communities(v.graph), gr.sampled_betweenness(v.graph, pivots=300, directed=False))


@query("n08_graph_payload")
def _(v: Views):
    nodes, _e = gr.graph_payload(v.graph, v.coord_accounts, v.behaviour, v.posts_core, v.accounts, 250)
    return nodes


@query("n09_influence_views")
def _(v: Views):
    out = gr.influence_views(v.edges, v.flagged, v.coord_accounts, v.accounts)
    return out["influencers"].select("view", "rank", "account_id", r6("influence").alias("influence"), "role", "rank_other_view", "handle")


def _ranked_sql(source: str) -> str:
    return f"""SELECT account_id, r FROM (SELECT account_id, row_number() OVER (ORDER BY influence DESC, account_id) AS r
      FROM (SELECT dst AS account_id, count(*) AS influence FROM {source} GROUP BY 1)) WHERE r <= 500"""


@query("w06_rank_in_other_view", with_views(["v_graph", "v_edges", "v_flagged"], "SELECT account_id, coalesce(a.r, -1) AS rank_raw, coalesce(b.r, -1) AS rank_organic FROM a FULL JOIN b USING (account_id)",
    {"og": _ORGANIC, "a": _ranked_sql("v_graph"), "b": _ranked_sql("og")}))
def _(v: Views):
    """Ranks by number of interactors."""
    def score(g):
        return g.groupBy(F.col("dst").alias("account_id")).agg(F.count("*").alias("influence"))

    d = gr.rank_in_other_view(score(v.graph), score(organic_graph(v)))
    return d.select("account_id", F.coalesce("rank_raw", F.lit(-1)).alias("rank_raw"), F.coalesce("rank_organic", F.lit(-1)).alias("rank_organic"))


@query("n10_audience_segments")
def _(v: Views):
    _segments, labels = gr.audience_segments(v.graph, v.flagged, v.posts_core, v.assign, v.topics)
    return labels


def segments_by_account(v: Views):
    n = F.col("account_id").cast("bigint") % 6
    return v.accounts.select("account_id", (n - 1).cast("int").alias("segment"))


@query("n11_segment_spread", with_views(["v_core", "v_assign", "v_emo"], f"""
    SELECT key, {sql_ts('min(first)')} AS first_seen, CAST(sum(n) AS BIGINT) AS posts, round(sum(a * n) / sum(n), 3) AS anxiety FROM (
      SELECT date_trunc('hour', created_at) AS h, CASE WHEN user_id % 6 - 1 IN (0, 1, 2) THEN 's' || (user_id % 6 - 1) ELSE 'other' END AS key, user_id % 6 AS seg, count(*) AS n, avg(anxiety) AS a, min(created_at) AS first
      FROM v_core JOIN v_assign USING (platform, post_id) JOIN v_emo USING (platform, post_id) WHERE topic_id = 2 GROUP BY 1, 2, 3) GROUP BY 1"""))
def _(v: Views):
    _frames, summary = gr.segment_spread(v.posts_core, v.assign, segments_by_account(v), v.emotions, 2, [0, 1, 2])
    return summary.withColumn("first_seen", ts("first_seen"))


@query("n11_segment_frames", with_views(["v_core", "v_assign"], f"""
    SELECT {sql_ts("date_trunc('hour', created_at)")} AS bucket, count(*) FILTER (user_id % 6 = 1) AS s0, count(*) FILTER (user_id % 6 = 2) AS s1, count(*) FILTER (user_id % 6 = 3) AS s2,
      count(*) FILTER (user_id % 6 NOT IN (1, 2, 3)) AS other FROM v_core JOIN v_assign USING (platform, post_id) WHERE topic_id = 2 GROUP BY 1"""))
def _(v: Views):
    frames, _summary = gr.segment_spread(v.posts_core, v.assign, segments_by_account(v), v.emotions, 2, [0, 1, 2])
    return frames.withColumn("bucket", ts("bucket"))


@query("n12_account_detail", with_views(["v_core", "v_edges", "v_assign"], """
    SELECT 'platform' AS part, platform AS key, count(*) AS n FROM v_core WHERE author_id = '7' GROUP BY 2
    UNION ALL SELECT 'degree', 'in', count(DISTINCT src_account) FROM v_edges WHERE dst_account = '7'
    UNION ALL SELECT 'degree', 'out', count(DISTINCT dst_account) FROM v_edges WHERE src_account = '7' AND NOT starts_with(dst_account, 'post:')
    UNION ALL (SELECT 'topic', CAST(topic_id AS VARCHAR), count(*) FROM v_core JOIN v_assign USING (platform, post_id) WHERE author_id = '7' GROUP BY topic_id ORDER BY count(*) DESC, topic_id LIMIT 4)
    UNION ALL (SELECT 'tie', src_account || '/' || kind, count(*) FROM v_edges WHERE dst_account = '7' GROUP BY src_account, src_platform, kind ORDER BY count(*) DESC, src_account, src_platform, kind LIMIT 12)"""))
def _(v: Views):
    d = gr.account_detail("7", v.posts_core, v.accounts, v.edges, v.assign, v.topics, v.coord_accounts)
    degree = d["degree"].selectExpr("stack(2, 'in', engaged_by, 'out', engages_with) as (key, n)")
    parts = [
        d["platforms"].select(F.lit("platform").alias("part"), F.col("platform").alias("key"), "n"),
        degree.select(F.lit("degree").alias("part"), "key", "n"),
        d["topics"].select(F.lit("topic").alias("part"), F.col("topic_id").cast("string").alias("key"), "n"),
        d["in_ties"].select(F.lit("tie").alias("part"), F.concat_ws("/", "account_id", "kind").alias("key"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("n13_thread", with_views(["v_core"], f"""
    SELECT c.platform, c.post_id, w.depth FROM (SELECT post_id, min(depth) AS depth FROM walk GROUP BY 1) w JOIN v_core c USING (post_id)""",
    {"up": """SELECT post_id AS child, parent_post_id AS up FROM v_core WHERE parent_post_id IS NOT NULL UNION SELECT post_id, origin_post_id FROM v_core WHERE origin_post_id IS NOT NULL""",
     "walk(post_id, depth)": "SELECT post_id, 0 FROM v_core WHERE post_id = '0' UNION SELECT child, depth + 1 FROM walk JOIN up ON up.up = walk.post_id"}, recursive=True))
def _(v: Views):
    first = v.posts_core.where("post_id = '0'").select("platform").first()["platform"]
    return gr.thread(v.posts_core, first, "0").select("platform", "post_id", "depth")
