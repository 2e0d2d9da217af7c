"""Aggregations: timelines, platforms, audiences, hashtags, situation."""

from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.rules import sector_level
from driftlens.operators import coordination as co
from driftlens.operators import demographics as dm
from driftlens.operators import situation as st
from driftlens.operators import timelines as tl
from driftlens.operators import topics as tp
from driftlens.operators import trends as tr
from driftlens.operators import alerts as al
from driftlens.operators import behaviour as bh
from driftlens.operators import ledger as lg
from driftlens.plans import views as vw
from driftlens.plans.catalog import joined, query, r6, sql_ts, ts
from driftlens.plans.catalog_scalars import AGE_SQL, INTEREST_SQL
from driftlens.plans.views import Views, with_views

AFFECT = fixed.AFFECT_DIMENSIONS
_MEANS = ", ".join(f"round(avg({a}), 6) AS {a}" for a in AFFECT)


def _rounded(d, *keys):
    return d.select(*keys, *[r6(a).alias(a) for a in AFFECT], "n")


@query("g01_topic_series", with_views(["v_series"], f"SELECT topic_id, {sql_ts('bucket_start')} AS bucket_start, count_all, count_organic FROM v_series"))
def _(v: Views):
    d = tl.topic_series(v.posts_core, v.assign, v.flagged)
    return d.withColumn("bucket_start", ts("bucket_start"))


@query("g02_emotion_timeline", with_views(["v_flagposts", "v_emo"], f"""
    SELECT {sql_ts("date_trunc('hour', created_at)")} AS bucket, {_MEANS}, count(*) AS n FROM v_flagposts JOIN v_emo USING (platform, post_id) WHERE NOT coordinated GROUP BY 1"""))
def _(v: Views):
    return _rounded(tl.emotion_timeline(v.posts_core, v.emotions, flagged=v.flagged), ts("bucket").alias("bucket"))


@query("g02_emotion_timeline_topic_comments", with_views(["v_core", "v_assign", "v_emo"], f"""
    SELECT {sql_ts("CAST(date_trunc('day', created_at) AS TIMESTAMP)")} AS bucket, {_MEANS}, count(*) AS n FROM v_core JOIN v_emo USING (platform, post_id)
    JOIN v_assign USING (platform, post_id) WHERE topic_id = 5 AND platform = 'x' AND kind IN ('reply', 'comment') GROUP BY 1"""))
def _(v: Views):
    d = tl.emotion_timeline(v.posts_core, v.emotions, bucket="1d", assign=v.assign, topic_id=5, platform="x", kind="comments")
    return _rounded(d, ts("bucket").alias("bucket"))


@query("g03_volume_timeline", with_views(["v_flagposts"], f"""
    SELECT {sql_ts("date_trunc('hour', created_at)")} AS bucket, platform, count(*) AS n, count(*) FILTER (coordinated) AS coordinated FROM v_flagposts GROUP BY 1, 2"""))
def _(v: Views):
    return tl.volume_timeline(v.posts_core, v.flagged).withColumn("bucket", ts("bucket"))


@query("g04_compare_raw_organic", with_views(["v_flagposts", "v_emo"], f"""
    SELECT 'raw' AS view, {_MEANS}, count(*) AS n FROM v_flagposts JOIN v_emo USING (platform, post_id)
    UNION ALL SELECT 'organic', {_MEANS}, count(*) FROM v_flagposts JOIN v_emo USING (platform, post_id) WHERE NOT coordinated"""))
def _(v: Views):
    return _rounded(tl.compare_raw_organic(v.posts_core, v.emotions, v.flagged), "view")


@query("g05_platform_summary", with_views(["v_flagposts"], f"""
    SELECT platform, count(*) AS posts, count(DISTINCT author_id) AS accounts, count(*) FILTER (kind IN ('reply', 'comment')) AS comments,
      count(*) FILTER (kind = 'repost') AS reposts, round(avg(CASE WHEN coordinated THEN 1.0 ELSE 0.0 END), 4) AS coordinated_share,
      {sql_ts('min(created_at)')} AS first_post, {sql_ts('max(created_at)')} AS last_post FROM v_flagposts GROUP BY 1"""))
def _(v: Views):
    return tl.platform_summary(v.posts_core, v.flagged).withColumns({"first_post": ts("first_post"), "last_post": ts("last_post")})


@query("g06_platform_topics", with_views(["v_core", "v_assign"], """
    SELECT platform, topic_id, n, rank FROM (SELECT platform, topic_id, count(*) AS n, row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, topic_id) AS rank
      FROM v_core JOIN v_assign USING (platform, post_id) GROUP BY 1, 2) WHERE rank <= 6"""))
def _(v: Views):
    return tl.platform_topics(v.posts_core, v.assign)


@query("g06_platform_accounts", with_views(["v_flagposts"], """
    SELECT platform, account_id, posts, coordinated, rank, (SELECT count(*) FROM v_flagposts c JOIN v_flagposts q ON q.platform = c.platform AND q.post_id = c.parent_post_id
        WHERE c.platform = t.platform AND q.author_id = t.account_id) AS replies_received
    FROM (SELECT platform, author_id AS account_id, count(*) AS posts, bool_or(coordinated) AS coordinated,
            row_number() OVER (PARTITION BY platform ORDER BY count(*) DESC, author_id) AS rank FROM v_flagposts GROUP BY 1, 2) t WHERE rank <= 8"""))
def _(v: Views):
    return tl.platform_accounts(v.posts_core, v.flagged)


@query("g06_platform_detail", with_views(["v_core", "v_emo"], f"""
    SELECT platform, 'affect' AS part, CAST(count(*) AS VARCHAR) AS key, round(avg(anxiety), 6) AS value FROM v_core JOIN v_emo USING (platform, post_id) GROUP BY 1
    UNION ALL SELECT platform, 'kind', kind, CAST(count(*) AS DOUBLE) FROM v_core GROUP BY 1, kind
    UNION ALL SELECT platform, 'recent', post_id, CAST(rank AS DOUBLE) FROM (SELECT platform, post_id, row_number() OVER (PARTITION BY platform ORDER BY created_at DESC, post_id) AS rank
      FROM v_core) WHERE rank <= 6"""))
def _(v: Views):
    affect = tl.platform_affect(v.posts_core, v.emotions).select("platform", F.lit("affect").alias("part"), F.col("n").cast("string").alias("key"), r6("anxiety").alias("value"))
    kinds = tl.platform_kinds(v.posts_core).select("platform", F.lit("kind").alias("part"), F.col("kind").alias("key"), F.col("n").cast("double").alias("value"))
    recent = tl.platform_recent(v.posts).select("platform", F.lit("recent").alias("part"), F.col("post_id").alias("key"), F.col("rank").cast("double").alias("value"))
    return affect.unionByName(kinds).unionByName(recent)


@query("g07_topic_nature", with_views(["v_nature"], "SELECT topic_id, coordinated_share, nature FROM v_nature"))
def _(v: Views):
    return tr.topic_nature(v.posts_core, v.assign, v.flagged, threshold=0.157)


BURST_STATS_SQL = """
    SELECT topic_id, start_ts, end_ts, level, weight, count(*) FILTER (inside) AS n_posts, count(DISTINCT author_id) FILTER (inside) AS n_accounts,
      coalesce(count(*) FILTER (inside AND coordinated) / nullif(count(*) FILTER (inside), 0), 0.0) AS coordinated_share,
      coalesce(avg(anxiety) FILTER (inside), 0.0) - coalesce(avg(anxiety) FILTER (NOT inside), coalesce(avg(anxiety) FILTER (inside), 0.0)) AS anxiety_shift,
      string_agg(DISTINCT platform, ',' ORDER BY platform) FILTER (inside) AS platforms
    FROM (SELECT *, created_at BETWEEN start_ts AND end_ts AS inside FROM v_flagposts JOIN v_assign USING (platform, post_id) JOIN v_emo USING (platform, post_id) JOIN {0} USING (topic_id))
    GROUP BY 1, 2, 3, 4, 5"""


@query("g08_burst_window_stats", with_views(["v_flagposts", "v_assign", "v_emo", "v_bursts"], f"""
    SELECT topic_id, {sql_ts('start_ts')} AS start_ts, n_posts, n_accounts, round(coordinated_share, 6) AS coordinated_share, round(anxiety_shift, 6) AS anxiety_shift, platforms
    FROM ({BURST_STATS_SQL.format('v_bursts')})"""))
def _(v: Views):
    d = al.burst_window_stats(v.day_bursts, v.posts_core, v.assign, v.emotions, v.flagged)
    return d.select("topic_id", ts("start").alias("start_ts"), "n_posts", "n_accounts", r6("coordinated_share").alias("coordinated_share"),
                    r6("anxiety_shift").alias("anxiety_shift"), joined("platforms").alias("platforms"))


@query("g15_dominant_language", with_views(["v_posts"], """
    SELECT platform, author_id, max_by(lang, (n, lang)) AS lang FROM (SELECT platform, author_id, lang, count(*) AS n FROM v_posts GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _(v: Views):
    return dm.dominant_language(v.posts)


@query("g16_home_platform", with_views(["v_core"], """
    SELECT account_id, min_by(platform, (-n, platform)) AS platform FROM (SELECT CAST(user_id // 2 AS VARCHAR) AS account_id, platform, count(*) AS n FROM v_core GROUP BY 1, 2) GROUP BY 1"""))
def _(v: Views):
    """Two users of different platforms share one account id here."""
    from driftlens.operators.graph import home_platform

    return home_platform(v.posts_core.withColumn("author_id", F.floor(F.col("user_id") / 2).cast("string")))


_DIMENSION_SQL = f"""SELECT dimension, bucket, count(*) AS n FROM (
      SELECT unnest(['geography', 'interests', 'age', 'language']) AS dimension, unnest([coalesce(region, 'unknown'), {INTEREST_SQL}, {AGE_SQL}, lang]) AS bucket
      FROM {{0}} a LEFT JOIN v_gaz ON alias = lower(location_text) LEFT JOIN (SELECT platform, author_id AS account_id, max_by(lang, (n, lang)) AS lang
        FROM (SELECT platform, author_id, lang, count(*) AS n FROM v_posts GROUP BY 1, 2, 3) GROUP BY 1, 2) l USING (platform, account_id))
    WHERE bucket IS NOT NULL GROUP BY 1, 2"""
_COHORT_VIEWS = ["v_accounts", "v_gaz", "v_posts", "v_flagged", "v_assign"]
_COHORT_ARGS = dict(as_of_year=vw.AS_OF_YEAR, interests=vw.INTERESTS, keep=vw.GAZETTEER_CHARS)


@query("g17_dimension_counts", with_views(_COHORT_VIEWS, f"SELECT * FROM ({_DIMENSION_SQL.replace('{0}', 'v_accounts')}) WHERE n >= {vw.K}"))
def _(v: Views):
    """Counts below k stay inside: shown through the release step."""
    counts = dm.dimension_counts(v.accounts, v.posts, v.gazetteer, **_COHORT_ARGS)
    return dm.release_counts(counts, k=vw.K, epsilon=0)[0].select("dimension", "bucket", F.col("count").alias("n"))


@query("g18_release_counts", with_views(["v_core"], """
    SELECT 'tag' AS dimension, bucket, CAST(n AS BIGINT) AS count FROM (SELECT tag AS bucket, count(*) AS n FROM v_core GROUP BY 1) WHERE n >= 100
    UNION ALL SELECT 'tag', 'suppressed', (SELECT count(*) FROM (SELECT tag, count(*) AS n FROM v_core GROUP BY 1) WHERE n < 100)"""))
def _(v: Views):
    counts = v.posts_core.groupBy(F.lit("tag").alias("dimension"), F.get("hashtags", F.lit(0)).alias("bucket")).agg(F.count("*").alias("n"))
    released, suppressed = dm.release_counts(counts, k=100, epsilon=0)
    return released.unionByName(suppressed.select("dimension", F.lit("suppressed").alias("bucket"), F.col("suppressed_buckets").alias("count")))


@query("g19_cohort_demographics", with_views(_COHORT_VIEWS, f"""
    SELECT 'raw' AS view, dimension, bucket, n FROM ({_DIMENSION_SQL.replace('{0}', 'v_accounts')}) WHERE n >= 10
    UNION ALL SELECT 'organic', dimension, bucket, n FROM ({_DIMENSION_SQL.replace('{0}', '(SELECT * FROM v_accounts WHERE (platform, account_id) NOT IN (SELECT (platform, account_id) FROM v_flagged))')}) WHERE n >= 10"""))
def _(v: Views):
    raw, _n = dm.cohort_demographics(v.accounts, v.posts, v.gazetteer, epsilon=0, **_COHORT_ARGS)
    organic, _n = dm.cohort_demographics(v.accounts, v.posts, v.gazetteer, v.flagged, epsilon=0, **_COHORT_ARGS)
    d = raw.withColumn("view", F.lit("raw")).unionByName(organic.withColumn("view", F.lit("organic")))
    return d.select("view", "dimension", "bucket", F.col("count").alias("n"))


_PEOPLE = """(SELECT * FROM v_accounts WHERE (platform, account_id) IN (SELECT (platform, author_id) FROM people))"""


@query("g20_topic_audience", with_views(_COHORT_VIEWS, f"""
    SELECT dimension, bucket, n, (SELECT CAST(round_even(count(*), -1) AS BIGINT) FROM {_PEOPLE}) AS accounts, (SELECT {sql_ts('max(created_at)')} FROM people) AS to_ts
    FROM ({_DIMENSION_SQL.replace('{0}', _PEOPLE)}) WHERE n >= {vw.K}""", {"people": """SELECT platform, post_id, created_at, author_id FROM v_posts WHERE (platform, post_id) IN
      (SELECT (platform, post_id) FROM v_assign WHERE topic_id = 1) UNION SELECT platform, post_id, created_at, author_id FROM v_posts
      WHERE (platform, parent_post_id) IN (SELECT (platform, post_id) FROM v_assign WHERE topic_id = 1)"""}))
def _(v: Views):
    out = dm.topic_audience(v.posts, v.accounts, v.assign, v.gazetteer, 1, k=vw.K, epsilon=0, **_COHORT_ARGS)
    cover = out["coverage"].select(F.lit(1).alias("_k"), F.col("accounts").cast("bigint").alias("accounts"), ts("to_ts").alias("to_ts"))
    return out["released"].withColumn("_k", F.lit(1)).join(cover, "_k").select("dimension", "bucket", F.col("count").alias("n"), "accounts", "to_ts")


@query("g23_likelihood_histogram", with_views(["v_behaviour"], "SELECT floor(likelihood * 10) / 10 AS bin, count(*) AS n FROM v_behaviour GROUP BY 1"))
def _(v: Views):
    return bh.likelihood_histogram(v.behaviour)


_TAG_SQL = """SELECT keyword, posts, peak_per_hour, strftime(peak_at, '%Y-%m-%d %H:%M:%S') AS peak_at, round(posts / hours, 2) AS usual_per_hour,
      round(peak_per_hour / greatest(posts / hours, 1.0), 1) AS spike, platforms
    FROM (SELECT tag AS keyword, sum(n) AS posts0, CAST(sum(n) AS BIGINT) AS posts, max(n) AS peak_per_hour, max_by(hour, (n, -epoch_us(hour))) AS peak_at FROM
        (SELECT tag, date_trunc('hour', created_at) AS hour, count(*) AS n FROM v_core GROUP BY 1, 2) GROUP BY 1)
      JOIN (SELECT tag AS keyword, string_agg(platform, ',' ORDER BY r) AS platforms FROM (SELECT tag, platform, row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, platform) AS r
        FROM v_core GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1) USING (keyword), (SELECT (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3600e6 AS hours FROM v_core)"""


def _tags(d):
    return d.select("keyword", "posts", "peak_per_hour", ts("peak_at").alias("peak_at"), "usual_per_hour", "spike", joined("platforms").alias("platforms"))


@query("g24_trending_hashtags_top", with_views(["v_core"], f"SELECT * FROM ({_TAG_SQL}) ORDER BY posts DESC, keyword LIMIT 12"))
def _(v: Views):
    return _tags(tl.trending_hashtags(v.posts_core)[1])


@query("g24_trending_hashtags_viral", with_views(["v_core"], f"SELECT * FROM ({_TAG_SQL}) WHERE peak_per_hour >= 3 ORDER BY spike DESC, posts DESC, keyword LIMIT 12"))
def _(v: Views):
    return _tags(tl.trending_hashtags(v.posts_core, min_peak=3)[0])


@query("g25_cluster_timing", with_views(["v_core", "v_assign", "v_clusters", "v_coord"], f"""
    SELECT cluster, {sql_ts("date_trunc('minute', created_at)")} AS minute, count(*) FILTER (coalesce(a.score >= 0.7, false)) AS coordinated,
      count(*) FILTER (NOT coalesce(a.score >= 0.7, false)) AS other
    FROM v_core c JOIN v_assign USING (platform, post_id) JOIN v_clusters k USING (topic_id)
    LEFT JOIN v_coord a ON a.cluster = k.cluster AND a.platform = c.platform AND a.account_id = c.author_id GROUP BY k.cluster, 2""".replace("SELECT cluster,", "SELECT k.cluster,")))
def _(v: Views):
    return co.cluster_timing(v.posts_core, v.assign, v.coord_clusters, v.coord_accounts).withColumn("minute", ts("minute"))


@query("g26_cluster_list", with_views(["v_clusters", "v_coord"], """
    SELECT cluster, score, n_accounts, coalesce(n_coordinated, 0) AS n_coordinated FROM v_clusters LEFT JOIN
      (SELECT cluster, count(DISTINCT account_id) FILTER (score >= 0.7) AS n_coordinated FROM v_coord GROUP BY 1) USING (cluster) ORDER BY score DESC, cluster LIMIT 50"""))
def _(v: Views):
    return co.cluster_list(v.coord_clusters, v.coord_accounts).select("cluster", "score", "n_accounts", "n_coordinated")


@query("g26_cluster_accounts", with_views(["v_coord"], "SELECT cluster, account_id, platform AS platforms, score, co_sync FROM v_coord"))
def _(v: Views):
    return co.cluster_accounts(v.coord_accounts).select("cluster", "account_id", joined("platforms").alias("platforms"), "score", F.col("reasons.co_sync").alias("co_sync"))


@query("g27_synchrony_fingerprint", with_views(["v_core", "v_assign", "v_coord"], """
    SELECT grp AS "group", count(*) AS posts, count(DISTINCT author_id) AS accounts, CAST(round_even(median(own_gap), 0) AS BIGINT) AS median_gap_s,
      round(count(*) FILTER (gap <= 3600 AND author_id <> before) / greatest(count(*) - 1, 1), 3) AS within_hour
    FROM (SELECT *, epoch_us(created_at) / 1e6 - lag(epoch_us(created_at) / 1e6) OVER (PARTITION BY grp, author_id ORDER BY created_at, post_id) AS own_gap,
            epoch_us(created_at) / 1e6 - lag(epoch_us(created_at) / 1e6) OVER (PARTITION BY grp ORDER BY created_at, post_id) AS gap,
            lag(author_id) OVER (PARTITION BY grp ORDER BY created_at, post_id) AS before
          FROM (SELECT 'flagged' AS grp, * FROM member UNION ALL SELECT 'organic', * FROM ordinary WHERE created_at >= (SELECT min(created_at) FROM member) - INTERVAL 30 MINUTE
            AND created_at <= (SELECT max(created_at) FROM member) + INTERVAL 60 MINUTE)) GROUP BY 1""",
    {"topic": "SELECT platform, post_id, author_id, created_at FROM v_core JOIN v_assign USING (platform, post_id) WHERE topic_id = 5",
     "member": "SELECT t.* FROM topic t WHERE (platform, author_id) IN (SELECT (platform, account_id) FROM v_coord WHERE score >= 0.7 AND cluster = 'c5')",
     "ordinary": "SELECT t.* FROM topic t WHERE author_id NOT IN (SELECT account_id FROM v_coord WHERE score >= 0.7)"}))
def _(v: Views):
    d = v.posts_core.select("platform", "post_id", "author_id", "created_at")
    out = co.synchrony_fingerprint(d, v.assign, v.coord_accounts, "c5", 5, seconds=3600)
    return out["stats"].withColumnRenamed("within_window", "within_hour")


@query("g28_feed_summary", with_views(["v_core", "v_text_emo"], """
    SELECT 'posts' AS part, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM v_core UNION ALL SELECT 'anxiety', 'all', round(avg(anxiety), 3) FROM v_core JOIN v_text_emo USING (doc_id)
    UNION ALL (SELECT 'term', tag, CAST(count(*) AS DOUBLE) FROM v_core GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 8)"""))
def _(v: Views):
    feed = v.posts.join(v.text_emotions.select("doc_id", "anxiety"), "doc_id").withColumn("sector", F.lit("other"))
    out = tl.feed_summary(feed.select("hashtags", "anxiety", "sector", "text"))
    totals = out["totals"].selectExpr("stack(2, 'posts', 'all', cast(posts as double), 'anxiety', 'all', anxiety) as (part, key, value)")
    return totals.unionByName(out["top_terms"].select(F.lit("term").alias("part"), F.col("term").alias("key"), F.col("n").cast("double").alias("value")))


# -- situation ---------------------------------------------------------------
K_SITUATION = 10
_SITUATION_VIEWS = ["v_flagposts", "v_assign", "v_emo", "v_topics", "v_accounts", "v_gaz", "v_bursts", "v_clusters", "v_series", "v_flagged"]
_SITUATION = {
    "pushed": "SELECT platform, post_id, topic_id FROM v_assign JOIN v_topics USING (topic_id) WHERE nature = 'manufactured'",
    "facts": """SELECT p.platform, p.post_id, p.author_id, p.created_at, a.topic_id, e.anxiety, p.coordinated, g.region, coalesce(o.topic_id, r.topic_id) AS exposure
      FROM v_flagposts p LEFT JOIN v_assign a USING (platform, post_id) LEFT JOIN v_emo e USING (platform, post_id) LEFT JOIN pushed o USING (platform, post_id)
      LEFT JOIN pushed r ON r.platform = p.platform AND r.post_id = p.parent_post_id LEFT JOIN v_accounts c ON c.platform = p.platform AND c.account_id = p.author_id
      LEFT JOIN v_gaz g ON g.alias = lower(c.location_text)""",
    "alert_rows": "SELECT topic_id, 'a' || CAST(topic_id AS VARCHAR) AS alert_id, 40.0 + topic_id * 5 AS priority FROM v_topics WHERE topic_id % 2 = 1",
    "topic_facts": """SELECT topic_id, nature, label, CASE topic_id % 3 WHEN 0 THEN 'infra' WHEN 1 THEN 'health' ELSE 'other' END AS sector, n AS posts, coord_posts, accounts, anx, anx_n, anx_org,
        level AS burst_level, coalesce(priority, 0.0) AS priority, (nature = 'manufactured')::INT AS made
      FROM (SELECT topic_id, count(*) AS n, count(*) FILTER (coordinated) AS coord_posts, count(DISTINCT (platform, author_id)) AS accounts, sum(anxiety) AS anx, count(anxiety) AS anx_n,
              avg(anxiety) FILTER (NOT coordinated) AS anx_org FROM facts WHERE topic_id IS NOT NULL GROUP BY 1)
      JOIN v_topics USING (topic_id) JOIN (SELECT topic_id, max(level) AS level FROM v_bursts GROUP BY 1) USING (topic_id) LEFT JOIN alert_rows USING (topic_id)""",
}


def _situation_sql(body: str) -> str:
    return with_views(_SITUATION_VIEWS, body, _SITUATION)


def demo_alerts(v: Views):
    """One alert for every odd topic, priority by topic."""
    d = v.topics.where("topic_id % 2 = 1")
    return d.select(F.concat(F.lit("a"), F.col("topic_id").cast("string")).alias("alert_id"), "topic_id",
                    (40.0 + F.col("topic_id") * 5).alias("priority"), F.lit("new").alias("status"))


def _facts(v: Views):
    return v.stage("facts", lambda: st.situation_facts(v.posts_core, v.assign, v.emotions, v.flagged, v.accounts, v.topics, v.gazetteer, vw.GAZETTEER_CHARS))


def _sectors(v: Views):
    m = F.col("topic_id") % 3
    return v.topics.select("topic_id", F.when(m == 0, "infra").when(m == 1, "health").otherwise("other").alias("sector"))


def _table(v: Views):
    return v.stage("topic_table", lambda: st.topic_table(_facts(v), v.topics, _sectors(v), v.day_bursts, demo_alerts(v)))


_LEVEL_SQL = """CASE WHEN posts = 0 THEN 'quiet' WHEN priority_alerts > 0 AND manufactured > 0 THEN 'critical' WHEN manufactured > 0 OR coordinated_share >= 0.10 THEN 'elevated'
      WHEN coordinated_share >= 0.02 OR max_burst >= 3 THEN 'watch' ELSE 'normal' END"""


@query("g29_sector_rollup", _situation_sql(f"""
    SELECT sector, posts, accounts, topics, manufactured, priority_alerts, max_burst, coordinated_share, coalesce(anxiety, -1.0) AS anxiety, coalesce(lead_topic, -1) AS lead_topic, platforms, {_LEVEL_SQL} AS level FROM (
      SELECT s.sector, coalesce(posts, 0) AS posts, coalesce(accounts, 0) AS accounts, coalesce(topics, 0) AS topics, coalesce(manufactured, 0) AS manufactured, coalesce(priority_alerts, 0) AS priority_alerts,
        coalesce(max_burst, 0) AS max_burst, coalesce(coordinated_share, 0.0) AS coordinated_share, anxiety, lead_topic, coalesce(platforms, '') AS platforms
      FROM (SELECT unnest([{', '.join(repr(s) for s in [*fixed.SECTORS, 'other'])}]) AS sector) s
      LEFT JOIN (SELECT sector, CAST(sum(posts) AS BIGINT) AS posts, count(*) AS topics, CAST(sum(made) AS BIGINT) AS manufactured, count(*) FILTER (priority >= 70) AS priority_alerts, max(burst_level) AS max_burst,
        round(sum(coord_posts) / sum(posts), 4) AS coordinated_share, round(sum(anx) / sum(anx_n), 3) AS anxiety, max_by(topic_id, (made, priority, posts, -topic_id)) AS lead_topic FROM topic_facts GROUP BY 1) b USING (sector)
      LEFT JOIN (SELECT sector, count(DISTINCT (platform, author_id)) AS accounts FROM facts JOIN topic_facts USING (topic_id) GROUP BY 1) c USING (sector)
      LEFT JOIN (SELECT sector, string_agg(platform, ',' ORDER BY r) AS platforms FROM (SELECT sector, platform, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, platform) AS r
        FROM facts JOIN topic_facts USING (topic_id) GROUP BY 1, 2) WHERE r <= 4 GROUP BY 1) d USING (sector)) WHERE sector <> 'other' OR posts > 0"""))
def _(v: Views):
    d = st.sector_rollup(_facts(v), _table(v))
    return d.withColumns({"platforms": joined("platforms"), "anxiety": F.coalesce("anxiety", F.lit(-1.0)), "lead_topic": F.coalesce("lead_topic", F.lit(-1))})


@query("g30_sector_level", with_views(["v_core"], """
    SELECT post_id, CASE WHEN posts = 0 THEN 'quiet' WHEN a > 0 AND m > 0 THEN 'critical' WHEN m > 0 OR s >= 0.10 THEN 'elevated' WHEN s >= 0.02 OR b >= 3 THEN 'watch' ELSE 'normal' END AS level
    FROM (SELECT post_id, event_id % 7 AS posts, event_id % 3 AS a, event_id % 2 * (event_id % 5) AS m, (event_id % 13) / 100 AS s, event_id % 4 AS b FROM v_core)"""))
def _(v: Views):
    e = F.col("event_id")
    return v.posts_core.select("post_id", sector_level(e % 7, e % 3, e % 2 * (e % 5), (e % 13) / 100, e % 4).alias("level"))


@query("g31_state_rollup", _situation_sql(f"""
    SELECT state, who >= {K_SITUATION} AS released, CASE WHEN who >= {K_SITUATION} THEN posts ELSE -1 END AS posts, CASE WHEN who >= {K_SITUATION} THEN coord ELSE -1 END AS coordinated_share,
      CASE WHEN who >= {K_SITUATION} THEN anx ELSE -1 END AS anxiety, CASE WHEN who >= {K_SITUATION} THEN made ELSE -1 END AS manufactured_share,
      CASE WHEN who >= {K_SITUATION} THEN top_topics ELSE '' END AS top_topics, CASE WHEN who >= {K_SITUATION} THEN platforms ELSE '' END AS platforms
    FROM (SELECT region AS state, count(*) AS posts, count(DISTINCT (platform, author_id)) AS who, round(avg(coordinated::INT), 4) AS coord, round(avg(anxiety), 3) AS anx, round(avg((exposure IS NOT NULL)::INT), 4) AS made
      FROM facts WHERE region IS NOT NULL GROUP BY 1)
    LEFT JOIN (SELECT region AS state, string_agg(CAST(topic_id AS VARCHAR), ',' ORDER BY r) AS top_topics FROM (SELECT region, topic_id, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, topic_id) AS r
      FROM facts WHERE region IS NOT NULL AND topic_id IS NOT NULL GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1) USING (state)
    LEFT JOIN (SELECT region AS state, string_agg(platform, ',' ORDER BY r) AS platforms FROM (SELECT region, platform, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, platform) AS r
      FROM facts WHERE region IS NOT NULL GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1) USING (state)"""))
def _(v: Views):
    d = st.state_rollup(_facts(v), _table(v), K_SITUATION)
    return d.select(
        "state", "released", F.coalesce("posts", F.lit(-1)).alias("posts"), *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("coordinated_share", "anxiety", "manufactured_share")],
        joined(F.transform("top_topics", lambda t: t.cast("string"))).alias("top_topics"), joined("platforms").alias("platforms"))


@query("g32_exposure", _situation_sql(f"""
    SELECT topic_id, reactions, coalesce(reaction_anxiety, -1.0) AS reaction_anxiety, coalesce(states, '') AS states FROM
      (SELECT exposure AS topic_id, count(*) FILTER (exposure <> topic_id) AS reactions, round(avg(anxiety) FILTER (exposure <> topic_id), 3) AS reaction_anxiety FROM facts WHERE exposure IS NOT NULL GROUP BY exposure)
    LEFT JOIN (SELECT exposure AS topic_id, string_agg(region, ',' ORDER BY n DESC, region) AS states FROM (SELECT exposure, region, count(*) AS n FROM facts WHERE exposure IS NOT NULL AND region IS NOT NULL
      GROUP BY 1, 2 HAVING count(DISTINCT (platform, author_id)) >= {K_SITUATION}) GROUP BY 1) USING (topic_id)"""))
def _(v: Views):
    d = st.exposure(_facts(v), K_SITUATION)
    return d.select("topic_id", "reactions", F.coalesce("reaction_anxiety", F.lit(-1.0)).alias("reaction_anxiety"), joined("states").alias("states"))


@query("g33_narratives", _situation_sql("""
    SELECT t.topic_id, t.nature, t.posts, t.accounts, round(t.coord_posts / t.posts, 4) AS coordinated_share, amplifiers, platforms, k.cluster AS groups FROM
      (SELECT * FROM topic_facts WHERE coord_posts > 0 OR made = 1 ORDER BY made DESC, coord_posts DESC, topic_id LIMIT 6) t
    LEFT JOIN (SELECT topic_id, string_agg(author_id, ',' ORDER BY r) AS amplifiers FROM (SELECT topic_id, author_id, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, platform, author_id) AS r
      FROM facts WHERE coordinated GROUP BY topic_id, platform, author_id) WHERE r <= 4 GROUP BY 1) USING (topic_id)
    LEFT JOIN (SELECT topic_id, string_agg(platform, ',' ORDER BY r) AS platforms FROM (SELECT topic_id, platform, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, platform) AS r
      FROM facts GROUP BY 1, 2) GROUP BY 1) USING (topic_id) LEFT JOIN v_clusters k USING (topic_id)"""))
def _(v: Views):
    d = st.narratives(_facts(v), _table(v), v.coord_clusters, K_SITUATION)
    return d.select("topic_id", "nature", "posts", "accounts", "coordinated_share", joined(F.transform("amplifiers", lambda a: a["account_id"])).alias("amplifiers"),
                    joined("platforms").alias("platforms"), joined(F.transform("groups", lambda g: g["cluster"])).alias("groups"))


@query("g34_hot_topics", _situation_sql("""
    SELECT topic_id, nature, sector, posts, round(spike, 1) AS spike, burst_level, round(coord_posts / posts, 4) AS coordinated_share, round(anx / anx_n, 3) AS anxiety, round(anx_org, 3) AS anxiety_organic FROM (
      SELECT t.*, peak / greatest(1.0, posts / (SELECT (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3600e6 FROM facts)) AS spike
      FROM topic_facts t JOIN (SELECT topic_id, max(count_all) AS peak FROM v_series GROUP BY 1) USING (topic_id) WHERE posts >= 30) ORDER BY spike DESC, topic_id LIMIT 8"""))
def _(v: Views):
    return st.hot_topics(_table(v), v.series, tl.span_hours(v.posts_core), _facts(v)).drop("label", "platforms")


@query("g35_situation_kpis", _situation_sql(f"""
    SELECT (SELECT count(*) FROM facts) AS posts_secured, (SELECT count(*) FROM alert_rows WHERE priority >= 70) AS priority_alerts, (SELECT count(*) FROM alert_rows) AS signals,
      (SELECT max_by(topic_id, priority) FROM alert_rows) AS top_alert_topic, (SELECT count(*) FROM v_flagged) AS coordinated_accounts, (SELECT count(*) FROM v_topics WHERE nature = 'manufactured') AS manufactured_trends,
      (SELECT count(*) FROM v_topics) AS topics, (SELECT count(DISTINCT platform) FROM facts) AS platforms, (SELECT {sql_ts('max(created_at)')} FROM facts) AS as_of,
      (SELECT count(*) FROM (SELECT region FROM facts WHERE region IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (platform, author_id)) >= {K_SITUATION})) AS states_released,
      round((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM facts WHERE region IS NOT NULL GROUP BY region HAVING count(DISTINCT (platform, author_id)) >= {K_SITUATION})) / (SELECT count(*) FROM facts), 3) AS located_share"""))
def _(v: Views):
    f, t = _facts(v), _table(v)
    d = st.situation_kpis(v.raw_records, v.checkpoints, demo_alerts(v), v.flagged, v.topics, v.posts_core, st.state_rollup(f, t, K_SITUATION), st.sector_rollup(f, t), v.coord_clusters)
    return d.select("posts_secured", "priority_alerts", "signals", "top_alert_topic", "coordinated_accounts", "manufactured_trends", "topics", "platforms", ts("as_of").alias("as_of"), "states_released", "located_share")


@query("g35_situation_lead", _situation_sql("""
    SELECT topic_id, posts, first_platform FROM (SELECT * FROM topic_facts WHERE coord_posts > 0 OR made = 1 ORDER BY made DESC, coord_posts DESC, topic_id LIMIT 1)
    JOIN (SELECT topic_id, min_by(platform, (created_at, platform, post_id)) AS first_platform FROM facts GROUP BY 1) USING (topic_id) WHERE nature = 'manufactured'"""))
def _(v: Views):
    pushed = st.narratives(_facts(v), _table(v), v.coord_clusters, K_SITUATION)
    return st.situation_lead(pushed, v.posts_core, v.assign).select("topic_id", "posts", "first_platform")


@query("g29_topic_sectors")
def _(v: Views):
    return st.topic_sectors(v.topics, v.posts_core, v.assign, texts=v.texts, text_id="doc_id")


@query("g36_topic_list", with_views(["v_topics", "v_assign", "v_bursts"], f"""
    SELECT topic_id, label, nature, n_posts, max_burst_level, array_to_string(keywords, ',') AS keywords, {sql_ts('last_seen')} AS last_seen FROM v_topics
    JOIN (SELECT topic_id, count(*) AS n_posts FROM v_assign GROUP BY 1) USING (topic_id) JOIN (SELECT topic_id, max(level) AS max_burst_level FROM v_bursts GROUP BY 1) USING (topic_id)"""))
def _(v: Views):
    d = tp.topic_list(v.topics, v.assign, v.day_bursts, sort="coordinated")
    return d.select("topic_id", "label", "nature", "n_posts", "max_burst_level", joined("keywords").alias("keywords"), ts("last_seen").alias("last_seen"))


@query("g36_topic_detail", with_views(["v_core", "v_assign"], """
    SELECT topic_id, 'post' AS part, post_id AS key, rank AS value FROM (SELECT topic_id, post_id, row_number() OVER (PARTITION BY topic_id ORDER BY platform, post_id) AS rank FROM v_core JOIN v_assign USING (platform, post_id)) WHERE rank <= 8
    UNION ALL SELECT topic_id, 'platform', platform, count(*) FROM v_core JOIN v_assign USING (platform, post_id) GROUP BY 1, platform"""))
def _(v: Views):
    central, platforms = tp.topic_detail(v.posts, v.assign)
    a = central.select("topic_id", F.lit("post").alias("part"), F.col("post_id").alias("key"), F.col("rank").cast("bigint").alias("value"))
    return a.unionByName(platforms.select("topic_id", F.lit("platform").alias("part"), F.col("platform").alias("key"), F.col("n").alias("value")))


@query("g37_series_with_bursts", with_views(["v_series", "v_bursts"], f"""
    SELECT 'series' AS part, {sql_ts('bucket_start')} AS at, count_all AS value FROM v_series WHERE topic_id = 3 UNION ALL SELECT 'burst', {sql_ts('start_ts')}, level FROM v_bursts WHERE topic_id = 3"""))
def _(v: Views):
    empty = v.series.select("topic_id", F.lit("none").alias("model"), "bucket_start").where("false")
    out = tp.series_with_bursts_and_forecast(3, v.series, v.day_bursts, empty)
    a = out["series"].select(F.lit("series").alias("part"), ts("bucket_start").alias("at"), F.col("count_all").alias("value"))
    return a.unionByName(out["bursts"].select(F.lit("burst").alias("part"), ts("start").alias("at"), F.col("level").cast("bigint").alias("value")))


@query("g38_ledger_summary", with_views(["v_core"], """
    SELECT count(*) AS record_count, max(ledger_seq) AS last_seq, (SELECT count(DISTINCT (ledger_seq - 1) // 100) FROM v_core) AS checkpoint_count, max(ledger_seq) AS covered_to FROM v_core"""))
def _(v: Views):
    return lg.ledger_summary(v.raw_records, v.checkpoints).select("record_count", "last_seq", "checkpoint_count", "covered_to")
