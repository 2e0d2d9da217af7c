"""Topics, bursts, trends, forecasts and alerts."""

from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.numeric import priority
from driftlens.operators import alerts as al
from driftlens.operators import bursts as bu
from driftlens.operators import forecast as fc
from driftlens.operators import links
from driftlens.operators import topics as tp
from driftlens.operators import trends as tr
from driftlens.plans.catalog import joined, query, r6, sql_ts, ts
from driftlens.plans.catalog_aggregates import BURST_STATS_SQL
from driftlens.plans.views import Views, with_views
from driftlens.session import cut_lineage


# -- topics ------------------------------------------------------------------
def text_vectors(v: Views):
    return v.stage("text_vectors", lambda: links.hash_embed(
        v.texts.groupBy("text_hash").agg(F.min("text").alias("text")).withColumnRenamed("text_hash", "topic_key"), "topic_key"))


def topic_posts(v: Views):
    return v.hashed_posts.select("platform", "post_id", "created_at", F.col("text_hash").alias("topic_key"))


@query("t01_window_clusters")
def _(v: Views):
    d = tp.window_clusters(topic_posts(v), text_vectors(v))
    return d.groupBy("window", "cluster").agg(F.count("*").alias("posts"))


@query("t02_assign_posts", """
    WITH c AS (SELECT label, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)
    SELECT label, vec_id, round(s, 4) AS prob FROM (SELECT label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), center) AS s FROM embeddings JOIN c USING (label))
    WHERE s >= 0.2 AND label IN (SELECT label FROM embeddings JOIN c USING (label) WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), center) >= 0.2 GROUP BY 1 HAVING count(*) >= 5)""")
def _(v: Views):
    e = v.table("embeddings")
    members = e.select("label", "vec_id")
    return tp.assign_posts(members, e.select("vec_id", F.col("embedding").alias("vector")), tau=0.2, min_posts=5, key="vec_id", cluster=["label"]).select("label", "vec_id", "prob")


@query("t03_match_across_windows")
def _(v: Views):
    """Label centroids of the embeddings, one window per hundred vectors."""
    e = v.table("embeddings").select(F.floor(F.col("vec_id") / 100).alias("window"), F.col("label").cast("string").alias("cluster"), F.col("embedding").alias("vector"))
    c = tp.centroid(e, ["window", "cluster"]).withColumns({"first_seen": F.timestamp_seconds(F.col("window") * 86400), "last_seen": F.timestamp_seconds(F.col("window") * 86400 + 1)})
    mapping, _topics = tp.match_across_windows(c, 0.3)
    return mapping


@query("t04_ctfidf_keywords", with_views(["v_texts"], f"""
    SELECT lang, string_agg(term, ',' ORDER BY r) AS keywords FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(n / total * ln(1 + clusters / df), 12) DESC, term) AS r FROM
      (SELECT lang, term, count(*) AS n FROM tok GROUP BY 1, 2) JOIN (SELECT lang, count(*) AS total FROM tok GROUP BY 1) USING (lang)
      JOIN (SELECT term, count(DISTINCT lang) AS df FROM tok GROUP BY 1) USING (term), (SELECT count(DISTINCT lang) AS clusters FROM v_texts)) WHERE r <= 5 GROUP BY 1""",
    {"tok": f"""SELECT lang, t AS term FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '#?[a-z][a-z0-9]+')) AS t FROM v_texts)
      WHERE ltrim(t, '#') NOT IN ({', '.join(repr(x) for x in fixed.TOPIC_STOPWORDS)})"""}))
def _(v: Views):
    return tp.ctfidf_keywords(v.texts.select("lang", "text"), "lang").select("lang", joined("keywords").alias("keywords"))


@query("k02_top_terms", with_views(["v_texts"], """
    SELECT lang, term, n, rank FROM (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rank
      FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM v_texts) GROUP BY 1, 2) WHERE rank <= 5"""))
def _(v: Views):
    from driftlens.functions.sequence import top_n_per_group

    words = v.texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    counts = words.groupBy("lang", "term").agg(F.count("*").alias("n"))
    return top_n_per_group(counts, ["lang"], [F.desc("n"), F.col("term")], 5)


@query("t05_topic_label")
def _(v: Views):
    members = v.texts.select("lang", F.lit("text").alias("platform"), F.col("doc_id").cast("string").alias("post_id"), "text", F.lit(1.0).alias("prob"))
    words = tp.ctfidf_keywords(v.texts.select("lang", "text"), "lang")
    return tp.topic_label(members, words, "lang")


@query("t06_run_topics")
def _(v: Views):
    """Windowed clusters to lasting, labelled topics over all posts."""
    topics, assign = tp.run_topics(v.posts.select("platform", "post_id", "created_at", "text"))
    sizes = assign.groupBy("topic_id").agg(F.count("*").alias("assigned"))
    return topics.join(sizes, "topic_id").select("topic_id", "label", joined("keywords").alias("keywords"), "n_posts", "assigned", ts("first_seen").alias("first_seen"))


# -- bursts ------------------------------------------------------------------
def kleinberg_views(gamma: float) -> dict[str, str]:
    """The automaton as a recursive walk over gaps, one row per topic and gap,
    costs and back pointers as lists."""
    cost = f"list_min(list_transform(range(1, k + 1), lambda i: v.cost[i] + CASE WHEN j > i THEN (j - i) * {gamma} * ln(n) ELSE 0 END))"
    back = f"list_position(list_transform(range(1, k + 1), lambda i: v.cost[i] + CASE WHEN j > i THEN (j - i) * {gamma} * ln(n) ELSE 0 END), {cost})"
    emit = "(-ln(power(2, j - 1) / g_hat) + power(2, j - 1) / g_hat * w.gap)"
    return {
        "tm": "SELECT DISTINCT topic_id, epoch_us(created_at) AS t FROM v_core JOIN v_assign USING (platform, post_id)",
        "gp": """SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY t) - 1 AS pos, t, lag(t) OVER (PARTITION BY topic_id ORDER BY t) AS t0,
            greatest((t - lag(t) OVER (PARTITION BY topic_id ORDER BY t)) / 1e6, 1e-6) AS gap FROM tm""",
        "md": """SELECT topic_id, n, span / n AS g_hat, CAST(greatest(2, least(10, ceil(log2(span / greatest(p5, 1e-3))) + 1)) AS INTEGER) AS k FROM
            (SELECT topic_id, count(*) AS n, (max(t) - min(t)) / 1e6 AS span FROM tm GROUP BY 1)
            JOIN (SELECT topic_id, list_sort(list(gap))[(count(*) // 20) + 1] AS p5 FROM gp WHERE t0 IS NOT NULL GROUP BY 1) USING (topic_id)""",
        "wk": "SELECT * FROM gp JOIN md USING (topic_id) WHERE t0 IS NOT NULL",
        "vit(topic_id, pos, cost, back)": f"""SELECT topic_id, pos, list_transform(range(1, k + 1), lambda j: {emit} + (j - 1) * {gamma} * ln(n)), CAST([] AS BIGINT[]) FROM wk w WHERE pos = 1
            UNION ALL SELECT w.topic_id, w.pos, list_transform(range(1, k + 1), lambda j: {cost} + {emit}), list_transform(range(1, k + 1), lambda j: CAST({back} AS BIGINT))
            FROM vit v JOIN wk w ON w.topic_id = v.topic_id AND w.pos = v.pos + 1""",
        "bt(topic_id, pos, state)": """SELECT topic_id, pos, CAST(list_position(cost, list_min(cost)) AS BIGINT) FROM vit WHERE (topic_id, pos) IN (SELECT (topic_id, max(pos)) FROM vit GROUP BY topic_id)
            UNION ALL SELECT v.topic_id, v.pos - 1, v.back[b.state] FROM bt b JOIN vit v ON v.topic_id = b.topic_id AND v.pos = b.pos WHERE v.pos > 1""",
        "st": f"""SELECT topic_id, pos, t0, t, state - 1 AS state, -ln(1 / g_hat) + gap / g_hat - (-ln(power(2, state - 1) / g_hat) + power(2, state - 1) / g_hat * gap) AS saved, n,
            coalesce(lag(state - 1) OVER (PARTITION BY topic_id ORDER BY pos), 0) AS before FROM bt JOIN wk USING (topic_id, pos)""",
        "runs": """SELECT *, sum((state = 0)::INT) OVER (PARTITION BY topic_id ORDER BY pos) AS run FROM st""",
        "found": f"""SELECT topic_id, min(t0) AS t_from, max(t) AS t_to, max(state) AS level, sum(saved) - sum(CASE WHEN before >= 1 AND state > before THEN (state - before) * {gamma} * ln(n) ELSE 0 END) AS weight
            FROM runs WHERE state >= 1 GROUP BY topic_id, run""",
    }


_BURST_ROWS = f"SELECT topic_id, {sql_ts('make_timestamp(t_from)')} AS start_ts, {sql_ts('make_timestamp(t_to)')} AS end_ts, level, round(weight, 4) AS weight FROM found"


def _burst_rows(d):
    return d.select("topic_id", ts("start").alias("start_ts"), ts("end").alias("end_ts"), F.col("level").cast("bigint").alias("level"), F.round("weight", 4).alias("weight"))


@query("b01_kleinberg_bursts", with_views(["v_core", "v_assign"], _BURST_ROWS, kleinberg_views(0.1), recursive=True))
def _(v: Views):
    times = bu.distinct_times(v.posts_core, v.assign)
    return _burst_rows(bu.kleinberg_bursts(times, gamma=0.1, chunk=256))


@query("b02_topic_bursts", with_views(["v_core", "v_assign"], _BURST_ROWS, kleinberg_views(0.05), recursive=True))
def _(v: Views):
    return _burst_rows(bu.topic_bursts(v.posts_core, v.assign, gamma=0.05))


@query("b03_open_burst_flag")
def _(v: Views):
    d = bu.open_burst_flag(bu.distinct_times(v.posts_core, v.assign), gamma=0.3)
    return d.select("topic_id", ts("first_flag").alias("first_flag"))


@query("b04_priority", with_views(["v_core"], """
    SELECT post_id, round(100 * (0.35 * least(1.0, level / 5) + 0.30 * share + 0.20 * least(1.0, abs(shift) / 0.5) + 0.15 * reach), 6) AS priority
    FROM (SELECT post_id, event_id % 9 AS level, (event_id % 11) / 10 AS share, (event_id % 13 - 6) / 10 AS shift, (event_id % 7) / 6 AS reach FROM v_core)"""))
def _(v: Views):
    e = F.col("event_id")
    return v.posts_core.select("post_id", r6(priority(e % 9, (e % 11) / 10, (e % 13 - 6) / 10, (e % 7) / 6)).alias("priority"))


_BEST = "SELECT topic_id, start_ts, end_ts, level, weight FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY level DESC, weight DESC, start_ts DESC) AS r FROM v_bursts) WHERE r = 1"


@query("w05_best_burst_per_topic", with_views(["v_bursts"], f"SELECT topic_id, {sql_ts('start_ts')} AS start_ts, level, weight FROM ({_BEST})"))
def _(v: Views):
    return al.best_burst_per_topic(v.day_bursts).select("topic_id", ts("start").alias("start_ts"), F.col("level").cast("bigint").alias("level"), "weight")


_ALERT_VIEWS = ["v_flagposts", "v_assign", "v_emo", "v_bursts", "v_topics"]
_ALERT_EXTRA = {"best": _BEST, "stats": BURST_STATS_SQL.format("best"), "reached": "SELECT *, cume_dist() OVER (ORDER BY n_posts) AS reach FROM stats"}


@query("w04_reach_percentile", with_views(_ALERT_VIEWS, "SELECT topic_id, n_posts, round(reach, 6) AS reach FROM reached", _ALERT_EXTRA))
def _(v: Views):
    stats = al.burst_window_stats(al.best_burst_per_topic(v.day_bursts), v.posts_core, v.assign, v.emotions, v.flagged)
    return al.reach_percentile(stats).select("topic_id", "n_posts", r6("reach").alias("reach"))


def alerts(v: Views):
    return al.generate_alerts(v.day_bursts, v.topics, v.posts_core, v.assign, v.emotions, v.flagged)


_HEADLINE = """CASE WHEN coordinated_share >= 0.3 THEN 'Manufactured surge' ELSE 'Organic burst' END || ': ' || label || ' - ' || n_posts || ' posts from ' || n_accounts || ' accounts, '
      || CAST(round_even(coordinated_share * 100, 0) AS BIGINT) || '% from coordinated accounts'"""
ALERT_SQL = f"""SELECT topic_id, round(100 * (0.35 * least(1.0, level / 5) + 0.30 * coordinated_share + 0.20 * least(1.0, abs(anxiety_shift) / 0.5) + 0.15 * reach), 6) AS priority,
      {_HEADLINE} AS headline, start_ts, end_ts FROM reached JOIN (SELECT topic_id, label FROM v_topics) USING (topic_id) WHERE n_posts >= 10"""


@query("b05_generate_alerts", with_views(_ALERT_VIEWS, f"SELECT topic_id, priority, headline, {sql_ts('start_ts')} AS start_ts FROM ({ALERT_SQL})", _ALERT_EXTRA))
def _(v: Views):
    return alerts(v).select("topic_id", r6("priority").alias("priority"), "headline", ts("evidence.start").alias("start_ts"))


@query("k04_alerts_by_priority", with_views(_ALERT_VIEWS, f"SELECT topic_id, nature, priority FROM ({ALERT_SQL}) JOIN (SELECT topic_id, nature FROM v_topics) USING (topic_id) ORDER BY priority DESC LIMIT 5", _ALERT_EXTRA))
def _(v: Views):
    return al.alerts_by_priority(alerts(v), v.topics, "new", 5).select("topic_id", "nature", r6("priority").alias("priority"))


# -- trends ------------------------------------------------------------------
@query("w03_spread_frames", with_views(["v_core", "v_assign"], f"""
    SELECT topic_id, {sql_ts('hour')} AS hour, posts, accounts, coalesce(x, 0) AS on_x FROM (
      SELECT topic_id, hour, CAST(sum(n) OVER w AS BIGINT) AS posts, CAST(sum(coalesce(new_accounts, 0)) OVER w AS BIGINT) AS accounts, CAST(sum(nx) OVER w AS BIGINT) AS x, row_number() OVER (PARTITION BY topic_id ORDER BY hour DESC) AS r
      FROM (SELECT topic_id, date_trunc('hour', created_at) AS hour, count(*) AS n, count(*) FILTER (platform = 'x') AS nx FROM v_core JOIN v_assign USING (platform, post_id) GROUP BY 1, 2)
      LEFT JOIN (SELECT topic_id, hour, count(*) AS new_accounts FROM (SELECT topic_id, author_id, min(date_trunc('hour', created_at)) AS hour FROM v_core JOIN v_assign USING (platform, post_id) GROUP BY 1, 2) GROUP BY 1, 2) USING (topic_id, hour)
      WINDOW w AS (PARTITION BY topic_id ORDER BY hour ROWS UNBOUNDED PRECEDING)) WHERE r <= 48"""))
def _(v: Views):
    from driftlens.operators.timelines import spread_frames

    d = spread_frames(v.posts_core, v.assign)
    return d.select("topic_id", ts("hour").alias("hour"), "posts", "accounts", F.coalesce(F.try_element_at("platforms", F.lit("x")), F.lit(0)).alias("on_x"))


@query("w07_ewma_acceleration", with_views(["v_series"], """
    SELECT topic_id, round(list_reduce(c[:24], lambda a, x: 0.3 * x + 0.7 * a) - 2 * list_reduce(c[:23], lambda a, x: 0.3 * x + 0.7 * a) + list_reduce(c[:22], lambda a, x: 0.3 * x + 0.7 * a), 6) AS acceleration
    FROM (SELECT topic_id, list_reverse(list(CAST(count_all AS DOUBLE) ORDER BY bucket_start DESC)[:24]) AS c FROM v_series GROUP BY 1)"""))
def _(v: Views):
    return tr.ewma_acceleration(v.series).withColumn("acceleration", r6("acceleration"))


_CENTER = """SELECT topic_id, list(m ORDER BY i) AS c FROM (SELECT CAST(label AS BIGINT) AS topic_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1"""


@query("w09_novelty", with_views(["v_topics"], """
    SELECT a.topic_id, round(1 - coalesce(max(list_cosine_similarity(x.c, y.c)), 0), 6) AS novelty FROM v_topics a LEFT JOIN v_topics b
      ON epoch_us(a.first_seen) - epoch_us(b.first_seen) > 86400 * 1000000::BIGINT AND a.topic_id <> b.topic_id
    JOIN center x ON x.topic_id = a.topic_id LEFT JOIN center y ON y.topic_id = b.topic_id GROUP BY 1""", {"center": _CENTER}))
def _(v: Views):
    return tr.topic_novelty(v.topics).withColumn("novelty", r6("novelty"))


_GROWTH = """SELECT topic_id, count(DISTINCT author_id) FILTER (created_at > m - INTERVAL 6 HOUR) - count(DISTINCT author_id) FILTER (created_at <= m - INTERVAL 6 HOUR) AS account_growth
    FROM v_core JOIN v_assign USING (platform, post_id), (SELECT max(created_at) AS m FROM v_core) WHERE created_at > m - INTERVAL 12 HOUR GROUP BY 1"""


@query("w10_account_growth", with_views(["v_core", "v_assign"], f"SELECT topic_id, coalesce(account_growth, 0) AS account_growth FROM (SELECT DISTINCT topic_id FROM v_assign) LEFT JOIN ({_GROWTH}) USING (topic_id)"))
def _(v: Views):
    return tr.account_growth(v.posts_core, v.assign)


@query("w08_rise_score", with_views(["v_assign", "v_bursts", "v_core"], """
    SELECT topic_id, round(0.35 * (l - avg(l) OVER ()) / coalesce(nullif(stddev_pop(l) OVER (), 0), 1) + 0.25 * (a - avg(a) OVER ()) / coalesce(nullif(stddev_pop(a) OVER (), 0), 1)
      + 0.20 * (n - avg(n) OVER ()) / coalesce(nullif(stddev_pop(n) OVER (), 0), 1) + 0.20 * (g - avg(g) OVER ()) / coalesce(nullif(stddev_pop(g) OVER (), 0), 1), 4) AS rise
    FROM (SELECT topic_id, max(level) AS l, count(*) / 10 AS a, topic_id / 7 AS n FROM v_bursts GROUP BY 1) JOIN (SELECT topic_id, count(*) % 17 AS g FROM v_assign GROUP BY 1) USING (topic_id)"""))
def _(v: Views):
    """Scores from plain features; rise_features computes the real ones."""
    a = v.day_bursts.groupBy("topic_id").agg(F.max("level").alias("burst_level"), (F.count("*") / 10).alias("acceleration"), (F.first("topic_id") / 7).alias("novelty"))
    g = v.assign.groupBy("topic_id").agg((F.count("*") % 17).alias("account_growth"))
    return tr.rise_scores(cut_lineage(a.join(g, "topic_id"), "rise")).select("topic_id", "rise")


@query("w08_rise_features")
def _(v: Views):
    d = tr.rise_features(v.topics, v.day_bursts, v.series, v.posts_core, v.assign)
    return tr.rise_scores(cut_lineage(d, "rise"))


_KEY_HOURS = """SELECT tag AS keyword, date_trunc('hour', created_at) AS hour, count(*) AS n FROM v_core GROUP BY 1, 2"""


@query("w11_volume_z_alerts", with_views(["v_core"], f"""
    SELECT keyword, {sql_ts('hour')} AS hour, n AS count FROM (SELECT g.keyword, g.hour, coalesce(k.n, 0) AS n, avg(coalesce(k.n, 0)) OVER w AS mean, stddev_pop(coalesce(k.n, 0)) OVER w AS sd
      FROM (SELECT keyword, unnest(generate_series((SELECT min(hour) FROM kh), (SELECT max(hour) FROM kh), INTERVAL 1 HOUR)) AS hour FROM (SELECT keyword FROM kh GROUP BY 1 HAVING sum(n) >= 30)) g
      LEFT JOIN kh k ON k.keyword = g.keyword AND k.hour = g.hour WINDOW w AS (PARTITION BY g.keyword ORDER BY g.hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
    WHERE n >= 2 AND n > mean + 1.2 * greatest(sd, 1.0) AND hour >= (SELECT min(hour) FROM kh) + INTERVAL 24 HOUR""", {"kh": _KEY_HOURS}))
def _(v: Views):
    counts = v.posts_core.groupBy(F.get("hashtags", F.lit(0)).alias("keyword"), F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("n"))
    return tr.volume_z_alerts(v.posts_core, z=1.2, min_count=2, counts=counts).withColumn("hour", ts("hour"))


@query("w11_keyword_hours", with_views(["v_posts"], f"""
    SELECT keyword, count(*) AS hours, CAST(sum(n) AS BIGINT) AS posts FROM (SELECT keyword, date_trunc('hour', created_at) AS hour, count(*) AS n FROM (SELECT created_at,
      unnest(list_distinct(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: lower(trim(w, '#!.,?'))), lambda w: length(w) >= 5))) AS keyword FROM v_posts) GROUP BY 1, 2) GROUP BY 1"""))
def _(v: Views):
    d = tr.keyword_hours(v.posts_core, texts=v.texts.select("doc_id", "text"), text_id="doc_id")
    return d.groupBy("keyword").agg(F.count("*").alias("hours"), F.sum("n").alias("posts"))


@query("w15_dense_series", with_views(["v_series"], f"""
    SELECT topic_id, {sql_ts('g.hour')} AS bucket_start, CAST(coalesce(count_all, 0) AS DOUBLE) AS y FROM (SELECT topic_id, unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 1 HOUR)) AS hour FROM v_series GROUP BY 1) g
    LEFT JOIN v_series s USING (topic_id) WHERE s.bucket_start = g.hour OR s.bucket_start IS NULL
    UNION ALL SELECT topic_id, {sql_ts('g.hour')}, 0.0::DOUBLE FROM (SELECT topic_id, unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 1 HOUR)) AS hour FROM v_series GROUP BY 1) g
    WHERE NOT EXISTS (SELECT 1 FROM v_series s WHERE s.topic_id = g.topic_id AND s.bucket_start = g.hour)"""))
def _(v: Views):
    return tr.dense_series(v.series).withColumn("bucket_start", ts("bucket_start"))


_DENSE = """SELECT g.topic_id, g.hour, CAST(coalesce(s.count_all, 0) AS DOUBLE) AS y FROM (SELECT topic_id, unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 1 HOUR)) AS hour FROM v_series GROUP BY 1) g
    LEFT JOIN v_series s ON s.topic_id = g.topic_id AND s.bucket_start = g.hour"""


@query("w16_lag_features", with_views(["v_series"], f"""
    SELECT topic_id, {sql_ts('hour')} AS bucket_start, y, {', '.join(f'coalesce(lag(y, {k}) OVER w, 0.0::DOUBLE) AS lag{k}' for k in fixed.FORECAST_LAGS)},
      round(sin(2 * pi() * hour(hour) / 24), 6) AS sin_hour, round(cos(2 * pi() * hour(hour) / 24), 6) AS cos_hour FROM ({_DENSE}) WINDOW w AS (PARTITION BY topic_id ORDER BY hour)"""))
def _(v: Views):
    d = tr.lag_features(tr.dense_series(v.series)).drop("position")
    # + 0.0 turns a rounded negative zero into zero
    return d.withColumns({"bucket_start": ts("bucket_start"), "sin_hour": r6("sin_hour") + 0.0, "cos_hour": r6("cos_hour") + 0.0})


# -- forecasts ---------------------------------------------------------------
@query("b06_gbr_forecast")
def _(v: Views):
    d = fc.gbr_forecast(v.series)
    return d.select("topic_id", "model", ts("bucket_start").alias("bucket_start"), *[r6(c).alias(c) for c in ("predicted", "lower", "upper")])


@query("b07_hawkes_forecast")
def _(v: Views):
    d = fc.hawkes_forecast(v.posts_core, v.assign, v.series)
    return d.select("topic_id", "model", ts("bucket_start").alias("bucket_start"), F.round("predicted", 4).alias("predicted"))


@query("b08_compute_forecasts")
def _(v: Views):
    d = fc.compute_forecasts(v.series, v.posts_core, v.assign)
    return d.groupBy("topic_id", "model").agg(F.count("*").alias("hours"))


@query("b09_backtest_naive", with_views(["v_series"], f"""
    SELECT 'naive' AS model, round(avg(abs(y - last)), 3) AS mae, count(*) AS n_points FROM (SELECT topic_id, y, row_number() OVER (PARTITION BY topic_id ORDER BY hour DESC) AS r, count(*) OVER (PARTITION BY topic_id) AS points,
      nth_value(y, 7) OVER (PARTITION BY topic_id ORDER BY hour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM ({_DENSE})) WHERE r <= 6 AND points >= 54"""))
def _(v: Views):
    return fc.backtest(v.series, models=("naive",))


@query("b09_backtest")
def _(v: Views):
    return fc.backtest(v.series, v.posts_core, v.assign)
