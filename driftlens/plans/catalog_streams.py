"""Structured Streaming queries, run over the landed tables until they are
drained, and the SQL function surface."""

from pyspark.sql import functions as F

from driftlens.functions import registry
from driftlens.operators import gaps as gp
from driftlens.plans.catalog import query, r6, sql_ts, ts
from driftlens.plans.views import Views, with_views
from driftlens.streaming import streams


def landing(v: Views, name: str, build):
    """A streaming read of a landed table."""
    path = v.files(f"landing_{name}", lambda p: build().write.parquet(p))
    return v.spark.readStream.schema(v.spark.read.parquet(path).schema).parquet(path)


def drained(v: Views, name: str, stream, mode: str = "append"):
    def run(path: str) -> None:
        streams.run_available(stream, path, f"{path}_checkpoint", mode)

    return v.spark.read.parquet(v.files(name, run))


def post_stream(v: Views):
    return landing(v, "posts", lambda: v.posts_core.drop("mentions"))


@query("st01_stream_posts", with_views(["v_core"], "SELECT platform, post_id, author_id FROM v_core"))
def _(v: Views):
    """Every post landed twice, kept once."""
    twice = landing(v, "posts_twice", lambda: v.posts_core.select("platform", "post_id", "author_id", "created_at").unionByName(
        v.posts_core.select("platform", "post_id", "author_id", "created_at")))
    return drained(v, "st01", streams.stream_posts(twice)).select("platform", "post_id", "author_id")


_CLOSED = "{0} <= (SELECT max(created_at) FROM v_core) - INTERVAL 1 HOUR"


@query("st02_stream_topic_volume", with_views(["v_series", "v_core"], f"""
    SELECT topic_id, {sql_ts('bucket_start')} AS bucket_start, count_all, count_organic FROM v_series WHERE {_CLOSED.format('bucket_start + INTERVAL 1 HOUR')}"""))
def _(v: Views):
    """Hours that closed before the watermark."""
    d = drained(v, "st02", streams.stream_topic_volume(post_stream(v), v.assign, v.flagged))
    return d.withColumn("bucket_start", ts("bucket_start"))


@query("st03_stream_hashtag_spikes", with_views(["v_core"], f"""
    SELECT keyword, {sql_ts('hour')} AS start, n FROM (SELECT tag AS keyword, date_trunc('hour', created_at) AS hour, count(*) AS n FROM v_core GROUP BY 1, 2) WHERE {_CLOSED.format('hour + INTERVAL 1 HOUR')}"""))
def _(v: Views):
    d = drained(v, "st03", streams.stream_hashtag_spikes(post_stream(v)))
    return d.select("keyword", ts("start").alias("start"), "n")


@query("st04_stream_feed_summary", with_views(["v_core", "v_text_emo"], f"""
    SELECT {sql_ts('w')} AS start, count(*) AS posts, round(avg(anxiety), 3) AS anxiety FROM (SELECT time_bucket(INTERVAL 2 MINUTE, created_at) - INTERVAL 2 MINUTE * unnest(range(0, 5)) AS w, anxiety
      FROM v_core JOIN v_text_emo USING (doc_id)) WHERE w + INTERVAL 10 MINUTE <= (SELECT max(created_at) FROM v_core) - INTERVAL 10 MINUTE GROUP BY 1"""))
def _(v: Views):
    feed = landing(v, "feed", lambda: v.posts_core.join(v.text_emotions.select("doc_id", "anxiety"), "doc_id").select("created_at", "anxiety", F.lit("other").alias("sector")))
    d = drained(v, "st04", streams.stream_feed_summary(feed))
    return d.select(ts("start").alias("start"), "posts", "anxiety")


@query("st05_stream_open_bursts")
def _(v: Views):
    from driftlens.operators.timelines import with_topic

    key = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(key)
    v.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        topical = landing(v, "topical", lambda: with_topic(v.posts_core, v.assign).select("topic_id", "created_at"))
        d = drained(v, "st05", streams.stream_open_bursts(topical, gamma=0.3))
    finally:
        v.spark.conf.set(key, before)
    return d.select("topic_id", ts("flagged_at").alias("flagged_at"))


@query("st06_late_parent_resolution", with_views(["v_core"], """
    SELECT c.post_id, coalesce(q.author_id, 'post:' || c.parent_post_id) AS dst_account FROM v_core c LEFT JOIN v_core q ON q.post_id = c.parent_post_id
      AND q.created_at BETWEEN c.created_at - INTERVAL 24 HOUR AND c.created_at + INTERVAL 24 HOUR WHERE c.parent_post_id IS NOT NULL AND q.author_id IS NOT NULL"""))
def _(v: Views):
    """Reply edges that arrive as pending and meet their parent on the stream."""
    def pending():
        return v.posts_core.where("parent_post_id IS NOT NULL").select(
            F.col("platform").alias("src_platform"), F.col("author_id").alias("src_account"), F.col("platform").alias("dst_platform"),
            F.concat(F.lit("post:"), "parent_post_id").alias("dst_account"), F.lit("reply").alias("kind"), F.col("created_at").alias("ts"), "post_id", F.lit(1.0).alias("weight"))

    edges = landing(v, "pending_edges", pending)
    d = drained(v, "st06", streams.late_parent_resolution(edges, post_stream(v)))
    return d.where(~F.col("dst_account").startswith("post:")).select("post_id", "dst_account")


@query("st07_stream_seal", with_views(["v_core"], "SELECT 'PASS' AS status, count(*) AS records FROM v_core"))
def _(v: Views):
    """Records sealed by a stream must verify as one chain."""
    from driftlens.operators.ledger import verify_chain

    raw = landing(v, "records", lambda: v.records.select("platform", "collector_id", "collected_at", "payload"))

    def run(path: str) -> None:
        streams.stream_seal(raw, path, f"{path}_checkpoint").awaitTermination()

    sealed = v.spark.read.parquet(v.files("st07", run))
    return verify_chain(sealed).select("status", "records")


@query("p04_sql_functions", with_views(["v_gaps"], """
    SELECT platform, author_id, round(coalesce((stddev_pop(gap_s) - avg(gap_s)) / nullif(stddev_pop(gap_s) + avg(gap_s), 0), 0.0), 6) AS burstiness FROM v_gaps GROUP BY 1, 2"""))
def _(v: Views):
    registry.register_functions(v.spark)
    gp.inter_post_gaps(v.posts_core, ["platform", "author_id"]).createOrReplaceTempView("post_gaps")
    return v.spark.sql("""SELECT platform, author_id, burstiness(count(gap_s), avg(gap_s), stddev_pop(gap_s)) AS burstiness
        FROM post_gaps GROUP BY platform, author_id""").withColumn("burstiness", r6("burstiness"))


@query("p04_gap_entropy", with_views(["v_gaps"], """
    SELECT c.platform, c.author_id, round(CASE WHEN any_value(total) < 2 THEN 1.0 ELSE -sum(n / total * log2(n / total)) / log2(12) END, 6) AS gap_entropy
    FROM gap_counts c JOIN gap_totals t ON c.platform = t.platform AND c.author_id = t.author_id GROUP BY c.platform, c.author_id""", {
    "gap_bins": "SELECT platform, author_id, least(floor(12 * log10(least(greatest(gap_s, 1.0), 86400.0)) / log10(86400.0)), 11) AS bin FROM v_gaps WHERE gap_s IS NOT NULL",
    "gap_counts": "SELECT platform, author_id, bin, count(*) AS n FROM gap_bins GROUP BY ALL",
    "gap_totals": "SELECT platform, author_id, sum(n) AS total FROM gap_counts GROUP BY ALL",
}))
def _(v: Views):
    registry.register_functions(v.spark)
    gp.inter_post_gaps(v.posts_core, ["platform", "author_id"]).createOrReplaceTempView("post_gaps")
    return v.spark.sql("""SELECT platform, author_id, gap_entropy(collect_list(n)) AS gap_entropy FROM (
        SELECT platform, author_id, gap_bin(gap_s) AS bin, count(*) AS n FROM post_gaps WHERE gap_s IS NOT NULL GROUP BY ALL)
        GROUP BY platform, author_id""").withColumn("gap_entropy", r6("gap_entropy"))


@query("p02_embed")
def _(v: Views):
    d = registry.embed(v.texts.select("doc_id", "text"), "doc_id")
    return d.select("doc_id", r6(F.array_max("vector").cast("double")).alias("top"))
