"""Sources, normalisation and ingest."""

from pyspark.sql import functions as F

from driftlens.functions.time import parse_event_time
from driftlens.plans.catalog import joined, query, sql_ts, ts
from driftlens.plans.views import Views, with_views
from driftlens.sources import csv_import, flatten, ingest, normalize, replay
from driftlens.streaming import streams

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


# -- payloads in each platform's shape, built from the posts -----------------
def _raw(d, platform: str, payload, collector: str = "landing"):
    return d.select(
        F.lit(platform).alias("platform"), F.lit(collector).alias("collector_id"), F.col("created_at").alias("collected_at"),
        F.to_json(payload).alias("payload"), "ledger_seq",
    )


def _tagged():
    return F.concat("text", F.lit(" #"), F.get("hashtags", F.lit(0)))


def native_x(v: Views):
    origin = F.when(F.col("origin_post_id").isNotNull(), F.struct(F.col("origin_post_id").alias("id")))
    user = F.struct(F.col("author_id").alias("id"), F.concat(F.lit("u"), "author_id").alias("username"),
                    (F.col("user_id") * 3).alias("followersCount"), F.lit("2019-03-02T10:00:00+00:00").alias("created"))
    payload = F.struct(
        F.col("post_id").alias("id"), F.date_format("created_at", ISO).alias("date"), _tagged().alias("rawContent"),
        F.col("parent_post_id").alias("inReplyToTweetId"), origin.alias("retweetedTweet"),
        F.col("event_id").alias("likeCount"), user.alias("user"),
    )
    return _raw(v.posts.where("platform = 'x'"), "x", payload)


def native_telegram(v: Views):
    header = F.when(F.col("origin_post_id").isNotNull(), F.struct(
        F.concat(F.lit("c"), "origin_post_id").alias("from_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("channel_post")))
    payload = F.struct(
        F.col("event_id").alias("id"), F.date_format("created_at", ISO).alias("date"), F.col("text"),
        F.concat(F.lit("@ch"), (F.col("user_id") % 7).cast("string")).alias("channel"),
        F.when(F.col("event_id") % 3 > 0, F.col("author_id")).alias("from_id"), header.alias("fwd_from"),
        F.col("parent_post_id").alias("reply_to"), F.col("event_id").alias("views"),
    )
    return _raw(v.posts.where("platform = 'telegram'"), "telegram", payload)


def native_reddit(v: Views):
    payload = F.struct(
        F.col("post_id").alias("id"), F.concat(F.lit("u"), "author_id").alias("author"), F.col("text").alias("body"),
        F.unix_seconds("created_at").alias("created_utc"),
        F.when(F.col("parent_post_id").isNotNull(), F.concat(F.lit("t1_"), "parent_post_id")).otherwise("").alias("parent_id"),
        F.concat(F.lit("sub"), (F.col("user_id") % 5).cast("string")).alias("subreddit"), F.col("event_id").alias("score"),
    )
    return _raw(v.posts.where("platform = 'reddit'"), "reddit", payload)


def native_youtube(v: Views):
    payload = F.struct(
        F.col("post_id").alias("id"), F.concat(F.lit("u"), "author_id").alias("author"), F.col("text").alias("textDisplay"),
        F.date_format("created_at", ISO).alias("published_at"), F.col("parent_post_id").alias("parent_id"),
        F.concat(F.lit("vid"), (F.col("event_id") % 9).cast("string")).alias("video_id"), F.col("event_id").alias("likes"),
    )
    return _raw(v.posts.where("platform = 'youtube'"), "youtube", payload)


def canonical_records(v: Views, collector: str = "replay"):
    """Every post in canonical field names; forwards carry an unknown platform."""
    shown = F.when(F.col("kind") == "forward", "elsewhere").otherwise(F.col("platform"))
    account = F.struct(F.col("author_id").alias("account_id"), F.concat(F.lit("u"), "author_id").alias("handle"),
                       (F.col("user_id") * 2).alias("followers"))
    payload = F.struct(
        shown.alias("platform"), F.concat(F.lit("p"), "post_id").alias("post_id"), "author_id",
        F.when(F.col("kind") == "comment", "note").otherwise(F.col("kind")).alias("kind"), F.col("text"),
        F.date_format("created_at", ISO).alias("created_at"), "parent_post_id", "origin_post_id",
        F.transform("hashtags", lambda t: F.concat(F.lit("#"), t)).alias("hashtags"), "mentions", account.alias("account"),
    )
    return v.posts.select(
        F.col("platform"), F.lit(collector).alias("collector_id"), F.col("created_at").alias("collected_at"),
        F.to_json(payload).alias("payload"), "ledger_seq",
    )


def _show(d):
    """Posts in comparable columns: the text as its digest."""
    return d.select(
        "platform", "post_id", "author_id", "kind", F.md5("text").alias("text_md5"), ts("created_at").alias("created_at"),
        F.coalesce("parent_post_id", F.lit("")).alias("parent_post_id"), F.coalesce("origin_post_id", F.lit("")).alias("origin_post_id"),
        F.coalesce("channel", F.lit("")).alias("channel"), joined("hashtags").alias("hashtags"),
        F.coalesce(F.try_element_at(F.map_values("metrics"), F.lit(1)), F.lit(-1.0)).alias("metric"),
    )


def _sql_show(platform, post_id, author, kind, text, parent, origin, channel, tags, metric, where="", views="v_posts") -> str:
    return with_views([views], f"""
        SELECT {platform} AS platform, {post_id} AS post_id, {author} AS author_id, {kind} AS kind, md5({text}) AS text_md5,
          {sql_ts('created_at')} AS created_at, coalesce({parent}, '') AS parent_post_id, coalesce({origin}, '') AS origin_post_id,
          {channel} AS channel, {tags} AS hashtags, CAST({metric} AS DOUBLE) AS metric FROM {views} {where}""")


@query("s01_read_replay_jsonl", with_views(["v_posts"], f"""
    SELECT CASE WHEN kind = 'forward' THEN 'elsewhere' ELSE platform END AS platform, count(*) AS records,
      min({sql_ts('created_at')}) AS first_created, max({sql_ts('created_at')}) AS last_created FROM v_posts GROUP BY 1"""))
def _(v: Views):
    def write(path: str) -> None:
        lines = canonical_records(v).select(F.explode(F.array(
            F.concat(F.lit("# record "), F.col("ledger_seq").cast("string")), F.lit(""), F.col("payload"))).alias("value"))
        lines.write.text(path)

    d = replay.read_replay_jsonl(v.spark, v.files("replay_lines", write))
    at = F.date_format(F.to_timestamp("created_at"), "yyyy-MM-dd HH:mm:ss")
    return d.groupBy("platform").agg(F.count("*").alias("records"), F.min(at).alias("first_created"), F.max(at).alias("last_created"))


_X_KIND = "CASE WHEN parent_post_id IS NOT NULL THEN 'reply' WHEN origin_post_id IS NOT NULL THEN 'repost' ELSE 'post' END"


@query("s02_normalize_x", _sql_show("'x'", "post_id", "author_id", _X_KIND, "text || ' #' || tag", "parent_post_id", "origin_post_id",
                                    "''", "tag", "event_id", "WHERE platform = 'x'"))
def _(v: Views):
    return _show(normalize.normalize_x(native_x(v)).select("post.*"))


@query("s03_normalize_telegram", _sql_show(
    "'telegram'", "'@ch' || CAST(user_id % 7 AS VARCHAR) || '_' || post_id",
    "CASE WHEN event_id % 3 > 0 THEN author_id ELSE '@ch' || CAST(user_id % 7 AS VARCHAR) END",
    "CASE WHEN origin_post_id IS NOT NULL THEN 'forward' WHEN parent_post_id IS NOT NULL THEN 'reply' ELSE 'post' END", "text",
    "'@ch' || CAST(user_id % 7 AS VARCHAR) || '_' || parent_post_id",
    "'c' || origin_post_id || CASE WHEN event_id % 2 = 0 THEN '_' || CAST(event_id AS VARCHAR) ELSE '' END",
    "'@ch' || CAST(user_id % 7 AS VARCHAR)", "''", "event_id", "WHERE platform = 'telegram'"))
def _(v: Views):
    return _show(normalize.normalize_telegram(native_telegram(v)).select("post.*"))


@query("s04_normalize_reddit", _sql_show(
    "'reddit'", "post_id", "'u' || author_id", "CASE WHEN parent_post_id IS NOT NULL THEN 'comment' ELSE 'post' END", "text",
    "parent_post_id", "''", "'sub' || CAST(user_id % 5 AS VARCHAR)", "''", "event_id", "WHERE platform = 'reddit'"))
def _(v: Views):
    return _show(normalize.normalize_reddit(native_reddit(v)).select("post.*"))


@query("s05_normalize_youtube", _sql_show(
    "'youtube'", "post_id", "'u' || author_id", "CASE WHEN parent_post_id IS NOT NULL THEN 'reply' ELSE 'comment' END", "text",
    "parent_post_id", "''", "'vid' || CAST(event_id % 9 AS VARCHAR)", "''", "event_id", "WHERE platform = 'youtube'"))
def _(v: Views):
    return _show(normalize.normalize_youtube(native_youtube(v)).select("post.*"))


_CANON_PLATFORM = "CASE WHEN kind = 'forward' THEN 'synthetic' ELSE platform END"
_CANON_KIND = "CASE WHEN kind = 'comment' THEN 'post' ELSE kind END"


@query("s06_normalize_canonical", _sql_show(_CANON_PLATFORM, "'p' || post_id", "author_id", _CANON_KIND, "text", "parent_post_id",
                                            "origin_post_id", "''", "tag", "-1"))
def _(v: Views):
    return _show(normalize.normalize_canonical(canonical_records(v)).select("post.*"))


_ROUTED_SQL = f"""
    SELECT platform, kind, count(*) AS posts, count(DISTINCT author) AS authors FROM (
      SELECT {_CANON_PLATFORM} AS platform, {_CANON_KIND} AS kind, author_id AS author FROM v_core
      UNION ALL SELECT platform, CASE platform WHEN 'x' THEN {_X_KIND}
        WHEN 'telegram' THEN CASE WHEN origin_post_id IS NOT NULL THEN 'forward' WHEN parent_post_id IS NOT NULL THEN 'reply' ELSE 'post' END
        WHEN 'reddit' THEN CASE WHEN parent_post_id IS NOT NULL THEN 'comment' ELSE 'post' END
        ELSE CASE WHEN parent_post_id IS NOT NULL THEN 'reply' ELSE 'comment' END END,
        CASE platform WHEN 'x' THEN author_id WHEN 'telegram' THEN CASE WHEN event_id % 3 > 0 THEN author_id ELSE '@ch' || CAST(user_id % 7 AS VARCHAR) END
        ELSE 'u' || author_id END FROM v_core) GROUP BY 1, 2"""


def mixed_records(v: Views):
    d = native_x(v)
    for other in (native_telegram(v), native_reddit(v), native_youtube(v), canonical_records(v)):
        d = d.unionByName(other)
    return d


@query("s07_normalize_router", with_views(["v_core"], _ROUTED_SQL))
def _(v: Views):
    d = normalize.normalize(mixed_records(v)).select("post.*")
    return d.groupBy("platform", "kind").agg(F.count("*").alias("posts"), F.countDistinct("author_id").alias("authors"))


@query("s08_explode_comment_threads", """
    SELECT 'c' || conv_id || '.' || turn AS id, 'v' || conv_id AS video_id, role AS author, md5(text) AS text_md5,
      CASE WHEN turn % 2 = 1 THEN 'c' || conv_id || '.' || (turn - 1) ELSE '' END AS parent_id
    FROM conversations c WHERE turn % 2 = 0 OR EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)""")
def _(v: Views):
    """A thread is an even turn with the next turn as its reply."""
    c = v.table("conversations")

    def comment(d, p):
        cid = F.concat(F.lit("c"), F.col(f"{p}conv_id").cast("string"), F.lit("."), F.col(f"{p}turn").cast("string"))
        snippet = F.struct(F.col(f"{p}role").alias("authorDisplayName"), F.col(f"{p}text").alias("textOriginal"))
        return F.struct(cid.alias("id"), snippet.alias("snippet"))

    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.struct("conv_id", "turn", "role", "text").alias("n"))
    d = c.where("turn % 2 = 0").join(nxt, ["conv_id", "turn"], "left")
    replies = F.when(F.col("n").isNotNull(), F.struct(F.array(comment(d, "n.")).alias("comments")))
    thread = F.struct(F.struct(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("videoId"), comment(d, "").alias("topLevelComment")).alias("snippet"),
                      replies.alias("replies"))
    out = flatten.explode_comment_threads(d.select(F.to_json(thread).alias("thread")))
    return out.select("id", "video_id", "author", F.md5("text").alias("text_md5"), F.coalesce("parent_id", F.lit("")).alias("parent_id"))


@query("s09_flatten_submissions", """
    SELECT CAST(page_id AS VARCHAR) AS id, md5(trim(url || chr(10) || html, chr(10) || chr(9) || chr(13) || ' ')) AS text_md5, '' AS parent_id FROM pages""")
def _(v: Views):
    p = v.table("pages")
    rows = p.select(F.col("page_id").cast("string").alias("id"), F.lit("u").alias("author"), F.concat(F.lit(" "), "url").alias("title"),
                    F.col("html").alias("selftext"), F.lit(0.0).alias("created_utc"), F.lit("s").alias("subreddit"), F.lit(1).alias("score"))
    return flatten.flatten_submissions(rows).select("id", F.md5("selftext").alias("text_md5"), "parent_id")


@query("s10_flatten_messages", with_views(["v_core"], """
    SELECT post_id AS id, CASE event_id % 3 WHEN 0 THEN 'ch' WHEN 1 THEN 'us' ELSE 'gr' END || author_id AS from_id,
      coalesce('o' || origin_post_id, '') AS fwd_from, coalesce(parent_post_id, '') AS reply_to, event_id % 2 = 0 AS has_media FROM v_core"""))
def _(v: Views):
    m = F.col("event_id") % 3
    peer = F.struct(F.when(m == 0, F.concat(F.lit("ch"), "author_id")).alias("channel_id"),
                    F.when(m == 1, F.concat(F.lit("us"), "author_id")).alias("user_id"),
                    F.when(m == 2, F.concat(F.lit("gr"), "author_id")).alias("chat_id"))
    none = F.lit(None).cast("string")
    origin = F.struct(F.concat(F.lit("o"), "origin_post_id").alias("channel_id"), none.alias("user_id"), none.alias("chat_id"))
    fwd = F.when(F.col("origin_post_id").isNotNull(), F.struct(origin.alias("from_id"), F.lit(1).alias("channel_post"), none.alias("date")))
    rows = v.posts_core.select(
        F.col("post_id").alias("id"), ts("created_at").alias("date"), F.lit("m").alias("message"), F.lit(1).alias("views"), F.lit(1).alias("forwards"),
        F.lit("@c").alias("channel"), peer.alias("from_id"), fwd.alias("fwd_from"), F.col("parent_post_id").alias("reply_to_msg_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("photo")).alias("media"))
    out = flatten.flatten_messages(rows)
    return out.select("id", "from_id", F.coalesce("fwd_from.from_id", F.lit("")).alias("fwd_from"),
                      F.coalesce("reply_to", F.lit("")).alias("reply_to"), "has_media")


@query("s11_import_export_csv", with_views(["v_core"], f"""
    SELECT 'facebook' AS platform, 'f' || post_id AS post_id, 'u' || author_id AS author_id,
      CASE kind WHEN 'repost' THEN 'repost' WHEN 'reply' THEN 'reply' WHEN 'comment' THEN 'comment' ELSE 'post' END AS kind, tag AS text,
      {sql_ts("CASE WHEN event_id % 2 = 0 THEN created_at - INTERVAL 330 MINUTE ELSE created_at END")} AS created_at, CAST(event_id AS DOUBLE) AS shares FROM v_core"""))
def _(v: Views):
    kinds = F.when(F.col("kind") == "repost", "Share").when(F.col("kind") == "forward", "Photo").when(F.col("kind") == "post", "Status").otherwise(F.col("kind"))
    stamp = F.when(F.col("event_id") % 2 == 0, F.concat(ts("created_at"), F.lit(" IST"))).otherwise(F.unix_seconds("created_at").cast("string"))

    def write(path: str) -> None:
        d = v.posts_core.select(
            F.concat(F.lit("f"), "post_id").alias("ID"), F.lit("").alias("Page Name"), F.concat(F.lit("u"), "author_id").alias("User Name"),
            stamp.alias("Post Created"), kinds.alias("Type"), F.get("hashtags", F.lit(0)).alias("Message"), F.col("event_id").alias("Shares"))
        d.write.option("header", "true").csv(path)

    out = csv_import.import_export_csv(v.spark, v.files("export_csv", write), "facebook", "export.csv").select("payload.*")
    return out.select("platform", "post_id", "author_id", "kind", "text", ts("created_at").alias("created_at"),
                      F.try_element_at("metrics", F.lit("shares")).alias("shares"))


@query("s12_parse_event_time", with_views(["v_core"], f"""
    SELECT post_id, {sql_ts("CASE event_id % 5 WHEN 0 THEN created_at - INTERVAL 330 MINUTE WHEN 3 THEN CAST(date_trunc('day', created_at) AS TIMESTAMP) ELSE created_at END")} AS parsed
    FROM v_core"""))
def _(v: Views):
    m = F.col("event_id") % 5
    text = (
        F.when(m == 0, F.concat(ts("created_at"), F.lit(" IST"))).when(m == 1, F.unix_seconds("created_at").cast("string"))
        .when(m == 2, ts("created_at")).when(m == 3, F.date_format("created_at", "yyyy-MM-dd"))
        .otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return v.posts_core.select("post_id", ts(parse_event_time(text)).alias("parsed"))


@query("s13_insert_posts_first_wins", with_views(["v_core"], "SELECT platform, post_id, author_id, ledger_seq FROM v_core"))
def _(v: Views):
    first = v.posts_core.select("platform", "post_id", "author_id", "ledger_seq")
    again = first.select("platform", "post_id", F.lit("late").alias("author_id"), (F.col("ledger_seq") + 1_000_000_000).alias("ledger_seq"))
    return ingest.insert_posts_first_wins(again.unionByName(first))


@query("s14_upsert_accounts_last_wins", with_views(["v_accounts"], "SELECT platform, account_id, handle || '+' AS handle, followers FROM v_accounts"))
def _(v: Views):
    old = v.accounts.select("platform", "account_id", "handle", F.lit(0).cast("bigint").alias("followers"), F.lit(1).alias("ledger_seq"))
    new = v.accounts.select("platform", "account_id", F.concat("handle", F.lit("+")).alias("handle"), "followers", F.lit(2).alias("ledger_seq"))
    return ingest.upsert_accounts_last_wins(new.unionByName(old)).drop("ledger_seq")


_EDGE_COLUMNS = f"src_platform, src_account, dst_platform, dst_account, kind, {sql_ts('ts')} AS ts, post_id, CAST(weight AS DOUBLE) AS weight"


def _edges(d):
    return d.select("src_platform", "src_account", "dst_platform", "dst_account", "kind", ts("ts").alias("ts"), "post_id", "weight")


@query("s15_derive_edges", with_views(["v_edges"], f"SELECT {_EDGE_COLUMNS} FROM v_edges"))
def _(v: Views):
    return _edges(ingest.derive_edges(v.posts_core, v.accounts))


@query("s16_resolve_pending_edges", with_views(["v_edges"], f"SELECT {_EDGE_COLUMNS} FROM v_edges WHERE kind <> 'mention'"))
def _(v: Views):
    """Every edge starts pending: no parent is known at derive time."""
    plain = v.posts_core.withColumn("mentions", F.array().cast("array<string>"))
    pending = ingest.derive_edges(plain, v.accounts, known_posts=v.posts_core.where("false"))
    return _edges(ingest.resolve_pending_edges(pending, v.posts_core))


@query("s17_attach_media", """
    SELECT CASE WHEN page_id % 2 = 0 THEN substr(sha256(html), 1, 16) ELSE 'm' || page_id END AS media_id, min(sha256(html)) AS sha256, count(*) AS posts
    FROM pages GROUP BY 1""")
def _(v: Views):
    p = v.table("pages")
    key = F.col("page_id").cast("string")
    refs = p.select(F.lit("x").alias("platform"), key.alias("post_id"), F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("m"), key)).alias("media_id"),
                    F.lit(None).cast("string").alias("kind"), F.col("url"), key.alias("local_path"))
    media, links = ingest.attach_media(refs, p.select(key.alias("local_path"), F.encode("html", "UTF-8").alias("content")))
    return media.join(links, "media_id").groupBy("media_id", "sha256").agg(F.count("*").alias("posts"))


@query("s18_ingest_stream", with_views(["v_core"], _ROUTED_SQL))
def _(v: Views):
    """A stream over landed raw records into the posts table."""
    def run(path: str) -> None:
        landing = v.files("landing", lambda p: mixed_records(v).write.option("compression", "zstd").parquet(p))
        raw = v.spark.readStream.schema(v.spark.read.parquet(landing).schema).parquet(landing)
        streams.ingest_stream(raw, path, f"{path}_checkpoint").awaitTermination()

    d = v.spark.read.parquet(v.files("ingested", run) + "/posts")
    return d.groupBy("platform", "kind").agg(F.count("*").alias("posts"), F.countDistinct("author_id").alias("authors"))


@query("s19_export_graph", with_views(["v_edges", "v_coord"], """
    SELECT platform, account_id, coalesce(score, -1.0) AS coord_score FROM (SELECT src_platform AS platform, src_account AS account_id FROM v_edges
      UNION SELECT dst_platform, dst_account FROM v_edges) LEFT JOIN (SELECT platform, account_id, max(score) AS score FROM v_coord GROUP BY 1, 2)
      USING (platform, account_id)"""))
def _(v: Views):
    nodes, _edges_out = ingest.export_graph(v.edges, v.coord_accounts)
    return nodes.withColumn("coord_score", F.coalesce("coord_score", F.lit(-1.0)))


@query("s20_source_counts", with_views(["v_records"], "SELECT platform, count(*) AS records, max(collected_at) AS last_record FROM v_records GROUP BY 1"))
def _(v: Views):
    return ingest.source_counts(v.records)
