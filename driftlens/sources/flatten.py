"""Nested API objects to the flat payloads the normalisers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens import schemas


def _comment(c: Column, video_id: Column, parent: Column) -> Column:
    s = c["snippet"]
    text = F.coalesce(
        F.when(s["textOriginal"] != "", s["textOriginal"]),
        F.when(s["textDisplay"] != "", s["textDisplay"]),
        F.lit(""),
    )
    return F.struct(
        c["id"].alias("id"),
        video_id.alias("video_id"),
        F.coalesce(s["authorChannelId"]["value"], s["authorDisplayName"]).alias("author"),
        s["authorDisplayName"].alias("author_name"),
        text.alias("text"),
        s["publishedAt"].alias("published_at"),
        F.coalesce(s["likeCount"], F.lit(0)).alias("likes"),
        parent.cast("string").alias("parent_id"),
    )


def explode_comment_threads(threads: DataFrame, thread: str = "thread") -> DataFrame:
    """Video comment threads (JSON text): the top comment, then each reply with
    the top comment as its parent."""
    t = F.from_json(thread, schemas.YOUTUBE_THREAD)
    d = threads.select(t.alias("t")).select(
        F.col("t.snippet.topLevelComment").alias("top"),
        F.col("t.snippet.videoId").alias("video_id"),
        F.coalesce(F.col("t.replies.comments"), F.array().cast(schemas.YOUTUBE_THREAD["replies"].dataType["comments"].dataType)).alias("replies"),
    )
    top = _comment(F.col("top"), F.col("video_id"), F.lit(None))
    replies = F.transform("replies", lambda r: _comment(r, F.col("video_id"), F.col("top.id")))
    return d.select(F.explode(F.concat(F.array(top), replies)).alias("c")).select("c.*")


def flatten_submissions(rows: DataFrame) -> DataFrame:
    """Forum submissions: text is title, newline, body, trimmed."""
    text = F.regexp_replace(
        F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))),
        r"(?U)^\s+|\s+$", "",
    )
    return rows.select(
        "id", "author", text.alias("selftext"), "created_utc", F.lit("").alias("parent_id"), "subreddit", "score"
    )


def flatten_comments(rows: DataFrame) -> DataFrame:
    return rows.select("id", "author", "body", "created_utc", "link_id", "parent_id", "subreddit", "score")


def _peer_id(peer: Column) -> Column:
    return F.coalesce(*[peer[f].cast("string") for f in ("channel_id", "user_id", "chat_id")])


def flatten_messages(rows: DataFrame) -> DataFrame:
    """Channel messages: structured sender and forward header to plain ids.

    Expects id, date, message, views, forwards, channel, from_id STRUCT,
    fwd_from STRUCT<from_id STRUCT, channel_post, date>, reply_to_msg_id, media.
    """
    fwd = F.col("fwd_from")
    header = F.when(
        fwd.isNotNull(),
        F.struct(
            _peer_id(fwd["from_id"]).alias("from_id"),
            fwd["channel_post"].alias("channel_post"),
            fwd["date"].alias("date"),
        ),
    )
    return rows.select(
        "id", "date", F.coalesce("message", F.lit("")).alias("text"), "views", "forwards", "channel",
        _peer_id(F.col("from_id")).alias("from_id"), header.alias("fwd_from"),
        F.col("reply_to_msg_id").alias("reply_to"), F.col("media").isNotNull().alias("has_media"),
    )
