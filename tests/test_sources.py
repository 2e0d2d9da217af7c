"""Normalisers, imports, edges and streams on documented payload shapes."""

import json

from pyspark.sql import functions as F

from driftlens import schemas
from driftlens.sources import csv_import, flatten, ingest, normalize, replay
from driftlens.streaming import streams

AT = "2024-11-07T17:00:00+00:00"


def raw(spark, *records):
    rows = [(p, c, json.dumps(x)) for p, c, x in records]
    return spark.createDataFrame(rows, "platform STRING, collector_id STRING, payload STRING").withColumn(
        "collected_at", F.to_timestamp(F.lit(AT)))


def test_native_payloads(spark):
    d = normalize.normalize(raw(
        spark,
        ("x", "live", {"id": 18, "date": AT, "rawContent": "see #Dam @city", "user": {"id": 9, "username": "w", "followersCount": 5400},
                       "inReplyToTweetId": None, "quotedTweet": {"id": 17}, "likeCount": 120}),
        ("telegram", "live", {"id": 5012, "date": AT, "text": "t", "channel": "@v", "from_id": None, "views": 18,
                              "fwd_from": {"from_id": "1300", "channel_post": 811}}),
        ("reddit", "live", {"id": "kq", "author": "p", "body": "b", "created_utc": 1730998800.0, "parent_id": "t1_kq3x1aa", "subreddit": "pune"}),
        ("youtube", "live", {"id": "U1", "author": "a", "text": "q", "published_at": AT, "parent_id": "U0", "video_id": "v"}),
        ("x", "replay", {"platform": "nope", "post_id": "1", "author_id": "2", "kind": "odd", "text": "hi #a", "created_at": AT,
                         "account": {"account_id": "2", "handle": "h"}}),
    ))
    posts = {r["post_id"]: r for r in d.select("post.*").collect()}
    x = posts["18"]
    assert (x["kind"], x["origin_post_id"], x["hashtags"], x["mentions"], x["metrics"]["likes"]) == ("quote", "17", ["Dam"], ["city"], 120.0)
    t = posts["@v_5012"]
    assert (t["kind"], t["origin_post_id"], t["author_id"]) == ("forward", "1300_811", "@v")
    r = posts["kq"]
    assert (r["kind"], r["parent_post_id"], r["channel"], str(r["created_at"])) == ("comment", "kq3x1aa", "pune", "2024-11-07 17:00:00")
    assert posts["U1"]["kind"] == "reply"
    assert (posts["1"]["platform"], posts["1"]["kind"], posts["1"]["synthetic"]) == ("synthetic", "post", True)
    accounts = {r["account_id"]: r for r in normalize.accounts_of(d).collect()}
    assert accounts["9"]["followers"] == 5400 and accounts["2"]["handle"] == "h" and "p" in accounts


def test_threads_and_replay(spark, tmp_path):
    item = {"id": "T", "snippet": {"videoId": "v", "topLevelComment": {"id": "T", "snippet": {"authorChannelId": {"value": "U"}, "textOriginal": "q"}}},
            "replies": {"comments": [{"id": "T.R", "snippet": {"authorDisplayName": "m", "textDisplay": "no"}}]}}
    rows = flatten.explode_comment_threads(spark.createDataFrame([(json.dumps(item),)], "thread STRING")).collect()
    assert [(r["id"], r["author"], r["parent_id"]) for r in rows] == [("T", "U", None), ("T.R", "m", "T")]
    f = tmp_path / "r.jsonl"
    f.write_text('# note\n\n{"platform":"x","created_at":"2024-02-01"}\n{"created_at":"2024-01-01"}\n')
    got = replay.read_replay_jsonl(spark, str(f)).collect()
    assert [(r["platform"], r["created_at"]) for r in got] == [("synthetic", "2024-01-01"), ("x", "2024-02-01")]


def test_export_csv(spark, tmp_path):
    f = tmp_path / "e.csv"
    f.write_text("Page Name,User Name,Post Created,Type,Message,Shares,URL\n"
                 'P,u,2024-11-07 17:20:00 IST,Photo,"two\nlines",85,http://f/1\nQ,,2024-11-07,Share,m,,\n')
    rows = [r["payload"] for r in csv_import.import_export_csv(spark, str(f), "facebook", "e.csv").collect()]
    assert (rows[0]["author_id"], rows[0]["post_id"], rows[0]["metrics"], rows[0]["text"]) == ("u", "http://f/1", {"shares": 85.0}, "two\nlines")
    import hashlib
    assert rows[1]["post_id"] == hashlib.sha256(b"e.csv:1:m").hexdigest()[:16]
    assert (rows[1]["author_id"], rows[1]["kind"]) == ("Q", "repost")


def posts_frame(spark, rows):
    """(platform, post_id, author, kind, parent, origin, mentions, seconds)"""
    d = spark.createDataFrame(rows, "platform STRING, post_id STRING, author_id STRING, kind STRING, parent_post_id STRING, "
                                    "origin_post_id STRING, mentions ARRAY<STRING>, s BIGINT")
    return d.withColumn("created_at", F.timestamp_seconds("s"))


def test_edges_and_repair(spark):
    p = posts_frame(spark, [
        ("x", "1", "a", "post", None, None, [], 0), ("x", "2", "b", "reply", "1", None, ["carol"], 1),
        ("x", "3", "b", "repost", None, "1", [], 2), ("x", "4", "a", "reply", "1", None, [], 3), ("x", "5", "c", "reply", "99", None, [], 4)])
    accounts = spark.createDataFrame([("x", "c", "carol")], "platform STRING, account_id STRING, handle STRING")
    got = {(r["src_account"], r["dst_account"], r["kind"], r["weight"]) for r in ingest.derive_edges(p, accounts).collect()}
    assert got == {("b", "a", "reply", 1.0), ("b", "c", "mention", 0.3), ("b", "a", "repost", 0.8), ("c", "post:99", "reply", 1.0)}
    late = posts_frame(spark, [("x", "99", "z", "post", None, None, [], 9)])
    fixed = ingest.resolve_pending_edges(ingest.derive_edges(p, accounts), late)
    assert ("c", "z") in {(r["src_account"], r["dst_account"]) for r in fixed.collect()}


def test_stream_ingest_resumes(spark, tmp_path):
    land, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def put(i):
        raw(spark, ("x", "live", {"id": i, "date": AT, "rawContent": f"t{i}", "user": {"id": 1, "username": "u"},
                                  "inReplyToTweetId": i - 1 if i > 1 else None})).write.mode("append").parquet(land)

    def run():
        s = spark.readStream.schema(spark.read.parquet(land).schema).parquet(land)
        streams.ingest_stream(s, out, cp).awaitTermination()

    put(1), put(2), run()
    put(2), put(3), run()
    posts = streams.read_or_empty(spark, f"{out}/posts", schemas.POSTS)
    assert sorted(r["post_id"] for r in posts.collect()) == ["1", "2", "3"]


def test_first_wins_shuffles_no_text(spark):
    """Repeated keys (null ones too) keep their earliest record; posts that come once are not
    moved by an exchange."""
    rows = [("x", "1", "late", 5), ("x", "1", "early", 2), ("x", None, "null late", 9), ("x", None, "null early", 3), ("x", "2", "old", 4), ("y", "1", "other", 7)]
    d = spark.createDataFrame(rows, "platform STRING, post_id STRING, text STRING, ledger_seq BIGINT")
    got = {(r["platform"], r["post_id"], r["text"]) for r in ingest.insert_posts_first_wins(d, d.where("post_id = '2'")).collect()}
    assert got == {("x", "1", "early"), ("x", None, "null early"), ("y", "1", "other")}
    once = ingest.insert_posts_first_wins(d.where("text IN ('early', 'old', 'other')"), d.where("text = 'old'"))
    assert {r["text"] for r in once.collect()} == {"early", "other"}
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
