"""Ingest steps: dedupe, upsert, interaction edges, media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens import schemas
from driftlens.functions.text import nonblank
from driftlens.session import cut_lineage


def insert_posts_first_wins(batch: DataFrame, existing: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """New posts of a batch, one per (platform, post_id), earliest record kept.

    Keys that the batch repeats, and those that ``existing`` holds, are found on keys
    alone; the other posts stay where they are read, so that a text is shuffled only
    where its post comes again. ``seen`` is where the keys of the batch are read (the
    batch itself by default).
    """
    keys = ["platform", "post_id"]
    seen = (batch if seen is None else seen).select(*keys)
    # null keys are one key to an aggregate, but meet nothing in a join
    again = cut_lineage(seen.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "repeated")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    fresh = batch
    if not again.isEmpty():
        rest = [c for c in batch.columns if c not in keys]
        first = batch.join(again, same, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("ledger_seq")).alias("r"))
        fresh = batch.join(again, same, "left_anti").unionByName(first.select(*keys, "r.*").select(*batch.columns))
    if existing is None:
        return fresh
    known = cut_lineage(seen.join(existing.select(*keys), keys, "left_semi").distinct(), "known")
    return fresh if known.isEmpty() else fresh.join(known, keys, "left_anti")


def upsert_accounts_last_wins(accounts: DataFrame) -> DataFrame:
    """Newest row per (platform, account_id), replacing the whole row."""
    keys = ["platform", "account_id"]
    rest = [c for c in accounts.columns if c not in keys]
    last = accounts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("ledger_seq")).alias("r"))
    return last.select(*keys, "r.*").select(*accounts.columns)


def _authors_by_post(posts: DataFrame) -> DataFrame:
    """One author per post_id and a map by platform: the same platform is
    preferred, then the smallest platform name."""
    return posts.groupBy("post_id").agg(
        F.min_by(F.struct("platform", "author_id"), "platform").alias("any_author"),
        F.map_from_entries(F.collect_set(F.struct("platform", "author_id"))).alias("by_platform"),
    )


def _resolve(targets: DataFrame, posts: DataFrame) -> DataFrame:
    """Adds dst_platform/dst_account of ``target`` where that post is known.

    A post_id exists at most once per platform, so the per-id map has at most
    one entry per platform. Only ids that are referenced are looked up.
    """
    wanted = targets.select(F.col("target").alias("post_id")).distinct()
    known = _authors_by_post(posts.select("platform", "post_id", "author_id").join(wanted, "post_id", "left_semi"))
    joined = targets.join(known.withColumnRenamed("post_id", "target"), "target", "left")
    same = F.try_element_at("by_platform", F.col("src_platform"))
    return joined.select(
        *targets.columns,
        F.when(same.isNotNull(), F.col("src_platform")).otherwise(F.col("any_author.platform")).alias("_platform"),
        F.coalesce(same, F.col("any_author.author_id")).alias("_account"),
    )


def derive_edges(posts: DataFrame, accounts: DataFrame, known_posts: DataFrame | None = None) -> DataFrame:
    """Account-to-account interactions of ``posts``.

    reply 1.0 to the parent's author, repost 0.8 or forward 0.9 to the origin's
    author, mention 0.3. An unknown parent gives the account ``post:<id>``;
    edges to oneself are dropped. ``known_posts`` is where parents are looked
    up (the batch itself by default).
    """
    known_posts = posts if known_posts is None else known_posts
    base = [F.col("platform").alias("src_platform"), F.col("author_id").alias("src_account"),
            F.col("created_at").alias("ts"), "post_id"]
    is_repost = F.col("kind") == "repost"
    links = posts.select(
        *base,
        F.explode(F.filter(F.array(
            F.struct(nonblank(F.col("parent_post_id")).alias("target"), F.lit("reply").alias("kind"),
                     F.lit(1.0).alias("weight")),
            F.struct(nonblank(F.col("origin_post_id")).alias("target"),
                     F.when(is_repost, "repost").otherwise("forward").alias("kind"),
                     F.when(is_repost, 0.8).otherwise(0.9).alias("weight")),
        ), lambda x: x["target"].isNotNull())).alias("link"),
    ).select("src_platform", "src_account", "ts", "post_id", "link.*")
    resolved = _resolve(links, known_posts).select(
        "src_platform", "src_account",
        F.coalesce("_platform", "src_platform").alias("dst_platform"),
        F.coalesce("_account", F.concat(F.lit("post:"), "target")).alias("dst_account"),
        "kind", "ts", "post_id", "weight",
    )
    handles = (
        accounts.where(F.col("handle").isNotNull())
        .groupBy("handle")
        .agg(F.min(F.struct("platform", "account_id")).alias("a"))
    )
    mentions = (
        posts.select(*base, F.explode("mentions").alias("handle"))
        .join(handles, "handle", "left")
        .select(
            "src_platform", "src_account",
            F.coalesce("a.platform", "src_platform").alias("dst_platform"),
            F.coalesce("a.account_id", "handle").alias("dst_account"),
            F.lit("mention").alias("kind"), "ts", "post_id", F.lit(0.3).alias("weight"),
        )
    )
    edges = resolved.unionByName(mentions)
    return edges.where(F.col("dst_account") != F.col("src_account")).select(*schemas.EDGES.fieldNames())


def resolve_pending_edges(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """Edges whose ``post:<id>`` target has arrived since, pointed at its author."""
    pending = edges.where(F.col("dst_account").startswith("post:"))
    settled = edges.where(~F.col("dst_account").startswith("post:"))
    resolved = _resolve(pending.withColumn("target", F.right(F.col("dst_account"), F.length(F.col("dst_account")) - 5)), posts)
    fixed_up = resolved.select(
        "src_platform", "src_account",
        F.coalesce("_platform", "dst_platform").alias("dst_platform"),
        F.coalesce("_account", "dst_account").alias("dst_account"),
        "kind", "ts", "post_id", "weight",
    )
    everything = settled.select(*fixed_up.columns).unionByName(fixed_up)
    return everything.where(F.col("dst_account") != F.col("src_account"))


def read_media_files(spark, path: str) -> DataFrame:
    """(local_path, content) of media files under a directory."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("local_path"), "content")


def attach_media(refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, post_media) of posts' media references.

    ``refs``: platform, post_id, media_id?, kind?, url?, local_path. ``files``:
    local_path, content. Files are digested once each, before the join, so the
    bytes never shuffle. The media id defaults to 16 hex digits of the digest.
    """
    digests = files.select("local_path", F.sha2("content", 256).alias("sha256"))
    hits = refs.join(digests, "local_path")
    media_id = F.coalesce(nonblank(F.col("media_id")), F.substring("sha256", 1, 16))
    hits = hits.withColumn("media_id", media_id).withColumn("kind", F.coalesce("kind", F.lit("image")))
    media = (
        hits.groupBy("media_id")
        .agg(F.min(F.struct("local_path", "kind", "url", "sha256")).alias("m"))
        .select("media_id", "m.kind", "m.url", "m.local_path", "m.sha256")
    )
    return media, hits.select("platform", "post_id", "media_id")


def source_counts(raw: DataFrame) -> DataFrame:
    """Records and newest collection time per platform."""
    return raw.groupBy("platform").agg(
        F.count("*").alias("records"), F.max("collected_at").alias("last_record")
    )


def export_graph(edges: DataFrame, coordination: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) tables for an external graph store: every account with
    its highest coordination score (NULL when never scored)."""
    ends = edges.select(F.col("src_platform").alias("platform"), F.col("src_account").alias("account_id")).union(
        edges.select("dst_platform", "dst_account")
    ).distinct()
    top = coordination.groupBy("platform", "account_id").agg(F.max("score").alias("coord_score"))
    nodes = ends.join(top, ["platform", "account_id"], "left")
    return nodes, edges.select("src_platform", "src_account", "dst_platform", "dst_account", "kind", "ts", "weight")
