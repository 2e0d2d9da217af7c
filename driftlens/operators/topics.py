"""Topics: windowed clusters, matching across windows, keywords and labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import text as tx
from driftlens.functions.numeric import cosine
from driftlens.functions.sequence import numbered, top_n_per_group
from driftlens.operators.filters import POST_KEY
from driftlens.operators.linkage import average_clusters
from driftlens.operators.links import _unit_rows, hash_embed, near_groups, similar_pairs
from driftlens.session import cut_lineage

MIN_POSTS = 15
TOGETHER = 1 << 13  # clusters and topics of a task: 8,192 x 384 x 8 bytes = 25 MB


def centroid(vectors: DataFrame, keys: list[str], vector: str = "vector", weight: str | None = None) -> DataFrame:
    """(keys, n, vector): mean vector per key, optionally weighted.

    Summed with the vectorised Summarizer, whose partial results combine
    map-side: one dense vector per key and task is shuffled.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(vector).cast("array<double>"))
    mean = Summarizer.mean(v, F.col(weight)) if weight else Summarizer.mean(v)
    d = vectors.groupBy(*keys).agg(
        (F.sum(weight) if weight else F.count("*")).cast("bigint").alias("n"), mean.alias("_mean")
    )
    return d.select(*keys, "n", vector_to_array("_mean").alias("vector"))


def merge_centroids(a_vec, a_n, b_vec, b_n):
    """Running mean of two centroids weighted by size (Columns)."""
    return F.zip_with(a_vec, b_vec, lambda x, y: (x * a_n + y * b_n) / (a_n + b_n))


def window_number(posts: DataFrame, hours: int = 24) -> DataFrame:
    """Posts plus ``window``: whole windows since the first post."""
    first = posts.agg(F.min("created_at")).first()[0]
    micros = F.unix_micros("created_at") - F.unix_micros(F.lit(first).cast("timestamp"))
    return posts.withColumn("window", F.floor(micros / F.lit(hours * 3600 * 1_000_000)).cast("bigint"))


def window_clusters(posts: DataFrame, vecs: DataFrame, *, window_hours: int = 24, distance: float = 0.35,
                    min_posts: int = MIN_POSTS, text_key: str = "topic_key") -> DataFrame:
    """(platform, post_id, window, cluster, text_key): clusters per time window.

    The average-linkage tree of a window's posts, cut at a mean cosine distance of
    ``distance``. Distinct texts are connected at that distance first, exactly; the tree is
    then grown inside each component (``linkage``), where all its merges lie. Clusters
    and windows under ``min_posts`` posts are noise, and so are components.
    """
    d = window_number(posts.select(*POST_KEY, "created_at", text_key), window_hours)
    sizes = d.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") >= min_posts).select("window")
    d = cut_lineage(d.join(sizes, "window"), "windowed")
    unique = cut_lineage(d.groupBy("window", text_key).agg(F.count("*").alias("weight")).join(vecs, text_key), "unique")
    parts = near_groups(unique, 1.0 - distance, key=text_key, within=["window"]).withColumnRenamed("group", "component")
    parts = unique.join(parts, ["window", text_key])
    known = parts.groupBy("component").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_posts).select("component")
    groups = average_clusters(parts.join(known, "component"), 1.0 - distance, key=text_key)
    named = F.concat_ws("\u0001", F.col("window").cast("string"), "cluster").alias("cluster")
    groups = parts.select("window", text_key, "component").join(groups, ["component", text_key]).select("window", text_key, named)
    members = d.join(groups, ["window", text_key])
    big = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_posts).select("cluster")
    return members.join(big, "cluster").select(*POST_KEY, "created_at", "window", "cluster", text_key)


def assign_posts(members: DataFrame, vecs: DataFrame, *, tau: float = 0.55, min_posts: int = MIN_POSTS,
                 key: str = "topic_key", cluster: list[str] | None = None) -> DataFrame:
    """Members plus ``prob``, the cosine to their cluster's centroid, where it is
    at least ``tau``; clusters left with fewer than ``min_posts`` disappear.

    The centroid weighs each distinct text by its posts, so vectors join once
    per (cluster, text), not once per post.
    """
    cluster = cluster or ["cluster"]
    texts = members.groupBy(*cluster, key).agg(F.count("*").alias("_w")).join(vecs, key)
    centers = centroid(texts, cluster, weight="_w").select(*cluster, F.col("vector").alias("_center"))
    near = texts.join(centers, cluster).select(*cluster, key, "_w", cosine(F.col("vector"), F.col("_center")).alias("_sim"))
    near = near.where(F.col("_sim") >= tau)
    kept = near.groupBy(*cluster).agg(F.sum("_w").alias("_n")).where(F.col("_n") >= min_posts).select(*cluster)
    near = near.join(kept, cluster).select(*cluster, key, F.round("_sim", 4).alias("prob"))
    return members.join(near, [*cluster, key])


def match_across_windows(clusters: DataFrame, tau: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """(mapping, topics): clusters of successive windows to lasting topics.

    ``clusters``: window, cluster, vector, n, first_seen, last_seen. Window after
    window, each cluster joins the topic of highest cosine above ``tau`` among
    those of earlier windows, else starts one; clusters of one window never join
    each other. A topic's centroid is the mean of its clusters so far.
    Successive windows go through one task while their clusters and the topics so
    far are at most TOGETHER; a larger window is compared in blocks, with jobs of its own.
    """
    rows = clusters.select("window", "cluster", F.col("vector").cast("array<double>").alias("vector"),
                           F.col("n").cast("bigint").alias("n"), "first_seen", "last_seen")
    mapping, centers = _match_by_window(rows, tau)
    topics = mapping.join(rows, ["window", "cluster"]).groupBy("topic_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n_posts")
    ).join(centers, "topic_id")
    return mapping, topics


def _match_by_window(rows: DataFrame, tau: float) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(rows, "clusters")
    topics, mapping = None, rows.where("false").select("window", "cluster", F.lit(0).cast("bigint").alias("topic_id"))
    sizes = rows.groupBy("window").count().orderBy("window").collect()
    while sizes:
        room, many = TOGETHER - (0 if topics is None else topics.count()), 0
        while many < len(sizes) and sizes[many][1] <= room:
            room -= sizes[many][1]
            many += 1
        now = rows.where(F.col("window").between(sizes[0][0], sizes[max(many, 1) - 1][0]))
        sizes = sizes[max(many, 1):]
        if many:
            matched = cut_lineage(_matched_in_order(now, topics, tau), "matched")
            mapping = mapping.unionByName(matched.select("window", "cluster", "topic_id"))
            topics = _grown(topics, matched)
            continue
        if topics is None:
            matched = now.select("window", "cluster", "vector", "n", F.lit(None).cast("bigint").alias("topic_id"))
            used = 0
        else:
            used = topics.agg(F.max("topic_id")).first()[0]
            pool = now.select(F.concat(F.lit("c"), "cluster").alias("key"), "vector").unionByName(
                topics.select(F.concat(F.lit("t"), F.col("topic_id").cast("string")).alias("key"), "vector")
            )
            pairs = similar_pairs(pool, tau).where(F.col("a").startswith("c") & F.col("b").startswith("t"))
            best = pairs.where(F.col("similarity") > tau).groupBy(F.right(F.col("a"), F.length(F.col("a")) - 1).alias("cluster")).agg(
                F.max_by(F.right(F.col("b"), F.length(F.col("b")) - 1).cast("bigint"), F.struct("similarity", "b")).alias("topic_id")
            )
            matched = now.select("window", "cluster", "vector", "n").join(best, "cluster", "left")
        fresh = matched.where("topic_id IS NULL").select("cluster")
        ids = numbered(fresh, ["cluster"], "_place").select("cluster", (F.col("_place") + 1 + used).alias("_new"))
        matched = cut_lineage(
            matched.join(ids, "cluster", "left").withColumn("topic_id", F.coalesce("topic_id", "_new")).drop("_new"), "matched"
        )
        step = matched.select("window", "cluster", "topic_id")
        mapping = mapping.unionByName(step)
        topics = _grown(topics, matched)
    if topics is None:
        return mapping, mapping.select("topic_id", F.array().cast("array<double>").alias("centroid"))
    return mapping, topics.select("topic_id", F.col("vector").alias("centroid"))


def _grown(topics: DataFrame | None, matched: DataFrame) -> DataFrame:
    """(topic_id, n, vector) of the topics with the clusters that joined."""
    pieces = matched.select("topic_id", "vector", "n")
    if topics is not None:
        pieces = pieces.unionByName(topics.select("topic_id", "vector", "n"))
    return cut_lineage(centroid(pieces, ["topic_id"], weight="n"), "topics")


def _matched_in_order(now: DataFrame, topics: DataFrame | None, tau: float) -> DataFrame:
    """``now`` plus ``topic_id``, window after window in one task."""
    kind = now.schema["window"].dataType.simpleString()
    d = now.select("window", "cluster", "vector", "n", F.lit(None).cast("bigint").alias("topic_id"))
    if topics is not None:
        d = d.unionByName(topics.select(F.lit(None).cast(kind).alias("window"), F.lit(None).cast("string").alias("cluster"), "vector", "n", "topic_id"))

    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        if not len(table):
            return
        window, cluster, known = (table[c].to_pylist() for c in ("window", "cluster", "topic_id"))
        vector = np.array(table["vector"].to_pylist(), np.float64)
        n = table["n"].to_numpy().astype(np.float64)
        ids, sums, sizes = [], np.zeros_like(vector), np.zeros(len(vector))

        def join(place, i):
            sums[place] += n[i] * vector[i]
            sizes[place] += n[i]

        for i in sorted((i for i, w in enumerate(window) if w is None), key=lambda i: known[i]):
            join(len(ids), i)
            ids.append(known[i])
        out = []
        for w in sorted({w for w in window if w is not None}):
            rows = sorted((i for i, x in enumerate(window) if x == w), key=lambda i: cluster[i])
            have = len(ids)
            used = max(ids, default=0)
            own = _unit_rows(vector[rows].astype(np.float32))
            topic = _unit_rows((sums[:have] / sizes[:have, None]).astype(np.float32)) if have else None
            placed = []
            for i, u in zip(rows, own, strict=True):
                near = topic @ u if have else np.zeros(0)
                ties = np.flatnonzero(near >= near.max() - 1e-12) if have else []
                best = max(((float(np.einsum("j,j->", u, topic[t])), f"t{ids[t]}", t) for t in ties), default=None)
                if best and best[0] > tau:
                    placed.append((best[2], i))
                else:
                    used += 1
                    ids.append(used)
                    placed.append((len(ids) - 1, i))
            for place, i in placed:
                join(place, i)
                out.append((window[i], cluster[i], ids[place]))
        yield pa.RecordBatch.from_pylist([dict(zip(("window", "cluster", "topic_id"), o, strict=True)) for o in out], schema=pa.schema([table.schema.field(c) for c in ("window", "cluster", "topic_id")]))

    found = d.repartition(1).mapInArrow(run, f"window {kind}, cluster string, topic_id bigint")
    return now.select("window", "cluster", "vector", "n").join(found, ["window", "cluster"])


def ctfidf_keywords(texts: DataFrame, cluster: str = "cluster", top_n: int = 5, weight: str | None = None) -> DataFrame:
    """(cluster, keywords): terms frequent in one cluster and rare in others,
    (count / cluster total) * ln(1 + clusters / clusters with the term)."""
    tok = texts.select(cluster, *([weight] if weight else []), F.explode(tx.topic_tokens(F.col("text"))).alias("term"))
    tf = tok.groupBy(cluster, "term").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    total = tf.groupBy(cluster).agg(F.sum("n").alias("total"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n_clusters = texts.select(cluster).distinct().count()
    scored = tf.join(df, "term").join(total, cluster).withColumn(
        "score", F.col("n") / F.col("total") * F.log(1 + F.lit(max(1, n_clusters)) / F.col("df"))
    )
    top = top_n_per_group(scored, [cluster], [F.desc("score"), F.col("term")], top_n)
    return top.groupBy(cluster).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords")
    )


def topic_label(members: DataFrame, keywords: DataFrame, cluster: str = "cluster", depth: int = 25) -> DataFrame:
    """(cluster, label): the first readable label among the ``depth`` most
    central posts, else the first three keywords, else "topic"."""
    central = top_n_per_group(members, [cluster], [F.desc("prob"), *[F.col(c) for c in POST_KEY]], depth)
    named = central.select(cluster, "rank", tx.label_from_text(F.col("text")).alias("label")).where("label IS NOT NULL")
    best = named.groupBy(cluster).agg(F.min_by("label", "rank").alias("_label"))
    three = F.array_join(F.transform(F.slice("keywords", 1, 3), lambda k: F.ltrim(k, F.lit("#"))), " ")
    return members.select(cluster).distinct().join(best, cluster, "left").join(keywords, cluster, "left").select(
        cluster, F.coalesce("_label", tx.nonblank(three), F.lit("topic")).alias("label")
    )


def run_topics(posts: DataFrame, *, window_hours: int = 24, distance: float = 0.35, tau_assign: float = 0.55,
               tau_match: float = 0.80, min_posts: int = MIN_POSTS, embedder=None) -> tuple[DataFrame, DataFrame]:
    """(topics, topic_assign) over the whole range. Topic ids follow the order
    of (window, smallest member), so a rerun gives the same ids."""
    written = posts.where(F.col("text") != "")
    cleaned = tx.topic_text(F.col("text"))
    keyed = written.withColumn("topic_key", F.md5(cleaned))
    unique = keyed.groupBy("topic_key").agg(F.min("text").alias("text"))
    unique = cut_lineage(unique.withColumn("text", tx.topic_text(F.col("text"))), "texts")
    embed = embedder or (lambda d: hash_embed(d, "topic_key"))
    vecs = cut_lineage(embed(unique), "vectors")
    members = window_clusters(keyed, vecs, window_hours=window_hours, distance=distance, min_posts=min_posts)
    kept = cut_lineage(assign_posts(members, vecs, tau=tau_assign, min_posts=min_posts), "assigned")
    texts = kept.groupBy("window", "cluster", "topic_key").agg(F.count("*").alias("w"), F.max("prob").alias("prob"))
    bounds = kept.groupBy("window", "cluster").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    centers = centroid(texts.join(vecs, "topic_key"), ["window", "cluster"], weight="w").join(bounds, ["window", "cluster"])
    mapping, topics = match_across_windows(centers, tau_match)
    mapping = cut_lineage(mapping, "mapping")
    assign = kept.join(mapping, ["window", "cluster"]).select(*POST_KEY, "topic_id", "prob")
    # a topic is named by the cluster that started it
    start = mapping.groupBy("topic_id").agg(F.min(F.struct("window", "cluster")).alias("s")).select("topic_id", "s.cluster")
    named = texts.join(start, "cluster").join(unique, "topic_key")
    words = ctfidf_keywords(named, "topic_id", weight="w")
    labels = topic_label(named.withColumns({"platform": F.lit(""), "post_id": F.col("topic_key")}), words, "topic_id")
    topics = topics.join(words, "topic_id", "left").join(labels, "topic_id", "left").withColumn("status", F.lit("active"))
    return topics, assign


# -- topic views -------------------------------------------------------------
def topic_list(topics: DataFrame, assign: DataFrame, bursts: DataFrame, rise: DataFrame | None = None,
               sort: str = "volume", limit: int = 50) -> DataFrame:
    """Topics with size and strongest burst, ordered volume | recent |
    coordinated | rising."""
    sizes = assign.groupBy("topic_id").agg(F.count("*").alias("n_posts"))
    levels = bursts.groupBy("topic_id").agg(F.max("level").alias("max_burst_level"))
    d = topics.drop("n_posts").join(sizes, "topic_id", "left").join(levels, "topic_id", "left").fillna(0, ["n_posts"])
    order = {
        "volume": [F.desc("n_posts")],
        "recent": [F.desc("last_seen")],
        "coordinated": [F.desc("coordinated_share"), F.desc("n_posts")],
        "rising": [F.desc_nulls_last("rise")],
    }[sort]
    if rise is not None:
        d = d.join(rise, "topic_id", "left")
    return d.orderBy(*order, "topic_id").limit(limit)


def topic_detail(posts: DataFrame, assign: DataFrame, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """(most central posts, posts per platform) of every topic."""
    d = posts.join(assign.select(*POST_KEY, "topic_id", "prob"), POST_KEY)
    central = top_n_per_group(
        d.select("topic_id", *POST_KEY, "author_id", "text", "created_at", "prob"),
        ["topic_id"], [F.desc("prob"), F.col("platform"), F.col("post_id")], n,
    )
    return central, d.groupBy("topic_id", "platform").agg(F.count("*").alias("n"))


def series_with_bursts_and_forecast(topic_id: int, series: DataFrame, bursts: DataFrame,
                                    forecasts: DataFrame) -> dict[str, DataFrame]:
    def mine(d: DataFrame) -> DataFrame:
        return d.where(F.col("topic_id") == topic_id)

    return {
        "series": mine(series).orderBy("bucket_start"),
        "bursts": mine(bursts).orderBy("start"),
        "forecast": mine(forecasts).orderBy("model", "bucket_start"),
    }


def default_topic(topics: DataFrame, assign: DataFrame) -> DataFrame:
    """One row: the manufactured topic, else the one, with the most posts."""
    sizes = assign.groupBy("topic_id").agg(F.count("*").alias("n"))
    d = topics.select("topic_id", "nature").join(sizes, "topic_id", "left").fillna(0, ["n"])
    return d.agg(
        F.max_by("topic_id", F.struct(F.col("nature") == "manufactured", F.col("n"), -F.col("topic_id"))).alias("topic_id")
    )
