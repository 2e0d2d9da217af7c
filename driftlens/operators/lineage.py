"""Where a claim was first seen, how it hopped between platforms, and image copies."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.numeric import hamming64
from driftlens.functions.rules import stance
from driftlens.functions.sequence import top_n_per_group
from driftlens.operators.filters import POST_KEY
from driftlens.operators.links import connected_components
from driftlens.operators.timelines import with_topic
from driftlens.session import cut_lineage

COLUMNS = ["topic_id", "platform", "post_id", "author_id", "text", "created_at", "origin_post_id", "kind"]


def with_stance(posts: DataFrame, decide=stance) -> DataFrame:
    """Posts with their stance in place of their text, written once. What follows then shuffles and
    writes no texts; ``first_per_platform`` looks up those it shows."""
    return cut_lineage(posts.withColumn("stance", decide(F.col("text"), F.col("kind"))).drop("text"), "stances")


def lineage_posts(posts: DataFrame, assign: DataFrame) -> DataFrame:
    """Posts of each topic plus origin posts they point to outside the topic.
    ``posts`` have a text, or the stance that ``with_stance`` made of it."""
    columns = [c for c in [*COLUMNS, "stance"] if c == "topic_id" or c in posts.columns]
    inside = with_topic(posts, assign).select(*columns)
    wanted = inside.where("origin_post_id IS NOT NULL").select("topic_id", F.col("origin_post_id").alias("post_id")).distinct()
    wanted = wanted.join(inside.select("topic_id", "post_id").distinct(), ["topic_id", "post_id"], "left_anti")
    outside = posts.join(wanted, "post_id").select(*columns)
    return inside.unionByName(outside)


def classified(lineage: DataFrame) -> DataFrame:
    """Lineage posts plus stance and ``traced``: spreading posts carry the
    trace; in a topic without any, all posts do. Written once without texts: every
    view of a lineage reads it."""
    d = lineage if "stance" in lineage.columns else lineage.withColumn("stance", stance(F.col("text"), F.col("kind")))
    d = cut_lineage(d.drop("text"), "lineage")
    has = d.groupBy("topic_id").agg(F.max((F.col("stance") == "spreading").cast("int")).alias("_any"))
    return d.join(has, "topic_id").withColumn("traced", (F.col("stance") == "spreading") | (F.col("_any") == 0)).drop("_any")


def stance_counts(classified_posts: DataFrame, by_platform: bool = False) -> DataFrame:
    keys = ["topic_id", "platform"] if by_platform else ["topic_id"]
    return classified_posts.groupBy(*keys).agg(*[F.count_if(F.col("stance") == s).alias(s) for s in fixed.STANCES])


def first_per_platform(classified_posts: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Earliest traced post per topic and platform with the number of traced
    posts; an aggregate, so a busy platform does not sort in one task. The first 280
    characters of its text come from ``posts`` (by default the rows themselves), where they
    have one (else NULL)."""
    posts = classified_posts if posts is None else posts
    row = F.struct("created_at", "post_id", "author_id")
    firsts = classified_posts.where("traced").groupBy("topic_id", "platform").agg(
        F.min_by(row, F.struct("created_at", "post_id")).alias("f"), F.count("*").alias("n_posts")
    ).select("topic_id", "platform", F.col("f.post_id").alias("first_post_id"), F.col("f.created_at").alias("first_seen"),
             F.col("f.author_id").alias("author_id"), "n_posts")
    if "text" not in posts.columns:
        return firsts.withColumn("text", F.lit(None).cast("string"))
    texts = posts.groupBy("platform", F.col("post_id").alias("first_post_id")).agg(F.min(F.substring("text", 1, 280)).alias("text"))
    return firsts.join(texts, ["platform", "first_post_id"], "left")


def platform_hops(firsts: DataFrame) -> DataFrame:
    """Successive platforms by first sighting (at most one row per platform)."""
    w = Window.partitionBy("topic_id").orderBy("first_seen", "platform")
    d = firsts.select("topic_id", F.col("platform").alias("from_platform"), F.col("first_seen").alias("from_ts"),
                      F.lead("platform").over(w).alias("to_platform"), F.lead("first_seen").over(w).alias("to_ts"))
    return d.where("to_platform IS NOT NULL")


def repost_chains(classified_posts: DataFrame, limit: int = 200) -> DataFrame:
    """Origin -> copy links whose both ends are traced, oldest first."""
    traced = classified_posts.where("traced")
    ids = traced.select("topic_id", F.col("post_id").alias("origin_post_id")).distinct()
    linked = traced.join(ids, ["topic_id", "origin_post_id"], "left_semi").select(
        "topic_id", F.col("origin_post_id").alias("src"), F.col("post_id").alias("dst"), "platform", F.col("created_at").alias("ts")
    )
    return top_n_per_group(linked, ["topic_id"], [F.col("ts"), F.col("dst"), F.col("platform")], limit)


def topic_lineage(posts: DataFrame, assign: DataFrame, post_media: DataFrame | None = None,
                  chain_limit: int = 200) -> dict[str, DataFrame]:
    """Lineage of every topic in ``assign`` in one pass, keyed by topic_id."""
    lean = posts if "stance" in posts.columns else with_stance(posts)
    return _trace(classified(lineage_posts(lean, assign)), post_media, chain_limit, posts)


def _trace(d: DataFrame, post_media: DataFrame | None, chain_limit: int, posts: DataFrame | None = None) -> dict[str, DataFrame]:
    firsts = first_per_platform(d)
    platforms = first_per_platform(d, posts).join(stance_counts(d, by_platform=True), ["topic_id", "platform"])
    if post_media is not None:
        marks = post_media.select("platform", F.col("post_id").alias("first_post_id")).distinct().withColumn("_m", F.lit(True))
        platforms = platforms.join(marks, ["platform", "first_post_id"], "left").withColumn("has_media", F.col("_m").isNotNull()).drop("_m")
    summary = d.groupBy("topic_id").agg(F.count("*").alias("n_posts"), F.count_if("traced").alias("n_spreading"))
    origin = firsts.groupBy("topic_id").agg(
        F.min("first_seen").alias("earliest_observed"),
        F.min_by(F.struct("platform", "first_post_id", "author_id"), F.struct("first_seen", "platform")).alias("origin"),
    )
    summary = summary.join(origin, "topic_id").join(stance_counts(d), "topic_id").withColumn("caveat", F.lit(fixed.LINEAGE_CAVEAT))
    return {
        "platforms": platforms, "hops": platform_hops(firsts), "chains": repost_chains(d, chain_limit),
        "stance_counts": stance_counts(d), "summary": summary,
    }


def cluster_lineage(posts: DataFrame, assign: DataFrame, coord_clusters: DataFrame, coord_accounts: DataFrame) -> dict[str, DataFrame]:
    """Lineage over posts that a cluster's accounts wrote in its topic; the key
    column ``topic_id`` holds the cluster."""
    who = coord_accounts.select("cluster", "platform", F.col("account_id").alias("author_id")).distinct()
    lean = posts if "stance" in posts.columns else with_stance(posts)
    d = with_topic(lean, assign).join(coord_clusters.select("cluster", "topic_id"), "topic_id").join(
        who, ["cluster", "platform", "author_id"]
    )
    d = d.select(F.col("cluster").alias("topic_id"), *(c for c in COLUMNS[1:] if c != "text"), "stance")
    return _trace(classified(d), None, 200, posts)


def lineage_overview(posts: DataFrame, assign: DataFrame, topics: DataFrame, accounts: DataFrame, n: int = 5,
                     chains: int = 30) -> dict[str, DataFrame]:
    """Lineage of the topics with the highest coordinated share (then size)."""
    sizes = assign.groupBy("topic_id").agg(F.count("*").alias("_n"))
    top = topics.join(sizes, "topic_id").orderBy(F.desc("coordinated_share"), F.desc("_n"), "topic_id").limit(n)
    out = topic_lineage(posts, assign.join(top.select("topic_id"), "topic_id", "left_semi"), chain_limit=chains)
    names = accounts.groupBy("platform", "account_id").agg(F.max("handle").alias("handle"))
    s = out["summary"]
    named = s.join(names, (s["origin.platform"] == names["platform"]) & (s["origin.author_id"] == names["account_id"]), "left")
    out["summary"] = named.select(s["*"], F.coalesce(names["handle"], s["origin.author_id"]).alias("origin_handle")).join(
        top.select("topic_id", "label", "nature", "coordinated_share"), "topic_id"
    )
    return out


# -- images ------------------------------------------------------------------
def media_first_seen(media: DataFrame, post_media: DataFrame, posts: DataFrame) -> DataFrame:
    """(media_id, phash, first_seen, platform, posts) of hashed media in use."""
    used = post_media.join(posts.select(*POST_KEY, "created_at"), POST_KEY).groupBy("media_id").agg(
        F.min("created_at").alias("first_seen"), F.min_by("platform", F.struct("created_at", "platform")).alias("platform"),
        F.count("*").alias("posts"),
    )
    return media.where("phash IS NOT NULL").select("media_id", "phash").join(used, "media_id")


MAX_NEIGHBOURS = 5_000  # band values looked up per hash and band
LOOKUP_COST = 1_000  # comparisons of two hashes in a block that cost as much as one row of a band join
HASH_BLOCK = 1 << 18  # hashes of one side of a comparison: 2 MB


def band_plan(max_distance: int, n: int) -> tuple[int, int, float]:
    """(bands, radius, candidates and look-ups per hash) for ``n`` hashes.

    By the pigeonhole, hashes within T bits agree on some of m bands up to T // m bits.
    Wide bands have few candidates and many neighbours to look up, narrow ones the
    reverse, so the best number of bands falls as the hashes grow in number.
    """
    best = None
    for m in range(2, max(2, min(max_distance + 1, 64)) + 1):
        radius, width = max_distance // m, 64 // m
        neighbours = sum(comb(width + 1, r) for r in range(radius + 1))
        if neighbours <= MAX_NEIGHBOURS:
            cost = m * neighbours * (1 + n / 2**width)
            if best is None or cost < best[2]:
                best = (m, radius, cost)
    return best


def _flips(width: int, radius: int) -> list[int]:
    """Numbers of ``width`` bits with up to ``radius`` bits set."""
    return [sum(1 << j for j in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def similar_hashes(hashes: DataFrame, max_distance: int = 10, value: str = "phash", bands: int | None = None) -> DataFrame:
    """(a, b, hamming), a < b: distinct 64-bit hex hashes within the distance.

    Exact, by the cheaper of two ways. Multi-index hashing: one side is keyed by its
    band values, the other by band values and their neighbours within the radius; the
    equi join is verified by the true distance. A wide distance leaves so many
    neighbours that comparing blocks of hashes with blocks costs less up to many
    millions of hashes. ``bands`` sets the number of bands (``band_plan``).
    """
    as_long = F.conv(value, 16, -10).cast("bigint")
    d = cut_lineage(hashes.select(F.col(value).alias("h"), as_long.alias("v")).where("v IS NOT NULL").distinct(), "hashes")
    n = d.count()
    m, _, rows = band_plan(max_distance, n)
    if bands is None and n / 2 <= LOOKUP_COST * rows:
        return _near_in_blocks(d, n, max_distance)
    return _near_by_bands(d, bands or m, max_distance)


def _near_by_bands(d: DataFrame, m: int, max_distance: int) -> DataFrame:
    radius = max_distance // m
    bounds = [round(i * 64 / m) for i in range(m + 1)]

    def band(i: int, radius: int):
        lo, width = bounds[i], bounds[i + 1] - bounds[i]
        own = F.shiftrightunsigned("v", lo).bitwiseAND((1 << width) - 1)
        flips = F.split(F.lit(",".join(map(str, _flips(width, radius)))), ",").cast("array<bigint>")
        return F.transform(flips, lambda f: F.struct(F.lit(i).alias("band"), own.bitwiseXOR(f).alias("key")))

    def keys(neighbours: bool):
        return F.flatten(F.array(*(band(i, radius if neighbours else 0) for i in range(m))))

    left = d.select(F.col("h").alias("a"), F.explode(keys(False)).alias("k"))
    right = d.select(F.col("h").alias("b"), F.explode(keys(True)).alias("k"))
    # Spark's size estimate does not see what explode multiplies: neither side may be broadcast on it
    pairs = left.hint("merge").join(right, "k").where("a < b").select("a", "b", hamming64(F.col("a"), F.col("b")).alias("hamming"))
    near = pairs.where(F.col("hamming") <= max_distance)
    return near.groupBy("a", "b").agg(F.first("hamming").alias("hamming"))


def _near_in_blocks(d: DataFrame, n: int, max_distance: int) -> DataFrame:
    """Blocks of hash values against blocks: a task holds two blocks and a few rows of
    their distances; the numbers become texts again in joins of what was found."""
    size = min(HASH_BLOCK, max(HASH_BLOCK >> 4, -(-n // 16)))
    blocks = max(1, -(-n // size))
    dealt = d.select("v").distinct().groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("own")).agg(F.collect_list("v").alias("vs"))
    meet = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("own", "other").cast("bigint").alias("lo"), F.greatest("own", "other").cast("bigint").alias("hi"), "own", "vs"
    )
    tasks = min(4096, blocks * (blocks + 1) // 2)

    def near(key, table):
        sides = [np.asarray(x.values.to_numpy(), np.int64).view(np.uint64) for x in table["vs"]]
        within = key[0].as_py() == key[1].as_py()
        if not within and len(sides) < 2:
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "hamming": pa.array([], pa.int32())})
        x, y = _near_values(sides[0], sides[-1], max_distance)
        if within:
            x, y = x[x < y], y[x < y]
        return pa.table({"x": x.view(np.int64), "y": y.view(np.int64), "hamming": np.bitwise_count(x ^ y).astype(np.int32)})

    found = meet.repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInArrow(near, "x bigint, y bigint, hamming int")
    left, right = d.select(F.col("h").alias("p"), F.col("v").alias("x")), d.select(F.col("h").alias("q"), F.col("v").alias("y"))
    apart = found.join(left, "x").join(right, "y").select("p", "q", "hamming")
    written = left.join(right, F.col("x") == F.col("y")).where("p < q").select("p", "q", F.lit(0).alias("hamming"))  # one value written in two ways
    return apart.unionByName(written).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "hamming")


_TOGETHER = 1 << 20  # pairs that are compared at once


def _near_values(one: np.ndarray, two: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(x of ``one``, y of ``two``) of all pairs within the distance.

    Of bands with radii r that add up, each plus one, to one more than the distance, two near
    values are within r in one band at least: values of ``two`` are looked up by each band
    value of ``one`` and its neighbours. All pairs are compared where that costs less, or where so
    many values share their bands that the candidates come near all pairs.
    """
    bands, cost = _task_bands(max_distance, len(one), len(two))
    found = _by_lookup(one, two, max_distance, bands) if cost < 1.5 * len(one) * len(two) else None
    if found is None:
        step, xs, ys = max(1, (1 << 16) // max(1, len(two))), [one[:0]], [two[:0]]
        for at in range(0, len(one), step):
            i, j = np.nonzero(np.bitwise_count(one[at:at + step, None] ^ two) <= max_distance)
            xs.append(one[at + i])
            ys.append(two[j])
        found = np.concatenate(xs), np.concatenate(ys)
    return found


def _task_bands(max_distance: int, n: int, m: int) -> tuple[list[tuple[int, int, int]], float]:
    """((first bit, width, radius) of each band, nanoseconds) of the cheapest plan."""
    best = None
    for k in range(3, min(max_distance + 1, 8) + 1):
        least, more = divmod(max_distance + 1, k)
        bounds = [i * 64 // k for i in range(k + 1)]
        bands = [(lo, hi - lo, least - (i >= more)) for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        cost = sum(sum(comb(width, r) for r in range(radius + 1)) * (20 * n + 15 * n * m / 2**width) for _, width, radius in bands)
        if best is None or cost < best[1]:
            best = (bands, cost)
    return best or ([], float("inf"))


def _by_lookup(one: np.ndarray, two: np.ndarray, max_distance: int, bands: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs, or nothing where there are too many candidates."""
    left, xs, ys = len(one) * len(two) / 10, [one[:0]], [two[:0]]
    value = lambda v, band: ((v >> np.uint64(band[0])) & np.uint64((1 << band[1]) - 1)).astype(np.int64)
    for place, band in enumerate(bands):
        a, b = one[np.argsort(value(one, band))], two[np.argsort(value(two, band))]
        mine = value(a, band)
        starts = np.concatenate([[0], np.cumsum(np.bincount(value(b, band), minlength=1 << band[1]))])
        for flip in _flips(band[1], band[2]):
            key = mine ^ flip
            first = starts[key]
            many = starts[key + 1] - first
            some = np.flatnonzero(many)
            first, many = first[some], many[some]
            ends = np.cumsum(many)
            left -= int(ends[-1]) if len(ends) else 0
            if left < 0:
                return None
            at = 0
            while at < len(some):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")))
                n, done = many[at:to], ends[at - 1] if at else 0
                x = np.repeat(a[some[at:to]], n)
                y = b[np.arange(int(ends[to - 1] - done)) + np.repeat(first[at:to] - (ends[at:to] - n - done), n)]
                apart = x ^ y
                keep = np.flatnonzero(np.bitwise_count(apart) <= max_distance)
                x, y, apart = x[keep], y[keep], apart[keep]
                for before in bands[:place]:  # a pair counts in its first band
                    new = np.bitwise_count(value(apart, before).view(np.uint64)) > before[2]
                    x, y, apart = x[new], y[new], apart[new]
                xs.append(x)
                ys.append(y)
                at = to
    return np.concatenate(xs), np.concatenate(ys)


def similar_images(images: DataFrame, max_distance: int = 10) -> DataFrame:
    """Image pairs within the distance, the earlier one as ``a``.

    Identical hashes collapse to their earliest image first: every further copy
    is paired with that one (distance 0), and only distinct hashes are compared
    with each other. A picture reposted under a third of all media ids thus
    costs one row per copy, not a pair per two copies.
    """
    order = F.struct("first_seen", "media_id")
    head = images.groupBy("phash").agg(F.min_by(F.struct("media_id", "platform", "first_seen", "posts"), order).alias("h"))
    copies = images.join(head, "phash").where(F.col("media_id") != F.col("h.media_id")).select(
        F.col("h").alias("x"), F.struct("media_id", "platform", "first_seen", "posts").alias("y"), F.lit(0).alias("hamming")
    )
    pairs = similar_hashes(images, max_distance)
    x, y = head.select(F.col("phash").alias("a"), F.col("h").alias("x")), head.select(F.col("phash").alias("b"), F.col("h").alias("y"))
    distinct = pairs.join(x, "a").join(y, "b").select("x", "y", "hamming")
    both = copies.unionByName(distinct)
    first = F.struct(F.col("x.first_seen"), F.col("x.media_id")) <= F.struct(F.col("y.first_seen"), F.col("y.media_id"))
    a, b = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    d = both.select(a.alias("a"), b.alias("b"), "hamming")
    return d.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in ("media_id", "platform", "first_seen", "posts")],
                    "hamming", F.lit(max_distance).alias("threshold"))


def image_families(pairs: DataFrame) -> DataFrame:
    """(family, original, media_id, hamming, ...): connected copies. The earliest
    image is the original; ``hamming`` is NULL for copies that do not match it
    directly and for the original itself. Input: media_id_a/b, hamming and
    optionally platform, first_seen, posts per side."""
    full = pairs
    for c, t in (("platform", "string"), ("first_seen", "timestamp"), ("posts", "bigint")):
        for s in ("a", "b"):
            if f"{c}_{s}" not in full.columns:
                full = full.withColumn(f"{c}_{s}", F.lit(None).cast(t))
    info = full.select(*[F.col(f"{c}_a").alias(c) for c in ("media_id", "platform", "first_seen", "posts")]).union(
        full.select(*[f"{c}_b" for c in ("media_id", "platform", "first_seen", "posts")])
    ).distinct()
    comp = connected_components(pairs.select(F.col("media_id_a").alias("src"), F.col("media_id_b").alias("dst")))
    d = info.join(comp.select(F.col("node").alias("media_id"), F.col("component").alias("family")), "media_id")
    first = d.groupBy("family").agg(F.min_by("media_id", F.struct(F.col("first_seen"), F.col("media_id"))).alias("original"))
    direct = pairs.select(F.col("media_id_a").alias("original"), F.col("media_id_b").alias("media_id"), "hamming").union(
        pairs.select("media_id_b", "media_id_a", "hamming")
    )
    direct = direct.groupBy("original", "media_id").agg(F.min("hamming").alias("hamming"))
    return d.join(first, "family").join(direct, ["original", "media_id"], "left").select(
        "family", "original", "media_id", (F.col("media_id") == F.col("original")).alias("is_original"),
        "hamming", "platform", "first_seen", "posts",
    )


def family_summary(families: DataFrame) -> DataFrame:
    return families.groupBy("family", "original").agg(
        F.count_if(~F.col("is_original")).alias("copies"), F.sum(F.coalesce("posts", F.lit(0))).alias("total_posts"),
        F.sort_array(F.collect_set("platform")).alias("platforms"),
    )
