"""Linking: connected components, near-duplicate groups, similar pairs.

Scale notes. A group of near copies may hold a third of all rows, so grouping
never emits all pairs of a group. Equal vectors collapse first; the others are
compared block by block on the executors, each task emits a spanning forest of
what it sees, and components join the forests. Results are exact at every size;
comparisons grow with the square of the distinct vectors of a scope.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions import text as tx
from driftlens.session import cut_lineage


# -- components --------------------------------------------------------------
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list; component = smallest
    node of it.

    Alternating large-star / small-star: O(log n) rounds, each an aggregate
    (combined map-side, so a hub costs one row per task) and an equi join that
    adaptive execution can split when a hub is skewed. Each round is written to
    the shared folder.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    current = cut_lineage(
        e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    def fingerprint(d: DataFrame):
        return d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    previous = fingerprint(current)
    for _ in range(max_rounds):
        stars = cut_lineage(_small_star(_large_star(current)), "cc")
        state = fingerprint(stars)
        current = stars
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not converge; raise max_rounds")
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest neighbour."""
    both = e.union(e.select("v", "u"))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v")


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def star_links(members: DataFrame, key: str, node: str) -> DataFrame:
    """(src, dst) linking each member of a key to the key's smallest member.
    Keys with one member give nothing."""
    heads = members.groupBy(key).agg(F.min(node).alias("dst"), F.max(node).alias("_hi")).where("dst != _hi")
    return (
        members.join(heads.select(key, "dst"), key)
        .select(F.col(node).alias("src"), "dst")
        .where("src != dst")
    )


# -- embeddings --------------------------------------------------------------
def hash_embed(texts: DataFrame, key: str, text: str = "text", dims: int = 384) -> DataFrame:
    """(key, vector): L2-normalised counts of 3- and 4-character n-grams inside
    space-padded words, hashed into ``dims`` buckets. JVM only."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    padded = F.concat(F.lit(" "), F.lower(tx.normalize_for_model(F.col(text))), F.lit(" "))
    # an n-gram inside a space-padded word may hold a space at its ends only;
    # lookaheads find the overlapping ones in one scan
    threes = F.regexp_extract_all(padded, F.lit("(?=(.[^ ].))"), F.lit(1))
    fours = F.regexp_extract_all(padded, F.lit("(?=(.[^ ]{2}.))"), F.lit(1))
    d = texts.select(F.col(key), F.concat(threes, fours).alias("_grams"))
    d = HashingTF(numFeatures=dims, inputCol="_grams", outputCol="_tf").transform(d)
    d = Normalizer(inputCol="_tf", outputCol="_unit").transform(d)
    return d.select(key, vector_to_array("_unit", "float32").alias("vector"))


# -- similar pairs and near-duplicate groups ---------------------------------
BLOCK = 2048  # vectors of one side of a comparison: 2,048 x 384 x 4 bytes = 3 MB


def compared(vecs: DataFrame, node: str, within: list[str], compare, schema: str, extra: str | None = None,
             unit_length: bool = True) -> DataFrame:
    """``compare(nodes, unit vectors, own block numbers or None, extra)`` for every
    pair of blocks with equal ``within``; its results as rows of ``schema``.
    ``extra`` names a BIGINT column to hand over. Without ``unit_length`` vectors
    keep their lengths and double precision.

    Vectors are dealt into blocks of about BLOCK by a hash. Each goes to the
    groups of its block with every other block, so each two vectors meet in
    exactly one group, and a task holds two blocks at most, whatever the number
    of vectors or their distribution. Nothing is gathered or shared.
    """
    scope = [F.col(w).cast("string") for w in within]
    tagged = vecs.select(F.col(node).alias("n"), F.concat_ws("\u0001", F.lit(""), *scope).alias("scope"), F.col("vector").cast("array<float>" if unit_length else "array<double>").alias("v"), (F.col(extra) if extra else F.lit(0)).cast("bigint").alias("x"))
    sizes = tagged.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    d = tagged.join(sizes, "scope").withColumn("own", F.pmod(F.xxhash64("n"), "blocks"))
    d = d.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    d = d.select("scope", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "n", "own", "v", "x")
    groups = d.repartition("scope", "lo", "hi").sortWithinPartitions("scope", "lo", "hi")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        key, parts = None, []

        def flush():
            if not parts:
                return
            whole = pa.Table.from_batches(parts).combine_chunks()
            nodes = whole["n"].to_pandas().to_numpy()
            unit = _unit_rows(whole["v"], unit_length)
            own = whole["own"].to_numpy()
            found = compare(nodes, unit, own if key[1] != key[2] else None, whole["x"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(found, types, strict=True)], names)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != key:
                    yield from flush()
                    key, parts = keys[at], []
                parts.append(batch.slice(at, to - at))
                at = to
        yield from flush()

    return groups.mapInArrow(run, schema)


def _unit_rows(vectors, scaled: bool = True) -> np.ndarray:
    """Rows of unit length; a zero vector stays zero. As they are, if not
    ``scaled``."""
    if isinstance(vectors, pa.ChunkedArray):
        flat = vectors.combine_chunks()
        m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    else:
        m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    if not scaled:
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def similar_pairs(vecs: DataFrame, min_sim: float = fixed.DUPLICATE_SIMILARITY, key: str = "key") -> DataFrame:
    """(a, b, similarity), a < b, for vectors with cosine >= ``min_sim``. Exact
    at every size; work grows with the square of the number of vectors."""
    def pairs(nodes, unit, own, _):
        i, j = _near(unit, own, min_sim)
        sims = np.einsum("ij,ij->i", unit[i], unit[j])
        swap = nodes[i] > nodes[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        differ = nodes[i] != nodes[j]
        return nodes[i][differ], nodes[j][differ], sims[differ]

    kind = vecs.schema[key].dataType.simpleString()
    return compared(vecs, key, [], pairs, f"a {kind}, b {kind}, similarity double")


def _near(unit: np.ndarray, own: np.ndarray | None, min_sim: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the near pairs: of all rows, or of rows of different blocks."""
    if own is None:
        i, j = np.nonzero(unit @ unit.T >= min_sim)
        return i[i < j], j[i < j]
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    i, j = np.nonzero(unit[left] @ unit[right].T >= min_sim)
    return left[i], right[j]


def near_groups(vecs: DataFrame, min_sim: float = fixed.DUPLICATE_SIMILARITY, key: str = "key",
                within: list[str] | None = None) -> DataFrame:
    """(key, group[, within]): groups of vectors connected by cosine >= min_sim.

    ``within`` restricts links to equal values of those columns (for example a
    time window); ``key`` must then be unique per (within, key). Equal vectors
    collapse first. Exact at every size: blocks are compared with blocks, and a
    task emits a spanning forest of its blocks, never the pairs.
    """
    within = within or []
    node = F.concat_ws("\u0001", *[F.col(w).cast("string") for w in within], F.col(key).cast("string"))
    tagged = cut_lineage(vecs.select(key, *within, "vector", node.alias("_node"), F.sha2(F.col("vector").cast("string"), 256).alias("_same")), "vectors")
    heads = tagged.groupBy(*within, "_same").agg(F.min("_node").alias("_head"))
    named = cut_lineage(tagged.join(heads, [*within, "_same"]), "heads")

    def forest(nodes, unit, own, _):
        comp = np.arange(len(nodes))
        src, dst = [], []
        i, j = _near(unit, own, min_sim)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]]) if len(i) else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            one = i[lo]
            apart = j[lo:hi][comp[j[lo:hi]] != comp[one]]
            _, first = np.unique(comp[apart], return_index=True)
            for k in apart[first]:  # one link to each component reached
                src.append(nodes[one])
                dst.append(nodes[k])
            comp[np.isin(comp, comp[apart])] = comp[one]
        return src, dst

    links = compared(named.where("_node = _head"), "_node", within, forest, "src string, dst string")
    components = connected_components(links).withColumnRenamed("node", "_head")
    out = named.select(key, *within, "_head").join(components, "_head", "left")
    return out.select(key, *within, F.coalesce("component", "_head").alias("group"))


def text_groups(posts: DataFrame, min_sim: float | None = None, embedder=None) -> DataFrame:
    """(text_key, text_group) of posts' texts.

    Equal normalised texts share a key. Without ``min_sim`` the key is the
    group; with it, keys whose n-gram counts are near duplicates share one, by the
    prefix index of ``grams``. With ``embedder`` its dense vectors are compared
    instead, block by block. Each distinct text is embedded once.
    """
    key = F.col("text_key") if "text_key" in posts.columns else tx.duplicate_key(F.col("text"))
    keyed = posts.select(key.alias("text_key"), "text")
    unique = keyed.groupBy("text_key").agg(F.min("text").alias("text"))
    if min_sim is None:
        return unique.select("text_key", F.col("text_key").alias("text_group"))
    if embedder is None:
        from driftlens.operators.grams import near_texts

        groups = near_texts(cut_lineage(unique, "texts"), min_sim)
    else:
        groups = near_groups(cut_lineage(embedder(unique), "vectors"), min_sim, key="text_key")
    return groups.select("text_key", F.col("group").alias("text_group"))
