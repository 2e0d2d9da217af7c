"""The prefix trie of conversations: who shares which beginning, and what that saves.

A turn is 16 bytes: 12 of a digest of role and text, 4 of the text's code points. A
conversation is its turns' bytes one after the other, so byte order is prefix order and
texts are read once. Equal conversations become one row with their number. Ranges of the
distinct sequences, in order, are the prefix shards: a hot first turn is cut by its
continuations. Each shard packs its sequences into a double-array trie
(``doublearray``), traverses it, and sums its subtrees.

Two shards share nodes only on the paths to the end of one and the beginning of the
next. How many turns neighbours have in common (two numbers a shard, the only thing
gathered) tells every shard which of its nodes are shared and which shard is the
first to hold them. Members add up; leaves, children and text lengths are counted by the
first holder only, so the parts of a shared node add up too, and one aggregate over the
shared nodes alone merges the shards.

A conversation of very many turns is read by many tasks, each of which joins the turns of
its range; the whole is one value of 16 bytes a turn. Conversations that end at one node
are listed in chunks of 4,096 ids, which one stream hashes in order without holding
the list.

Defined cases. Rows without a conversation id are left out. A null turn number comes
first; turns of one number are ordered by digest, and each counts, repeated rows too. A null
role or text is empty. A conversation may be rebuilt without turns: it is a member of
the root and ends there. Other columns do not matter. Without conversations there is no
node, not even the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.doublearray import TOKEN, DoubleArrayTrie, split
from driftlens.session import cut_lineage

PERIOD, HEADS = 100, 6  # a conversation begins as the first of its hundred, by up to 5 turns
ID_BITS = 12  # ids in one chunk of a list of ends
SHARD_BYTES = 8 << 20
_RUN_BYTES = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "owner int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_owner int, parent_conv_id long"


def turn_token(role: Column, text: Column) -> Column:
    """16 bytes: a digest of role and text, and the text's code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(F.substring(digest, 1, 24), F.lpad(F.hex(F.length(text)), 8, "0")))


def _joined_runs(batches):
    """Rows sorted by conversation to (conv_id, part, seq): the turns of a conversation
    that this task holds, in parts of bounded size."""
    part = TaskContext.get().partitionId() << 32
    held, size, owner = [], 0, None
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tokens = batch.column(1).cast(pa.large_binary())
        first = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset] if len(ids) else 0
        data = memoryview(tokens.buffers()[2])[first : first + TOKEN * len(ids)] if len(ids) else b""
        out = ([], [], [])
        edge = np.flatnonzero(np.diff(ids, prepend=ids[:1], append=ids[-1:] + 1)) if len(ids) else []
        at = 0
        for to in edge:
            if held and (ids[at] != owner or size >= _RUN_BYTES):
                for o, x in zip(out, (owner, part, b"".join(held)), strict=True):
                    o.append(x)
                part, held, size = part + 1, [], 0
            owner = ids[at]
            held.append(bytes(data[TOKEN * at : TOKEN * to]))
            size += TOKEN * (int(to) - at)
            at = int(to)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["conv_id", "part", "seq"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([part], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["conv_id", "part", "seq"])


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq) per conversation: its turns in order."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn_token(F.col("role"), F.col("text")).alias("token"), "turn").where("conv_id IS NOT NULL")
    order = ["conv_id", F.asc_nulls_first("turn"), "token"]
    runs = d.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "token").mapInArrow(_joined_runs, "conv_id long, part long, seq binary")
    pieces = F.sort_array(F.collect_list(F.struct("part", "seq")))
    d = runs.groupBy("conv_id").agg(pieces.alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["seq"]))
    return d.select("conv_id", F.when(F.size("p") == 1, F.col("p")[0]["seq"]).otherwise(whole).alias("seq"))


def rebuilt(own: DataFrame, period: int = PERIOD, heads: int = HEADS) -> DataFrame:
    """(conv_id, seq) with the first h turns of the conversation that starts each
    ``period`` in place of a conversation's own first h; h = crc32(id) mod ``heads``."""
    first = own.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, TOKEN * (heads - 1)).alias("head"))
    d = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % period, "h": ((F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads) * TOKEN).cast("int")})
    d = d.join(first, "base", "left")
    empty = F.lit(b"")
    head, tail = F.substring(F.coalesce("head", empty), F.lit(1), F.col("h")), F.substring(F.col("seq"), F.col("h") + 1, F.octet_length("seq"))
    return d.select("conv_id", F.concat(head, tail).alias("seq"))


def _hashed_lists(batches):
    """Chunks of id lists, sorted by list and chunk, to (seq, n, conv_id, digest) per
    list."""
    key = row = digest = None

    def table(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["seq", "n", "conv_id", "ends_sha256"])

    for batch in batches:
        done = []
        for sd, seq, n, first, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sd != key:
                if key is not None:
                    done.append((*row, digest.hexdigest()))
                key, row, digest = sd, [seq, 0, first], hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
            row[1] += n
        yield table(done)
    if key is not None:
        yield table([(*row, digest.hexdigest())])


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(seq, n, conv_id, ends_sha256): each distinct sequence, how many conversations
    are equal to it, the smallest of them, and the digest of their ids in order."""
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = seqs.groupBy(F.md5("seq").alias("sd"), F.shiftright("conv_id", ID_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("seq").alias("seq"))
    d = d.select("sd", "seq", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "chunk")
    d = d.repartition(parts, "sd").sortWithinPartitions("sd", "chunk").drop("chunk")
    return d.mapInArrow(_hashed_lists, "seq binary, n long, conv_id long, ends_sha256 string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(v, np.uint8, n).reshape(-1, TOKEN) for v in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n // TOKEN


class Seams:
    """What neighbouring shards have in common: ``cross[i]`` turns of the last sequence
    of shard i - 1 and the first of shard i (-1 at the ends), ``inner[i]`` of the first and last of
    shard i."""

    def __init__(self, cross: list[int], inner: list[int]):
        self.cross, self.inner = [*cross, -1], inner

    def owners(self, i: int) -> np.ndarray:
        """First shard that holds the node at each depth up to ``cross[i]`` on the path
        of shard i's first sequence."""
        out = np.zeros(self.cross[i] + 1, np.int32)
        depth, j = self.cross[i], i - 1
        while depth >= 0:
            further = min(self.inner[j], self.cross[j])
            out[max(further, -1) + 1 : depth + 1] = j
            depth, j = min(depth, further), j - 1
        return out


def trie_nodes(table: pa.Table, i: int, seams: Seams) -> pa.Table:
    """The nodes of shard i; of shared ones, its part."""
    table = table.sort_by("seq").combine_chunks()
    n, conv = (table[c].to_numpy() for c in ("n", "conv_id"))
    turns, lengths, bounds = split(table["seq"].chunk(0) if table["seq"].num_chunks else table["seq"].combine_chunks())
    trie = DoubleArrayTrie(turns, bounds)
    cells = len(trie.check)
    members, least = np.zeros(cells, np.int64), np.full(cells, np.iinfo(np.int64).max)
    depth, length, ends = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.full(cells, -1, np.int64)

    def visit(d, rows, at):
        np.add.at(members, at, n[rows])
        np.minimum.at(least, at, conv[rows])
        depth[at] = d
        if d:
            length[at] = lengths[bounds[rows] + d - 1]

    last = trie.walk(turns, bounds, visit)
    ends[last] = np.arange(len(n))

    def path(row, upto):
        found = np.zeros(upto + 1, np.int64)
        for d in range(upto):
            found[d + 1] = trie.step(found[d : d + 1], turns[bounds[row] + d : bounds[row] + d + 1])[0]
        return found

    owner = np.full(cells, -1, np.int32)
    owned = np.ones(cells, bool)
    owner[path(len(n) - 1, seams.cross[i + 1])] = i
    before = path(0, seams.cross[i])
    owner[before] = seams.owners(i)
    owned[before] = False

    nodes = np.concatenate(trie.levels)
    inner = nodes[1:]
    parent = trie.check
    children, any_child = np.zeros(cells, np.int64), np.zeros(cells, bool)
    np.add.at(children, parent[inner], owned[inner].astype(np.int64))
    any_child[parent[inner]] = True
    if seams.cross[i + 1] == bounds[-1] - bounds[-2]:
        any_child[last[-1]] = True  # the next shard goes on from the last sequence
    leaves = trie.sum_subtrees((owned & ~any_child & (members > 0)).astype(np.int64))
    saved = trie.sum_subtrees((members - owned) * length)

    def column(values, kind, known=None):
        return pa.array(values, kind, mask=None if known is None else ~known)

    up = parent[nodes]
    above = depth[nodes] > 0
    digests = table["ends_sha256"].combine_chunks().take(pa.array(ends[nodes], pa.int64(), mask=ends[nodes] < 0))
    shared, shared_up = owner[nodes] >= 0, (owner[up] >= 0) & above
    return pa.table({
        "owner": column(owner[nodes], pa.int32(), shared), "depth": column(depth[nodes], pa.int64()), "conv_id": column(least[nodes], pa.int64()),
        "n_convs": column(members[nodes], pa.int64()), "n_children": column(children[nodes], pa.int64()), "n_leaves": column(leaves[nodes], pa.int64()),
        "saved_tokens": column(saved[nodes], pa.int64()), "ends_sha256": digests.cast(pa.string()) if isinstance(digests, pa.Array) else digests.combine_chunks(),
        "parent_owner": column(owner[up], pa.int32(), shared_up), "parent_conv_id": column(least[up], pa.int64(), above & ~shared_up),
    })


def _seams(placed: DataFrame) -> tuple[dict[int, int], Seams]:
    """(place of each shard, what neighbours share) of sequences in shards."""
    spark = placed.sparkSession
    bounds = cut_lineage(placed.groupBy("shard").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")), "bounds")
    order = sorted(r[0] for r in bounds.select("shard").collect())
    pairs = spark.createDataFrame(list(zip(order[1:], order, strict=False)), "shard int, previous int")

    @F.arrow_udf("long")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([-1 if x is None or y is None else common_turns(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    before = bounds.select(F.col("shard").alias("previous"), F.col("hi").alias("end"))
    # pairs: two numbers a shard
    d = bounds.join(F.broadcast(pairs), "shard", "left").join(before, "previous", "left")
    found = {r[0]: (r[1], r[2]) for r in d.select("shard", common("end", "lo"), common("lo", "hi")).collect()}
    return {s: i for i, s in enumerate(order)}, Seams([found[s][0] for s in order], [found[s][1] for s in order])


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) per node of the trie over (conv_id, seq)."""
    spark = seqs.sparkSession
    distinct = cut_lineage(distinct_sequences(seqs), "distinct")
    size = distinct.agg(F.sum(F.octet_length("seq") + 64)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    placed = distinct.repartitionByRange(shards, "seq").withColumn("shard", F.spark_partition_id())
    placed = cut_lineage(placed, "placed")
    place, seams = _seams(placed)

    def pack(key, table):
        return trie_nodes(table.select(["seq", "n", "conv_id", "ends_sha256"]), place[key[0].as_py()], seams)

    nodes = cut_lineage(placed.groupBy("shard").applyInArrow(pack, NODES), "nodes")
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = cut_lineage(
        nodes.where("owner IS NOT NULL").groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *total, F.max("ends_sha256").alias("ends_sha256"), F.min("parent_owner").alias("parent_owner")), "shared"
    )
    parents = shared.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = nodes.where("owner IS NULL")
    inside = local.where("parent_owner IS NULL").select(names)
    below = local.where("parent_owner IS NOT NULL").drop("parent_conv_id").join(parents, ["parent_owner", "depth"], "left").select(names)
    upper = shared.join(parents, ["parent_owner", "depth"], "left").select(names)
    return inside.unionByName(below).unionByName(upper).fillna(_EMPTY, ["ends_sha256"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(cut_lineage(sequences(conversations), "sequences")))
