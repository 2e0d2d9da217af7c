"""Shards of near equal bytes, in which equal texts stay together.

The atoms are groups of equal texts, ordered by a hash of the text. Splitting an
ordered sequence into a given number of contiguous shards so that the largest is as
small as possible is a search for the smallest capacity that a greedy filling meets:
the check fills each shard as far as the capacity allows and asks whether all fits.
The cuts are then made at that capacity, each as near to an even share of what is left
as the capacity permits. A group above the fair share of the rest is set aside first;
it is a shard of its own.

The groups are never gathered. The driver sees their order through an outline: sums of
group sizes over ranges of hashes, 4,096 at first. Greedy filling over the outline gives
bounds for each cut; only the ranges in which a cut may fall are split further, by
one aggregate over the written groups for all of them, until every cut is known exactly.
The outline holds some thousand sums at any number of groups.

A group's size is summed map-side, so a text that a third of all rows share costs a row
a task. Numbers inside a shard come from one range partitioning by (shard, id) and the
counts of its partitions.

Defined cases. A null text has no bytes, size 1, checksum 0, and shares the group of
the empty text. Rows without an id come first in their shard; rows of one id are ordered by
size and checksum; equal rows are interchangeable. Texts whose 64-bit hashes meet share
a group. With fewer groups than shards, some shards are empty. An empty table gives no
rows. Text length matters nowhere: texts are read once, for their size and two hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.tables import fresh
from driftlens.session import cut_lineage

SHARDS = 8
LAW = "bytes"
FIRST_BITS, MORE_BITS = 12, 8
_KEY_BITS = 64


# -- the outline of the ordered groups -----------------------------------------
@dataclass
class Outline:
    """Ranges of hashes in order: ``prefix`` of ``bits`` leading bits each, the sum of
    its groups' sizes and how many there are. ``wanted`` collects the ranges that an
    answer would need in more detail."""

    prefix: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray
    wanted: set = field(default_factory=set)

    def __post_init__(self):
        order = np.argsort([int(p) << (_KEY_BITS - int(b)) for p, b in zip(self.prefix, self.bits, strict=True)], kind="stable")
        self.prefix, self.bits, self.size, self.groups = (x[order] for x in (self.prefix, self.bits, self.size, self.groups))
        self.ends = np.cumsum(self.size)
        self.total = int(self.ends[-1]) if len(self.ends) else 0

    def floor(self, low: int, high: int) -> tuple[int, int]:
        """Bounds of the last group end at or before a point between ``low`` and
        ``high``."""
        return self._step(low)[0], self._step(high, low)[1]

    def ceil(self, low: int, high: int) -> tuple[int, int]:
        """Bounds of the first group end at or after such a point."""
        return self._step(low, above=True)[0], self._step(high, low, above=True)[1]

    def _step(self, at: int, since: int | None = None, above: bool = False) -> tuple[int, int]:
        """Bounds of the group end next to ``at``, below or above."""
        if at <= 0:
            return 0, 0
        i = int(np.searchsorted(self.ends, at, side="left"))
        since = i if since is None else int(np.searchsorted(self.ends, max(since, 0), side="left"))
        between = range(since, min(i + 1, len(self.ends)))
        self.wanted |= {k for k in between if self.groups[k] > 1 and (k != i or self.ends[i] != at)}
        if at >= self.total:
            return self.total, self.total
        start, end = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        if end == at:
            return at, at
        if self.groups[i] == 1:
            return (end, end) if above else (start, start)
        return (at, end) if above else (start, at)

    def bound(self, end: int) -> int:
        """The hash from which on groups lie behind the group end ``end``."""
        if end == 0:
            return -(1 << _KEY_BITS)
        i = int(np.searchsorted(self.ends, end, side="left"))
        return (int(self.prefix[i]) + 1) << (_KEY_BITS - int(self.bits[i]))


def filled(outline: Outline, shards: int, capacity: int) -> tuple[int, int]:
    """Bounds of how far greedy filling of ``shards`` shards reaches."""
    low = high = 0
    for _ in range(shards):
        low, high = outline.floor(low + capacity, high + capacity)
    return low, high


def smallest_capacity(outline: Outline, shards: int, low: int, high: int) -> tuple[int, int]:
    """Bounds (no, yes]: greedy filling surely fails at the first and surely reaches the
    end at the second; next to each other when the outline is detailed enough.
    ``low`` fails and ``high`` does."""
    sure = low
    unsure = high
    while unsure - sure > 1:
        mid = (sure + unsure) // 2
        if filled(outline, shards, mid)[1] < outline.total:
            sure = mid
        else:
            unsure = mid
    no, low, yes = sure, sure, high
    while yes - low > 1:
        mid = (low + yes) // 2
        if filled(outline, shards, mid)[0] >= outline.total:
            yes = mid
        else:
            low = mid
    return no, yes


def even_cuts(outline: Outline, shards: int, capacity: int) -> list[tuple[int, int]]:
    """Bounds of the ``shards - 1`` cuts at a capacity that suffices: each the group end
    nearest to an even share of what is left, as far as this shard and the shards behind
    it can hold."""
    least = [(outline.total, outline.total)]
    for _ in range(shards - 1):
        low, high = least[-1]
        least.append(outline.ceil(low - capacity, high - capacity))
    least = least[::-1]  # least[j - 1]: the first start from which the shards from j on hold the rest
    cuts, low, high = [], 0, 0
    for j in range(1, shards):
        left = shards - j + 1
        aim = [p + (outline.total - p) // left for p in (low, high)]
        below, above = outline.floor(*aim), outline.ceil(*aim)
        most = outline.floor(low + capacity, high + capacity)
        exact = low == high and below[0] == below[1] and above[0] == above[1]
        if exact:
            near = below[0] if aim[0] - below[0] <= above[0] - aim[0] else above[0]
            near = (near, near)
        else:
            near = (below[0], above[1])
        low, high = (min(max(n, a), m) for n, a, m in zip(near, least[j - 1], most, strict=True))
        cuts.append((low, high))
    return cuts


def minimax_cuts(outline: Outline, shards: int, refine: Callable[[Outline, set], Outline], largest: int) -> tuple[int, list[int]]:
    """(smallest capacity, hashes at which the shards 1, 2, ... start)."""
    if shards < 2 or not outline.total:
        return outline.total, [1 << _KEY_BITS] * (shards - 1)
    no, yes = max(-(-outline.total // shards), largest) - 1, outline.total
    while True:
        outline.wanted = set()
        no, yes = smallest_capacity(outline, shards, no, yes)
        if yes - no == 1:
            break
        # only the ranges between the cuts at both bounds matter
        outline.wanted = set()
        low = high = 0
        for _ in range(shards):
            low, high = outline.floor(low + no, high + yes)
        outline = refine(outline, outline.wanted)
    while True:
        outline.wanted = set()
        cuts = even_cuts(outline, shards, yes)
        if all(low == high for low, high in cuts):
            return yes, [outline.bound(low) for low, _ in cuts]
        outline = refine(outline, outline.wanted)


# -- Spark ---------------------------------------------------------------------
def _outline_rows(groups: DataFrame, bits: int) -> list:
    """(prefix, sum, count) per range of hashes with equal leading ``bits``."""
    prefix = F.shiftright("key", _KEY_BITS - bits)
    return groups.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()


def _outline(rows: list, bits: list[int]) -> Outline:
    return Outline(*(np.array(x, np.int64) for x in ([r[0] for r in rows], bits, [r[1] for r in rows], [r[2] for r in rows])))


def _refined(groups: DataFrame) -> Callable[[Outline, set], Outline]:
    """A function that splits the wanted ranges of an outline further."""

    def refine(outline: Outline, wanted: set) -> Outline:
        keep = [k for k in range(len(outline.prefix)) if k not in wanted]
        rows = [(int(outline.prefix[k]), int(outline.size[k]), int(outline.groups[k])) for k in keep]
        bits = [int(outline.bits[k]) for k in keep]
        for depth in sorted({int(outline.bits[k]) for k in wanted}):
            prefixes = [int(outline.prefix[k]) for k in sorted(wanted) if outline.bits[k] == depth]
            more = min(depth + MORE_BITS, _KEY_BITS)
            bounds = [(p << (_KEY_BITS - depth), ((p + 1) << (_KEY_BITS - depth)) - 1) for p in prefixes]
            inside = F.col("key").between(bounds[0][0], bounds[-1][1]) & F.shiftright("key", _KEY_BITS - depth).isin(prefixes)
            split = [tuple(r) for r in _outline_rows(groups.where(inside), more)]
            rows += split
            bits += [more] * len(split)
        return _outline(rows, bits)

    return refine


@dataclass
class Plan:
    """Hashes of groups that are shards of their own, and the hashes at which the other
    shards start."""

    alone: list[int]
    starts: list[int]
    capacity: int

    def shard(self, key: Column) -> Column:
        top = (1 << (_KEY_BITS - 1)) - 1
        n = F.lit(len(self.alone))
        for s in self.starts:
            if s <= top:
                n = n + (key >= F.lit(max(s, -top - 1))).cast("int")
        for i, k in enumerate(self.alone):
            n = F.when(key == F.lit(k), F.lit(i)).otherwise(n)
        return n.cast("int")


def plan_shards(groups: DataFrame, shards: int = SHARDS) -> Plan:
    """Plan for (key, size) groups of a written table."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    # at most ``shards`` groups can exceed a fair share
    top = [(r["key"], r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards + 1).collect()]
    alone, left = [], shards
    while left > 1 and len(alone) < len(top) and top[len(alone)][1] * left > total:
        total -= top[len(alone)][1]
        alone.append(top[len(alone)][0])
        left -= 1
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    rows = _outline_rows(rest, FIRST_BITS)
    largest = top[len(alone)][1] if len(alone) < len(top) else 0
    capacity, starts = minimax_cuts(_outline(rows, [FIRST_BITS] * len(rows)), left, _refined(rest), largest)
    return Plan(alone, starts, max([capacity, *(s for _, s in top[: len(alone)])]))


def numbered(rows: DataFrame, group: str, order: list[str], into: str) -> DataFrame:
    """``rows`` with their place in their group, from 0 without gaps. ``group`` has few
    values; no group has to fit in a task. The rows are written once, so places do
    not change when an executor is lost."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    d = cut_lineage(d.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    runs = d.groupBy(part.alias("_part"), group).agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()  # groups + partitions
    seen: dict = {}
    offsets = []
    for r in sorted(runs, key=lambda r: r["_part"]):
        offsets.append((r["_part"], r[group], seen.get(r[group], 0) - r["first"]))
        seen[r[group]] = seen.get(r[group], 0) + r["n"]
    kind = rows.schema[group].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(offsets, f"_part long, {group} {kind}, _from long")
    d = d.withColumn("_part", part).join(F.broadcast(table), ["_part", group])
    return d.withColumn(into, place + F.col("_from")).drop("_part", "_id", "_from")


def _keyed(text: Column) -> tuple[Column, Column, Column]:
    """(key, size, checksum) of a text."""
    known = F.coalesce(text, F.lit(""))
    return F.xxhash64(known), (F.octet_length(known) + 1).cast("long"), F.crc32(known.cast("binary"))


def _planned(keyed: DataFrame, shards: int) -> Plan:
    groups = cut_lineage(keyed.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    return plan_shards(groups, shards)


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per document row."""
    key, size, crc = _keyed(docs[text])
    rows = cut_lineage(docs.select(docs[doc_id].alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("key")), "sizes")
    plan = _planned(rows, shards)
    placed = rows.withColumn("shard", plan.shard(F.col("key")))
    placed = numbered(placed, "shard", ["doc_id", "size", "text_crc32", "key"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Writes all columns of ``docs`` under ``path`` in one folder per shard, and returns
    (shard, rows, bytes) of what was written. The column that names the folder is ``shard``, with
    underscores after it where ``docs`` has one."""
    key, size, _ = _keyed(docs[text])
    plan = _planned(docs.select(key.alias("key"), size.alias("size")), shards)
    name = fresh(docs, "shard")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.withColumn(name, plan.shard(key)).repartition(parts, name, F.pmod(F.xxhash64(*docs.columns), F.lit(max(1, parts // shards))))
    spread.write.mode("overwrite").partitionBy(name).parquet(path)
    written = docs.sparkSession.read.schema(T.StructType([*docs.schema.fields, T.StructField(name, T.IntegerType())])).parquet(path)
    return written.groupBy(F.col(name).alias("shard")).agg(F.count("*").alias("rows"), F.sum(_keyed(written[text])[1]).alias("bytes"))
