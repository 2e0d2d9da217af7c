"""Evidence ledger: hash chain, Merkle checkpoints, verification, proofs."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.sequence import with_previous

SLOT = 100_000  # records per window slot


def record_hash(payload: Column) -> Column:
    return F.sha2(F.encode(payload, "UTF-8"), 256)


def _entry_hash(prev: Column, rec: Column) -> Column:
    return F.sha2(F.concat(prev, rec, F.col("collected_at"), F.col("collector_id"), F.col("seq").cast("string")), 256)


def seal_records(records: DataFrame, chain: str | None = None, last_hash: str = fixed.GENESIS_HASH) -> DataFrame:
    """Records with record_hash, entry_hash and prev_entry_hash.

    ``records``: seq, platform, collector_id, collected_at (text), payload. An
    entry depends on the one before, so a chain is sealed in order by one task;
    it streams through batches and keeps one hash in memory. ``chain`` names a
    column that splits the ledger into independently verifiable chains (for
    example a segment number), which seal in parallel; without it there is a
    single chain. Record hashes are computed in parallel beforehand and only
    the narrow columns go through the chain.
    """
    hashed = records.withColumn("record_hash", record_hash(F.col("payload")))
    key = chain or "_chain"
    narrow = hashed if chain else hashed.withColumn("_chain", F.lit("0"))
    narrow = narrow.select(F.col(key).cast("string").alias("_chain"), "seq", "collected_at", "collector_id", "record_hash")
    ordered = narrow.repartition("_chain").sortWithinPartitions("_chain", "seq")

    def run(batches):
        current, prev = None, last_hash
        for pdf in batches:
            out = []
            for c, seq, at, who, rec in zip(pdf["_chain"], pdf["seq"], pdf["collected_at"], pdf["collector_id"], pdf["record_hash"]):
                if c != current:
                    current, prev = c, last_hash
                entry = hashlib.sha256(f"{prev}{rec}{at}{who}{seq}".encode()).hexdigest()
                out.append((c, seq, entry, prev))
                prev = entry
            yield pd.DataFrame(out, columns=["_chain", "seq", "entry_hash", "prev_entry_hash"])

    sealed = ordered.mapInPandas(run, "_chain string, seq bigint, entry_hash string, prev_entry_hash string")
    joined = hashed.join(sealed, "seq")
    columns = ["seq", "platform", "collector_id", "collected_at", F.col("payload").alias("payload_canonical"),
               "record_hash", "entry_hash", "prev_entry_hash"]
    return joined.select(*columns, *([chain] if chain else []))


def chain_failures(raw_records: DataFrame, chain: str | None = None) -> DataFrame:
    """(seq, reason) of every record that fails; stored hashes make each check
    local once the predecessor's stored hash is attached."""
    keys = [chain] if chain else ["_chain"]
    d = raw_records if chain else raw_records.withColumn("_chain", F.lit(0))
    d = with_previous(d, keys, ["seq"], F.floor(F.col("seq") / SLOT).cast("bigint"), {"_prev": "entry_hash"})
    prev = F.coalesce("_prev", F.lit(fixed.GENESIS_HASH))
    rec = record_hash(F.col("payload_canonical"))
    reason = (
        F.when(rec != F.col("record_hash"), "record_hash mismatch")
        .when(_entry_hash(prev, rec) != F.col("entry_hash"), "entry_hash chain break")
        .when(F.col("prev_entry_hash") != prev, "prev_entry_hash mismatch")
    )
    return d.select(*([chain] if chain else []), "seq", reason.alias("reason")).where("reason IS NOT NULL")


def verify_chain(raw_records: DataFrame, chain: str | None = None) -> DataFrame:
    """(status, records, first_bad_seq, reason): the lowest failing seq and its
    first reason. Fully parallel."""
    bad = chain_failures(raw_records, chain).agg(F.min(F.struct("seq", "reason")).alias("b"))
    total = raw_records.agg(F.count("*").alias("records"))
    both = bad.select("b", F.lit(None).cast("bigint").alias("records")).unionByName(
        total.select(F.lit(None).cast(bad.schema["b"].dataType).alias("b"), "records")
    )
    d = both.agg(F.max("b").alias("b"), F.max("records").alias("records"))
    return d.select(
        F.when(F.col("b").isNull(), "PASS").otherwise("FAIL").alias("status"), "records",
        F.col("b.seq").alias("first_bad_seq"), F.col("b.reason").alias("reason"),
    )


def _head_hash(prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, "first_seq", "last_seq", "records", "final_hash"), 256)


def segment_heads(sealed: DataFrame, chain: str = "segment") -> DataFrame:
    """(chain, first_seq, last_seq, records, final_hash, prev_head, head_hash): one
    row per segment of a ledger sealed in segments. Each head covers the head
    before it, so removing a segment, or records from the end of one, shows. The
    heads are a chain and pass through one task, a row per segment."""
    d = sealed.groupBy(chain).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("records"), F.max_by("entry_hash", "seq").alias("final_hash")
    )
    kind = sealed.schema[chain].dataType.simpleString()

    def run(batches):
        prev = fixed.GENESIS_HASH
        for pdf in batches:
            heads, before = [], []
            for row in pdf[["first_seq", "last_seq", "records", "final_hash"]].itertuples(index=False):
                before.append(prev)
                prev = hashlib.sha256("|".join(map(str, (prev, *row))).encode()).hexdigest()
                heads.append(prev)
            yield pdf.assign(prev_head=before, head_hash=heads)

    return d.repartition(1).sortWithinPartitions("first_seq").mapInPandas(
        run, f"{chain} {kind}, first_seq bigint, last_seq bigint, records bigint, final_hash string, prev_head string, head_hash string"
    )


def verify_segments(raw_records: DataFrame, heads: DataFrame, chain: str = "segment") -> DataFrame:
    """(status, records, first_bad_seq, reason) of a ledger in segments against its
    heads: altered records, missing records anywhere, missing segments, altered
    or missing heads. Parallel: every check is local once a predecessor is
    attached."""
    found = raw_records.groupBy(chain).agg(
        F.min("seq").alias("_first"), F.max("seq").alias("_last"), F.count("*").alias("_records"), F.max_by("entry_hash", "seq").alias("_final")
    )
    both = heads.join(found, chain, "full")
    differ = both.select(
        chain,
        F.when(F.col("first_seq").isNull(), F.struct(F.col("_first").alias("seq"), F.lit("segment without a head").alias("reason")))
        .when(F.col("_first").isNull() | (F.col("_first") != F.col("first_seq")), F.struct(F.col("first_seq").alias("seq"), F.lit("missing record").alias("reason")))
        .when(F.col("_last") != F.col("last_seq"), F.struct((F.col("_last") + 1).alias("seq"), F.lit("missing record").alias("reason")))
        .when(F.col("_final") != F.col("final_hash"), F.struct(F.col("last_seq").alias("seq"), F.lit("final hash mismatch").alias("reason"))).alias("b"),
        (F.col("_records") != F.col("records")).alias("_short"),
    )
    # inside a segment that is short, a record whose predecessor is not the one before
    short = raw_records.join(differ.where("_short").select(chain), chain, "left_semi")
    gaps = with_previous(short.select(chain, "seq"), [chain], ["seq"], F.floor(F.col("seq") / SLOT).cast("bigint"), {"_prev": "seq"})
    gaps = gaps.where("seq > _prev + 1").select(F.struct((F.col("_prev") + 1).alias("seq"), F.lit("missing record").alias("reason")).alias("b"))
    linked = heads.withColumn("_all", F.lit(0))
    linked = with_previous(linked, ["_all"], ["first_seq"], F.floor(F.col("first_seq") / (SLOT * 1000)).cast("bigint"), {"_head": "head_hash", "_end": "last_seq"})
    prev = F.coalesce("_head", F.lit(fixed.GENESIS_HASH))
    broken = linked.where((F.col("prev_head") != prev) | (_head_hash(prev) != F.col("head_hash")) | (F.col("first_seq") != F.col("_end") + 1))
    broken = broken.select(F.struct(F.coalesce(F.col("_end") + 1, "first_seq").alias("seq"), F.lit("head chain break").alias("reason")).alias("b"))
    altered = chain_failures(raw_records, chain).select(F.struct("seq", "reason").alias("b"))
    bad = altered.unionByName(gaps).unionByName(differ.where("b IS NOT NULL").select("b")).unionByName(broken)
    empty = F.lit(None).cast("bigint")
    total = raw_records.agg(F.count("*").alias("records")).select(F.lit(None).cast("struct<seq:bigint,reason:string>").alias("b"), "records")
    d = bad.agg(F.min("b").alias("b")).select("b", empty.alias("records")).unionByName(total).agg(F.max("b").alias("b"), F.max("records").alias("records"))
    return d.select(
        F.when(F.col("b").isNull(), "PASS").otherwise("FAIL").alias("status"), "records",
        F.col("b.seq").alias("first_bad_seq"), F.col("b.reason").alias("reason"),
    )


def _levels(leaves: DataFrame, size: int) -> list[DataFrame]:
    """Merkle layers as (id, pos, h), leaves first; an odd last node is paired
    with itself. A layer halves, so there are ceil(log2(size)) rounds, all
    grouped by checkpoint and pair."""
    layers = [leaves]
    width = size
    while width > 1:
        parent = F.floor(F.col("pos") / 2).cast("bigint")
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("h")))
        right = F.max(F.when(F.col("pos") % 2 == 1, F.col("h")))
        lone = F.max("n") == 1
        up = layers[-1].groupBy("id", parent.alias("pos")).agg(
            left.alias("l"), right.alias("r"), lone.alias("done"), F.max("n").alias("n")
        )
        pair = F.sha2(F.concat(F.unhex("l"), F.unhex(F.coalesce("r", "l"))), 256)
        layers.append(up.select("id", "pos", F.when(F.col("done"), F.col("l")).otherwise(pair).alias("h"),
                                F.ceil(F.col("n") / 2).cast("bigint").alias("n")))
        width = -(-width // 2)
    return layers


def _leaves(raw_records: DataFrame, checkpoints: DataFrame | None, size: int) -> DataFrame:
    """(id, pos, h, n): entries by checkpoint; blocks of ``size`` by default."""
    if checkpoints is None:
        d = raw_records.select((F.floor((F.col("seq") - 1) / size)).cast("bigint").alias("id"),
                               ((F.col("seq") - 1) % size).cast("bigint").alias("pos"), F.col("entry_hash").alias("h"))
    else:
        mine = raw_records.select("seq", "entry_hash", F.floor((F.col("seq") - 1) / size).alias("block"))
        spans = checkpoints.select("id", "first_seq", "last_seq", F.explode(F.sequence(
            F.floor((F.col("first_seq") - 1) / size), F.floor((F.col("last_seq") - 1) / size))).alias("block"))
        d = mine.join(spans, "block").where("seq BETWEEN first_seq AND last_seq").select(
            "id", (F.col("seq") - F.col("first_seq")).alias("pos"), F.col("entry_hash").alias("h"))
    sizes = d.groupBy("id").agg((F.max("pos") + 1).alias("n"))
    return d.join(sizes, "id").select("id", "pos", "h", "n")


def merkle_roots(raw_records: DataFrame, size: int = fixed.CHECKPOINT_SIZE) -> DataFrame:
    """(id, first_seq, last_seq, merkle_root) per block of ``size`` entries."""
    root = _levels(_leaves(raw_records, None, size), size)[-1].select("id", F.col("h").alias("merkle_root"))
    spans = raw_records.groupBy(F.floor((F.col("seq") - 1) / size).cast("bigint").alias("id")).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    return spans.join(root, "id").select((F.col("id") + 1).alias("id"), "first_seq", "last_seq", "merkle_root")


def covering_checkpoint(raw_records: DataFrame, checkpoints: DataFrame, size: int = fixed.CHECKPOINT_SIZE) -> DataFrame:
    """(seq, checkpoint_id): the checkpoint whose span holds each record, by an
    equi join on blocks of ``size``."""
    mine = raw_records.select("seq", F.floor((F.col("seq") - 1) / size).alias("block"))
    spans = checkpoints.select(F.col("id").alias("checkpoint_id"), "first_seq", "last_seq", F.explode(F.sequence(
        F.floor((F.col("first_seq") - 1) / size), F.floor((F.col("last_seq") - 1) / size))).alias("block"))
    return mine.join(spans, "block").where("seq BETWEEN first_seq AND last_seq").select("seq", "checkpoint_id")


def inclusion_proofs(raw_records: DataFrame, checkpoints: DataFrame, seqs: DataFrame,
                     size: int = fixed.CHECKPOINT_SIZE) -> DataFrame:
    """(seq, checkpoint_id, entry_hash, path, merkle_root) for the given seqs.
    The path holds at most log2(size) siblings."""
    leaves = _leaves(raw_records, checkpoints, size)
    layers = _levels(leaves, size)
    asked = covering_checkpoint(raw_records.join(seqs.select("seq"), "seq", "left_semi"), checkpoints, size)
    asked = asked.join(checkpoints.select(F.col("id").alias("checkpoint_id"), "first_seq", "merkle_root"), "checkpoint_id")
    asked = asked.withColumn("pos", F.col("seq") - F.col("first_seq"))
    steps = None
    for depth, layer in enumerate(layers[:-1]):
        at = asked.select("seq", F.col("checkpoint_id").alias("id"), F.floor(F.col("pos") / (2 ** depth)).cast("bigint").alias("mine"))
        sibling = at.withColumn("pos", F.col("mine").bitwiseXOR(F.lit(1).cast("bigint")))
        own = layer.select("id", F.col("pos").alias("mine"), F.col("h").alias("own"), "n")
        near = sibling.join(own, ["id", "mine"]).where("n > 1").join(layer.select("id", "pos", "h"), ["id", "pos"], "left")
        step = near.select("seq", F.lit(depth).alias("depth"), F.coalesce("h", "own").alias("hash"),
                           F.when(F.col("mine") % 2 == 0, "right").otherwise("left").alias("position"))
        steps = step if steps is None else steps.unionByName(step)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("depth", "hash", "position"))),
                          lambda s: F.struct(s["hash"].alias("hash"), s["position"].alias("position")))
    paths = steps.groupBy("seq").agg(ordered.alias("path"))
    empty = F.array().cast("array<struct<hash:string,position:string>>")
    return asked.join(paths, "seq", "left").join(raw_records.select("seq", "entry_hash"), "seq").select(
        "seq", "checkpoint_id", "entry_hash", F.coalesce("path", empty).alias("path"), "merkle_root"
    )


def verify_inclusion(entry_hash: Column, path: Column, merkle_root: Column) -> Column:
    """Folds a proof up to the root."""
    def step(acc: Column, s: Column) -> Column:
        a, b = F.unhex(acc), F.unhex(s["hash"])
        return F.sha2(F.when(s["position"] == "right", F.concat(a, b)).otherwise(F.concat(b, a)), 256)

    return F.aggregate(path, entry_hash, step) == merkle_root


def verify_checkpoints(raw_records: DataFrame, checkpoints: DataFrame, size: int = fixed.CHECKPOINT_SIZE) -> DataFrame:
    """(id, ok, reason): every seq of the span present and the root equal."""
    leaves = _leaves(raw_records, checkpoints, size)
    counts = leaves.groupBy("id").agg(F.countDistinct("pos").alias("present"))
    roots = _levels(leaves, size)[-1].select("id", F.col("h").alias("_root"))
    d = checkpoints.join(counts, "id", "left").join(roots, "id", "left")
    span = F.col("last_seq") - F.col("first_seq") + 1
    reason = F.when(F.coalesce("present", F.lit(0)) != span, "covers missing records").when(
        F.coalesce(F.col("_root") != F.col("merkle_root"), F.lit(True)), "merkle root mismatch"
    )
    return d.select("id", reason.isNull().alias("ok"), reason.alias("reason"))


def ledger_summary(raw_records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    r = raw_records.agg(F.count("*").alias("record_count"), F.max("seq").alias("last_seq"))
    c = checkpoints.agg(
        F.count("*").alias("checkpoint_count"), F.max("id").alias("last_checkpoint"),
        F.max_by("merkle_root", "id").alias("last_root"), F.max("last_seq").alias("covered_to"),
    )
    return r.withColumn("_k", F.lit(1)).join(c.withColumn("_k", F.lit(1)), "_k").drop("_k")


def audit_events(actions: DataFrame, first_seq: int, last_hash: str = fixed.GENESIS_HASH) -> tuple[DataFrame, DataFrame]:
    """(raw_records, audit_log): analyst actions appended to the chain as
    records of collector ``audit``.

    ``actions``: action_id (orders the events), ts, actor, action, detail (JSON
    text). Their sequence numbers continue after ``first_seq - 1``; actions are
    human decisions, a few per minute at most.
    """
    from pyspark.sql import Window

    numbered = actions.withColumn("seq", F.row_number().over(Window.orderBy("action_id")) + F.lit(first_seq - 1))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    detail = F.coalesce("detail", F.lit("{}"))
    quoted = [F.to_json(F.struct(F.col(c).alias("v"))) for c in ("action", "actor")]
    plain = [F.right(q, F.length(q) - 5) for q in quoted]  # drops {"v": and keeps value plus the closing brace
    value = [F.left(p, F.length(p) - 1) for p in plain]
    payload = F.concat(F.lit('{"action":'), value[0], F.lit(',"actor":'), value[1], F.lit(',"detail":'), detail,
                       F.lit(',"ts":"'), at, F.lit('","type":"audit"}'))
    records = numbered.select(F.col("seq").cast("bigint").alias("seq"), F.lit("audit").alias("platform"), F.lit("audit").alias("collector_id"),
                              at.alias("collected_at"), payload.alias("payload"))
    log = numbered.select("ts", "actor", "action", detail.alias("detail"), F.col("seq").cast("bigint").alias("ledger_seq"))
    return seal_records(records, last_hash=last_hash), log.orderBy(F.desc("ledger_seq"))
