"""Shards against plain minimax partition of the same order."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from small import ODD_ROWS, corpus, frame

from driftlens.llm import sharding


def text_key(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def greedy(sizes, capacity):
    shards, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return 1 << 60
        if s > room:
            shards, room = shards + 1, capacity
        room -= s
    return shards


def least_capacity(sizes, shards):
    """Smallest of all sums of contiguous groups that greedy filling meets."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.unique((at[None, :] - at[:, None])[np.triu_indices(len(at), 1)])
    return next(int(c) for c in sums if greedy(sizes, c) <= shards)


def outline_of(keys, sizes, bits=3):
    rows = defaultdict(lambda: [0, 0])
    for k, s in zip(keys, sizes, strict=True):
        rows[k >> (64 - bits)][0] += s
        rows[k >> (64 - bits)][1] += 1
    return sharding.Outline(*(np.array(x, np.int64) for x in ([*rows], [bits] * len(rows), [r[0] for r in rows.values()], [r[1] for r in rows.values()])))


def splitter(keys, sizes, calls):
    def refine(outline, wanted):
        calls.append(len(wanted))
        assert wanted and len(calls) < 200
        keep = [k for k in range(len(outline.prefix)) if k not in wanted]
        cols = [[x[k] for k in keep] for x in (outline.prefix, outline.bits, outline.size, outline.groups)]
        for k in wanted:
            depth = int(outline.bits[k])
            inside = [i for i, key in enumerate(keys) if key >> (64 - depth) == outline.prefix[k]]
            parts = outline_of([keys[i] for i in inside], [sizes[i] for i in inside], min(64, depth + 4))
            for c, x in zip(cols, (parts.prefix, parts.bits, parts.size, parts.groups), strict=True):
                c.extend(x)
        return sharding.Outline(*(np.array(c, np.int64) for c in cols))

    return refine


@pytest.mark.parametrize("seed", range(60))
def test_capacity_and_cuts(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 5, 30, 120])
    keys = sorted(rng.sample(range(-(1 << 63), 1 << 63, 1 << 40), n)) if seed % 3 else sorted(rng.sample(range(-500, 500), n))
    sizes = [rng.choice([1, 2, 3, 10, rng.randint(1, 100)]) for _ in keys]
    shards, calls = rng.randint(2, 8), []
    capacity, starts = sharding.minimax_cuts(outline_of(keys, sizes), shards, splitter(keys, sizes, calls), max(sizes))
    assert capacity == least_capacity(sizes, shards)
    assert starts == sorted(starts) and len(starts) == shards - 1
    load = Counter()
    for k, s in zip(keys, sizes, strict=True):
        load[sum(k >= x for x in starts)] += s
    assert max(load.values()) == capacity or max(load.values()) <= capacity
    small = -(-sum(sizes) // shards) + max(sizes)
    assert capacity <= small


def check(rows, got, shards=8):
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["doc_id"]))
    for slots in by.values():
        slots.sort(key=lambda x: x[0])
        assert [s for s, _ in slots] == list(range(len(slots)))
        ids = [(i is not None, i or 0) for _, i in slots]
        assert ids == sorted(ids)
    size = Counter()
    for _, t in rows:
        size[text_key(t)] += len((t or "").encode()) + 1
    home = defaultdict(set)
    digest = {(i, zlib.crc32((t or "").encode())): text_key(t) for i, t in rows}
    for r in got:
        home[digest[r["doc_id"], r["text_crc32"]]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    rest, left, alone = dict(size), shards, 0
    for k, s in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        if left > 1 and s * left > sum(rest.values()):
            alone += 1
            assert home[k] == {alone - 1}
            del rest[k]
            left -= 1
        else:
            break
    order = sorted(rest)
    where = [min(home[k]) for k in order]
    assert where == sorted(where) and (not where or where[0] >= alone)
    load = Counter()
    for k in order:
        load[min(home[k])] += rest[k]
    if order:
        assert max(load.values()) <= least_capacity([rest[k] for k in order], left)
    return load


def test_documents(spark):
    rows = [(i, t) for i, t in corpus(8) if len(t or "") < 5000]
    rows += [(1000 + i, f"text {i} " + "w" * (i % 70)) for i in range(400)] + [(5000, None), (5001, ""), *ODD_ROWS]
    load = check(rows, sharding.assign_shards(frame(spark, rows)).collect())
    assert len(load) == 8 and max(load.values()) < 1.25 * min(load.values())


def test_hot_group_and_few_groups(spark):
    hot = [(i, "a copy of which there are many" * 3) for i in range(900)] + [(2000 + i, f"{i} another text {i * i} here") for i in range(500)]
    load = check(hot, sharding.assign_shards(frame(spark, hot)).collect())
    assert len(load) == 7 and max(load.values()) < 1.1 * min(load.values())
    few = [(1, "a"), (2, "b"), (3, "a"), (4, "y" * 300_000)]
    check(few, sharding.assign_shards(frame(spark, few)).collect())
    same = [(i, "x") for i in range(20)]
    assert {r["shard"] for r in sharding.assign_shards(frame(spark, same)).collect()} == {0}
    assert sharding.assign_shards(frame(spark, [])).collect() == []


def test_written(spark, tmp_path):
    rows = [(i, f"text {i % 50}") for i in range(300)]
    docs = frame(spark, rows).withColumnRenamed("slot", "shard")
    made = sharding.write_shards(docs, str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows
    assert "shard_" in back.columns and sum(r["rows"] for r in made.collect()) == 300
    assert all(len({r["shard_"] for r in back.where(back["text"] == t).collect()}) == 1 for t in ("text 0", "text 7"))
    assert sharding.write_shards(frame(spark, []), str(tmp_path / "none")).collect() == []
