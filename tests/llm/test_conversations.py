"""The trie against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftlens.llm import conversations as cv
from driftlens.llm import doublearray


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()[:12] + len(text).to_bytes(4, "big")
            own[c].append((turn is not None, turn or 0, token, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    return out


def plain(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if convs[c] == p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, seq binary, shard int, part long, token string, h int, n long"
    return spark.createDataFrame([(*r, b"x", 1, 2, "t", 3, 4) for r in rows], schema)


def got(spark, rows):
    return sorted((tuple(r) for r in cv.conversation_trie(table(spark, rows)).collect()), key=str)


def talk(rng, n, base=0):
    rows = []
    for c in range(base, base + n):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é🙂", f"only {c} {t}"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_dictionaries(spark, seed):
    rng = random.Random(seed)
    rows = talk(rng, 330, base=rng.choice([0, -150, 10**12]))
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = talk(rng, 40) + [(None, 1, "user", "no id"), (7, None, "user", "null turn"), (7, None, None, None), (50, 3, None, "no role"), (50, 4, "user", None)]
    rows += [(51, 1, "user", "twice"), (51, 1, "user", "twice"), (52, 1, "user", "tie a"), (52, 1, "user", "tie b"), (53, 0, "", "")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [(None, 1, "a", "b")]) == [] and got(spark, []) == []


def test_turnless_only(spark):
    # conversations whose own turns all give way to those of an absent first one
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(c, 0, "user", "gone")]
    want = (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())
    assert got(spark, rows) == [want] == plain(rows)


def test_hot_and_long(spark):
    rng = random.Random(4)
    same = [(c, t, "user", f"turn {t}") for c in range(6000, 15_000, 7) for t in range(8)]
    one = [(77, t, "user", f"step {t % 5}") for t in range(250)]
    first = [(c, t, "system" if t == 0 else "user", "one first turn" if t == 0 else rng.choice("abc")) for c in range(20_000, 20_400) for t in range(10)]
    rows = same + one + first + [(5, 0, "user", "x" * 500_000)]
    assert got(spark, rows) == plain(rows)


def test_double_array():
    rng = random.Random(1)
    for trial in range(40):
        seqs = sorted({bytes(b for _ in range(rng.randrange(0, 7)) for b in [rng.randrange(rng.choice([2, 30]))] * 16) for _ in range(rng.choice([1, 5, 200]))})
        turns, lengths, bounds = doublearray.split(pa.array(seqs, pa.binary()))
        trie = doublearray.DoubleArrayTrie(turns, bounds)
        seen = {}
        trie.walk(turns, bounds, lambda d, rows, cells: [seen.setdefault(seqs[r][: 16 * d], set()).add(int(c)) for r, c in zip(rows, cells, strict=True)])
        assert all(len(c) == 1 for c in seen.values()) and len({c for s in seen.values() for c in s}) == len(seen)
        assert sum(len(x) for x in trie.levels) == len(seen)
        below = trie.sum_subtrees((trie.check >= 0).astype(np.int64))
        for p, (c,) in ((p, tuple(c)) for p, c in seen.items()):
            assert below[c] == sum(q.startswith(p) for q in seen)
        missing = trie.step(np.zeros(1, np.int64), np.array([turns.max()])) if len(turns) else None
        assert missing is None or missing[0] in {c for s in seen.values() for c in s} | {-1}


def test_owners():
    # the last node of shard 0 is shared on to shard 3, one turn less deep each time
    seams = cv.Seams([-1, 3, 2, 1], [4, 3, 2, 5])
    assert seams.owners(1).tolist() == [0, 0, 0, 0]
    assert seams.owners(2).tolist() == [0, 0, 0]
    assert seams.owners(3).tolist() == [0, 0]
    apart = cv.Seams([-1, 2, 3], [5, 0, 5])
    assert apart.owners(2).tolist() == [0, 1, 1, 1]
