"""Line dedup against a plain version."""

import hashlib
from collections import defaultdict

from small import ODD_ROWS, UPPER, corpus, frame

from driftlens.llm import bitfilter, linededup

STRIP = " \t\n\x0b\x0c\r"


def plain(rows):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(STRIP).translate(UPPER)
            if len(key) >= 20 and i is not None:
                docs[key].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            ids = docs.get(line.strip(STRIP).translate(UPPER), ())
            if not (i is not None and len(ids) >= 3 and i < max(ids)):
                stay.append(line)
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()], key=str)


def test_against_plain(spark):
    rows = corpus(2) + ODD_ROWS
    want = plain(rows)
    assert sum(r[2] for r in want) > 20
    assert rows_of(linededup.dedup_lines(frame(spark, rows))) == want


def test_a_full_filter_changes_nothing(spark):
    rows = corpus(3)
    assert rows_of(linededup.dedup_lines(frame(spark, rows), max_filter_bytes=64 * 8)) == plain(rows)


def test_other_columns_stay(spark):
    docs = frame(spark, corpus(4))
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) and r["_lost"] == 1 for r in out.collect())


def test_empty_table(spark):
    assert linededup.dedup_lines(frame(spark, [])).collect() == []


def test_filter_never_misses():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    batches = [bitfilter.slice_rows(x) for x in (a, b, a[:500], np.concatenate([b[:9], b[:9]]))]
    batches = [pa.RecordBatch.from_arrays([x.column(0), x.column(2)], ["slice", "hashes"]) for x in batches]
    for bits in (64, 4096):
        built = {s: np.frombuffer(w, np.uint8) for x in bitfilter._fill(bits, True)(iter(batches)) for s, w in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
        f = bitfilter.BitFilter(built, bits)
        assert f.has(a[:500]).all() and f.has(b[:9]).all()
    assert f.has(a[500:]).mean() < 0.1 and not f.has(np.zeros(0, np.uint64)).any()
