"""Bloom filters of a fixed size, built by tasks that each own slices of them.

Hashes travel as packed arrays, one row per slice; the task that owns a slice
keeps two arrays of bits: hashes seen once, and hashes that were seen before.
Only the finished bits reach the driver, and their size does not follow the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64
ROW_SCHEMA = "slice int, n long, hashes binary"
_SLICE_SHIFT = np.uint64(58)


def slice_rows(hashes: np.ndarray) -> pa.RecordBatch:
    """Rows of ROW_SCHEMA that hold ``hashes``."""
    owner = (hashes >> _SLICE_SHIFT).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    own, first = np.unique(owner, return_index=True)
    parts = np.split(hashes, first[1:]) if len(own) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
        ["slice", "n", "hashes"],
    )


def _bit_pairs(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions inside a slice of ``bits`` bits (a power of two)."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(29) & mask).astype(np.int64)


def _has(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1) != 0


def _put(words: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(words, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


class BitFilter:
    """``has`` may err on the side of true, never of false."""

    def __init__(self, slices: dict[int, np.ndarray], bits: int):
        self.slices, self.bits = slices, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        owner = (hashes >> _SLICE_SHIFT).astype(np.int64)
        for s in np.unique(owner):
            if s in self.slices:
                at = np.flatnonzero(owner == s)
                a, b = _bit_pairs(hashes[at], self.bits)
                out[at] = _has(self.slices[s], a) & _has(self.slices[s], b)
        return out


def _fill(bits: int, repeated: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s not in once:
                    once[s], twice[s] = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                own, times = np.unique(np.frombuffer(packed, np.uint64), return_counts=True)
                a, b = _bit_pairs(own, bits)
                again = (times > 1) | (_has(once[s], a) & _has(once[s], b))
                for at in (a, b):
                    _put(twice[s], at[again])
                    _put(once[s], at)
        for s, words in (twice if repeated else once).items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["slice", "words"])

    return run


def build_filter(rows: DataFrame, n: int, bits_per_hash: int, max_bytes: int, repeated: bool) -> BitFilter:
    """The filter of ``rows`` (ROW_SCHEMA) holding about ``n`` hashes: of all of
    them, or of those that occur at least twice (``repeated``). It has
    ``bits_per_hash`` bits for each, ``max_bytes`` in all at most; a fuller
    filter only lets more through."""
    wanted = max(n, 1) * bits_per_hash // SLICES
    bits = min(max(1 << 10, 1 << (wanted - 1).bit_length()), max_bytes * 8 // SLICES)
    built = rows.select("slice", "hashes").repartition(SLICES, "slice").mapInArrow(_fill(bits, repeated), "slice int, words binary")
    # SLICES rows, max_bytes together at most
    return BitFilter({r["slice"]: np.frombuffer(r["words"], np.uint8) for r in built.collect()}, bits)
