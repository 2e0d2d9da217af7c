"""A double-array trie over sequences of turns, and what its nodes say about them.

A sequence is a byte string of 16 bytes a turn (see ``conversations``). Turns get dense
ids in the order in which the levels of the trie meet them, so siblings mostly have ids
next to each other. A node is a cell: its child by turn c is cell ``base[node] + c``,
provided that ``check`` of that cell is the node. Cells that a wide node leaves between
its children are filled by later nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TOKEN = 16
_FREE = -1


def split(sequences: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(turns, lengths, bounds): a number for each distinct turn, in the order of the
    sequences, the code points of each turn, and where each sequence begins."""
    sequences = sequences.cast(pa.large_binary())
    at = np.frombuffer(sequences.buffers()[1], np.int64)[sequences.offset : sequences.offset + len(sequences) + 1]
    data = (sequences.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])]
    n = len(data) // TOKEN
    tokens = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TOKEN), n, [None, data])
    turns = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.frombuffer(data, ">u4")[3::4].astype(np.int64)
    return turns, lengths, (at - at[0]) // TOKEN


class DoubleArrayTrie:
    """Trie of sequences that are sorted and distinct."""

    def __init__(self, turns: np.ndarray, bounds: np.ndarray):
        self.base, self.check = np.zeros(64, np.int64), np.full(64, _FREE, np.int64)
        self.check[0] = 0  # the root is cell 0 and its own parent
        self._top, self._holes = 1, np.zeros(0, np.int64)
        self._code = np.full(int(turns.max()) + 1 if len(turns) else 0, -1, np.int64)
        self._codes = 0
        self.levels = [np.zeros(1, np.int64)]
        start, size = bounds[:-1], np.diff(bounds)
        state, live, depth = np.zeros(len(size), np.int64), np.flatnonzero(size > 0), 0
        while len(live):
            turn = turns[start[live] + depth]
            # sorted sequences: those of one child follow each other
            new = np.ones(len(live), bool)
            new[1:] = (state[live][1:] != state[live][:-1]) | (turn[1:] != turn[:-1])
            heads = np.flatnonzero(new)
            cells = self._add(state[live][heads], self._dense(turn[heads]))
            state[live] = cells[np.cumsum(new) - 1]
            self.levels.append(cells)
            depth += 1
            live = live[size[live] > depth]

    def _dense(self, turns: np.ndarray) -> np.ndarray:
        fresh, first = np.unique(turns[self._code[turns] < 0], return_index=True)
        order = np.argsort(first, kind="stable")
        self._code[fresh[order]] = self._codes + np.arange(len(fresh))
        self._codes += len(fresh)
        return self._code[turns]

    def _reach(self, cell: int) -> None:
        if cell >= len(self.check):
            more = max(cell + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, _FREE, np.int64)])

    def _add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Cells of the children (parent, code); those of one parent follow each
        other."""
        cells = np.zeros(len(parents), np.int64)
        edge = np.flatnonzero(np.diff(parents, prepend=-1, append=-1))
        width = np.diff(edge)
        for i, n in zip(edge[:-1][width > 1], width[width > 1], strict=True):
            cells[i : i + n] = self._place(int(parents[i]), codes[i : i + n])
        alone = edge[:-1][width == 1]
        if len(alone):
            cells[alone] = self._take(len(alone))
            self.base[parents[alone]] = cells[alone] - codes[alone]
            self.check[cells[alone]] = parents[alone]
        return cells

    def _take(self, n: int) -> np.ndarray:
        """``n`` free cells: holes first, then the end."""
        found = self._holes[self.check[self._holes] == _FREE]
        self._holes = found[n:]
        rest = n - min(n, len(found))
        self._reach(self._top + rest)
        out = np.concatenate([found[:n], np.arange(self._top, self._top + rest)])
        self._top += rest
        return out

    def _place(self, parent: int, codes: np.ndarray) -> np.ndarray:
        """Cells of several children: from one of the last holes on if all are free
        there, else from the end on."""
        low, high = int(codes.min()), int(codes.max())
        for first in [*self._holes[-8:].tolist(), self._top]:
            base = first - low
            self._reach(base + high)
            cells = base + codes
            if (self.check[cells] == _FREE).all():
                break
        self.base[parent] = base
        self.check[cells] = parent
        if base + high >= self._top:
            gap = np.arange(self._top, base + high + 1)
            gap = gap[self.check[gap] == _FREE]
            self._holes = np.concatenate([self._holes, gap]) if len(gap) else self._holes
            self._top = base + high + 1
        return cells

    def step(self, cells: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of ``cells`` by ``turns``; -1 where there is none."""
        codes = self._code[turns]
        to = self.base[cells] + codes
        inside = (codes >= 0) & (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == cells) & (to > 0), to, -1)

    def walk(self, turns: np.ndarray, bounds: np.ndarray, visit) -> np.ndarray:
        """Follows all sequences at once, level by level: ``visit(depth, rows, cells)``
        for the sequences of at least that many turns. Returns their last cells."""
        start, size = bounds[:-1], np.diff(bounds)
        cells, depth, live = np.zeros(len(size), np.int64), 0, np.arange(len(size))
        while len(live):
            visit(depth, live, cells[live])
            live = live[size[live] > depth]
            cells[live] = self.step(cells[live], turns[start[live] + depth])
            depth += 1
        return cells

    def sum_subtrees(self, values: np.ndarray) -> np.ndarray:
        """Per cell, the values of the cell and all cells below it."""
        values = values.copy()
        for cells in reversed(self.levels[1:]):
            np.add.at(values, self.check[cells], values[cells])
        return values
