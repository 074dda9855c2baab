"""Packing into fixed windows (operator 6): sum-of-squares online packing.

Every task packs the documents of its input split as they come.  A document
first fills whole windows; its rest goes to the fill level for which the sum of
squares of the counts of open windows per level becomes least (Csirik et al.).
The counts per level are one array.  When a task holds ``max_open`` windows, and
at its end, the open windows are poured together and cut into full ones, which
bounds memory and leaves less than a window; at the end that rest becomes
sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from phaseloom.llm.common import released, text_or_empty
from phaseloom.llm.library_ids import word_ids

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


class SumOfSquares:
    """Online packing of ids into windows; ``done`` collects (sequence, offset, piece)."""

    def __init__(self, window: int = 4096, max_open: int = 512):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = self.next_sequence = 0
        self.done: list[tuple[int, int, Piece]] = []

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.done.append((self.next_sequence, offset, p))
            offset += len(p[2])
        self.next_sequence += 1

    def _level(self, size: int) -> int:
        """The level to add ``size`` ids to; 0 opens a window.  Ties: the fullest."""
        n, top = self.levels, self.window - size
        here, there = n[1 : top + 1], n[1 + size : self.window + 1]
        change = (there - here + 1).astype(float)
        if top:
            change[-1] = 0.5 - here[-1]  # it becomes full and is open no more
            change[here == 0] = np.inf
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= n[size] + 0.5:
                return best + 1
        return 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self._close([(doc_id, at, ids[at : at + self.window], total)])
            at += self.window
        size = total - at
        if not size:
            return
        h = self._level(size)
        pieces = self.open[h].pop() if h else []
        pieces.append((doc_id, at, ids[at:], total))
        if h:
            self.levels[h] -= 1
        else:
            self.n_open += 1
        if h + size == self.window:
            self.n_open -= 1
            self._close(pieces)
        else:
            self.levels[h + size] += 1
            self.open.setdefault(h + size, []).append(pieces)
        if self.n_open > self.max_open:
            self._pour()

    def _pour(self) -> None:
        """All open windows, fullest first, cut into full ones; the rest stays open."""
        pieces = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        held: list[Piece] = []
        room = self.window
        for doc_id, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                held.append((doc_id, start + at, ids[at : at + take], total))
                at, room = at + take, room - take
                if not room:
                    self._close(held)
                    held, room = [], self.window
        if held:
            self.levels[self.window - room] = self.n_open = 1
            self.open[self.window - room] = [held]

    def finish(self) -> None:
        self._pour()
        for (pieces,) in self.open.values():
            left = sum(len(p[2]) for p in pieces)
            queue = list(pieces)
            while left:
                size = 1 << (left.bit_length() - 1)
                left -= size
                own: list[Piece] = []
                while size:
                    doc_id, start, ids, total = queue.pop(0)
                    own.append((doc_id, start, ids[:size], total))
                    if len(ids) > size:
                        queue.insert(0, (doc_id, start + size, ids[size:], total))
                    size -= len(own[-1][2])
                self._close(own)
        self.open, self.n_open = {}, 0
        self.levels[:] = 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, max_open: int = 512, with_ids: bool = False, encode: Callable[[str, list[str]], Iterator[np.ndarray]] = word_ids) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    and offset, and with ``with_ids`` the ids themselves.

    A document is its ids and then ``end_id``; null text counts as empty, so it
    is that id alone.  Rows are packed one by one: repeated rows and null doc_id
    are packed like others.  An empty table gives no rows.  Sequence ids hold
    the task's number in their upper bits; a task that runs again on its split
    gives the same pieces.
    """

    @released
    def run(batches):
        packer = SumOfSquares(window, max_open)
        base = TaskContext.get().partitionId() << 36

        def rows() -> pa.RecordBatch:
            done, packer.done = packer.done, []
            cols = [
                pa.array([p[0] for _, _, p in done], pa.int64()),
                pa.array([p[1] for _, _, p in done], pa.int64()),
                pa.array([len(p[2]) for _, _, p in done], pa.int64()),
                pa.array([zlib.crc32(p[2].astype("<u4").tobytes()) for _, _, p in done], pa.int64()),
                pa.array([p[3] for _, _, p in done], pa.int64()),
                pa.array([base + s for s, _, _ in done], pa.int64()),
                pa.array([o for _, o, _ in done], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([p[2].astype(np.int32) for _, _, p in done], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(path, b.column("text").to_pylist()), strict=True):
                packer.add(doc_id, np.concatenate((ids, end)))
                if len(packer.done) >= 4096:
                    yield rows()
        packer.finish()
        yield rows()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
