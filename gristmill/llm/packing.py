"""Sum-of-squares packing of documents into training windows.

Every task packs the documents of its own partition, online, in the order in which they come. A document's ids are cut at
the window length; the rest, shorter than a window, goes to the fill level that leaves the least sum of squared counts of
partly filled windows. The counts stand in an array over levels. Windows still open at the end of a partition are
strung together and cut anew, the very last remainder at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.tokens import encoder


class Levels:
    """Counts of open windows by fill level, and which windows those are."""

    def __init__(self, length: int):
        self.length = length
        self.count = np.zeros(length + 1, dtype=np.int64)
        self.windows: dict[int, list[int]] = {}

    def choose(self, size: int) -> int:
        """Level (0: a new window) where ``size`` ids add least to the sum of squares; the fullest of equals."""
        n = self.count
        levels = np.flatnonzero(n[1 : self.length - size + 1]) + 1
        levels = np.concatenate([levels, [0]])
        after = levels + size
        # a level that loses a window: (n-1)^2 - n^2; one that gains a window: (n+1)^2 - n^2; a full one isn't counted
        change = np.where(levels > 0, 1 - 2 * n[levels], 0) + np.where(after < self.length, 2 * n[after] + 1, 0)
        best = np.flatnonzero(change == change.min())
        return int(levels[best].max())

    def take(self, level: int) -> int | None:
        if level == 0:
            return None
        self.count[level] -= 1
        return self.windows[level].pop()

    def put(self, level: int, window: int) -> None:
        if level < self.length:
            self.count[level] += 1
            self.windows.setdefault(level, []).append(window)


class Packer:
    """Packs one stream of documents; ``place`` and ``finish`` give rows of pieces."""

    def __init__(self, length: int = 4096, first_sequence: int = 0):
        self.length, self.next = length, first_sequence
        self.levels = Levels(length)
        self.open: dict[int, list[tuple]] = {}  # pieces of windows that aren't full

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, doc_id: int | None, raw: bytes) -> Iterator[tuple]:
        total = len(raw) // 4
        full = total - total % self.length
        for start in range(0, full, self.length):
            yield from self._rows(self._new(), [(doc_id, start, raw[4 * start : 4 * (start + self.length)], total)])
        size = total - full
        if size:
            level = self.levels.choose(size)
            window = self.levels.take(level)
            window = self._new() if window is None else window
            pieces = self.open.setdefault(window, [])
            pieces.append((doc_id, full, raw[4 * full :], total))
            if level + size == self.length:
                yield from self._rows(window, self.open.pop(window))
            else:
                self.levels.put(level + size, window)

    def finish(self) -> Iterator[tuple]:
        """The windows still open, strung together and cut anew."""
        queue = [p for w in sorted(self.open) for p in self.open[w]]
        left = sum(len(p[2]) // 4 for p in queue)
        self.open.clear()
        at = 0
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            own = []
            while room:
                doc_id, start, raw, total = queue[at]
                n = min(room, len(raw) // 4)
                own.append((doc_id, start, raw[: 4 * n], total))
                room -= n
                if 4 * n == len(raw):
                    at += 1
                else:
                    queue[at] = (doc_id, start + n, raw[4 * n :], total)
            yield from self._rows(self._new(), own)

    def _rows(self, window: int, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, raw, total in pieces:
            n = len(raw) // 4
            yield doc_id, start, n, raw, total, window, offset
            offset += n


def pack(docs: DataFrame, tokenizer: str, *, length: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids
    (packed u32, little endian) if ``with_ids``.

    No shuffle: a partition of the input is packed by the task that reads it, and ``sequence_id`` holds the partition in its
    upper bits, so a task that runs again gives the same rows. Memory is bounded by the open windows (few: their counts are
    what the method keeps small) and one batch of texts. A null text counts as empty and has the end id alone; a null
    doc_id is packed like any other; repeated rows are packed each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        packer = Packer(length, TaskContext.get().partitionId() << 36)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, n, raw, total, window, offset = zip(*rows, strict=True)
            cols = {"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(n, pa.int64())}
            cols |= {"ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()), "doc_tokens": pa.array(total, pa.int64())}
            cols |= {"sequence_id": pa.array(window, pa.int64()), "offset": pa.array(offset, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(raw, pa.binary())
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                some, rows = batch.slice(at, 1_024), []
                for key, raw in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    rows += packer.place(key, raw)
                if rows:
                    yield out(rows)
        rows = list(packer.finish())
        if rows:
            yield out(rows)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, kinds + ", ids binary" * with_ids)
