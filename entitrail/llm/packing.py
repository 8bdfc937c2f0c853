"""Packing of documents into fixed windows by the sum-of-squares rule.

Each partition of the input packs its own documents in one pass, without a shuffle. A document gives full windows
for each whole ``window`` of ids; the rest is placed, uncut, into the fill level that minimises the sum of squared
counts of partially filled windows, which a level array tracks. Windows that are still open at the end of a partition
(or when their ids pass ``open_ids``, a parameter that bounds memory and changes the layout, never the padding) are laid end to end and cut anew into full windows; what
remains after that becomes windows whose lengths are powers of two, so no padding is needed.

Defined cases: a null or empty text is its end id alone; a null ``doc_id`` is kept; repeated rows are packed each;
an empty table gives no rows; other columns are ignored. Retries give the same result, as a file split's rows
come in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark import TaskContext

from .chunks import library_coder
from .common import crc, spread, table, text_slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Packer:
    """Online sum-of-squares packing. ``emit`` gets (sequence number, pieces); a piece is (doc_id, start, id bytes, doc_tokens)."""

    def __init__(self, window: int, emit, open_ids: int = 4_000_000):
        self.window, self.emit, self.most = window, emit, open_ids
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array: open windows by fill
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.sequence, self.held = 0, 0

    def close(self, pieces: list) -> None:
        self.emit(self.sequence, pieces)
        self.sequence += 1

    def level(self, size: int) -> int:
        """The fill level, 0 for a new window, whose choice gives the least sum of squared counts; the fullest of equals."""
        n = self.window - size
        gain = self.count[size:] - self.count[: n + 1]  # of level h: count[h + size] - count[h], up to a factor
        change = 2 * gain + 2
        change[n] -= 2 * self.count[self.window] + 1  # a filled window is no longer counted
        change[0] = 2 * self.count[size] + 1
        change[1:][self.count[1 : n + 1] == 0] = np.iinfo(np.int64).max
        return n - int(np.argmin(change[::-1]))

    def add(self, doc_id, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        full = total - total % w
        for start in range(0, full, w):
            self.close([(doc_id, start, ids[4 * start : 4 * (start + w)], total)])
        if full < total:
            self.place((doc_id, full, ids[4 * full :], total))
            if self.held > self.most:
                self.settle(False)

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        h = self.level(size)
        pieces = []
        if h:
            pieces = self.at[h].pop()
            self.count[h] -= 1
        pieces.append(piece)
        if h + size == self.window:
            self.held -= h
            self.close(pieces)
        else:
            self.held += size
            self.at[h + size].append(pieces)
            self.count[h + size] += 1

    def settle(self, last: bool) -> None:
        """Lays the open windows end to end, fullest first, and cuts them into full windows; ``last``: and the rest into powers of two."""
        queue = [x for level in reversed(self.at) for pieces in level for x in pieces]
        self.count[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        left = sum(len(x[2]) // 4 for x in queue)
        self.held = 0
        pieces, room = [], self.room(left, last)
        for doc_id, start, ids, total in queue:
            while ids:
                if room == 0:  # not last, and less than a window remains
                    self.place((doc_id, start, ids, total))
                    break
                cut = ids[: 4 * room]
                pieces.append((doc_id, start, cut, total))
                n = len(cut) // 4
                ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
                if room == 0:
                    self.close(pieces)
                    pieces, room = [], self.room(left, last)

    def room(self, left: int, last: bool) -> int:
        if left >= self.window:
            return self.window
        return 1 << (left.bit_length() - 1) if last and left else 0


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, open_ids: int = 4_000_000) -> DataFrame:
    """Pieces of the documents (doc_id, text), see SCHEMA; ``sequence_id`` is the partition and a number within it."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base, rows = library_coder(tokenizer), TaskContext.get().partitionId() << 40, []

        def emit(sequence: int, pieces: list) -> None:
            offset = 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids) // 4, crc(ids), total, base + sequence, offset))
                offset += len(ids) // 4

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, schema=_ARROW)
            rows.clear()
            return batch

        packer = Packer(window, emit, open_ids)
        for doc_ids, texts in text_slices(batches):
            for doc_id, ids in zip(doc_ids, coder.encode(texts)):
                packer.add(doc_id, ids + end)
            yield out()
        packer.settle(True)
        yield out()

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
