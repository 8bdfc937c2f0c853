"""Token ids in Simple-8b files: 64-bit words of a 4-bit selector and as many ids as fit.

File, little-endian: magic ``ES8B0001``; u32 range number, u32 file number in the range, u64 documents, u64 ids, u64
blocks, u64 words, u64 exceptions; i64 doc_id per document; u8 per document, 1 where doc_id is null; u64 ids per
document; u64 first word of each block; u64 words; u64 exceptions; a line feed. A block is BLOCK ids of the file's
stream (the last may be shorter), so blocks decode independently and all words of a selector decode at once. A word
pads with zeros at its block's end. Selector 0 escapes: the payload is an index into the exceptions, for values that
take more than 60 bits. Selectors 2 to 15 hold 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values.

Defined cases: a null or empty text is its end id alone; rows with equal ``doc_id`` follow each other in the order
of their texts' hashes and are kept each; null ids come first; an empty table gives no files and no rows.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import library_coder
from .common import column_slices, table, work_dir, written
from .files import read_blobs, write_blobs

BLOCK = 256
#: Values per word by selector; 0 is the escape and 1 is not used.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_HEAD = "<8sIIQQQQQ"


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each block, words, exceptions) of unsigned 64-bit values; every block is coded greedily, all blocks in step."""
    n = len(values)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, dtype=np.uint64)
    v[:n] = values
    big = v >= np.uint64(1) << np.uint64(60)
    exceptions = v[big]
    width = np.zeros((blocks, BLOCK + int(COUNTS.max())), dtype=np.uint8)  # bits of each value; zeros pad a block's last words
    width[:, :BLOCK] = np.frexp(v.astype(np.float64))[1].reshape(blocks, BLOCK)
    choice = np.full((blocks, BLOCK), 15, dtype=np.uint8)
    for s in range(14, 1, -1):  # the last that fits holds most values
        wide = width > BITS[s]
        rows = np.flatnonzero(BLOCK - wide[:, :BLOCK].sum(axis=1) >= COUNTS[s])
        if not len(rows):
            continue
        seen = np.cumsum(wide[rows], axis=1, dtype=np.int16)
        before = np.zeros((len(rows), BLOCK), dtype=np.int16)
        before[:, 1:] = seen[:, : BLOCK - 1]
        fits = seen[:, COUNTS[s] - 1 : COUNTS[s] - 1 + BLOCK] == before
        choice[rows] = np.where(fits, np.uint8(s), choice[rows])
    choice = choice.ravel()
    choice[big] = 0
    take = COUNTS[choice]
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    starts, block = [], []
    live = np.arange(len(at))
    while len(live):
        starts.append(at)
        block.append(live)
        at = at + take[at]
        more = at < end
        at, end, live = at[more], end[more], live[more]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), exceptions
    start = np.sort(np.concatenate(starts))
    first = np.searchsorted(start, np.arange(0, n, BLOCK)).astype(np.uint64)
    selector = choice[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    bound = np.minimum((start // BLOCK + 1) * BLOCK, n)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            words[own] |= (np.cumsum(big)[start[own]] - 1).astype(np.uint64)
            continue
        for j in range(COUNTS[s]):
            p = start[own] + j
            fits = p < bound[own]
            words[own[fits]] |= v[p[fits]] << np.uint64(BITS[s] * j)
    return first, words, exceptions


def decode_words(n: int, first: np.ndarray, words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """The ``n`` values; each selector's words are unpacked at once."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selector]
    before = np.cumsum(held) - held
    first = first.astype(np.int64)
    block = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    start = before - before[first][block] + block * BLOCK
    bound = np.minimum((block + 1) * BLOCK, n)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[start[own]] = exceptions[payload[own].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNTS[s]):
            p = start[own] + j
            fits = p < bound[own]
            out[p[fits]] = (payload[own[fits]] >> np.uint64(BITS[s] * j)) & mask
    return out


def file_bytes(part: int, number: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    first, words, exceptions = encode_words(ids)
    head = struct.pack(_HEAD, b"ES8B0001", part, number, len(doc_ids), len(ids), len(first), len(words), len(exceptions))
    known = np.array([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes()
    null = bytes(x is None for x in doc_ids)
    return b"".join([head, known, null, np.array(counts, dtype="<u8").tobytes(), first.astype("<u8").tobytes(), words.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes(), b"\n"])


class File:
    """One file's parts; the ids are decoded when asked for."""

    def __init__(self, content: bytes):
        magic, self.part, self.number, docs, self.n_ids, blocks, words, exceptions = struct.unpack_from(_HEAD, content)
        if magic != b"ES8B0001" or content[-1:] != b"\n":
            raise ValueError("not a Simple-8b id file")
        at = struct.calcsize(_HEAD)
        take = lambda kind, n: np.frombuffer(content, kind, n, at)
        known = take("<i8", docs)
        at += 8 * docs
        null = content[at : at + docs]
        at += docs
        self.doc_ids = [None if x else int(i) for i, x in zip(known, null)]
        self.counts = take("<u8", docs).astype(np.int64)
        at += 8 * docs
        self.first = take("<u8", blocks)
        at += 8 * blocks
        self.words = take("<u8", words)
        at += 8 * words
        self.exceptions = take("<u8", exceptions)
        if at + 8 * exceptions + 1 != len(content):
            raise ValueError("the file's length does not agree with its head")

    def ids(self) -> np.ndarray:
        return decode_words(self.n_ids, self.first, self.words, self.exceptions)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, file_ids: int = 2_000_000) -> None:
    """Writes the ids of (doc_id, text) to files below ``path``, in ascending ``doc_id`` order over ranges and file numbers.

    Texts are dealt by ranges of (doc_id, hash), so that equal ids do not meet in one task. A file ends with the
    document that fills it to ``file_ids``, which bounds what a task holds besides its longest document.
    """
    spark = docs.sparkSession
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = library_coder(tokenizer), TaskContext.get().partitionId()
        doc_ids, counts, parts, held, number = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            content = file_bytes(part, number, doc_ids, counts, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for rows in column_slices(batches):
            flat, sizes = coder.flat(rows.column(1))
            flat, at = flat.tobytes(), 0
            for doc_id, size in zip(rows.column(0).to_pylist(), sizes.tolist()):
                doc_ids.append(doc_id)
                counts.append(size + 1)
                parts += (flat[at : at + 4 * size], end)
                at += 4 * size
                held += counts[-1]
                if held >= file_ids:
                    yield out()
                    doc_ids, counts, parts, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield out()

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(ranges, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    write_blobs(rows.mapInArrow(run, "content binary"), path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, place, doc_id, before, n_tokens, ids): ``before`` counts the file's ids before the document; ids are little-endian u32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = File(content.as_py())
                ids, ends = f.ids().astype("<u4"), np.cumsum(f.counts)
                n = len(f.doc_ids)
                columns = [pa.array([f.part] * n, pa.int32()), pa.array([f.number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(f.doc_ids, pa.int64()), pa.array(ends - f.counts, pa.int64()), pa.array(f.counts, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(ends - f.counts, ends)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "place", "doc_id", "before", "n_tokens", "ids"])

    return read_blobs(spark, path).mapInArrow(run, "part int, number int, place int, doc_id long, before long, n_tokens long, ids binary")


def with_starts(found: DataFrame) -> DataFrame:
    """``found``, a written table of (part, number, before, n_tokens, ...), with ``start``: the ids of all documents before.

    Totals of files are summed within their range, totals of ranges, one per shuffle partition, in the driver.
    """
    files = found.groupBy("part", "number").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n_ids"))
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases = [(part, end - n) for (part, n), end in zip(totals, itertools.accumulate(n for _, n in totals))]
    starts = files.selectExpr("part", "number", "sum(n_ids) over (partition by part order by number) - n_ids own")
    # one row per range of the written order, so the lookup is as small as the number of shuffle partitions
    starts = starts.join(F.broadcast(found.sparkSession.createDataFrame(bases, "part int, base long")), "part")
    return found.join(starts, ["part", "number"]).withColumn("start", F.col("base") + F.col("own") + F.col("before")).drop("base", "own")


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_dir(spark, "simple8b")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    found = read_ids(spark, path).select("part", "number", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(written(found, "simple8b-read")).select("doc_id", "start", "n_tokens", "ids_crc32")
