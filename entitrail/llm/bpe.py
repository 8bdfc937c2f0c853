"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token-byte table.

1. Each task cuts whole texts into pre-tokens and numbers the distinct ones of a block of documents; the positions
   are kept as the sequence of these numbers. A block ends with the document that brings ``block_words`` distinct
   words, ``block_positions`` positions or ``block_docs`` documents.
2. A block's distinct words are dealt by hash into buckets, packed: one row per block and bucket. In a bucket every
   distinct word is merged to ids once, and its ids go back to each block that holds it.
3. Per block, words and positions meet again and the ids of each document are put in order.

No task holds more than one block, or the distinct words of one bucket (at most ``most_words``; beyond, the memory
starts anew, which costs time only). A frequent word is one entry per block, so no key is hot.

Defined cases: a null or empty text has no ids; ``doc_id`` may be null or repeat, each row gives a row; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import spread, table, text_slices, work_dir

_BLOCKS = "block long, bucket int, doc_ids array<long>, counts array<long>, payload binary"
_INDEX = -1  # the bucket number of a block's positions


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Words(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    import zstandard

    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype="<u4").tobytes()
    planes = (a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)  # like bytes stand together
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes) + tail)


def _unpacked(payload: bytes) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out = 4 + 4 * n, []
    for size in np.frombuffer(raw, "<u4", n, 4):
        out.append(np.frombuffer(raw, np.uint8, 4 * int(size), at).reshape(4, -1).T.copy().view("<u4").reshape(-1))
        at += 4 * int(size)
    return out, raw[at:]


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def blocks(docs: DataFrame, pattern: str, buckets: int, block_words: int = 280_000, block_positions: int = 4_000_000, block_docs: int = 100_000) -> DataFrame:
    """Rows of _BLOCKS: a block's positions, and its distinct words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        number = itertools.count(TaskContext.get().partitionId() << 32)
        words, ids, sequences, held = _Words(), [], [], 0

        def out() -> pa.RecordBatch:
            block = next(number)
            rows = [(block, _INDEX, list(ids), [len(x) for x in sequences], _packed(np.concatenate(sequences)))]
            dealt: list[list[tuple[int, bytes]]] = [[] for _ in range(buckets)]
            for word, n in words.items():
                raw = word.encode()
                dealt[zlib.crc32(raw) % buckets].append((n, raw))
            for bucket, own in enumerate(dealt):
                if own:
                    rows.append((block, bucket, None, None, _packed(np.diff([n for n, _ in own], prepend=0), np.array([len(x) for _, x in own]), tail=b"".join(x for _, x in own))))
            words.clear(), ids.clear(), sequences.clear()
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=["block", "bucket", "doc_ids", "counts", "payload"])

        for doc_ids, texts in text_slices(batches):
            for doc_id, text in zip(doc_ids, texts):
                ids.append(doc_id)
                sequences.append(np.fromiter(map(words.__getitem__, find(text)), dtype=np.uint32))
                held += len(sequences[-1])
                if len(words) >= block_words or held >= block_positions or len(ids) >= block_docs:
                    yield out()
                    held = 0
        if ids:
            yield out()

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, _BLOCKS)


def word_ids(words: DataFrame, ranks: str, pattern: str, most_words: int = 1_000_000) -> DataFrame:
    """For the packed words of each (block, bucket), partitions dealt and sorted by bucket: the packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            blocks_out, payloads = [], []
            for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now or len(known) > most_words:
                    known.clear()
                    now = bucket
                (numbers, lengths), raw = _unpacked(payload)
                ends = _offsets(lengths).tolist()
                own = []
                for a, b in itertools.pairwise(ends):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = coder._encode_single_piece(word)
                    own.append(ids)
                blocks_out.append(block)
                payloads.append(_packed(numbers, np.array([len(x) for x in own]), np.fromiter(itertools.chain.from_iterable(own), dtype=np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks_out, pa.int64()), pa.array(payloads, pa.binary())], names=["block", "payload"])

    return words.mapInArrow(run, "block long, payload binary")


def encode(docs: DataFrame, ranks: str, pattern: str, then: Callable[[pa.Table], pa.Table] | None = None, schema: str = "doc_id long, ids binary") -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers.

    ``then`` maps such a table of a block's documents where it is made, giving ``schema``, so that ids need not travel.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select("doc_id", "text")
    buckets = min(1 << 12, max(256, 2 * source.rdd.getNumPartitions()))  # some 70 words of a block at least
    made = _clustered(blocks(source, pattern, buckets), min(4 * parts, 50_000))
    words = made.where(f"bucket <> {_INDEX}").select("block", "bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket")
    index = made.where(f"bucket = {_INDEX}").select("block", "doc_ids", "counts", "payload")

    def made_whole(index: pa.Table, ids: pa.Table) -> pa.Table:
        return then(_reassembled(index, ids)) if then else _reassembled(index, ids)

    return index.groupBy("block").cogroup(word_ids(words, ranks, pattern).groupBy("block")).applyInArrow(made_whole, schema)


def _clustered(df: DataFrame, n: int) -> DataFrame:
    """``df`` written to the shared folder in ``n`` buckets by block, so that later work by block moves only the other side."""
    spark, name = df.sparkSession, f"entitrail_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", work_dir(spark, "bpe-blocks")).bucketBy(n, "block").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files at a given path stay, and the frame is resolved
    return found


def _reassembled(index: pa.Table, ids: pa.Table) -> pa.Table:
    """A block's documents: positions and the ids of its words meet."""
    words = [_unpacked(x)[0] for x in ids.column("payload").to_pylist()]
    empty = [np.zeros(0, np.uint32)]
    number = np.concatenate([np.cumsum(x[0]) for x in words] or empty)
    length = np.concatenate([x[1] for x in words] or empty)
    flat = np.concatenate([x[2] for x in words] or empty)
    start, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    start[number], size[number] = _offsets(length)[:-1], length
    doc_ids, out = [], []
    for _, of, counts, payload in zip(*(index.column(c).to_pylist() for c in ("block", "doc_ids", "counts", "payload"))):
        sequence = _unpacked(payload)[0][0]
        doc_ids += of
        for a, b in itertools.pairwise(_offsets(np.array(counts)).tolist()):
            own = sequence[a:b]
            n = size[own]
            out.append(flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<u4").tobytes())
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.binary())})


@functools.lru_cache(maxsize=1)
def token_bytes(ranks: str) -> list[bytes]:
    """The token-byte table of a rank file, bounded by the vocabulary; one per Python worker."""
    found = load_ranks(ranks)
    out = [b""] * (max(found.values()) + 1)
    for raw, rank in found.items():
        out[rank] = raw
    return out


def decoded(ids: list[int], ranks: str) -> bytes:
    return b"".join(map(token_bytes(ranks).__getitem__, ids))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, content): the bytes that the ids of (doc_id, ids) stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decoded(np.frombuffer(x, "<u4").tolist(), ranks) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """What the query returns: the ids of each text, decoded again, as digests."""

    def digest(rows: pa.Table) -> pa.Table:
        sizes, ids_sha, decoded_sha = [], [], []
        for x in rows.column("ids"):  # one at a time, as texts may be long
            ids = np.frombuffer(x.as_buffer(), "<u4").tolist()
            sizes.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decoded(ids, ranks)).hexdigest())
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())})

    return encode(docs, ranks, pattern, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
