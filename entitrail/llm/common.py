"""What the corpus operators share: reading tables, the shared work folder, Arrow mapping."""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to Python; Spark's own bound suits short rows, not documents.
ARROW_BATCH = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to ARROW_BATCH bytes, which JVM and Python each hold some of."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").rstrip("bB")  # Spark answers in bytes
    if not now.isdigit() or int(now) > ARROW_BATCH:
        spark.conf.set(key, f"{ARROW_BATCH}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors must share; without that setting there is none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, computes it once, survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out anew only if the input has fewer partitions than cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in itertools.chain([w], (f"{w}_{n}" for n in itertools.count(1))) if x.lower() not in taken) for w in wanted]


def by_id_and_text(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (left_semi or left_anti) with ``keys`` (doc_id, text_hash), where a null id equals a null id."""
    a, b = free_names(docs, "key_id", "key_hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    return docs.join(keys.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)), same, how)


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` less the rows of ``removed`` (doc_id[, text_hash]), a written table; by both, a null id equals a null id."""
    if "text_hash" in removed.columns:
        return by_id_and_text(docs, removed, "left_anti")
    [a] = free_names(docs, "key_id")
    return docs.join(removed.select(F.col("doc_id").alias(a)), F.col("doc_id").cast("long") == F.col(a), "left_anti")


#: Characters of text that Python code takes from an Arrow batch at a time.
SLICE_CHARS = 4_000_000


def column_slices(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most about SLICE_CHARS bytes of text, the column ``at``, or one row."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_CHARS // max(batch.column(at).nbytes, SLICE_CHARS))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Lists of (first column's values, texts), null text as empty, of at most SLICE_CHARS bytes or one row."""
    for part in column_slices(batches):
        yield part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 4, is not 2. Null ids are left out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
