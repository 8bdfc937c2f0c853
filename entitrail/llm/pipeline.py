"""The corpus pipeline: from documents to packed training sequences, each stage one operator of ``entitrail.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
back as the next one's docs. All but the last return the columns of docs. Every stage works on all rows that its
predecessor kept, with whole texts, and accepts what the operators accept: null texts, labels and ids, repeated rows,
other columns, empty tables.

1. language_id: rows go whose text has no letter or, if it has some length, is in none of the languages that docs
   themselves teach; where they teach none, all lettered rows stay.
2. toxicity: rows go that score THRESHOLD or more; it learns from docs with labels.
3. simhash: of each group of near duplicates, linked over any way, the row with the least doc_id (then text hash) stays.
4. pii: every span of personal data and every secret in text gives way to its kind's name; n_chars follows.
5. packing: pieces of token ids in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, packing, pii, simhash, toxicity
from .common import in_training, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.kept_rows(docs, langid.fit(docs, in_training()))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept_rows(docs, table(spark, sf_dir, "labels"), toxicity.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.redacted(docs)
    return found.withColumn("n_chars", F.length("text").cast(found.schema["n_chars"].dataType)) if "n_chars" in found.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("simhash", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: Models, fingerprints and token ids are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
