"""Language identification by a blended-spectrum string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text is the set of its character n-grams for n = 1 .. ``n_max`` (presence, lower case, digits as one character),
hashed into ``bins``; the kernel of two texts is the cosine of these sets. A bounded sample of labelled rows, dealt
evenly over the languages, is fitted: ``landmarks`` of them give the Nystroem features K(x, L) K(L, L)^-1/2, on which a
ridge regression per language (1 for its rows, -1 for others) is solved. As K(x, L) is a product with the landmarks'
sets, landmarks and weights fold into one matrix of a column per language, and texts are scored in batches by one matrix
product each. The score is the softmax of the regressions' outputs. As a filter, a text of some length is rejected if
too few of its n-grams occur in the sample, so that no language's kernel can speak for it: see ``kept_rows``.

Only text and non-null ``lang`` of training rows are learned from. Sets of the sample reach the driver as bits, ``bins``
/ 8 bytes a row, whatever the texts' lengths.

Defined cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn from, all are;
``doc_id`` may be null or repeat, each row gives a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_slices, held_out, in_training, spread, table, text_slices

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
BINS = 1 << 15
#: A text with at least so many letters is in no learned language if the sample has a lesser share of its n-grams.
REJECT, REJECT_LETTERS = 0.8, 50


def presence(texts: list[str], bins: int, n_max: int = 3) -> np.ndarray:
    """A row per text, 1 where an n-gram of it falls into the bin."""
    out = np.zeros((len(texts), bins), dtype=np.float32)
    mask = np.uint32(bins - 1)
    for row, text in zip(out, texts):
        for at in range(0, len(text), 1 << 20):  # whole texts, a part at a time
            code = np.frombuffer(text[max(0, at - n_max + 1) : at + (1 << 20)].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            code = np.where((code >= 48) & (code <= 57), np.uint32(48), code)
            gram = np.zeros(len(code), dtype=np.uint32)
            for n in range(n_max):
                if len(code) <= n:
                    break
                gram = gram[: len(code) - n] * np.uint32(0x01000193) + code[n:] + np.uint32(1)
                mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                row[(mixed ^ (mixed >> np.uint32(13))) & mask] = 1
    return out


def _unit(sets: np.ndarray) -> np.ndarray:
    return sets / np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # bins x languages
    bias: np.ndarray
    sharpness: float
    known: np.ndarray  # bins that two rows of the sample have
    reject: float

    def outputs(self, texts: list[str]) -> np.ndarray:
        """The regressions' outputs, a row per text, a column per language."""
        return self.measures(texts)[0]

    def measures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The outputs, and the share of each text's n-grams that the sample has, too."""
        out, share = np.empty((len(texts), len(self.languages))), np.empty(len(texts))
        for at in range(0, len(texts), 128):
            sets = presence(texts[at : at + 128], self.weights.shape[0])
            share[at : at + 128] = (sets @ self.known) / np.maximum(sets.sum(axis=1), 1)
            out[at : at + 128] = _unit(sets) @ self.weights + self.bias
        return out, share

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities."""
        return self.softmax(self.outputs(texts))

    def softmax(self, out: np.ndarray) -> np.ndarray:
        out = np.exp(self.sharpness * (out - out.max(axis=1, keepdims=True)))
        return out / out.sum(axis=1, keepdims=True)


def _rows_of(bits: np.ndarray) -> np.ndarray:
    return _unit(np.unpackbits(bits, axis=1).astype(np.float32))


def fit_kernel_ridge(bits: np.ndarray, langs: list[str], landmarks: int, ridge: float = 1.0, sharpness: float = 4.0) -> Model:
    """Of rows (sets as packed bits) in an order that deals languages evenly: the first ``landmarks`` are landmarks.

    Only the landmarks' sets are unpacked together; the others meet them 128 at a time.
    """
    languages = sorted(set(langs))
    z = _rows_of(bits[:landmarks])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # K(L, L)^-1/2 up to a rotation
    phi = np.concatenate([(_rows_of(bits[at : at + 128]) @ z.T).astype(np.float64) for at in range(0, len(bits), 128)]) @ root
    mean = phi.mean(axis=0)
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1.0 / np.unique(langs, return_counts=True)[1][np.searchsorted(languages, langs)]  # languages count alike
    weight *= len(langs) / weight.sum()
    c = (phi - mean) * weight[:, None]
    centre = (y * weight[:, None]).mean(axis=0)
    beta = np.linalg.solve(c.T @ (phi - mean) + ridge * np.eye(phi.shape[1]), c.T @ (y - centre))
    parts = [np.unpackbits(bits[at : at + 128], axis=1) for at in range(0, len(bits), 128)]
    known = (sum(p.sum(axis=0, dtype=np.int64) for p in parts) >= 2).astype(np.float32)
    shares = np.concatenate([(p @ known) / np.maximum(p.sum(axis=1), 1) for p in parts])
    # a small sample does not have all n-grams of its languages: what rejects is well below its own rows
    reject = min(REJECT, 0.9 * float(np.quantile(shares, 0.01)))
    return Model(languages, (z.T.astype(np.float64) @ (root @ beta)).astype(np.float32), centre - mean @ beta, sharpness, known, reject)


def fit(docs: DataFrame, train: Column, per_language: int = 400, most: int = 4000, landmarks: int = 160) -> Model | None:
    """From (doc_id, text, lang): at most ``per_language`` rows of each language and ``most`` in all, least id hashes first."""
    spark = docs.sparkSession
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # of frequent languages only rows with small hashes, some times as many as are wanted, need to be ranked
    frequent = F.broadcast(rows.groupBy("lang").count().where(F.col("count") > 4 * per_language).orderBy(F.desc("count"), "lang").limit(10_000))
    share = F.coalesce(4.0 * per_language / F.col("count"), F.lit(1.0))
    few = rows.join(frequent, "lang", "left").where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= per_language).orderBy("rank", "h", "lang").limit(most).collect()
    if not sample:
        return None
    order = {(r.doc_id, r.lang): i for i, r in reversed(list(enumerate(sample)))}
    ids = F.broadcast(spark.createDataFrame([(a, b, i) for (a, b), i in order.items()], "doc_id long, lang string, place int"))
    bins = BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, texts in text_slices(batches):
            bits = [np.packbits(presence([x], bins)[0] > 0).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(bits, pa.binary())], names=["place", "bits"])

    found = docs.select("doc_id", "text", "lang").join(ids, ["doc_id", "lang"]).select("place", "text").mapInArrow(run, "place int, bits binary")
    # rows may repeat; one stands for each id
    got = sorted((r.place, r.bits) for r in found.groupBy("place").agg(F.min("bits").alias("bits")).collect())
    packed = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), -1)
    return fit_kernel_ridge(packed, [sample[p].lang for p, _ in got], landmarks)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in text_slices(batches):
            lang, score = _best(shared.value, texts)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _best(model: Model | None, texts: list[str]) -> tuple[list[str], list[float]]:
    lettered = [i for i, x in enumerate(texts) if model and _LETTER.search(x)]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if lettered:
        p = model.score([texts[i] for i in lettered])
        for i, k, row in zip(lettered, p.argmax(axis=1), p):
            lang[i], score[i] = model.languages[k], min(1.0, float(row[k]))
    return lang, score


def _kept(model: Model | None, texts: list[str], languages: list[str] | None) -> list[bool]:
    letters = [sum(map(len, _LETTERS.findall(x))) for x in texts]
    kept = [n > 0 for n in letters]
    told = np.flatnonzero(kept) if model else []
    if len(told):
        out, share = model.measures([texts[i] for i in told])
        for i, best, known in zip(told.tolist(), out.argmax(axis=1), share):
            kept[i] = (letters[i] < REJECT_LETTERS or known >= model.reject) and (languages is None or model.languages[best] in languages)
    return kept


def kept_rows(docs: DataFrame, model: Model | None, languages: list[str] | None = None) -> DataFrame:
    """All columns of the rows that are in a learned language, or of ``languages`` only.

    Rows without a letter go; rows of REJECT_LETTERS letters and more go if the sample has less than a share REJECT of
    their n-grams, or less than nine tenths of the share that all but one in a hundred of its own rows reach. (On
    check_s all such rows have 0.9 and more; other alphabets 0.3, letters at random 0.6, related languages 0.7.) Shorter
    lettered rows say too little to be rejected. Without a model, all lettered rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in column_slices(batches, at):
            texts = [x or "" for x in part.column(at).to_pylist()]
            yield part.filter(pa.array(_kept(shared.value, texts, languages), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, in_training()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
