"""Toxicity by class-conditional Kneser-Ney models of words' letters.

Two interpolated Kneser-Ney models give the probability of a word letter by letter, each letter from up to ORDER - 1
before it in the word (a start and an end mark count as letters): one model of toxic, one of ordinary training rows.
P_c(x | h) = max(k_c(h x) - D, 0) / k_c(h) + b_c(h) P_c(x | h without its first letter), where k counts occurrences
at the longest history and at a word's start, and distinct letters before (continuation counts) elsewhere; b_c(h) is
what the discounts leave over. The SHARED shortest histories are counted over both classes: rare expressions fall back
to these shared counts and then say nothing of the class.

A text's evidence compares the two likelihoods of its words, normalised by its length in words: the logarithm of the
mean ratio P_toxic(word) / P_ordinary(word). (The mean of the logarithms would drown three insults in a long text: held
out on sf0.1 its area under the curve is 0.68, that of the mean ratio 0.96.) A slope and a bias make the score of it.

Counting covers every labelled row of folds 0, 1 and 3 (of crc32(doc_id) mod 4); fold 2 is never learned from. Slope
and bias come from models of folds 0 and 1 alone, on at most ``sample`` rows of each class of fold 3; the classes weigh
as the square roots of their sizes, as a missed row is worse than a false alarm where toxic rows are rare. Where fold 3
lacks a class, the slope is 1 and the bias the odds of the classes. N-grams are exact
strings, summed in 64 bits, and their tables grow with the corpus; models are made of them by DataFrame operations. A
model of at most ``most_grams`` entries goes to every task. A larger one stays a table, whole: rows are dealt into blocks
of some megabytes, the distinct n-grams of a block's words are joined with it, and a block meets its own part of the
model, which gives the same scores. A frequent n-gram is one row per block. No label or source is a key anywhere.

Defined cases: a null or empty text, or one without words, has evidence 0; a run of more than LONGEST characters without
a blank is read as several words; rows without a label, or with a null one, are not learned from; ids with several
labels are toxic if one is; without toxic or ordinary rows in folds 0 and 1, all scores are 0; ``doc_id`` may be null or
repeat, each row gives a row; other columns are ignored.
"""

from __future__ import annotations

import itertools
import string
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .bpe import _clustered
from .common import column_slices, held_out, spread, table, text_slices, written

ORDER = 5
#: Up to this many letters, counts are shared by the classes.
SHARED = 2
DISCOUNT = 0.75
START, END = "\x01", "\x02"
#: Below all letters: one of so many.
LETTERS = 10_000
_EDGES = string.punctuation + "…“”„«»‘’¡¿"
LONGEST = 1000
#: Labels up to this count are sent to the tasks (8 bytes an id); more meet the texts in a shuffle by id.
FEW_LABELS = 1_000_000
#: A model of up to this many n-grams is sent to the tasks; a larger one is joined.
MOST_GRAMS = 4_000_000
_COUNTS = "c0 long, c1 long, c2 long, c3 long"


def words(text: str) -> list[str]:
    """Lower-case words; longer runs than LONGEST in parts."""
    found = text.lower().split()
    if max(map(len, found), default=0) > LONGEST:
        found = [x[at : at + LONGEST] for x in found for at in range(0, len(x), LONGEST)]
    return found


def cleaned(word: str) -> str:
    return word.strip(_EDGES)


def _letters(cores: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Of words: all letters with marks as one string and as codes, and each letter's word and its place in it."""
    marked = [START + x + END for x in cores]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    text = "".join(marked)
    word = np.repeat(np.arange(len(marked)), sizes)
    place = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[word]
    return text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), word, place


def gram_counts_of(counted: list[Counter]) -> tuple[list[str], np.ndarray]:
    """Of word counts, one Counter per column: the distinct n-grams of 1 to ORDER letters, and a row of counts for each."""
    cores = [Counter() for _ in counted]
    for own, of in zip(cores, counted):
        for word, n in of.items():
            own[cleaned(word)] += n
    names = [x for x in set().union(*cores) if x]
    if not names:
        return [], np.zeros((0, len(counted)), dtype=np.int64)
    text, code, word, place = _letters(names)
    alphabet, letter = np.unique(code, return_inverse=True)
    if len(alphabet) >= 4095 and len(names) > 1:  # five letters of 12 bits each are one key
        half = [[Counter({x: c[x] for x in part if x in c}) for c in cores] for part in (names[::2], names[1::2])]
        (a, x), (b, y) = map(gram_counts_of, half)
        return a + b, np.concatenate([x, y])
    weights = [np.array([c[x] for x in names], dtype=np.float64) for c in cores]
    letter, word, place = (letter + 1).astype(np.int16), word.astype(np.int32), place.astype(np.int32)
    grams, rows, key = [], [], np.zeros(len(code), dtype=np.int64)
    for n in range(1, ORDER + 1):
        key[1:] = key[:-1] << 12 if n > 1 else 0
        key[:1] = 0
        key |= letter
        valid = np.flatnonzero(place >= max(n - 1, 1)).astype(np.int32)
        _, at, inverse = np.unique(key[valid], return_index=True, return_inverse=True)
        grams += [text[p - n + 1 : p + 1] for p in valid[at].tolist()]
        own = word[valid]
        rows.append(np.stack([np.bincount(inverse, weights=w[own], minlength=len(at)).astype(np.int64) for w in weights], axis=1))
    return grams, np.concatenate(rows)


def gram_counts(train: DataFrame) -> DataFrame:
    """(g, c0 .. c3) of rows (which, text): how often each n-gram occurs in rows of each ``which``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = [Counter() for _ in range(4)]

        def out() -> Iterator[pa.RecordBatch]:
            grams, counts = gram_counts_of(counted)
            for c in counted:
                c.clear()
            for at in range(0, len(grams), 50_000):
                part = counts[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + 50_000], pa.string()), *(pa.array(part[:, i]) for i in range(4))], names=["g", "c0", "c1", "c2", "c3"])

        for which, texts in text_slices(batches):
            for i, text in zip(which, texts):
                counted[i].update(words(text))
            if sum(map(len, counted)) > 100_000:
                yield from out()
        yield from out()

    return train.mapInArrow(run, f"g string, {_COUNTS}").groupBy("g").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(4)))


def model_rows(grams: DataFrame, every_fold: bool, discount: float = DISCOUNT, least: int = 1) -> DataFrame:
    """(g, s0, s1, b0, b1): by class, the discounted share of n-gram ``g`` after its history, and the weight of backing off from ``g``.

    ``grams`` is (g, c0, c1 of folds 0 and 1, c2, c3 of fold 3); n-grams of more than SHARED letters below ``least`` back off.
    """
    both = ((F.col("c0") + F.col("c2")), (F.col("c1") + F.col("c3"))) if every_fold else (F.col("c0"), F.col("c1"))
    rows = grams.select("g", F.length("g").alias("n"), *(k.alias(f"k{c}") for c, k in enumerate(both)))
    longer = rows.where("n > 1").groupBy(F.expr("substring(g, 2)").alias("g")).agg(*(F.count_if(F.col(f"k{c}") > 0).alias(f"t{c}") for c in (0, 1)))
    rows = rows.join(longer, "g", "left")
    as_it_is = (F.col("n") == ORDER) | F.col("g").startswith(START)
    used = [F.when(as_it_is, F.col(f"k{c}")).otherwise(F.coalesce(f"t{c}", F.lit(0))) for c in (0, 1)]
    used = [F.when(F.col("n") <= SHARED, used[0] + used[1]).otherwise(u) for u in used]
    rows = rows.select("g", "n", F.expr("substring(g, 1, n - 1)").alias("h"), (F.col("k0") + F.col("k1")).alias("k"), *(u.alias(f"u{c}") for c, u in enumerate(used)))
    total = [F.sum(f"u{c}").over(Window.partitionBy("h")) for c in (0, 1)]
    share = [F.when(F.col(f"u{c}") > 0, F.greatest(F.col(f"u{c}") - F.lit(discount), F.lit(0.0)) / total[c]).otherwise(0.0) for c in (0, 1)]
    rows = rows.select("g", "n", "h", "k", *(s.alias(f"s{c}") for c, s in enumerate(share))).where((F.col("k") >= least) | (F.col("n") <= SHARED))
    left = rows.groupBy("h").agg(*((1 - F.sum(f"s{c}")).alias(f"b{c}") for c in (0, 1))).withColumnRenamed("h", "g")
    found = rows.select("g", "s0", "s1").join(left, "g", "full_outer")
    return found.select("g", *(F.coalesce(f"s{c}", F.lit(0.0)).alias(f"s{c}") for c in (0, 1)), *(F.coalesce(f"b{c}", F.lit(1.0)).alias(f"b{c}") for c in (0, 1)))


def _hashes(code: np.ndarray, before: np.ndarray | int) -> np.ndarray:
    """64-bit keys of letters after others."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64) + np.uint64(1)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Models:
    """Both models as sorted 64-bit keys of n-grams by length, with their shares and weights of backing off by class."""

    def __init__(self, grams: list[str], values: np.ndarray):
        self.keys, self.values = [], []
        lengths = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        self.root = values[np.flatnonzero(lengths == 0)[0], 2:] if (lengths == 0).any() else np.ones(2)
        for n in range(1, ORDER + 1):
            own = np.flatnonzero(lengths == n)
            code = np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            h = np.zeros(len(own), dtype=np.uint64)
            for i in range(n):
                h = _hashes(code[:, i], h)
            order = np.argsort(h)
            self.keys.append(h[order])
            none = np.array([[0, 0, 1, 1]], dtype=np.float32)  # what is not there has no share and backs off wholly
            self.values.append(np.concatenate([values[own][order].astype(np.float32), none]))
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def ratios(self, cores: list[str]) -> np.ndarray:
        """Per word: log P(word) in the toxic less that in the ordinary model; an empty word's is 0."""
        if not cores:
            return np.zeros(0)
        _, code, word, place = _letters(cores)
        p = np.full((len(code), 2), 1 / LETTERS)
        h, back = np.uint64(0), np.broadcast_to(self.root, p.shape)
        for n, (keys, values) in enumerate(zip(self.keys, self.values), 1):
            h = _hashes(code, h)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            own = values[np.where(keys[at] == h, at, len(keys)) if len(keys) else np.zeros(len(h), np.int64)]
            p = np.where((place >= max(n - 1, 1))[:, None], own[:, :2] + back * p, p)
            # the next letter's history ends here
            back = np.concatenate([np.ones((1, 2)), own[:-1, 2:]])
            h = np.concatenate([[np.uint64(0)], h[:-1]])
        log = np.where(place > 0, np.log(p[:, 1]) - np.log(p[:, 0]), 0)
        out = np.bincount(word, weights=log, minlength=len(cores))
        return np.where([bool(x) for x in cores], out, 0)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ratio of every word of each text. Words that were met before are remembered, 200,000 of at most 40 letters."""
        split = [words(x) for x in texts]
        if len(self.known) > 200_000:
            self.known.clear()
        now: dict[str, float] = {}
        names = list(set().union(*split) - self.known.keys())
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            now.update(zip(part, self.ratios([cleaned(x) for x in part]).tolist()))
        self.known.update((k, v) for k, v in now.items() if len(k) <= 40)
        now = {k: v for k, v in now.items() if len(k) > 40}
        get = self.known.__getitem__ if not now else lambda x: self.known[x] if x in self.known else now[x]
        return [np.fromiter(map(get, own), dtype=np.float64, count=len(own)) for own in split]

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each text: the logarithm of its words' mean likelihood ratio."""
        out = np.zeros(len(texts))
        for i, ratio in enumerate(self.of(texts)):
            if len(ratio):
                top = ratio.max()
                out[i] = top + np.log(np.mean(np.exp(ratio - top)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """(slope, bias) by Newton's method."""
    count = weight * len(x) / weight.sum()
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (count * (y - p)) - ridge * w)
        w = w + step * min(1, 2 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(w[1])


class Scorer:
    """The models (or the written table of larger ones), and the slope and bias that turn a text's evidence into a score."""

    def __init__(self, models: Models | DataFrame, slope: float, bias: float):
        self.models, self.slope, self.bias = models, max(slope, 0.0), bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.curve()(self.models.evidence([x or "" for x in texts]))

    def curve(self) -> Callable[[np.ndarray], np.ndarray]:
        """Evidence to scores, without the models."""
        slope, bias = self.slope, self.bias
        return lambda evidence: 1 / (1 + np.exp(-np.clip(slope * evidence + bias, -700, 700)))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def _loaded(rows: pa.Table) -> Models:
    return Models(rows.column("g").to_pylist(), np.stack([rows.column(c).to_numpy() for c in ("s0", "s1", "b0", "b1")], axis=1))


def _models(grams: DataFrame, every_fold: bool, most_grams: int) -> Models | DataFrame:
    """The models of ``grams``, a written table; of more than ``most_grams``, their written table."""
    rows = written(model_rows(grams, every_fold), "toxic-model")
    return _loaded(rows.toArrow()) if grams.count() <= most_grams else rows


def blocks(rows: DataFrame, at: int, block_bytes: int = 16 << 20, block_words: int = 200_000) -> DataFrame:
    """``rows`` with their ``block``, and for each block rows of ``grams``, what the model may be asked for its texts, column ``at``.

    A block ends with the slice that brings ``block_bytes`` of text or ``block_words`` distinct words. Names must not clash.
    """
    schema = StructType([StructField("block", LongType()), StructField("grams", ArrayType(StringType())), *(StructField(f.name, f.dataType) for f in rows.schema)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        block, held, met, types = next(number), 0, set(), None

        def asked() -> Iterator[pa.RecordBatch]:
            grams = list({*gram_counts_of([Counter(dict.fromkeys(met, 1))])[0], START, ""})
            for first in range(0, len(grams), 50_000):
                lists = pa.array([grams[first : first + 50_000]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), lists, *(pa.nulls(1, t) for t in types)], names=names)

        for part in column_slices(batches, at):
            if not part.num_rows:
                continue
            types = part.schema.types
            yield pa.RecordBatch.from_arrays([pa.array([block] * part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.list_(pa.string())), *part.columns], names=names)
            for text in part.column(at).to_pylist():
                met.update(words(text or ""))
            held += part.column(at).nbytes
            if held >= block_bytes or len(met) >= block_words:
                yield from asked()
                block, held, met = next(number), 0, set()
        if held:
            yield from asked()

    return rows.mapInArrow(run, schema)


def in_blocks(docs: DataFrame, model: DataFrame, then: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: StructType | str, **bounds: int) -> DataFrame:
    """Rows of ``schema`` that ``then`` makes of parts of ``docs`` (text, others) and their evidence by ``model``, a written table."""
    at, columns = docs.columns.index("text"), docs.columns
    own = [f"c{i}" for i in range(len(columns))]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = _clustered(blocks(docs.toDF(*own), at, **bounds), min(4 * parts, 50_000))
    asked = made.where("grams is not null").selectExpr("block asked_by", "explode(grams) g")
    found = asked.join(model.select("g", *(F.col(c).cast("float") for c in ("s0", "s1", "b0", "b1"))).hint("merge"), "g")

    def run(rows: pa.Table, grams: pa.Table) -> pa.Table:
        models, out = _loaded(grams), []
        for part in column_slices(rows.select(own).rename_columns(columns).to_batches(), at):
            out.append(then(part, models.evidence([x or "" for x in part.column(at).to_pylist()])))
        return pa.Table.from_batches(out)

    return made.where("grams is null").select("block", *own).groupBy("block").cogroup(found.groupBy("asked_by")).applyInArrow(run, schema)


def _told(docs: DataFrame, models: Models | DataFrame | None, then: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: StructType | str) -> tuple[DataFrame, Broadcast | None]:
    """Rows of ``schema`` that ``then`` makes of parts of ``docs`` (text, others) and their evidence, 0 without models; and what was sent for it."""
    if isinstance(models, DataFrame):
        return in_blocks(docs, models, then, schema), None
    shared = docs.sparkSession.sparkContext.broadcast(models)  # at most most_grams entries
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in column_slices(batches, at):
            texts = [x or "" for x in part.column(at).to_pylist()]
            yield then(part, shared.value.evidence(texts) if shared.value else np.zeros(len(texts)))

    return docs.mapInArrow(run, schema), shared


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_grams: int = MOST_GRAMS) -> Scorer | None:
    """From (doc_id, text) and (doc_id, toxic); slope and bias take ``sample`` labelled ids of fold 3 of each class, least hashes first."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    marks = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null")
    marks = written(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(_fold() != 2), "toxic-labels")
    size = {(r.fold, r.toxic): r["count"] for r in marks.groupBy((_fold() == 3).alias("fold"), "toxic").count().collect()}
    side = F.broadcast(marks) if sum(size.values()) <= FEW_LABELS else marks.hint("merge")
    train = docs.where(_fold() != 2).join(side, "doc_id").select((F.col("toxic") + 2 * (_fold() == 3).cast("int")).alias("which"), "text")
    grams = written(gram_counts(spread(train)), "toxic-grams")
    seen = grams.agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(4))).head()
    if not (seen.c0 and seen.c1):
        return None

    def then(part: pa.RecordBatch, evidence: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(evidence)], names=["doc_id", "toxic", "e"])

    chosen = [marks.where((_fold() == 3) & (F.col("toxic") == c)).join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id")).limit(sample) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows, shared = _told(docs.join(chosen, "doc_id").select("doc_id", "text", "toxic"), _models(grams, False, most_grams), then, "doc_id long, toxic int, e double")
    found = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("e").alias("e")).collect()  # ids may repeat
    if shared:
        shared.destroy()
    x, y = np.array([r.e for r in found]), np.array([r.toxic for r in found], dtype=float)
    if seen.c2 and seen.c3 and len(y) and y.min() < y.max():
        each = [size.get((True, c), 0) ** 0.5 / max(1, (y == c).sum()) for c in (0, 1)]
        slope, bias = logistic(x, y, np.where(y == 1, each[1], each[0]))
    else:
        slope, bias = 1.0, float(np.log(size[False, 1] / size[False, 0]))
    return Scorer(_models(grams, True, most_grams), slope, bias)


def _curve(scorer: Scorer | None) -> Callable[[np.ndarray], np.ndarray]:
    return scorer.curve() if scorer else np.zeros_like


def scored(docs: DataFrame, labels: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, score): the toxicity of each row of (doc_id, text)."""
    scorer = fit(docs, labels, most_grams=most_grams)
    curve = _curve(scorer)

    def then(part: pa.RecordBatch, evidence: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(curve(evidence))], names=["doc_id", "score"])

    rows = spread(docs.selectExpr("cast(doc_id as long) doc_id", "text"))
    return _told(rows, scorer and scorer.models, then, "doc_id long, score double")[0]


def kept_rows(docs: DataFrame, labels: DataFrame, threshold: float, most_grams: int = MOST_GRAMS) -> DataFrame:
    """All columns of the rows that score below ``threshold``, decided where they are read or in their block."""
    scorer = fit(docs, labels, most_grams=most_grams)
    curve = _curve(scorer)

    def then(part: pa.RecordBatch, evidence: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(curve(evidence) < threshold))

    return _told(docs, scorer and scorer.models, then, docs.schema)[0]


#: Scores from here on are toxic.
THRESHOLD = 0.3


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
