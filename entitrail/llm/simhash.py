"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance, and their components.

Fingerprints are reduced to classes of equal value first; copies are never expanded into pairs. For each class a pivot
table is computed once: its Hamming distances to reference fingerprints. These are zero, one reference for each two
neighbouring bits (both set), and some well-mixed ones.

Candidates come from the table alone. The distances to zero and to a reference of two bits tell how many of these two are
set, so a class has 32 such coordinates; fingerprints at ``max_distance`` or less differ in at most that many of them.
With the coordinates dealt into ``max_distance + extra`` groups, two linked classes agree in all coordinates of at least
``extra`` groups: the cells that a choice of groups gives are join keys, and no link is lost. Within a cell, pairs whose
distances to any reference differ by more than ``max_distance`` are discarded (triangle inequality), the rest is verified.

A cell of more than LARGE classes gives a spanning forest instead of pairs, found by growing components. Classes in cells
of more than ``most`` are taken together and dealt anew by more and longer keys; what is still in such cells after the
last dealing is so alike that a forest is found in few steps, and such a cell is cut into parts, each two of which are
searched together, in tasks of their own.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer words than a shingle
are one shingle; ``doc_id`` may repeat (a row each) or be null (such rows link, but name no component unless all ids
in it are null, whose component is null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_id_and_text, column_slices, free_names, spread, table, without, written
from .components import components

#: Cells of more classes than this give a spanning forest.
LARGE = 64
#: Bits whose number a coordinate tells.
PAIR = 2
N_MIXED = 16
#: Groups that linked classes must agree in, by dealing; more classes start further on.
EXTRA = (2, 3, 4)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the XXH64 of the text's word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z changes, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 14):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): the text's xxhash64 and the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in column_slices(batches):
            fps = np.array([fingerprint(x or "", shingle, seed) for x in part.column(1).to_pylist()], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def references() -> np.ndarray:
    """Zero, the pairs of neighbouring bits, and a fixed, well-mixed sequence."""
    pairs = np.uint64((1 << PAIR) - 1) << np.arange(0, 64, PAIR, dtype=np.uint64)
    x = np.arange(1, N_MIXED + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([np.zeros(1, np.uint64), pairs, x ^ (x >> np.uint64(31))])


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """A row of distances to the references per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)


def cells(distances: np.ndarray, groups: int, agree: int) -> np.ndarray:
    """A row of keys per row of the pivot table: one for each choice of ``agree`` of ``groups`` groups of coordinates."""
    n = 64 // PAIR
    inside = (distances[:, :1] - distances[:, 1 : 1 + n] + PAIR) // 2  # bits set of each pair
    own = []
    for a, b in itertools.pairwise(n * i // groups for i in range(groups + 1)):
        own.append(inside[:, a:b].astype(np.int64) @ (PAIR + 1) ** np.arange(b - a, dtype=np.int64))
    keys = []
    for choice in itertools.combinations(range(groups), agree):
        key = np.zeros(len(distances), dtype=np.int64)
        for g in choice:  # 3 ** 32 is less than 2 ** 51
            key = key * (PAIR + 1) ** (n * (g + 1) // groups - n * g // groups) + own[g]
        keys.append(key)
    return np.stack(keys, axis=1)


def _linked(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of positions, those within ``most`` bits: the largest difference of distances discards, the rest is verified."""
    near = np.abs(table[a] - table[b]).max(axis=1) <= most if len(a) else np.zeros(0, bool)
    a, b = a[near], b[near]
    ok = np.bitwise_count(fps[a] ^ fps[b]) <= most
    return a[ok], b[ok]


def _forest(fps: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among all, by growing one component after another; memory in proportion."""
    left, at, to = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for node in queue.pop():
                if not len(left):
                    break
                near = np.flatnonzero(np.abs(table[left] - table[node]).max(axis=1) <= most)
                near = near[np.bitwise_count(fps[left[near]] ^ fps[node]) <= most]
                if len(near):
                    found = left[near]
                    at.append(np.full(len(found), node))
                    to.append(found)
                    queue.append(found)
                    left = np.delete(left, near)
    none = np.zeros(0, np.int64)
    return (np.concatenate(at), np.concatenate(to)) if at else (none, none)


def bucket_links(keys: list[np.ndarray], fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal keys, which stand together; rows of a large bucket give a spanning forest."""
    change = np.zeros(len(fps), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    run = np.cumsum(change) - 1
    size = np.bincount(run) if len(run) else np.zeros(0, np.int64)
    from_, to = [], []
    keep = np.flatnonzero((size[run] > 1) & (size[run] <= LARGE))
    f, r = fps[keep], run[keep]
    table, step = pivot_table(f), 1
    while step < len(f):
        a = np.flatnonzero(r[step:] == r[:-step])
        if not len(a):
            break
        for x, y in [_linked(f, table, a, a + step, most)]:
            from_.append(f[x])
            to.append(f[y])
        step += 1
    for large in np.flatnonzero(size > LARGE):
        f = fps[run == large]
        x, y = _forest(f, pivot_table(f), most)
        from_.append(f[x])
        to.append(f[y])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (none, none)


def keyed(classes: DataFrame, extra: int, max_distance: int) -> DataFrame:
    """(fp, c, k): the cells of each class, ``c`` numbers the choice of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                k = cells(pivot_table(fp.astype(np.uint64)), max_distance + extra, extra)
                c = np.tile(np.arange(k.shape[1], dtype=np.int32), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, k.shape[1])), pa.array(c), pa.array(k.ravel())], names=["fp", "c", "k"])

    return classes.select("fp").mapInArrow(run, "fp long, c int, k long")


def links(classes: DataFrame, max_distance: int = 4, most: int = 20_000, extra: tuple[int, ...] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all which are linked."""
    spark = classes.sparkSession
    if extra is None:  # longer keys for more classes: a cell of fingerprints at random stays small
        n = classes.count()
        extra = EXTRA[0 if n < 1 << 21 else 1 if n < 1 << 27 else 2 :]
    keys = keyed(classes, extra[0], max_distance)
    hot = written(keys.groupBy("c", "k").count().where(F.col("count") > most), "simhash-hot")
    n_hot = hot.count()
    if not n_hot:
        return _found(keys.withColumn("s", F.lit(0)), max_distance).distinct()
    side = F.broadcast(hot) if n_hot <= 100_000 else hot  # 20 bytes each
    rest = _found(keys.join(side, ["c", "k"], "left_anti").withColumn("s", F.lit(0)), max_distance)
    if extra[1:]:
        again = written(keys.join(side, ["c", "k"], "left_semi").select("fp").distinct(), "simhash-again")
        return rest.unionByName(links(again, max_distance, most, extra[1:])).distinct()
    parts = F.ceil(2 * F.col("count") / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, own) * F.col("parts") + F.greatest(o, own))
    cut = keys.join(side.withColumn("parts", parts), ["c", "k"]).withColumn("s", F.explode(pairs)).select("fp", "c", "k", "s")
    return rest.unionByName(_found(cut, max_distance)).distinct()


def _found(keys: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): links among the classes of each (c, k, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last cell may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
                if not len(held[0]):
                    continue
                same = np.ones(len(held[0]), dtype=bool)
                for c in held[1:]:
                    same &= c == c[-1]
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            elif held is None:
                break
            else:
                cut = len(held[0])
            now, held = [c[:cut] for c in held], [c[cut:] for c in held]
            if cut:
                a, b = bucket_links(now[1:], now[0].astype(np.uint64), max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select("fp", "c", "k", "s").repartition(parts, "c", "k", "s").sortWithinPartitions("c", "k", "s")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, max_distance: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id), a row per document; component_id is the smallest doc_id linked over any way.

    ``label`` names the component, too, by its smallest fingerprint.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    labels = components(links(classes, max_distance)).selectExpr("node fp", "label")
    named = written(classes.join(labels, "fp", "left").selectExpr("fp", "least", "coalesce(label, fp) label"), "simhash-labels")
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    of = written(named.join(least, "label").select("fp", "label", "component_id"), "simhash-components")
    return rows.join(of, "fp").select("doc_id", "text_hash", "fp", "label", "component_id")


def one_of_each(docs: DataFrame, max_distance: int = 4) -> DataFrame:
    """The rows of ``docs`` with the least (doc_id, text hash) of each component, whole; of equal rows, one."""
    rows = written(near_duplicates(docs, max_distance).select("doc_id", "text_hash", "label"), "simhash-found")
    if not rows.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():  # the id alone names a row
        least = written(rows.groupBy("label").agg(F.min("doc_id").alias("least")), "simhash-first")
        return without(docs, written(rows.join(least, "label").where("doc_id <> least").select("doc_id"), "simhash-removed"))
    key = F.struct("doc_id", "text_hash")
    first = written(rows.groupBy("label").agg(F.min(key).alias("first")), "simhash-first")
    copies = rows.groupBy("doc_id", "text_hash", "label").count()
    removed = copies.join(first, "label").where(~key.eqNullSafe(F.col("first"))).select("doc_id", "text_hash")
    kept = without(docs, written(removed, "simhash-removed"))
    again = written(copies.where("count > 1").join(first, "label").where(key.eqNullSafe(F.col("first"))).select("doc_id", "text_hash"), "simhash-again")
    if not again.limit(1).count():
        return kept
    [own] = free_names(kept, "key_hash")
    repeated = by_id_and_text(kept, again, "left_semi").withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).drop(own)
    return without(kept, again).unionByName(repeated)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
