"""Nearest neighbours by NN-descent: a neighbour graph improved by neighbours of neighbours, searched greedily.

Vectors are reduced to classes of equal value first, so that copies are one node, whose least ids stand for it. Nodes
are ordered by signs of random projections a few times; runs of ``block`` in that order, compared exactly, give the first graph. In each round of
descent a node's neighbours, and its closest reverse ones, meet by a Spark join with their vectors; each two of them, of which one is new
there, are compared, and what improves a list replaces its end. Rounds end when few lists change. A query starts from its own
node's list and repeatedly expands the closest nodes not yet expanded, until the best ``beam`` have all been expanded.

The graph is approximate; its distances are computed in double precision around a middle of the vectors that meet, so
that neither an outlier nor a cluster of vectors that are all but equal hides differences. Distances returned are
computed from the original vectors. Recall against brute force is a test, see the README.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or
candidates; vectors of different lengths are not compared, each length has a graph of its own; rows without an id take
no part; of equal ids each row is a candidate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

_EDGES = "v long, u long, d float, fresh boolean"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<float>) of the rows that take part."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))) & F.exists("embedding", lambda e: e != 0)
    return x.where(F.coalesce(sound, F.lit(False)))


def classes(x: DataFrame, k: int) -> DataFrame:
    """(node, embedding, ids): one row per distinct vector; node is its least id, ids the least k + 1: one may be the query's own."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = x.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("node"), "embedding", "ids")


def _vectors(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<f4").reshape(len(raw), -1).astype(np.float64)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Squared distances among rows, taken around the middle of some of them, which an outlier does not move."""
    x = x - np.median(x[:: max(1, len(x) // 32)], axis=0)
    n = (x * x).sum(axis=1)
    return np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)


def _edges(v: np.ndarray, u: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(d, pa.float32()), pa.array(np.ones(len(v), bool))], names=["v", "u", "d", "fresh"])


def first_edges(nodes: DataFrame, n: int, k: int, tree: int, bits: int, block: int) -> DataFrame:
    """The nearest ``k`` of each (node, vector) within its run of the order that the projections of ``tree`` give."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1))
                planes = np.random.default_rng(tree).standard_normal((x.shape[1], bits + 1)).astype(np.float32)
                y = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ planes
                code = ((y[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(y[:, bits]), *batch.columns], names=["code", "side", "node", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            rows = pa.Table.from_batches(held) if held else None
            if rows is None or (batch is not None and rows.num_rows < 2 * block):
                continue
            # all but the last two blocks; a short one joins its neighbour
            n = rows.num_rows if batch is None else rows.num_rows - rows.num_rows % block - block
            cuts = list(range(0, max(1, n - block // 2), block)) + [n]
            for a, b in itertools.pairwise(cuts):
                part = rows.slice(a, b - a).combine_chunks()
                node, d = part.column("node").to_numpy(), _pairs(_vectors(part.column("vector").combine_chunks()))
                np.fill_diagonal(d, np.inf)
                own = min(k, len(node) - 1)
                if own > 0:
                    near = np.argpartition(d, own - 1, axis=1)[:, :own]
                    yield _edges(np.repeat(node, own), node[near].ravel(), np.take_along_axis(d, near, axis=1).ravel())
            held = rows.slice(n).to_batches()

    keys = nodes.mapInArrow(keyed, "code long, side double, node long, vector binary")
    parts = min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (2 * block))  # a part holds some runs
    dealt = (keys.repartitionByRange(parts, "code", "side") if parts > 1 else keys.coalesce(1)).sortWithinPartitions("code", "side")
    return dealt.select("node", "vector").mapInArrow(run, _EDGES)


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` edges of each v; of equal pairs the one that is not fresh. Lists are cut before the shuffle, then after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if held is None or not len(held[0]):
                continue
            cut = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
            v, u, d, fresh = (c[:cut] for c in held)
            held = [c[cut:] for c in held]
            order = np.lexsort((fresh, u, v))
            v, u, d, fresh = v[order], u[order], d[order], fresh[order]
            first = np.ones(len(v), bool)
            first[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
            v, u, d, fresh = v[first], u[first], d[first], fresh[first]
            order = np.lexsort((u, d, v))
            v, u, d, fresh = v[order], u[order], d[order], fresh[order]
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
            rank = np.arange(len(v)) - np.repeat(start, np.diff(np.append(start, len(v))))
            keep = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(u[keep]), pa.array(d[keep], pa.float32()), pa.array(fresh[keep])], names=["v", "u", "d", "fresh"])

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(run, _EDGES)


def improvements(graph: DataFrame, nodes: DataFrame, k: int, reverse: int) -> DataFrame:
    """Edges that a round finds: each two that meet around a node, one of them fresh, and are closer than one's last."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))
    back = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "d", "fresh").withColumn("rank", rank).where(F.col("rank") <= reverse).drop("rank")
    around = graph.unionByName(back).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
    last = written(graph.groupBy("v").agg(F.max("d").alias("last"), F.count("*").alias("n")).selectExpr("v u", f"if(n < {k}, cast('inf' as float), last) last"), "ann-last")
    with_vectors = around.join(nodes.withColumnRenamed("node", "u"), "u").join(last, "u")
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_vectors.select("v", "u", "fresh", "last", "vector").repartition(parts, "v").sortWithinPartitions("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks() if held else None
            if rows is None or not rows.num_rows:
                continue
            v = rows.column("v").to_numpy()
            n = len(v) if batch is None else int(np.searchsorted(v, v[-1]))
            held = rows.slice(n).to_batches()
            if not n:
                continue
            rows, v = rows.slice(0, n), v[:n]
            u, fresh, last = (rows.column(c).to_numpy()[:n] for c in ("u", "fresh", "last"))
            x = _vectors(rows.column("vector").combine_chunks())
            bounds = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
            out = []
            for a, b in itertools.pairwise(bounds.tolist()):
                if not fresh[a:b].any():
                    continue
                d = _pairs(x[a:b])
                ok = (d < last[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                out.append((u[a + i], u[a + j], d[i, j]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))

    return dealt.mapInArrow(run, _EDGES)


def build_graph(x: DataFrame, k: int = 32, reverse: int = 24, trees: int = 4, block: int = 256, rounds: int = 8) -> DataFrame:
    """(v, u, d, fresh): up to ``k`` near nodes of each (node, embedding) with squared distances."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), "<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["node", "vector"])

    nodes = written(x.select("node", "embedding").mapInArrow(packed, "node long, vector binary"), "ann-vectors")
    n = nodes.count()
    bits = max(1, min(30, (n // block).bit_length()))
    made = [first_edges(nodes, n, k, t, bits, block) for t in range(trees)]
    graph = made[0]
    for other in made[1:]:
        graph = graph.unionByName(other)
    graph = written(nearest(graph, k), "ann-graph")
    for _ in range(rounds):
        old = graph.withColumn("fresh", F.lit(False))
        graph = written(nearest(old.unionByName(improvements(graph, nodes, k, reverse)), k), "ann-graph")
        if graph.where("fresh").count() <= 0.01 * k * n:
            break
    return graph


def distance(a: str, b: str) -> Column:
    """Euclidean, summed in double precision in the order of the components."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, e: s + e))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, u, d) of (q, u, here, there)."""
    for batch in batches:
        if batch.num_rows:
            here, there = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((here - there) ** 2).sum(axis=1)))], names=["q", "u", "d"])


def search(queries: DataFrame, graph: DataFrame, x: DataFrame, beam: int = 256, expand: int = 64) -> DataFrame:
    """(q, u, d): the best ``beam`` nodes found for each query node ``q``; ``x`` is (node, embedding)."""
    vectors = x.select(F.col("node").alias("u"), F.col("embedding").alias("there"))
    asked = queries.select("q", F.col("embedding").alias("here"))
    best = Window.partitionBy("q").orderBy("d", "u")
    steps = graph.select("v", "u")

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(vectors, "u").join(asked, "q").select("q", "u", "here", "there").mapInArrow(_measured, "q long, u long, d double")

    found = measured(steps.join(asked.select(F.col("q").alias("v")), "v", "left_semi").withColumnRenamed("v", "q"))
    found = written(found.withColumn("done", F.lit(False)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam), "ann-beam")
    while True:
        open_ = found.where("not done").withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= expand).select("q", "u")
        if not open_.limit(1).count():
            return found.select("q", "u", "d")
        open_ = written(open_, "ann-open")
        new = open_.withColumnRenamed("u", "v").join(steps, "v").where("u <> q").select("q", "u").distinct()
        new = new.join(found.select("q", "u"), ["q", "u"], "left_anti")
        kept = found.drop("rank").join(open_.withColumn("now", F.lit(True)), ["q", "u"], "left").selectExpr("q", "u", "d", "done or coalesce(now, false) done")
        both = kept.unionByName(measured(new).withColumn("done", F.lit(False)))
        found = written(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam), "ann-beam")


def neighbours(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row (vec_id, embedding) that is a query, the ``k`` nearest other rows found."""
    x = usable(rows)
    asked = usable(rows.where(is_query)).withColumnRenamed("vec_id", "query_id")
    nodes = written(classes(x, k), "ann-classes")
    found = None
    for r in nodes.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect():
        same = F.size("embedding") == r.n
        part = _of_one_length(nodes.where(same), asked.where(same), k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_one_length(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    asked = written(asked.join(nodes.select("node", "embedding"), "embedding").select("query_id", F.col("node").alias("q")), "ann-queries")
    if not asked.limit(1).count():
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("q").alias("vec_id"), F.lit(0.0).alias("score"))
    graph = build_graph(nodes)
    queries = written(nodes.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("q"), "embedding"), "ann-asked")
    near = search(queries, graph, nodes, max(256, 8 * k))
    # of the nodes found, the nearest k + 1, as one may be the query's own; measured anew
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "u"))).where(F.col("r") <= k + 1).select("q", "u")
    best = best.join(nodes.select(F.col("node").alias("u"), F.col("embedding").alias("there")), "u").join(queries.withColumnRenamed("embedding", "here"), "q")
    near = best.select("q", "u", distance("here", "there").alias("d")).unionByName(asked.select("q", F.col("q").alias("u"), F.lit(0.0).alias("d")).distinct())
    ids = near.join(nodes.select(F.col("node").alias("u"), "ids"), "u").select("q", "d", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    least = ids.withColumn("r", rank).where(F.col("r") <= k + 1)
    lists = written(least.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "vec_id"))).alias("list")), "ann-lists")
    others = F.slice(F.filter("list", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    found = asked.join(lists, "q").select("query_id", F.posexplode(others).alias("at", "e"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), "e.vec_id", F.col("e.d").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
