import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitrail.llm import ann


def brute(vectors, q, k=10):
    x = np.array([v for _, v in vectors], dtype=np.float64)
    here = x[[i for i, (n, _) in enumerate(vectors) if n == q][0]]
    d = np.sqrt(((x - here) ** 2).sum(axis=1))
    return sorted((d, n) for d, (n, _) in zip(d, vectors) if n != q)[:k]


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    got = {}
    for r in ann.op5_ann(spark, d).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        want = brute(vectors, q)
        assert [r["rank"] for r in rows] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        exact = dict((n, s) for s, n in brute(vectors, q, len(vectors)))
        assert all(math.isclose(r.score, exact[r.vec_id], rel_tol=1e-12) for r in rows)
        hits += len({r.vec_id for r in rows} & {n for _, n in want})
    assert set(got) == {n for n, _ in vectors if n % 100 == 0}
    assert hits >= 0.95 * 10 * len(got)


def rows(vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in vectors]


SCHEMA = "vec_id long, embedding array<float>, node int, q string"


def test_edges(spark):
    r = np.random.default_rng(0)
    vectors = [(i, r.standard_normal(8)) for i in range(30)]
    copies = [(100 + i, vectors[0][1]) for i in range(40)]
    bad = [(200, None), (300, [0.0] * 8), (400, [1.0] * 7 + [None]), (500, [float("nan")] * 8), (600, [float("inf")] * 8), (700, [1.0]), (None, [1.0] * 8), (800, [])]
    table = spark.createDataFrame(rows(vectors + copies + bad), SCHEMA)
    got = {}
    for x in ann.neighbours(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert set(got) == {0, 100}
    assert sorted(got[100]) == [(1, 0, 0.0)] + [(i, 99 + i, 0.0) for i in range(2, 11)]
    assert sorted(got[0]) == [(i, 99 + i, 0.0) for i in range(1, 11)]


def test_few_rows(spark):
    table = spark.createDataFrame(rows([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])]), SCHEMA)
    found = [tuple(x) for x in ann.neighbours(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(0, 1, 2, 1.0), (0, 2, 1, math.sqrt(5))]
    assert ann.neighbours(spark.createDataFrame(rows([(0, [1.0, 0.0])]), SCHEMA), F.lit(True)).count() == 0
    assert ann.neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def recall(spark, vectors, queries, k=10):
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<float>")
    stored = {r.vec_id: r.embedding for r in table.collect()}
    got = {}
    for r in ann.neighbours(table, F.col("vec_id").isin(queries), k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = [(i, stored[i]) for i, _ in vectors]
    assert all(len(got[q]) == min(k, len(vectors) - 1) for q in queries)
    return sum(len(got[q] & {n for _, n in brute(exact, q, k)}) for q in queries) / (k * len(queries))


def test_recall_with_an_outlier_and_a_tight_cluster(spark):
    r = np.random.default_rng(4)
    spread = r.standard_normal((1400, 16))
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    cluster = spread[0] * (1 + 1e-6) + 1e-4 * r.standard_normal((700, 16))
    vectors = list(enumerate([*spread, *cluster, spread[1] * 1e9]))
    queries = [*range(0, 1400, 140), *range(1400, 2100, 70)]
    assert recall(spark, vectors, queries) >= 0.9


def test_many_neighbours(spark):
    r = np.random.default_rng(5)
    assert recall(spark, list(enumerate(r.standard_normal((41, 6)))), [0, 7], 20) == 1
    vectors = list(enumerate(r.standard_normal((600, 6))))
    assert recall(spark, vectors, [0, 100], 20) >= 0.9


def test_each_length_is_searched_by_itself(spark):
    r = np.random.default_rng(6)
    vectors = [(i, r.standard_normal(4 if i < 30 else 6).tolist()) for i in range(50)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    rows = ann.neighbours(table, F.col("vec_id").isin(0, 40), 3).collect()
    assert sorted(x.query_id for x in rows) == [0] * 3 + [40] * 3
    assert all((x.query_id < 30) == (x.vec_id < 30) for x in rows)
