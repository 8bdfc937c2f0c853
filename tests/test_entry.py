import duckdb
import os

import __spark_entry__ as entry
from entitrail.functions.register import register
from entitrail.streaming.marking import candidate_stream, start_marking


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def rows(frame):
    return sorted(str([None if x != x else x for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def test_queries_equal_their_sql(spark, sf_dir):
    from entitrail.plans import queries as engine

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    assert set(engine.ORACLE_SQL) <= set(engine.QUERIES)
    for name, sql in engine.ORACLE_SQL.items():
        assert rows(engine.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(sql).df()), name


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT normalize_text('А 123 ВС 77', 'plate') x").head().x == "A123BC77"
    assert [tuple(r) for r in spark.sql("SELECT * FROM edit_spans('xabcx', 'abc', 0)").collect()] == [(1, 4, 0)]
    assert spark.sql("SELECT * FROM inflect_person('Иван', 'Петров', NULL)").count() > 1


ALIASES = [{"entity_type": "car", "entity_id": "c", "field_name": "vin", "value": "WQ9MTRDVK20417365", "weight": 1.0, "profile": "vin"}]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "VIN WQ9MTRDVK20417365"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    got = []
    start_marking(source, ALIASES, lambda m, n: got.extend(m.occurrences.collect()), str(tmp_path / "ck")).awaitTermination()
    assert [(r.doc_id, r.start) for r in got] == [(1, 4)]
    q = candidate_stream(source, ALIASES).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("found").count() == 1
