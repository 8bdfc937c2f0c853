import corpus_pipeline
from pyspark.sql import functions as F

from entitrail.llm import toxicity

from . import cases
from .test_simhash import plain_components, plain_fingerprint
from .test_tokens import check_packed


def test_stages(spark):
    """Each stage on its predecessor's rows, against plain versions where there is one."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language_id"](spark, docs, d)
    lettered = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(lettered)

    two = stages["toxicity"](spark, docs, d)
    high = {r.doc_id for r in toxicity.scored(docs, spark.read.parquet(f"{d}/labels.parquet")).where(F.col("score") >= 0.3).collect()}
    assert high and sorted(r.doc_id for r in two.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in high)

    three = stages["simhash"](spark, docs, d)
    fps = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.collect()}
    group, least = plain_components(fps.values()), {}
    for i, f in fps.items():
        least[group[f]] = min(i, least.get(group[f], i))
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == sorted(least.values())

    four = stages["pii"](spark, docs, d).collect()
    assert len(four) == docs.count() and sum("<EMAIL>" in r.text for r in four) > 0 and not any("@mail" in r.text for r in four)
    assert all(r.n_chars == len(r.text) for r in four)

    few = docs.where("doc_id < 100")
    check_packed(stages["packing"](spark, few, d).collect(), [(r.doc_id, r.text) for r in few.collect()])


def test_toxicity_keeps_the_same_rows_by_a_large_model(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = cases.frame(spark)
    some = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    for rows, marks in ((docs, labels), (odd, some), (cases.empty(spark), some)):
        whole, joined = (toxicity.kept_rows(rows, marks, toxicity.THRESHOLD, **options) for options in ({}, {"most_grams": 50}))
        assert joined.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(str, joined.collect())) == sorted(map(str, whole.collect()))


def test_edges(spark, tmp_path):
    docs = cases.frame(spark)
    spark.createDataFrame([(1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, cases.empty(spark)):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() >= (0 if start is not docs else 5)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
