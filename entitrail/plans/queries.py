"""The registered queries of the known-entity engine and their SQL.

Texts are the documents table, whole. The catalogs are derived from the tables or are the small one below, whose
values no ß can be part of, so that SQL's ``lower`` finds the same places as the engine's normalization. The SQL
covers exact and normalized matching and everything after; approximate matching, inflection and strict parsing are
beyond it and held against plain versions in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchingConfig
from ..operators.aliases import generate_aliases
from ..operators.resolve import DUPLICATE
from ..schema import ALIAS, CATALOG, field
from ..sources.catalog import validate
from .marking import Marking, mark, mark_aliases

#: (type, id, field, value): names that share text, surnames of two people, an organization that overlaps an address.
NAMED = (
    ("document", "d1", "document_type", "License"),
    ("legal_entity", "l1", "name", "Apache License"),
    ("legal_entity", "l2", "name", "License, Version 2.0"),
    ("misc", "m1", "reply_address", "Version 2.0"),
    ("person", "p1", "first_name", "Eriner"),
    ("person", "p1", "last_name", "thin"),
    ("person", "p2", "last_name", "thin"),
    ("person", "p3", "first_name", "aulich"),
    ("person", "p3", "last_name", "nicht"),
    ("person", "p4", "last_name", "une"),
    ("person", "p4", "middle_name", "hean"),
    ("person", "p5", "last_name", "Apache"),
    ("sender", "s1", "full_name", "Apache License"),
)
LITERAL = MatchingConfig(fuzzy_enabled=False)
EMAIL = r"[A-Za-z]+\.[0-9]+@[A-Za-z0-9]+\.[A-Za-z]+\.[A-Za-z]+"


def _named() -> list[tuple]:
    fields = [(t, i, n, v, field(t, n)) for t, i, n, v in NAMED]
    return sorted((t, i, n, v, f.weight, f.profile) for t, i, n, v, f in fields)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text); one small file is dealt out to all cores first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _marking(spark: SparkSession, sf_dir: str, config: MatchingConfig = LITERAL) -> Marking:
    return mark_aliases(documents(spark, sf_dir), spark.createDataFrame(_named(), ALIAS), config)


_MENTION = ["doc_id", "entity_type", "entity_id", "field_name", "start", "end"]


def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).candidates.select(*_MENTION, "matched_text", "score", "method")


def exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).candidates.where("method = 0").select(*_MENTION)


def normalized_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).candidates.where("method = 1").select(*_MENTION)


def dedup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = [*_named(), *[("person", "p4", "last_name", "Une", 0.65, "name"), ("legal_entity", "l1", "name", "apache license", 0.9, "text")]]
    docs, aliases = documents(spark, sf_dir), spark.createDataFrame(doubled, ALIAS)
    rows = mark_aliases(docs, aliases, LITERAL).rows.withColumn("first", ~F.col("reason").eqNullSafe(DUPLICATE))
    return rows.groupBy("doc_id", "first").agg(F.count("*").alias("n"))


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).unique.select(*_MENTION, "score", F.size("support").cast("long").alias("n_support"), "combined")


def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).pairs(LITERAL)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).rows.select(*_MENTION, "combined", F.coalesce("reason", F.lit("accepted")).alias("decision"))


def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).rejected.groupBy("reason").agg(F.count("*").alias("n"))


def mark_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _marking(spark, sf_dir).occurrences
    return found.select("doc_id", "region_id", "start", "end", F.col("matched_text").alias("text"), F.upper(F.concat_ws("_", "entity_type", "field_name")).alias("label"), "score")


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejection in its order."""
    return _marking(spark, sf_dir).rejected.select("doc_id", "reject_ord", "entity_type", "entity_id", "field_name", "start", "end", "method", "reason")


def repeated_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marking where ids are null or repeat: each row is marked by itself."""
    docs = documents(spark, sf_dir).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5))
    found = mark_aliases(docs, spark.createDataFrame(_named(), ALIAS), LITERAL).occurrences
    found = found.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    return found.groupBy("doc_id", "entity_type", "entity_id").agg(F.count("*").alias("n"), F.max("n").cast("long").alias("last_region"))


def email_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of the first thousand documents, wherever they stand for themselves."""
    docs = documents(spark, sf_dir)
    known = docs.where("doc_id < 1000").select(F.lower(F.regexp_extract("text", EMAIL, 0)).alias("value")).where("value <> ''").distinct()
    f = field("misc", "reply_email")
    aliases = known.select(F.lit("misc").alias("entity_type"), F.col("value").alias("entity_id"), F.lit("reply_email").alias("field_name"), "value", F.lit(f.weight).alias("weight"), F.lit(f.profile).alias("profile"))
    return mark_aliases(docs, aliases, LITERAL).candidates.select("doc_id", "entity_id", "start", "end", "matched_text", "method")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _marking(spark, sf_dir).occurrences
    return found.groupBy(F.upper(F.concat_ws("_", "entity_type", "field_name")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def predictions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).predictions()


def annotations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).annotations()


def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marking(spark, sf_dir).evidence()


def fuzzy_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three ways of matching, two edits for long names."""
    return _marking(spark, sf_dir, MatchingConfig(max_errors=2)).candidates.where("method = 2").select(*_MENTION, "matched_text", "edit_distance", "score")


def _empty(*groups: str) -> list:
    types = [x.split(" ", 1) for x in CATALOG.replace(">>, ", ">>|").split("|")]
    return [F.array().cast(kind).alias(name) for name, kind in types if name not in groups]


def _catalogs(rows: DataFrame, group: str, **fields: str) -> DataFrame:
    """One catalog per row of ``rows`` (catalog_id, ...), with one entity of ``group``."""
    kind = dict(x.split(" ", 1) for x in CATALOG.replace(">>, ", ">>|").split("|"))[group]
    names = [x.split(":")[0] for x in kind[len("array<struct<") : -2].split(",")]
    entity = F.struct(*[F.expr(fields.get(n, "null")).alias(n) for n in names])
    return rows.select("catalog_id", F.array(entity).cast(kind).alias(group), *_empty(group))


def alias_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_orderkey as string) catalog_id", "cast(o_orderdate as date) day")
    return generate_aliases(_catalogs(orders, "miscellaneous", id="'misc-1'", incoming_letter_date="day")).select("catalog_id", "field_name", "value", "weight")


def alias_case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_orderkey as string) catalog_id", "concat('A', o_custkey, ' - ', o_orderkey, '/', year(o_orderdate)) raw")
    return generate_aliases(_catalogs(orders, "miscellaneous", id="'misc-1'", case_number="raw")).select("catalog_id", "value", "profile", "weight")


def alias_sender_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(p_partkey as string) catalog_id", "concat_ws(' ', p_name, if(p_partkey % 2 = 0, lower(p_type), null)) name")
    return generate_aliases(_catalogs(part, "senders", id="'sender-1'", full_name="name")).select("catalog_id", "value", F.round("weight", 6).alias("weight"))


def alias_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("cast(c_custkey as string) catalog_id", "cast(c_nationkey as string) s", "cast(c_custkey as string) n", "c_mktsegment t")
    return generate_aliases(_catalogs(customer, "documents", id="'doc'", series="s", number="n", document_type="t")).select("catalog_id", "field_name", "value", "profile", "weight")


def alias_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are given, birth dates in three forms."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("cast(c_custkey as string) catalog_id", "c_custkey k", "c_name f", "c_mktsegment l")
    rows = _catalogs(customer, "people", id="'p'", first_name="f", last_name="l", previous_last_name="if(k % 2 = 0, f, null)", birth_date="date_add(date'1950-01-01', cast(k % 9000 as int))")
    return generate_aliases(rows).select("catalog_id", "field_name", "value", "profile", "weight")


def alias_legal_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_suppkey as string) catalog_id", "s_name n", "lpad(cast(s_suppkey as string), 10, '0') i")
    return generate_aliases(_catalogs(supplier, "legal_entities", id="'l'", inn="i", name="n")).select("catalog_id", "field_name", "value", "profile", "weight")


def field_weight_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("cast(c_custkey as string) catalog_id", "c_name v")
    config = MatchingConfig(field_weights={"vin": 0.2})
    return generate_aliases(_catalogs(customer, "cars", id="'car'", vin="v", license_plate="v"), config).select("catalog_id", "field_name", "weight")


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("id"), F.lit("x").alias("vin"), F.lit(None).cast("string").alias("license_plate"), F.lit(None).cast("string").alias("body_number"), F.lit(None).cast("string").alias("chassis_number"))).alias("cars"))
    return validate(lines.select(F.col("l_orderkey").cast("string").alias("catalog_id"), "cars", *_empty("cars")))


def inflected_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case forms and marking end to end, over the conversations."""
    person = spark.range(1).selectExpr("'catalog' catalog_id")
    catalog = _catalogs(person, "people", id="'p'", first_name="'Иван'", last_name="'Thin'", middle_name="'Иванович'", birth_date="date'1973-01-20'")
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("concat_ws(':', conv_id, turn) doc_id", "text")
    return mark(texts, catalog).rows.select("doc_id", "field_name", "start", "end", "method", "combined", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        mark_regions, candidate_spans, exact_spans, normalized_spans, dedup_candidates, evidence_pairs, evidence_scores, decisions, rejection_reasons,
        rejections, repeated_doc_ids, email_matches, label_counts, predictions_json, annotations_json, evidence_json, fuzzy_mentions, alias_dates, alias_case_numbers, alias_sender_names, alias_documents, alias_people, alias_legal_entities,
        field_weight_override, repeated_ids, inflected_people,
    )
}


_WORD_BOUNDS = """NOT regexp_matches(CASE WHEN "start" > 0 THEN substr(text, "start", 1) ELSE '' END, '[\\p{L}\\p{N}\\p{M}_]')
    AND NOT regexp_matches(substr(text, "end" + 1, 1), '[\\p{L}\\p{N}\\p{M}_]')"""
_EMAIL_BOUNDS = _WORD_BOUNDS + """
    AND NOT regexp_matches(CASE WHEN "start" > 0 THEN substr(text, "start", 1) ELSE '' END, '[.%+@-]') AND NOT regexp_matches(substr(text, "end" + 1, 1), '[@%+-]')
    AND NOT regexp_matches(substr(text, "end" + 1, 2), '[.][\\p{L}\\p{N}\\p{M}_]')"""


def _candidates_sql(aliases: list[tuple]) -> str:
    """CTEs up to ``cand``: exact and normalized candidates of ``aliases``."""
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)"
    values = ", ".join(f"({i}, {', '.join(map(quoted, a))})" for i, a in enumerate(sorted(aliases)))
    return _scan_sql(f"(VALUES {values})", _WORD_BOUNDS)


def _scan_sql(aliases: str, bounds: str) -> str:
    return f"""
aliases(alias_ord, entity_type, entity_id, field_name, value, weight, profile) AS {aliases},
scan AS (
  SELECT d.doc_id, d.text, a.*, m.method, CASE WHEN m.method = 0 THEN d.text ELSE lower(d.text) END AS hay,
         CASE WHEN m.method = 0 THEN a.value ELSE lower(a.value) END AS needle
  FROM documents d, aliases a, (VALUES (0), (1)) m(method)
  WHERE contains(CASE WHEN m.method = 0 THEN d.text ELSE lower(d.text) END, CASE WHEN m.method = 0 THEN a.value ELSE lower(a.value) END)
), parts AS (SELECT * EXCLUDE (hay), list_slice(string_split(hay, needle), 1, -2) AS p FROM scan),
pieces AS (SELECT * EXCLUDE (p), unnest(p) AS part, generate_subscripts(p, 1) AS i FROM parts),
hits AS (
  SELECT *, CAST(sum(length(part)) OVER (PARTITION BY doc_id, alias_ord, method ORDER BY i) + (i - 1) * length(needle) AS INTEGER) AS "start" FROM pieces
), spans AS (SELECT *, CAST("start" + length(needle) AS INTEGER) AS "end" FROM hits),
sound AS (
  SELECT * FROM spans
  WHERE {bounds}
), cand AS (
  SELECT doc_id, text, alias_ord, entity_type, entity_id, field_name, value, weight AS score, method, "start", "end",
         substr(text, "start" + 1, "end" - "start") AS matched_text
  FROM sound s
  WHERE method = 0 OR NOT EXISTS (SELECT 1 FROM sound x WHERE x.method = 0 AND x.doc_id = s.doc_id AND x.alias_ord = s.alias_ord AND x."start" = s."start" AND x."end" = s."end")
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY method, score DESC, "start" - "end", value, alias_ord, "start", "end") AS place,
         row_number() OVER (PARTITION BY doc_id, entity_type, entity_id, field_name, "start", "end" ORDER BY method, score DESC, "start" - "end", value, alias_ord) = 1 AS first
  FROM cand
)"""


_RESOLVED_SQL = """,
uniq AS (SELECT * FROM ranked WHERE first),
near AS (
  SELECT a.doc_id, a.place, b.place AS other, b.field_name AS other_field, b.score AS other_score, b."start" AS other_start, b."end" AS other_end, a."start", a."end"
  FROM uniq a JOIN uniq b ON a.doc_id = b.doc_id AND a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.field_name <> b.field_name
   AND ((a."end" <= b."start" AND b."start" - a."end" <= 80 AND NOT regexp_matches(substr(a.text, a."end" + 1, b."start" - a."end"), '[.!?;\\n\\r]'))
     OR (b."end" <= a."start" AND a."start" - b."end" <= 80 AND NOT regexp_matches(substr(a.text, b."end" + 1, a."start" - b."end"), '[.!?;\\n\\r]')))
), best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, place, other_field ORDER BY other) = 1),
supports AS (SELECT doc_id, place, count(*) AS n_support, max(other_score) AS strongest FROM best GROUP BY doc_id, place),
scored AS (
  SELECT u.*, coalesce(n_support, 0) AS n_support,
         least(CAST(1 AS DOUBLE), score + CASE WHEN field_name = 'full_name' THEN CAST(0 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) * coalesce(strongest, CAST(0 AS DOUBLE)) END) AS combined
  FROM uniq u LEFT JOIN supports USING (doc_id, place)
), judged AS (
  SELECT s.*, CASE WHEN coalesce((SELECT max(r.combined) FROM scored r WHERE r.doc_id = s.doc_id AND r.entity_type = s.entity_type AND r."start" = s."start" AND r."end" = s."end" AND r.entity_id <> s.entity_id), CAST(-1 AS DOUBLE)) >= s.combined - CAST(0.08 AS DOUBLE)
              THEN 'ambiguous entity identity' WHEN s.combined < CAST(0.6 AS DOUBLE) THEN 'insufficient local evidence' END AS reason
  FROM scored s
), accepted AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY method, combined DESC, "start" - "end", "start", "end", entity_type, entity_id, field_name) AS turn FROM judged WHERE reason IS NULL
), folds AS (
  SELECT doc_id, list_reduce(
    list(x ORDER BY turn),
    lambda k, x: CASE WHEN len(list_filter(k, lambda o: x[1].s < o.e AND o.s < x[1].e AND NOT (x[1].t <> o.t AND (
        (x[1].s = o.s AND x[1].e = o.e)
        OR (x[1].t = 'person' AND o.t = 'sender' AND x[1].f IN ('first_name', 'last_name', 'middle_name', 'previous_last_name') AND o.f = 'full_name' AND o.s <= x[1].s AND x[1].e <= o.e)
        OR (o.t = 'person' AND x[1].t = 'sender' AND o.f IN ('first_name', 'last_name', 'middle_name', 'previous_last_name') AND x[1].f = 'full_name' AND x[1].s <= o.s AND o.e <= x[1].e))))) > 0
      THEN k ELSE list_concat(k, x) END) AS kept
  FROM (SELECT doc_id, turn, [struct_pack(s := "start", e := "end", t := entity_type, f := field_name, place := place)] AS x FROM accepted)
  GROUP BY doc_id
)"""
_DECIDED_SQL = """,
kept AS (SELECT doc_id, unnest(list_transform(kept, lambda o: o.place)) AS place FROM folds),
decided AS (
  SELECT j.* EXCLUDE (reason), CASE WHEN j.reason IS NULL AND k.place IS NULL THEN 'overlap with stronger occurrence' ELSE j.reason END AS reason
  FROM judged j LEFT JOIN kept k ON j.doc_id = k.doc_id AND j.place = k.place
)"""


def _sql(select: str, stage: int = 2, aliases: list[tuple] | None = None) -> str:
    """``select`` over the CTEs: 0 candidates, 1 evidence and judgement, 2 decisions."""
    return "WITH " + _candidates_sql(aliases or _named()) + (_RESOLVED_SQL if stage > 0 else "") + (_DECIDED_SQL if stage > 1 else "") + "\n" + select


_JSON_SQL = """SELECT d.doc_id, to_json({{'data': {{'text': d.text}}, '{kind}': [{{{more}'result': coalesce(f.result, [])}}]}}) AS task
FROM documents d LEFT JOIN (
  SELECT doc_id, list({{'id': region_id, 'from_name': 'entities', 'to_name': 'text', 'type': 'labels', 'value': {{'start': "start", 'end': "end", 'text': matched_text, 'labels': [upper(entity_type || '_' || field_name)]}}}} ORDER BY region_id) AS result
  FROM (SELECT *, format('r{{:06d}}', row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", entity_type, entity_id, field_name)) AS region_id FROM decided WHERE reason IS NULL) GROUP BY doc_id
) f USING (doc_id)"""
_M = 'doc_id, entity_type, entity_id, field_name, "start", "end"'
_DOUBLED = [*_named(), ("person", "p4", "last_name", "Une", 0.65, "name"), ("legal_entity", "l1", "name", "apache license", 0.9, "text")]

ORACLE_SQL = {
    "candidate_spans": _sql(f"SELECT {_M}, matched_text, score, method FROM cand", 0),
    "exact_spans": _sql(f"SELECT {_M} FROM cand WHERE method = 0", 0),
    "normalized_spans": _sql(f"SELECT {_M} FROM cand WHERE method = 1", 0),
    "dedup_candidates": _sql("SELECT doc_id, first, count(*) AS n FROM ranked GROUP BY doc_id, first", 0, _DOUBLED),
    "evidence_pairs": _sql('SELECT doc_id, "start", "end", other_start, other_end, other_field FROM near', 1),
    "evidence_scores": _sql(f"SELECT {_M}, score, n_support, combined FROM scored", 1),
    "decisions": _sql(f"SELECT {_M}, combined, coalesce(reason, 'accepted') AS decision FROM decided"),
    "rejection_reasons": _sql("SELECT reason, count(*) AS n FROM decided WHERE reason IS NOT NULL GROUP BY reason"),
    "mark_regions": _sql(
        "SELECT doc_id, format('r{:06d}', row_number() OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", entity_type, entity_id, field_name)) AS region_id, "
        "\"start\", \"end\", matched_text AS text, upper(entity_type || '_' || field_name) AS label, combined AS score FROM decided WHERE reason IS NULL"
    ),
    "predictions_json": _sql(_JSON_SQL.format(kind="predictions", more="'model_version': 'entitrail-1', ")),
    "annotations_json": _sql(_JSON_SQL.format(kind="annotations", more="")),
    "rejections": _sql(
        f"SELECT {_M}, method, reason, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY stage, late_method, place_in, worst, shortness, late_start, late_end, late_type, late_id, late_field, place) AS INTEGER) AS reject_ord FROM ("
        f"SELECT {_M}, method, place, 'duplicate alias or method' AS reason, 0 AS stage, 0 AS late_method, place AS place_in, 0.0 AS worst, 0 AS shortness, 0 AS late_start, 0 AS late_end, '' AS late_type, '' AS late_id, '' AS late_field FROM ranked WHERE NOT first "
        f"UNION ALL SELECT {_M}, method, place, reason, 1, 0, first_seen, 0.0, 0, 0, 0, '', '', '' FROM (SELECT *, min(place) OVER (PARTITION BY doc_id, entity_type, \"start\", \"end\") AS first_seen FROM decided) WHERE reason IS NOT NULL AND reason NOT LIKE 'overlap%' "
        f"UNION ALL SELECT {_M}, method, place, reason, 2, method, 0, -combined, \"start\" - \"end\", \"start\", \"end\", entity_type, entity_id, field_name FROM decided WHERE reason LIKE 'overlap%')"
    ),
    "repeated_doc_ids": _sql(
        "SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 ELSE -1 END AS doc_id, entity_type, entity_id, count(*) AS n, max(region) AS last_region FROM ("
        "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", entity_type, entity_id, field_name) AS region FROM decided WHERE reason IS NULL) GROUP BY 1, 2, 3"
    ),
    "email_matches": "WITH " + _scan_sql(
        f"(SELECT row_number() OVER (ORDER BY v), 'misc', v, 'reply_email', v, 0.95, 'email' FROM (SELECT DISTINCT lower(regexp_extract(text, '{EMAIL}')) AS v FROM documents WHERE doc_id < 1000) WHERE v <> '')", _EMAIL_BOUNDS
    ) + '\nSELECT doc_id, entity_id, "start", "end", matched_text, method FROM cand',
    "label_counts": _sql("SELECT upper(entity_type || '_' || field_name) AS label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM decided WHERE reason IS NULL GROUP BY 1"),
    "alias_dates": """
SELECT CAST(o_orderkey AS VARCHAR) AS catalog_id, 'incoming_letter_date' AS field_name, unnest([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%d/%m/%Y')]) AS value,
       CAST(0.65 AS DOUBLE) AS weight
FROM orders""",
    "alias_case_numbers": """
SELECT CAST(o_orderkey AS VARCHAR) AS catalog_id, unnest(['A' || o_custkey || ' - ' || o_orderkey || '/' || year(o_orderdate), 'A' || o_custkey || '-' || o_orderkey || '/' || right(CAST(year(o_orderdate) AS VARCHAR), 2)]
         || [o_orderkey || '/' || year(o_orderdate), o_orderkey || '/' || right(CAST(year(o_orderdate) AS VARCHAR), 2)]) AS value,
       'reference' AS profile, CAST(0.9 AS DOUBLE) AS weight
FROM orders WHERE year(o_orderdate) >= 2000
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), 'A' || o_custkey || ' - ' || o_orderkey || '/' || year(o_orderdate), 'reference', CAST(0.9 AS DOUBLE) FROM orders WHERE year(o_orderdate) < 2000""",
    "alias_sender_names": """
WITH n AS (SELECT CAST(p_partkey AS VARCHAR) AS catalog_id, string_split(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_type) ELSE '' END, ' ') AS w FROM part),
a AS (
  SELECT catalog_id, array_to_string(w, ' ') AS value, 0.95 AS weight FROM n
  UNION SELECT catalog_id, w[1] || ' ' || w[2], 0.855 FROM n WHERE len(w) IN (2, 3)
  UNION SELECT catalog_id, w[2] || ' ' || w[1], 0.855 FROM n WHERE len(w) = 2
  UNION SELECT catalog_id, unnest([w[1] || ' ' || w[2] || ' ' || w[3], w[2] || ' ' || w[3] || ' ' || w[1]]), 0.95 FROM n WHERE len(w) = 3
  UNION SELECT catalog_id, unnest([w[1] || ' ' || left(w[2], 1) || '. ' || left(w[3], 1) || '.', w[1] || ' ' || left(w[2], 1) || '.' || left(w[3], 1) || '.']), 0.8075 FROM n WHERE len(w) = 3
)
SELECT catalog_id, value, CAST(weight AS DOUBLE) AS weight FROM a""",
    "alias_documents": """
SELECT CAST(c_custkey AS VARCHAR) AS catalog_id, x.f AS field_name, x.v AS value, x.p AS profile, CAST(x.w AS DOUBLE) AS weight
FROM (SELECT c_custkey, unnest([
  {'f': 'series', 'v': CAST(c_nationkey AS VARCHAR), 'p': 'identifier', 'w': 0.40}, {'f': 'number', 'v': CAST(c_custkey AS VARCHAR), 'p': 'identifier', 'w': 0.90},
  {'f': 'series_number', 'v': c_nationkey || ' ' || c_custkey, 'p': 'identifier', 'w': 0.98}, {'f': 'document_type', 'v': c_mktsegment, 'p': 'text', 'w': 0.40}]) AS x FROM customer)""",
    "alias_people": """
SELECT CAST(c_custkey AS VARCHAR) AS catalog_id, x.f AS field_name, x.v AS value, x.p AS profile, CAST(x.w AS DOUBLE) AS weight
FROM (SELECT c_custkey, unnest([
  {'f': 'first_name', 'v': c_name, 'p': 'name', 'w': 0.50}, {'f': 'last_name', 'v': c_mktsegment, 'p': 'name', 'w': 0.65},
  {'f': 'previous_last_name', 'v': CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'p': 'name', 'w': 0.65},
  {'f': 'birth_date', 'v': strftime(day, '%Y-%m-%d'), 'p': 'date', 'w': 0.70}, {'f': 'birth_date', 'v': strftime(day, '%d.%m.%Y'), 'p': 'date', 'w': 0.70}, {'f': 'birth_date', 'v': strftime(day, '%d/%m/%Y'), 'p': 'date', 'w': 0.70}]) AS x
  FROM (SELECT *, DATE '1950-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS day FROM customer))
WHERE x.v IS NOT NULL""",
    "alias_legal_entities": """
SELECT CAST(s_suppkey AS VARCHAR) AS catalog_id, unnest(['inn', 'name']) AS field_name, unnest([lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), s_name]) AS value, unnest(['tax_id', 'text']) AS profile,
       unnest([CAST(1.0 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS weight FROM supplier""",
    "field_weight_override": """
SELECT CAST(c_custkey AS VARCHAR) AS catalog_id, unnest(['vin', 'license_plate']) AS field_name, unnest([CAST(0.2 AS DOUBLE), CAST(0.95 AS DOUBLE)]) AS weight FROM customer""",
    "repeated_ids": """
SELECT CAST(l_orderkey AS VARCHAR) AS catalog_id, 'car' AS entity_type, CAST(l_suppkey AS VARCHAR) AS id, 'repeated id' AS problem
FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1""",
}
