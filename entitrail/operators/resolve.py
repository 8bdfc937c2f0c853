"""Resolution of tables of candidates: duplicates, local evidence, ambiguity, threshold and overlaps, as windows and keyed joins.

Marking resolves documents where they are matched (``document.py``); these operators take candidates from anywhere. A key
must name one text. Every step is keyed by document and entity or span. The evidence join meets neighbours by cells of text, so its work
grows with the candidates near each other, not with the square of an entity's mentions. The one step in sequence, greedy
overlap resolution, folds a run of mutually overlapping mentions at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchingConfig

DUPLICATE = "duplicate alias or method"
AMBIGUOUS = "ambiguous entity identity"
WEAK = "insufficient local evidence"
OVERLAP = "overlap with stronger occurrence"

#: Parts of a name, which may lie within a full name of another role.
NAME_PARTS = ("first_name", "last_name", "middle_name", "previous_last_name")
#: Fields whose parts are their own evidence, which is no further one.
COMPOSITES = ("full_name", "previous_full_name", "series_number")


def _rank() -> list[Column]:
    return [F.col("method"), F.desc("score"), F.col("edit_distance"), F.desc(F.col("end") - F.col("start")), F.col("value"), F.col("alias_ord"), F.col("start"), F.col("end")]


def deduplicated(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """``candidates`` with ``place``, their order in the document, and ``first``: of one entity, field and span, the best."""
    same = Window.partitionBy(key, "entity_type", "entity_id", "field_name", "start", "end").orderBy(*_rank())
    rows = candidates.withColumn("first", F.row_number().over(same) == 1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*_rank())))


def neighbours(unique: DataFrame, config: MatchingConfig, key: str = "doc_id") -> DataFrame:
    """(key, place, other...): the mentions of other fields of the same entity near each one, with no barrier between."""
    cell = config.evidence_window + 1
    cols = ["place", "field_name", "start", "end", "score", "method", "edit_distance", "value", "matched_text", "barriers_before", "barriers_within"]
    rows = unique.select(key, "entity_type", "entity_id", *cols)
    left = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("end") / cell), F.floor((F.col("end") + config.evidence_window) / cell))))
    right = rows.withColumn("cell", F.floor(F.col("start") / cell))
    on = ["entity_type", "entity_id", "cell"]
    left, right = left.select(key, *on, F.struct(*cols).alias("l")), right.select(F.col(key).alias("_key"), *on, F.struct(*cols).alias("r"))
    pairs = left.join(right.withColumnsRenamed({c: f"_{c}" for c in on}), [F.col(key).eqNullSafe(F.col("_key")), *(F.col(c) == F.col(f"_{c}") for c in on)])
    gap = F.col("r.start") - F.col("l.end")
    clear = F.col("l.barriers_before") + F.col("l.barriers_within") == F.col("r.barriers_before")
    pairs = pairs.where((gap >= 0) & (gap <= config.evidence_window) & clear & (F.col("l.field_name") != F.col("r.field_name")))
    both = F.array(F.struct(F.col("l.place").alias("place"), F.col("r").alias("other")), F.struct(F.col("r.place").alias("place"), F.col("l").alias("other")))
    return pairs.select(key, F.inline(both))  # each pair is found once


def _joined(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``more`` says of a key's place; a null key is one like any other."""
    more = more.withColumnsRenamed({key: "_key", "place": "_place"})
    return rows.join(more, F.col(key).eqNullSafe(F.col("_key")) & (F.col("place") == F.col("_place")), "left").drop("_key", "_place")


def with_evidence(unique: DataFrame, config: MatchingConfig, key: str = "doc_id") -> DataFrame:
    """``unique`` with ``support``, the best neighbour of each other field, and ``combined``, the score with its bonus."""
    best = Window.partitionBy(key, "place", "other.field_name").orderBy("other.place")
    supports = neighbours(unique, config, key).withColumn("n", F.row_number().over(best)).where("n = 1")
    item = F.struct("other.place", "other.field_name", "other.start", "other.end", "other.score", "other.method", "other.edit_distance", "other.value", "other.matched_text")
    supports = supports.groupBy(key, "place").agg(F.sort_array(F.collect_list(item)).alias("support"), F.max("other.score").alias("strongest"))
    bonus = F.when(F.col("field_name").isin(*COMPOSITES), 0.0).otherwise(config.evidence_bonus * F.coalesce("strongest", F.lit(0.0)))
    return _joined(unique, supports, key).withColumn("combined", F.least(F.lit(1.0), F.col("score") + bonus)).drop("strongest")


def decided(scored: DataFrame, config: MatchingConfig, key: str = "doc_id") -> DataFrame:
    """``scored`` with ``reason``: why a mention is rejected, null if it is not; ambiguity goes before weakness."""
    span = (key, "entity_type", "start", "end")
    rows = scored.withColumn("own", F.max("combined").over(Window.partitionBy(*span, "entity_id")))
    rows = rows.withColumn("top", F.max(F.struct("own", "entity_id")).over(Window.partitionBy(*span)))
    second = F.max(F.when(F.col("entity_id") != F.col("top.entity_id"), F.col("own"))).over(Window.partitionBy(*span))
    rows = rows.withColumn("second", second)
    rival = F.coalesce(F.when(F.col("entity_id") == F.col("top.entity_id"), F.col("second")).otherwise(F.col("top.own")), F.lit(-1.0))
    reason = F.when(rival >= F.col("combined") - config.ambiguity_margin, AMBIGUOUS).when(F.col("combined") < config.acceptance_threshold, WEAK)
    return rows.withColumn("reason", reason).drop("own", "top", "second")


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _compatible(a: Column, b: Column) -> Column:
    """Different roles may share text: one span, or a person's name part within a sender's full name."""

    def within(person: Column, sender: Column) -> Column:
        named = person["field_name"].isin(*NAME_PARTS) & (sender["field_name"] == "full_name")
        return (person["entity_type"] == "person") & (sender["entity_type"] == "sender") & named & (sender["start"] <= person["start"]) & (person["end"] <= sender["end"])

    same = (a["start"] == b["start"]) & (a["end"] == b["end"])
    return (a["entity_type"] != b["entity_type"]) & (same | within(a, b) | within(b, a))


def without_overlaps(accepted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``accepted`` with ``kept``: the best first, each is kept that overlaps no kept one of an incompatible role."""
    reach = Window.partitionBy(key).orderBy("start", "end", "place")
    rows = accepted.withColumn("before", F.max("end").over(reach.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(reach.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(
        "method", (-F.col("combined")).alias("worst"), "edit_distance", (F.col("start") - F.col("end")).alias("shortness"),
        "start", "end", "entity_type", "entity_id", "field_name", "place",
    )
    runs = rows.groupBy(key, "run").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    keep = F.aggregate("items", none, lambda kept, x: F.when(F.exists(kept, lambda o: _overlaps(x, o) & ~_compatible(x, o)), kept).otherwise(F.array_append(kept, x)))
    kept = runs.select(key, F.explode(F.transform(keep, lambda x: x["place"])).alias("place")).withColumn("kept", F.lit(True))
    return _joined(accepted, kept, key).withColumn("kept", F.coalesce("kept", F.lit(False)))


def resolved(candidates: DataFrame, config: MatchingConfig, key: str = "doc_id") -> DataFrame:
    """``candidates`` with ``support``, ``combined`` and ``reason``; accepted mentions have no reason."""
    rows = deduplicated(candidates, key)
    judged = decided(with_evidence(rows.where("first").drop("first"), config, key), config, key)
    settled = without_overlaps(judged.where("reason is null"), key)
    settled = settled.withColumn("reason", F.when(~F.col("kept"), OVERLAP)).drop("kept")
    rest = rows.where("not first").drop("first").withColumn("reason", F.lit(DUPLICATE))
    return settled.unionByName(judged.where("reason is not null")).unionByName(rest, allowMissingColumns=True)


def occurrences(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The accepted mentions of ``resolved`` with ``region_id``, numbered by start, end, type, id and field."""
    order = Window.partitionBy(key).orderBy("start", "end", "entity_type", "entity_id", "field_name")
    named = rows.where("reason is null").withColumn("n", F.row_number().over(order))
    return named.select(key, "n", F.format_string("r%06d", "n").alias("region_id"), "entity_type", "entity_id", "field_name", "start", "end", "matched_text", F.col("value").alias("source_value"), F.col("combined").alias("score"), "method", "edit_distance", "support")


def rejections(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rejected candidates of ``resolved`` with ``reject_ord``: duplicates by rank, then by span groups, then overlaps by rank."""
    stage = F.when(F.col("reason") == DUPLICATE, 0).when(F.col("reason") == OVERLAP, 2).otherwise(1)
    ranked = rows.withColumn("first_seen", F.min(F.when(F.col("reason").isNull() | (F.col("reason") != DUPLICATE), F.col("place"))).over(Window.partitionBy(key, "entity_type", "start", "end")))
    ranked = ranked.where("reason is not null").withColumn("stage", stage)
    worst = F.when(F.col("stage") == 2, -F.col("combined"))
    overlap = [F.when(F.col("stage") == 2, F.col(c)) for c in ("method",)]
    late = [worst, *(F.when(F.col("stage") == 2, c) for c in (F.col("edit_distance"), F.col("start") - F.col("end"), F.col("start"), F.col("end"), F.col("entity_type"), F.col("entity_id"), F.col("field_name")))]
    group = F.when(F.col("stage") == 1, F.col("first_seen"))
    order = Window.partitionBy(key).orderBy("stage", group, *overlap, *late, "place")
    numbered = ranked.withColumn("reject_ord", F.row_number().over(order))
    return numbered.select(key, "reject_ord", "entity_type", "entity_id", "field_name", "value", "weight", "profile", "start", "end", "matched_text", "score", "method", "edit_distance", "reason")
