"""Exports: labelled regions as task JSON, and evidence reports with every rejection. All are projections of marked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import labels
from .candidates import METHODS

#: What predictions name as their model, unless told otherwise.
MODEL_VERSION = "entitrail-1"


def label(entity_type: Column, field_name: Column) -> Column:
    return F.upper(F.concat_ws("_", entity_type, field_name))


def _sorted(mentions: Column, by: str) -> Column:
    """Those that have a number ``by``, in its order."""
    keyed = F.transform(F.filter(mentions, lambda m: m[by].isNotNull()), lambda m: F.struct(m[by].alias("by"), m.alias("m")))
    return F.transform(F.array_sort(keyed, lambda a, b: a["by"] - b["by"]), lambda x: x["m"])


def region_id(n: Column) -> Column:
    return F.format_string("r%06d", n)


def tasks(marked: DataFrame, key: str = "doc_id", annotations: bool = False, model_version: str = MODEL_VERSION) -> DataFrame:
    """(key, task): a task in JSON per row of (key, text, mentions[, metadata]); rows without regions have an empty result.

    ``metadata`` is a JSON object that joins the task's data.
    """

    def region(m: Column) -> Column:
        value = F.struct(m["start"].alias("start"), m["end"].alias("end"), m["matched_text"].alias("text"), F.array(label(m["entity_type"], m["field_name"])).alias("labels"))
        return F.struct(region_id(m["n"]).alias("id"), F.lit("entities").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), value.alias("value"))

    result = F.transform(_sorted(F.col("mentions"), "n"), region).alias("result")
    inner = F.struct(result) if annotations else F.struct(F.lit(model_version).alias("model_version"), result)
    body = F.to_json(F.struct(F.array(inner).alias("annotations" if annotations else "predictions")))
    data = F.to_json(F.struct("text"))
    if "metadata" in marked.columns:
        data = _merged(data, F.col("metadata"))
    return marked.select(key, _merged(F.concat(F.lit('{"data":'), data, F.lit("}")), body).alias("task"))


def _merged(a: Column, b: Column) -> Column:
    """One JSON object of two; the first may be empty."""
    return F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.when(F.length(a) > 2, F.lit(",")).otherwise(F.lit("")), F.substring(b, F.lit(2), F.length(b)))


def _candidate(m: Column) -> Column:
    # The keys of the report.
    alias = F.struct(*(m[c].alias(c) for c in ("entity_id", "entity_type", "field_name", "value", "weight", "profile")))
    span = F.struct(m["start"].alias("start"), m["end"].alias("end"))
    return F.struct(alias.alias("alias"), span.alias("span"), m["matched_text"].alias("matched_text"), F.struct(m["score"].alias("value")).alias("score"), _method(m).alias("method"), m["edit_distance"].alias("edit_distance"))


def _method(m: Column) -> Column:
    return F.get(F.array(*map(F.lit, METHODS)), m["method"])


def evidence(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, report): accepted occurrences with their supporting matches, and every rejection with its reason, in JSON."""

    def occurrence(m: Column) -> Column:
        own = F.struct(F.transform(F.coalesce(m["support"], F.array().cast(marked.schema["mentions"].dataType.elementType["support"].dataType)), _candidate).alias("supporting_matches"), F.struct(m["combined"].alias("value")).alias("score"))
        plain = [m[c].alias(c) for c in ("entity_id", "entity_type", "field_name", "matched_text")]
        return F.struct(*plain, m["value"].alias("source_value"), m["combined"].alias("score"), _method(m).alias("method"), m["edit_distance"].alias("edit_distance"), own.alias("evidence"), region_id(m["n"]).alias("region_id"), m["start"].alias("start"), m["end"].alias("end"))

    found = F.transform(_sorted(F.col("mentions"), "n"), occurrence).alias("occurrences")
    lost = F.transform(_sorted(F.col("mentions"), "reject_ord"), lambda m: F.struct(_candidate(m).alias("candidate"), m["reason"].alias("reason"))).alias("rejected")
    report = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("unicode_code_points").alias("offset_unit"), found, lost))
    if "metadata" in marked.columns:
        report = _merged(F.col("metadata"), report)
    return marked.select(key, report.alias("report"))


def labeling_config() -> str:
    """The configuration in which an annotation tool shows the regions: one label per field."""
    lines = "".join(f'    <Label value="{x}"/>\n' for x in labels())
    return f'<View>\n  <Labels name="entities" toName="text">\n{lines}  </Labels>\n  <Text name="text" value="$text"/>\n</View>\n'
