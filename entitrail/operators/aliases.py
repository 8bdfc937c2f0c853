"""Alias generation: a catalog's fields as the surface forms that are searched for.

One row per catalog goes in, one row per alias comes out; groups are exploded, projected and united. Only the case
forms of names need Python, in Arrow batches, and only where an inflector is given.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchingConfig
from ..functions.morphology import Inflector
from ..schema import EXTRA_WEIGHTS, FIELDS, GROUPS, field

_FORMS = "array<struct<first:string,last:string,middle:string>>"


def _alias(entity_type: str, name: str, value: Column, factor: float = 1.0) -> Column:
    f = field(entity_type, name)
    return F.struct(F.lit(name).alias("field_name"), value.alias("value"), F.lit(f.weight * factor).alias("weight"), F.lit(f.profile).alias("profile"))


def _dates(entity_type: str, name: str, value: Column) -> list[Column]:
    return [_alias(entity_type, name, F.date_format(value, form)) for form in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")]


def _items(catalogs: DataFrame, entity_type: str) -> DataFrame:
    """(catalog_id, entity_id, e): the entities of a type."""
    return catalogs.select("catalog_id", F.explode(GROUPS[entity_type]).alias("e")).select("catalog_id", F.col("e.id").alias("entity_id"), "e")


def _aliases(items: DataFrame, entity_type: str, columns: list[Column] | Column, weights: dict[str, float], differ: bool = True) -> DataFrame:
    """Explodes an entity's alias structs; those without a value fall away. Empty strings name nothing. Where they need not ``differ``, each is taken once."""
    each = columns if isinstance(columns, Column) else F.array(*columns)
    if weights:
        each = F.transform(each, lambda a: a.withField("weight", _weight(a, weights)))
    if not differ:
        each = F.array_distinct(F.filter(each, lambda a: a["value"] != ""))
    rows = items.select("catalog_id", F.lit(entity_type).alias("entity_type"), "entity_id", F.explode(each).alias("a")).select("catalog_id", "entity_type", "entity_id", "a.*")
    return rows.where("value is not null and value <> ''")


def _weight(a: Column, weights: dict[str, float]) -> Column:
    out = a["weight"]
    for name, weight in weights.items():
        base = EXTRA_WEIGHTS.get(name) or next(f.weight for f in FIELDS if f.name == name)
        out = F.when(a["field_name"] == name, a["weight"] / base * weight).otherwise(out)
    return out


def _forms(items: DataFrame, first: str, last: str, middle: str, inflector: Inflector | None) -> DataFrame:
    """``items`` with ``forms``: the name's case forms, the name as given first."""
    own = F.array(F.struct(F.col(first).alias("first"), F.col(last).alias("last"), F.col(middle).alias("middle")))
    if inflector is None:
        return items.withColumn("forms", own)

    @F.pandas_udf(_FORMS)
    def forms(first: pd.Series, last: pd.Series, middle: pd.Series) -> pd.Series:
        text = lambda x: x if isinstance(x, str) else None
        names = [(text(a), text(b), text(c)) for a, b, c in zip(first, last, middle)]
        return pd.Series([[dict(zip(("first", "last", "middle"), f)) for f in inflector.forms(*name)] if any(name) else [] for name in names])

    return items.withColumn("forms", forms(F.col(first), F.col(last), F.col(middle)))


def _person(catalogs: DataFrame, inflector: Inflector | None, weights: dict[str, float]) -> DataFrame:
    people = _items(catalogs, "person")
    now = _forms(people, "e.first_name", "e.last_name", "e.middle_name", inflector)
    parts = (("first_name", "first"), ("last_name", "last"), ("middle_name", "middle"))
    named = F.flatten(F.transform("forms", lambda f: F.array(*[_alias("person", name, f[part]) for name, part in parts])))
    before = _forms(people.where("e.previous_last_name is not null"), "e.first_name", "e.previous_last_name", "e.middle_name", inflector)
    previous = F.transform("forms", lambda f: _alias("person", "previous_last_name", f["last"]))
    dates = _dates("person", "birth_date", F.col("e.birth_date"))
    once = inflector is None
    return _aliases(now, "person", named, weights, once).unionByName(_aliases(people, "person", dates, weights)).unionByName(_aliases(before, "person", previous, weights, once))


def _car(catalogs: DataFrame, weights: dict[str, float]) -> DataFrame:
    return _aliases(_items(catalogs, "car"), "car", [_alias("car", n, F.col(f"e.{n}")) for n in ("vin", "license_plate", "body_number", "chassis_number")], weights)


def _document(catalogs: DataFrame, weights: dict[str, float]) -> DataFrame:
    full = F.when((F.col("e.series") != "") & (F.col("e.number") != ""), F.concat_ws(" ", "e.series", "e.number"))
    plain = [_alias("document", n, F.col(f"e.{n}")) for n in ("series", "number", "document_type")]
    return _aliases(_items(catalogs, "document"), "document", [*plain, _alias("document", "series_number", full), *_dates("document", "issue_date", F.col("e.issue_date"))], weights)


def _legal_entity(catalogs: DataFrame, weights: dict[str, float]) -> DataFrame:
    return _aliases(_items(catalogs, "legal_entity"), "legal_entity", [_alias("legal_entity", n, F.col(f"e.{n}")) for n in ("inn", "name")], weights)


def _sender(catalogs: DataFrame, inflector: Inflector | None, weights: dict[str, float]) -> DataFrame:
    senders = _items(catalogs, "sender")
    plain = F.array(*[_alias("sender", n, F.col(f"e.{n}")) for n in ("full_name", "position", "organization_name", "return_address", "email", "inn")])
    # two or three words of letters are surname, given name and maybe patronymic; anything else stays literal
    words = F.split(F.btrim("e.full_name", F.lit(" \t\n\r\x0b\x0c ")), r"[\s ]+")
    is_name = F.size("w").isin(2, 3) & F.forall("w", lambda x: F.regexp_replace(x, "-", "").rlike(r"\A\p{L}+\z"))
    named = senders.withColumn("w", words).withColumn("w", F.when(is_name, F.col("w")))
    named = named.withColumns({"w1": F.get("w", F.lit(1)), "w0": F.get("w", F.lit(0)), "w2": F.get("w", F.lit(2))})
    full = lambda factor, *parts: _alias("sender", "full_name", F.concat(*parts), factor)

    def orders(f: Column) -> Column:
        first, last, middle, gap = f["first"], f["last"], f["middle"], F.lit(" ")
        start = lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))
        long = [full(1.0, last, gap, first, gap, middle), full(1.0, first, gap, middle, gap, last), full(0.85, last, gap, start(first), gap, start(middle)), full(0.85, last, gap, start(first), start(middle))]
        return F.array(full(0.9, last, gap, first), *long, _alias("sender", "full_name", F.when(middle.isNull(), F.concat(first, gap, last)), 0.9))

    return _aliases(_forms(named, "w1", "w0", "w2", inflector), "sender", F.concat(plain, F.flatten(F.transform("forms", orders))), weights, False)


#: Court, number and year of a case; the letter may be Latin or Cyrillic.
CASE_NUMBER = r"\A([AАaа][0-9]+-)([0-9]+/)(20[0-9]{2}|[0-9]{2})\z"


def _misc(catalogs: DataFrame, weights: dict[str, float]) -> DataFrame:
    compact = F.translate("e.case_number", " \t", "")
    court, number, year = (F.regexp_extract(compact, CASE_NUMBER, i) for i in (1, 2, 3))
    other = F.when(F.length(year) == 4, F.substring(year, 3, 2)).otherwise(F.concat(F.lit("20"), year))
    case = lambda *parts: _alias("misc", "case_number", F.when(compact.rlike(CASE_NUMBER), F.concat(*parts)))
    plain = [_alias("misc", n, F.col(f"e.{n}")) for n in ("incoming_letter_number", "reply_email", "reply_address")]
    cases = [_alias("misc", "case_number", F.col("e.case_number")), case(court, number, other), case(number, year), case(number, other)]
    items = _items(catalogs, "misc")
    dates = [d for n in ("incoming_letter_date", "preliminary_response_due_date") for d in _dates("misc", n, F.col(f"e.{n}"))]
    return _aliases(items, "misc", [*plain, *dates], weights).unionByName(_aliases(items, "misc", cases, weights, False))


#: Entities that come twice and are sent to every task, at most.
REPEATED = 10_000


def _entity(catalog_id: Column, entity_type: Column, entity_id: Column) -> Column:
    return F.xxhash64(catalog_id, entity_type, entity_id)


def _without_repeats(rows: DataFrame, catalogs: DataFrame) -> DataFrame:
    """``rows``, where aliases of one entity are distinct, without those that an entity brings that its catalog names again.

    Entities are counted first, by a hash each; a common hash costs work, not rows. Where none comes twice, nothing is shuffled.
    """

    def ids(entity_type: str) -> Column:
        hashes = F.transform(GROUPS[entity_type], lambda e: _entity(F.col("catalog_id"), F.lit(entity_type), e["id"]))
        return F.coalesce(hashes, F.array().cast("array<bigint>"))

    each = catalogs.select(F.explode(F.concat(*map(ids, GROUPS))).alias("h"))
    again = [r.h for r in each.groupBy("h").count().where("count > 1").limit(REPEATED + 1).collect()]
    if not again:
        return rows
    if len(again) > REPEATED:
        return rows.distinct()
    shared = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in again], "h long"))
    hashed = rows.withColumn("h", _entity(F.col("catalog_id"), F.col("entity_type"), F.col("entity_id")))
    return hashed.join(shared, "h", "left_anti").drop("h").unionByName(hashed.join(shared, "h", "left_semi").drop("h").distinct())


def generate_aliases(catalogs: DataFrame, config: MatchingConfig | None = None, inflector: Inflector | None = None) -> DataFrame:
    """(catalog_id, entity_type, entity_id, field_name, value, weight, profile), without repeats, of rows (catalog_id, groups...)."""
    weights = config.field_weights if config else {}
    made = [_person(catalogs, inflector, weights), _car(catalogs, weights), _document(catalogs, weights), _legal_entity(catalogs, weights), _sender(catalogs, inflector, weights), _misc(catalogs, weights)]
    return _without_repeats(reduce(DataFrame.unionByName, made), catalogs)


ORDER = ("entity_type", "entity_id", "field_name", "value", "weight")


def alias_arrays(aliases: DataFrame) -> DataFrame:
    """(catalog_id, aliases): a catalog's aliases in their order, as one array."""
    item = F.struct(*ORDER, "profile")
    return aliases.groupBy("catalog_id").agg(F.sort_array(F.collect_list(item)).alias("aliases"))
