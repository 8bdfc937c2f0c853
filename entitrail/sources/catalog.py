"""Entity catalogs from JSON, held to a strict contract.

Unknown or doubled names, wrong JSON types, blank strings and bad dates are errors; so are blank ids and ids that a
group repeats. Names may be English or Russian, never both for one field. A catalog is read by the driver: it is one
document; tables of catalogs are DataFrames with the same columns, see ``validate``.
"""

from __future__ import annotations

import json
from collections import Counter
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOG, GROUPS

# The names that catalogs may use.
GROUP_NAMES = {
    "people": ("ФизЛицо",),
    "cars": (),
    "documents": ("Документ",),
    "legal_entities": ("Юр Лицо", "ЮрЛицо"),
    "senders": ("Отправитель",),
    "miscellaneous": ("Прочее",),
}
FIELD_NAMES = {
    "people": {
        "id": (),
        "first_name": ("Имя",),
        "last_name": ("Фамилия",),
        "middle_name": ("отчество", "Отчество"),
        "birth_date": ("дата рождения",),
        "previous_last_name": ("предыдущая фамилия",),
    },
    "cars": {"id": (), "vin": (), "license_plate": (), "body_number": (), "chassis_number": ()},
    "documents": {"id": (), "document_type": ("Тип",), "series": ("серия",), "number": ("номер",), "issue_date": ()},
    "legal_entities": {"id": (), "inn": ("ИНН",), "name": ("ИМЯ_ЮЛ",)},
    "senders": {
        "id": (),
        "full_name": ("ФИО",),
        "position": ("Должность",),
        "organization_name": ("Название организации",),
        "return_address": ("обратный адрес",),
        "email": (),
        "inn": ("ИНН",),
    },
    "miscellaneous": {
        "id": (),
        "incoming_letter_number": ("номер вх письма",),
        "case_number": ("номер дела",),
        "incoming_letter_date": ("дата вх письма",),
        "preliminary_response_due_date": ("дата истеченияпредв ответа", "дата истечения предв ответа"),
        "reply_email": ("email для ответа",),
        "reply_address": ("адрес для ответа",),
    },
}
_DATES = frozenset({"birth_date", "issue_date", "incoming_letter_date", "preliminary_response_due_date"})
_MAY_BE_BLANK = frozenset({"inn", "email", "reply_email"})


def parse_date(value: str) -> date:
    for form in ("%Y-%m-%d", "%d.%m.%Y"):
        try:
            return datetime.strptime(value, form).date()
        except ValueError:
            pass
    raise ValueError("dates must use YYYY-MM-DD or DD.MM.YYYY")


def _renamed(value: Any, names: dict[str, tuple[str, ...]], where: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ValueError(f"{where}: expected an object")
    of = {other: name for name, others in names.items() for other in (name, *others)}
    if unknown := [k for k in value if k not in of]:
        raise ValueError(f"{where}: unknown names {unknown}")
    if doubled := [name for name, n in Counter(of[k] for k in value).items() if n > 1]:
        raise ValueError(f"{where}: specify only one name for {doubled}")
    return {of[k]: v for k, v in value.items()}


def _entity(group: str, value: Any, where: str) -> dict[str, Any]:
    given = _renamed(value, FIELD_NAMES[group], where)
    out: dict[str, Any] = dict.fromkeys(FIELD_NAMES[group])
    for name, v in given.items():
        if v is None and name != "id":
            continue
        if name in _DATES and type(v) is date:
            out[name] = v
            continue
        if not isinstance(v, str):
            raise ValueError(f"{where}.{name}: expected a string")
        if name in _DATES:
            try:
                v = parse_date(v)
            except ValueError as e:
                raise ValueError(f"{where}.{name}: {e}") from None
        elif name not in _MAY_BE_BLANK and not v.strip():
            raise ValueError(f"{where}.{name}: must not be blank")
        out[name] = v
    if out["id"] is None:
        raise ValueError(f"{where}: id is required")
    return out


def checked(value: Any) -> dict[str, list[dict[str, Any]]]:
    """A catalog's groups, every field present, from its decoded JSON."""
    given = _renamed(value, GROUP_NAMES, "catalog")
    out = {}
    for group in GROUP_NAMES:
        items = given.get(group, [])
        if not isinstance(items, list):
            raise ValueError(f"{group}: expected a list")
        out[group] = [_entity(group, x, f"{group}[{i}]") for i, x in enumerate(items)]
        if repeated := [k for k, n in Counter(x["id"] for x in out[group]).items() if n > 1]:
            raise ValueError(f"{group}: repeated ids {repeated}")
    return out


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    return dict(pairs)


def parse_catalog(payload: str) -> dict[str, list[dict[str, Any]]]:
    def constant(name: str) -> None:
        raise ValueError(f"not JSON: {name}")

    return checked(json.loads(payload, object_pairs_hook=_once, parse_constant=constant))


def catalog_frame(spark: SparkSession, catalogs: list[tuple[str, dict]]) -> DataFrame:
    """(catalog_id, groups...) of (id, checked catalog)."""
    return spark.createDataFrame([(key, *(value[g] for g in GROUP_NAMES)) for key, value in catalogs], f"catalog_id string, {CATALOG}")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a UTF-8 JSON file, as catalog_id ``catalog``; any path that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one catalog that is not empty")
    return catalog_frame(spark, [("catalog", parse_catalog(bytes(rows[0].content).decode("utf-8")))])


def validate(catalogs: DataFrame) -> DataFrame:
    """(catalog_id, entity_type, id, problem): blank and repeated ids in a table of catalogs; empty if all are sound."""
    found = None
    for entity_type, group in GROUPS.items():
        ids = catalogs.select("catalog_id", F.lit(entity_type).alias("entity_type"), F.explode(F.transform(group, lambda e: e["id"])).alias("id"))
        found = ids if found is None else found.unionByName(ids)
    problem = F.when(F.col("id").isNull() | ~F.col("id").rlike(r"\S"), "blank id").when(F.col("n") > 1, "repeated id")
    return found.groupBy("catalog_id", "entity_type", "id").agg(F.count("*").alias("n")).select("catalog_id", "entity_type", "id", problem.alias("problem")).where("problem is not null")
