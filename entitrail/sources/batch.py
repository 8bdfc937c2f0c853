"""Batch exports: CSV files whose rows name a text and bring their own catalog.

Files are parsed strictly, one file per task; a row becomes its identifiers and its catalog's groups. The CSV reader
of Spark is no fit: it rewrites line ends in quoted cells, reads empty cells as null and takes broken quotes.
Any error in a row stops the batch before anything is written, naming file and row.
"""

from __future__ import annotations

import csv
import io
import json
import os
import sys
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOG
from .catalog import GROUP_NAMES, checked

# Column names of the exports, English for Russian, and keys in their JSON cells.
COLUMNS = {
    "InsuranceSubjects": "Субъект страхования ФЛ",
    "InsuranceSubjectsOrganization": "Субъект страхования ЮЛ",
    "InsuranceSubjectsVehicle": "Субъект страхования ТС",
    "PartnerKindName": "Вид контрагента",
    "PartnerName": "Контрагент",
    "SignerName": "ФИО подписанта документа",
    "Sender": "Отправитель",
    "SignerPosition": "Должность",
    "OutgoingOrganizationEmail": "Email отправителя",
    "SenderAddress": "Адрес отправителя",
    "FullNumber": "Порядковый номер",
    "CourtCase": "№ дела",
    "RegDate": "Дата регистрации",
    "AnswerDeadline": "Срок предоставления ответа",
    "EmailForAnswer": "Email для ответа",
    "AddressForAnswer": "Адрес для ответа",
}
PERSON_KEYS = {"last_name": "Фамилия", "first_name": "Имя", "middle_name": "Отчество", "birth_date": "Дата рождения", "previous_last_name": "Предыдущая фамилия"}
DOCUMENT_KEYS = {"document_type": "Удостоверение личности", "series": "Серия документа", "number": "Номер документа"}
CAR_KEYS = {"vin": "VIN", "license_plate": "Гос. номер", "body_number": "Номер кузова", "chassis_number": "Номер шасси"}
ORGANIZATION = "ЮЛ"

ROWS = f"csv_ord int, row_number int, source_csv string, version_id string, identifiers map<string,string>, {CATALOG}"


def _clean(value: Any, key: str) -> str | None:
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{key}: expected a string or null")
    return (value or "").strip() or None


def _cells(cell: str, column: str) -> list[dict[str, Any]]:
    if not cell.strip():
        return []
    try:
        items = json.loads(cell.strip())
    except ValueError as e:
        raise ValueError(f"{column}: invalid JSON: {e}") from e
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        raise ValueError(f"{column}: expected a JSON array of objects")
    return items


def _picked(item: dict[str, Any], keys: dict[str, str]) -> dict[str, str | None]:
    return {name: _clean(item.get(key), key) for name, key in keys.items()}


def _day(value: str | None) -> str | None:
    """A time stamp's day; anything else as it is, for the catalog's own check."""
    for form in ("%d.%m.%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S"):
        try:
            return datetime.strptime(value or "", form).date().isoformat()
        except ValueError:
            pass
    return value


def row_catalog(row: dict[str, str]) -> dict[str, list[dict[str, Any]]]:
    """The catalog that a CSV row describes."""
    value: dict[str, str] = dict(row)
    for english, russian in COLUMNS.items():
        if english in row:
            here, there = row[english].strip(), row.get(russian, "").strip()
            if here and there and here != there:
                raise ValueError(f"conflicting columns: {english} and {russian}")
            value[russian] = there or here
    cell = lambda name: _clean(value.get(COLUMNS[name]), COLUMNS[name])
    items = lambda name: _cells(value.get(COLUMNS[name], ""), COLUMNS[name])
    people = items("InsuranceSubjects")
    organization = cell("PartnerKindName") == ORGANIZATION
    sender = {
        "full_name": cell("SignerName") or cell("Sender") or (None if organization else cell("PartnerName")),
        "position": cell("SignerPosition"),
        "organization_name": cell("PartnerName") if organization else None,
        "return_address": cell("SenderAddress"),
        "email": cell("OutgoingOrganizationEmail"),
    }
    letter = {
        "incoming_letter_number": cell("FullNumber"),
        "case_number": cell("CourtCase"),
        "incoming_letter_date": _day(cell("RegDate")),
        "preliminary_response_due_date": _day(cell("AnswerDeadline")),
        "reply_email": cell("EmailForAnswer"),
        "reply_address": cell("AddressForAnswer"),
    }
    some = lambda x: any(v is not None for v in x.values())
    papers = [(f"person-{i}-document", _picked(p, DOCUMENT_KEYS)) for i, p in enumerate(people, 1)]
    firms = [{"inn": _clean(x.get("ИНН"), "ИНН"), "name": _clean(x.get("Полное наименование"), "Полное наименование") or _clean(x.get("Краткое наименование"), "Краткое наименование")} for x in items("InsuranceSubjectsOrganization")]
    return checked(
        {
            "people": [{"id": f"person-{i}", **_picked(p, PERSON_KEYS)} for i, p in enumerate(people, 1)],
            "documents": [{"id": key, **x} for key, x in papers if some(x)],
            "cars": [{"id": f"car-{i}", **_picked(x, CAR_KEYS)} for i, x in enumerate(items("InsuranceSubjectsVehicle"), 1)],
            "legal_entities": [{"id": f"legal-entity-{i}", **x} for i, x in enumerate(firms, 1)],
            "senders": [{"id": "sender-1", **sender}] if some(sender) else [],
            "miscellaneous": [{"id": "misc-1", **letter}] if some(letter) else [],
        }
    )


def _delimiter(text: str) -> str:
    """The one under which the header names versionId; data are never looked at."""
    for mark in (";", ","):
        try:
            if "versionId" in next(csv.reader(io.StringIO(text, newline=""), delimiter=mark, strict=True), []):
                return mark
        except csv.Error:
            continue
    return ";"


def parse_csv(content: bytes) -> Iterator[tuple[int, str, dict[str, str], dict[str, list]]]:
    """(record number, version id, identifiers, catalog) of each record; numbers start at 2 and skip blank lines."""
    csv.field_size_limit(min(sys.maxsize, (1 << 31) - 1))
    text = content.decode("utf-8-sig")
    records = csv.reader(io.StringIO(text, newline=""), delimiter=_delimiter(text), strict=True)
    header = next((r for r in records if r), [])
    if "versionId" not in header:
        raise ValueError("the header must contain versionId")
    if len(set(header)) != len(header) or "" in header:
        raise ValueError("column names must be nonempty and unique")
    number = 1
    for record in records:
        if not record:
            continue
        number += 1
        try:
            if len(record) != len(header):
                raise ValueError("a different number of cells than the header")
            row = dict(zip(header, record))
            version = row["versionId"].strip()
            if version in ("", ".", "..") or any(c in "/\\" or ord(c) < 32 for c in version):
                raise ValueError("versionId must be a nonempty file name")
            yield number, version, {k: row[k] for k in ("cardId", "fileId", "fileName") if row.get(k)}, row_catalog(row)
        except ValueError as e:
            raise ValueError(f"row {number}: {e}") from e
    if number == 1:
        raise ValueError("there must be at least one data row")


def read_batch(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ROWS of the CSV files, numbered in the order given."""
    found = {r.path.split(":", 1)[-1].lstrip("/"): r.path for r in spark.read.format("binaryFile").load(paths).select("path").collect()}
    order = {}
    for i, path in enumerate(paths):
        key = path.split(":", 1)[-1].lstrip("/")
        if key not in found:
            raise ValueError(f"{path}: the file is missing or empty")
        order[found[key]] = (i, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                i, name = order[path]
                try:
                    rows = [(i, number, name, version, identifiers, *(catalog[g] for g in GROUP_NAMES)) for number, version, identifiers, catalog in parse_csv(content)]
                except (ValueError, csv.Error) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=["csv_ord", "row_number", "source_csv", "version_id", "identifiers", *GROUP_NAMES])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, ROWS)


def _empty_files(spark: SparkSession, folders: list[str]) -> list[str]:
    """Paths of files without a byte, which no source of Spark shows."""
    found, hadoop = [], spark._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        listed = system.listStatusIterator(path) if system.exists(path) else None
        while listed is not None and listed.hasNext():
            status = listed.next()
            if status.getLen() == 0 and not status.isDirectory():
                found.append(status.getPath().toString())
    return found


def with_texts(rows: DataFrame, texts_dir: str | None = None) -> DataFrame:
    """``rows`` with ``text_file`` and ``text``, null where there is no such file; a text that is empty or no UTF-8 is an error."""
    spark = rows.sparkSession
    folder = F.lit(texts_dir.rstrip("/")) if texts_dir else F.concat(F.regexp_replace("source_csv", r"[^/]*\z", ""), F.lit("txts"))
    rows = rows.withColumn("text_file", F.concat(folder, F.lit("/"), "version_id", F.lit(".txt")))
    folders = [texts_dir] if texts_dir else [r[0] for r in rows.select(folder).distinct().collect()]
    bare = lambda c: F.regexp_replace(c, r"\A[A-Za-z0-9+.-]*:?/*", "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folders).select("path", "content")
    empty = spark.createDataFrame([(x, bytearray()) for x in _empty_files(spark, folders)], "path string, content binary")
    files = files.unionByName(empty).select(bare(F.col("path")).alias("at"), "content")
    # a link must not lead out of the folder; only local files can be links
    if all(f.startswith(("file:", "/")) or ":" not in f for f in folders):
        checked_path = F.udf(lambda x: bool(x) and os.path.islink(x) and os.path.dirname(os.path.realpath(x)) != os.path.realpath(os.path.dirname(x)), "boolean")
        escaped = checked_path(F.concat(F.lit("/"), F.col("at")))
        files = files.withColumn("content", F.when(escaped, F.raise_error(F.concat(F.lit("a text file must lie inside its folder: "), "at"))).otherwise(F.col("content")))
    joined = rows.join(files, bare(F.col("text_file")) == F.col("at"), "left")
    text = F.when(F.length("content") == 0, F.raise_error(F.concat(F.lit("empty text: "), "text_file"))).otherwise(F.decode("content", "UTF-8"))
    return joined.withColumn("text", F.when(F.col("content").isNotNull(), text)).drop("at", "content")
