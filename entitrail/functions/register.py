"""SQL functions: ``normalize_text(text, profile)``, ``edit_spans(text, pattern, k)`` and ``inflect_person(first, last, middle)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .morphology import SuffixInflector
from .normalize import normalize
from .search import fuzzy_spans


def normalize_text(text: pd.Series, profile: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else normalize(t, p).value for t, p in zip(text, profile)])


class EditSpans:
    """Every substring within k edits of the pattern."""

    def eval(self, text: str, pattern: str, k: int) -> Iterator[tuple[int, int, int]]:
        if text is not None:
            yield from fuzzy_spans(text, pattern, k)


class InflectPerson:
    """The aligned case forms of a name, the name as given first."""

    def eval(self, first: str, last: str, middle: str) -> Iterator[tuple[int, str, str, str]]:
        for i, form in enumerate(SuffixInflector().forms(first, last, middle)):
            yield (i, *form)


def register(spark: SparkSession) -> None:
    spark.udf.register("normalize_text", F.pandas_udf(normalize_text, "string"))
    spark.udtf.register("edit_spans", udtf(EditSpans, returnType="start: int, end: int, distance: int"))
    spark.udtf.register("inflect_person", udtf(InflectPerson, returnType="variant: int, first_name: string, last_name: string, middle_name: string"))
