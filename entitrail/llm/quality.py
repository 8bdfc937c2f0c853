"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

A rule is (name, measure, least, most) over the measures of a text: lengths, symbol ratios, stop-word counts and line
ratios. The table becomes one boolean column per rule and ``kept``. Every measure is taken row by row from the whole
text, in time n log n, so nothing is shuffled and no row depends on another.

Words are runs without ASCII white space. Words in repeated windows come from the sorted hashes of the windows of
``window`` words with their places: equal neighbours are repeats, and the places that they cover are summed.

Defined cases: a null or empty text has no words and fails; ``doc_id`` may be null or repeat, each row gives a row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Common function words of the languages that the rules are set for.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was at by this are from "
    "de la le les des et en un une du que qui est pour dans sur au "
    "der die das und ist von den mit zu ein eine für auf nicht sich dem des als "
    "el los las y a del se por con una su para es lo"
).split()

#: (name, measure, least, most); None leaves a side open.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("marks_per_word", "n_marks / n_words", None, 0.5),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.3),
    ("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
    ("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    ("letter_words", "n_letter_words / n_words", 0.7, None),
    ("stop_words", "if(n_words < 50, 1, n_stop_words)", 1, None),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(docs: DataFrame, window: int = 5) -> DataFrame:
    """(doc_id, n_words, word_chars, ...): the measures that rules are written over."""
    text = F.col("text")
    df = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    trimmed = F.btrim(text, F.lit(SPACE))
    df = df.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_marks"),
    )
    words, lines = F.col("words"), F.col("lines")
    n = F.size(words)
    window_at = lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(window)]).alias("h"), i.alias("p"))
    df = df.select(
        "doc_id", "word_chars", "n_symbols", "n_marks",
        n.cast("long").alias("n_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[ \t-\r]*\z"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"\A[ \t-\r]*[•*\-‣–][ \t]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(words, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter(words, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n >= window, F.sort_array(F.transform(F.sequence(F.lit(0), n - window), window_at))).otherwise(F.array()).alias("windows"),
    )
    seen = F.col("windows")
    hash_at = lambda i: F.get(seen, i)["h"]
    repeats = F.filter(seen, lambda x, i: (x["h"] == F.coalesce(hash_at(i + 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.when(i > 0, hash_at(i - 1)), F.bitwise_not(x["h"]))))
    df = df.withColumn("places", F.sort_array(F.transform(repeats, lambda x: x["p"]))).drop("windows")
    places = F.col("places")
    covered = F.transform(places, lambda p, i: F.when(i == 0, window).otherwise(F.least(F.lit(window), p - F.get(places, i - 1))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    # a column that is not deterministic keeps filters above: pushed below, they would repeat all of this per window
    return df.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, total)).drop("places")


def rule_columns(rules: Sequence[tuple[str, str, float | None, float | None]] = RULES) -> list[Column]:
    """A boolean column per rule, true where its measure is in bounds; a measure without a value passes."""
    out = []
    for name, measure, least, most in rules:
        value, ok = F.expr(f"try_divide({measure.split(' / ')[0]}, {measure.split(' / ')[1]})" if " / " in measure else measure), F.lit(True)
        if least is not None:
            ok = ok & (value >= least)
        if most is not None:
            ok = ok & (value <= most)
        out.append(F.coalesce(ok, F.lit(True)).alias(f"ok_{name}"))
    return out


def judged(docs: DataFrame, rules: Sequence[tuple[str, str, float | None, float | None]] = RULES) -> DataFrame:
    """The measures, ``base_failed``, a column ``ok_<rule>`` per rule, and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = measures(docs).select("*", base.alias("base_failed"), *rule_columns(rules))
    kept = ~F.col("base_failed")
    for name, *_ in rules:
        kept = kept & F.col(f"ok_{name}")
    return df.withColumn("kept", kept)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents")).select(*names)


def _rule_sql(measure: str, least: float | None, most: float | None) -> str:
    if " / " in measure:
        a, b = measure.split(" / ")
        measure = f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"
    elif measure.startswith("if("):
        test, yes, no = measure[3:-1].split(", ")
        measure = f"(CASE WHEN {test} THEN {yes} ELSE {no} END)"
    sides = ([f"{measure} >= CAST({least} AS DOUBLE)"] if least is not None else []) + ([f"{measure} <= CAST({most} AS DOUBLE)"] if most is not None else [])
    return f"coalesce({' AND '.join(sides)}, true)"


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), win AS (SELECT k, p, list_slice(ws, p, p + 4) AS win FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
rep AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p + j) AS n FROM rep, range(0, 5) r(j) GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, length(t) - length(translate(t, '!', '')) AS n_marks,
         len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t-\\r]*\\z'))) AS n_ellipsis_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '\\A[ \\t-\\r]*[•*\\-‣–][ \\t]'))) AS n_bullet_lines,
         len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
         len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS n_stop_words
  FROM w LEFT JOIN cov USING (k)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(_rule_sql(*r[1:]) for r in RULES)} AS kept
FROM b
"""
