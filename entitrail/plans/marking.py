"""Marking: the whole way from catalogs and texts to occurrences, rejections and exports.

One pass over the documents matches and resolves; everything else is a projection of its rows, so a plan reads the texts
once, shuffles nothing and needs no key: null and repeated ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchingConfig
from ..functions.morphology import Inflector, SuffixInflector
from ..operators import candidates as matching
from ..operators import export
from ..operators.aliases import ORDER, alias_arrays, generate_aliases
from ..operators.resolve import DUPLICATE

ALIASES_PER_PASS = matching.ALIASES_PER_PASS
_FOUND = ["alias_ord", "entity_type", "entity_id", "field_name", "value", "weight", "profile", "start", "end", "matched_text", "score", "method", "edit_distance", "barriers_before", "barriers_within"]


@dataclass(frozen=True)
class Marking:
    """Results over ``marked``, (key, text, mentions, ...): lazily computed frames."""

    marked: DataFrame
    key: str = "doc_id"

    @property
    def mentions(self) -> DataFrame:
        return self.marked.select(self.key, F.inline("mentions"))

    @property
    def candidates(self) -> DataFrame:
        return self.mentions.select(self.key, *_FOUND)

    @property
    def rows(self) -> DataFrame:
        """Every candidate with place, support, combined and reason; accepted ones have no reason."""
        return self.mentions.select(self.key, *_FOUND, "place", "support", "combined", "reason")

    @property
    def unique(self) -> DataFrame:
        """Of one entity, field and span, the best."""
        return self.rows.where(~F.col("reason").eqNullSafe(DUPLICATE))

    @property
    def occurrences(self) -> DataFrame:
        named = self.mentions.where("n is not null")
        return named.select(self.key, "n", export.region_id(F.col("n")).alias("region_id"), "entity_type", "entity_id", "field_name", "start", "end", "matched_text", F.col("value").alias("source_value"), F.col("combined").alias("score"), "method", "edit_distance", "support")

    @property
    def rejected(self) -> DataFrame:
        return self.mentions.where("reject_ord is not null").select(self.key, "reject_ord", "entity_type", "entity_id", "field_name", "value", "weight", "profile", "start", "end", "matched_text", "score", "method", "edit_distance", "reason")

    def pairs(self, config: MatchingConfig | None = None) -> DataFrame:
        """Each mention with every one that is evidence for it."""
        return matching.evidence_pairs(self.marked, config or MatchingConfig(), self.key)

    def predictions(self, **options: str) -> DataFrame:
        return export.tasks(self.marked, self.key, **options)

    def annotations(self) -> DataFrame:
        return export.tasks(self.marked, self.key, annotations=True)

    def evidence(self) -> DataFrame:
        return export.evidence(self.marked, self.key)


def _numbered(aliases: DataFrame) -> DataFrame:
    """``aliases`` with ``alias_ord``, their place in the one order of all; ranges are counted, and only counts meet in the driver."""
    spark, columns = aliases.sparkSession, [*ORDER, "profile"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = aliases.select(*columns).repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    placed = placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    base, before = 0, []
    for r in sorted(placed.groupBy("part").count().collect(), key=lambda r: r.part):
        before.append((r.part, base))
        base += r["count"]
    starts = F.broadcast(spark.createDataFrame(before, "part long, base long"))
    return placed.join(starts, "part").withColumn("alias_ord", (F.col("base") + F.col("at") - F.shiftleft("part", 33)).cast("int")).drop("part", "at", "base")


def alias_passes(aliases: DataFrame) -> Iterator[Broadcast]:
    """Aliases in their order, numbered over all, in lists of at most ALIASES_PER_PASS, each sent to every task.

    Their count is checked first. What is sent at a time never grows with the catalog: more take several passes.
    """
    spark, most = aliases.sparkSession, ALIASES_PER_PASS
    n = aliases.count()
    if n <= most:
        rows = aliases.select(*ORDER, "profile").orderBy(*ORDER, "profile").collect()
        yield spark.sparkContext.broadcast([{**r.asDict(), "alias_ord": i} for i, r in enumerate(rows)])
        return
    numbered = _numbered(aliases)
    for at in range(0, n, most):
        own = numbered.where((F.col("alias_ord") >= at) & (F.col("alias_ord") < at + most)).orderBy("alias_ord").collect()
        yield spark.sparkContext.broadcast([r.asDict() for r in own])


def mark_aliases(documents: DataFrame, aliases: DataFrame, config: MatchingConfig | None = None, key: str = "doc_id") -> Marking:
    """Marks (key, text) with a table of aliases (entity_type, entity_id, field_name, value, weight, profile)."""
    return Marking(matching.mark_texts(documents, [*alias_passes(aliases)], config or MatchingConfig()), key)


def mark(documents: DataFrame, catalog: DataFrame, config: MatchingConfig | None = None, inflector: Inflector | None = None, key: str = "doc_id") -> Marking:
    """Marks every text of (key, text) with one catalog (catalog_id, groups...)."""
    config = config or MatchingConfig()
    return mark_aliases(documents, generate_aliases(catalog, config, inflector or SuffixInflector()), config, key)


def mark_listed(documents: DataFrame, aliases: list[dict], config: MatchingConfig | None = None, key: str = "doc_id") -> Marking:
    """Marks with aliases that are at hand, also on a stream."""
    spark: SparkSession = documents.sparkSession
    rows = sorted(aliases, key=lambda a: tuple(a[c] for c in ORDER))
    return Marking(matching.mark_texts(documents, [spark.sparkContext.broadcast(rows)], config or MatchingConfig()), key)


def mark_batch(rows: DataFrame, config: MatchingConfig | None = None, inflector: Inflector | None = None) -> Marking:
    """Marks each row's text with its own catalog. ``rows`` as of ``with_texts``; rows without a text are left out.

    The key is the file's number and the record's; metadata go into the exports.
    """
    config = config or MatchingConfig()
    rows = rows.withColumn("row_key", F.concat_ws(":", F.lpad(F.col("csv_ord").cast("string"), 9, "0"), F.lpad(F.col("row_number").cast("string"), 12, "0")))
    aliases = generate_aliases(rows.withColumnRenamed("row_key", "catalog_id"), config, inflector or SuffixInflector())
    own = alias_arrays(aliases).withColumnRenamed("catalog_id", "row_key")
    named = F.to_json(F.struct(F.col("version_id").alias("versionId"), "source_csv", F.col("row_number").alias("source_row"), "text_file"))
    known = F.when(F.size("identifiers") > 0, F.concat(F.expr("rtrim('}', to_json(identifiers))"), F.lit(","), F.substring(named, 2, 1 << 30))).otherwise(named)
    documents = rows.where("text is not null").withColumn("metadata", known).select("row_key", "text", "metadata")
    return Marking(matching.mark_rows(documents.join(own, "row_key", "left"), config), "row_key")
