"""Marking a stream of texts: the same matching and resolution, row by row.

A document is one row and is resolved where it is matched, so marking has no state: ``marked_stream`` is a plain streaming
frame, and ``start_marking`` hands the batch API of each micro-batch to a sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import MatchingConfig
from ..plans.marking import Marking, mark_listed


def marked_stream(documents: DataFrame, aliases: list[dict], config: MatchingConfig | None = None, key: str = "doc_id") -> Marking:
    """Marking of a streaming frame (key, text): its frames are streams."""
    return mark_listed(documents, aliases, config, key)


def candidate_stream(documents: DataFrame, aliases: list[dict], config: MatchingConfig | None = None, key: str = "doc_id") -> DataFrame:
    """Candidates of a streaming frame (key, text)."""
    return marked_stream(documents, aliases, config, key).candidates


def start_marking(
    documents: DataFrame,
    aliases: list[dict],
    sink: Callable[[Marking, int], None],
    checkpoint: str,
    config: MatchingConfig | None = None,
    key: str = "doc_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Marks every micro-batch of (key, text) and hands it to ``sink`` with its number, which is the same on a retry."""

    def each(batch: DataFrame, number: int) -> None:
        sink(mark_listed(batch, aliases, config, key), number)

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
