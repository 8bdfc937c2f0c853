"""Connected components by minimum labels with pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected ``edges`` (a, b), for nodes that have an edge.

    A round takes the least label among a node's neighbours (summed up before the shuffle, so a hub is no hot key)
    and then its label's label. Labels only fall, so the rounds end when none has changed.
    """
    both = written(edges.selectExpr("a node", "b other").unionByName(edges.selectExpr("b node", "a other")).distinct(), "cc-edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "cc-labels")
    while True:
        told = both.join(labels, "node").selectExpr("other node", "label")
        least = labels.selectExpr("node", "label", "label was").unionByName(told.selectExpr("node", "label", "cast(null as long) was"))
        least = least.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        jump = labels.selectExpr("node label", "label further")
        now = least.join(jump, "label").selectExpr("node", "least(label, further) label", "was")
        now = written(now, "cc-labels")
        if not now.where("label <> was").limit(1).count():
            return now.select("node", "label")
        labels = now.select("node", "label")
