"""Connected components by smallest labels, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so paths shorten geometrically. Only a number of changes reaches the driver. Null ends
    link nothing; no edges give no rows.
    """
    both = stored(
        edges.select("a", "b")
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("root"))
        after = stored(
            low.join(jump, "low", "left").select(
                "node", F.least("low", "root").alias("comp"), (F.least("low", "root") != F.col("comp")).alias("moved")
            ),
            "labels",
        )
        labels = after.select("node", "comp")
        if after.filter("moved").count() == 0:
            return labels
