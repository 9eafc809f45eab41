"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgraph.llm.shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for each node of ``edges`` (columns a and b, longs).

    A round takes the least label of the neighbours and then the label of that
    label; every round is written to the shared folder. Self-loops and repeated
    edges are harmless; no edges give no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        low = labels.join(near, "node").withColumn("low", F.least("label", "near"))
        labels = materialise(
            low.join(jump, "low").select("node", F.least("low", "lower").alias("label"), F.col("label").alias("was")), "labels"
        )
        changed = labels.where("label <> was").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels
