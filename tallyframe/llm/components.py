"""Connected components of an edge table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b); the label is the smallest node.

    Every round takes the smallest label among the neighbours and then the label
    of that label. Both are partial aggregates or joins on a node, so a node that
    touches a third of all edges is combined before it is shuffled. Rounds are
    written to the shared folder, which cuts the lineage.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                         .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
        now = materialize(hooked.join(jump, "label").select("node", "was", F.least("label", "to").alias("label")), "labels")
        if now.where("was <> label").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")
