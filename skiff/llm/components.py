"""Connected components by label propagation with pointer jumping, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` for every end of the edges (a, b): the label is the component's
    least node.  Each round is written to the shared folder, which cuts its lineage; only
    the number of changed labels comes to the driver."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = both.groupBy("node").agg(F.min("other").alias("m"))
    labels = materialize(labels.select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        # neighbours' labels
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        better = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        # the label's own label
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = better.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "label")
        moved = materialize(moved, "labels")
        if moved.where("new <> label").limit(1).count() == 0:
            return labels
        labels = moved.select("node", F.col("new").alias("label"))
