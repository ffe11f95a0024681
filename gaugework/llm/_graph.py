"""Connected components of an edge table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scale


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> node, label: the least node of each node's component.

    Each round gives every node the least label among its neighbours' and then that label's own
    label, so a chain shortens geometrically. All tables stay distributed; a hub's rows are reduced
    to a minimum before they are shuffled.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = _scale.saved(both, "edges")
    labels = _scale.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = _scale.saved(step, "step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label"))
        after = _scale.saved(after, "labels")
        changed = after.where("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
