"""Connected components by min-label propagation with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id that can be reached.

    Each round takes the smallest label among the neighbours, then jumps to the label's own label. Labels
    and their changes are staged, so a round's plan does not hold the rounds before. A hub's edges are
    combined map-side on the way to it, and split by adaptive execution on the way out.
    """
    both = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct(), "edges")
    labels = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("n"))
        low = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "n").alias("l"))
        root = labels.select(F.col("u").alias("l"), F.col("l").alias("r"))
        new = stage(low.join(root, "l").select("u", F.least("l", "r").alias("l"), (F.least("l", "r") != F.col("old")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        unstage(labels)
        labels = new.select("u", "l")
        labels._staged_path = new._staged_path
        if not moved:
            unstage(both)
            return labels.select(F.col("u").alias("id"), F.col("l").alias("component"))
