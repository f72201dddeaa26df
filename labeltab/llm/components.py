"""Connected components of an edge table, with joins and aggregates only.

Labels start as the vertex itself. Each pass takes the smallest label among a vertex and its
neighbours (a partial aggregate, so a hub with very many edges is no hot group) and then follows
the label's own label (pointer jumping), which shortens chains by halves. Labels are written to
the shared folder after each pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(v, label)``: label is the smallest vertex reachable from v.

    Nulls are no vertices; an empty table gives an empty one. Repeated edges and loops are fine.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = stage(both.union(both.select("b", "a")).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                   .select("v", F.least("v", "m").alias("label")), "cc-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("v", "b"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m")))
        hooked = labels.join(near, "v").select("v", F.least("label", "m").alias("l"), F.col("label").alias("was"))
        own = labels.select(F.col("v").alias("l"), F.col("label").alias("up"))
        new = stage(hooked.join(own, "l", "left")
                    .select("v", F.least("l", "up").alias("label"), "was"), "cc-labels")
        moved = new.where("label <> was").limit(1).count()
        labels = new.select("v", "label")
        if not moved:
            return labels
