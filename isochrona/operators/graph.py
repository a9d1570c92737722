"""Connected components on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(v, root): least member of each vertex's component, of edges (a, b). Least labels go along the edges, then each vertex takes
    its label's label; both repeat on written tables until nothing changes. Vertices of loops alone do not appear."""
    own = edges.where("a <> b")
    both = stage(own.select("a", "b").union(own.select("b", "a")).distinct(), "part-edges")
    label = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "part-labels")
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = label.join(near, "v").select("v", "root", F.least("root", "near").alias("next"))
        jump = step.join(step.select(F.col("v").alias("next"), F.col("next").alias("far")), "next", "left").select("v", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved"))
        after = stage(jump, "part-labels")
        label = after.select("v", "root")
        if not after.where("moved").limit(1).count():
            return label


def component_sizes(edges: DataFrame) -> DataFrame:
    """(root, n_vertices) of each component."""
    return components(edges).groupBy("root").agg(F.count(F.lit(1)).alias("n_vertices"))
