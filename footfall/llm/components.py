"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.plans.scratch import materialise


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every end of the links ``a, b``; a component is named by its smallest id.

    Each round takes the smallest label among a node and its neighbours and then follows the label
    one step further, so rounds grow with the logarithm of the longest path. Labels are reduced on
    the map side, so a node with very many links is no hot group.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "graph-links")
    at = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "graph-labels")
    while True:
        near = both.join(at.withColumnsRenamed({"id": "b", "component": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        low = at.join(near, "id").select("id", F.least("component", "c").alias("c"), F.col("component").alias("was"))
        jump = at.select(F.col("id").alias("c"), F.col("component").alias("far"))
        new = low.join(jump, "c").select("id", F.least("c", "far").alias("component"), (F.least("c", "far") < F.col("was")).alias("moved"))
        new = materialise(new, "graph-labels")
        at = new.select("id", "component")
        if not new.where("moved").limit(1).count():
            return at
