"""Connected components by repeated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id a vertex is connected to.  `edges` has a and b.

    Each round every vertex hands its label to its neighbours and then takes its label's
    label, so chains shorten by more than half.  Minima are combined before each shuffle and
    each round is checkpointed."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "id"))
    while True:  # to the fixpoint
        handed = both.join(labels, both["a"] == labels["id"]).select(F.col("b").alias("id"), "l")
        low = labels.unionByName(handed).groupBy("id").agg(F.min("l").alias("l"))
        jump = low.select(F.col("id").alias("_i"), F.col("l").alias("_l"))
        new = low.join(jump, low["l"] == jump["_i"], "left").select("id", F.coalesce("_l", "l").alias("l"))
        new = cut_lineage(new)
        changed = new.join(labels.withColumnRenamed("l", "_old"), "id").filter(F.col("l") != F.col("_old"))
        labels = new
        if changed.isEmpty():
            return labels.withColumnRenamed("l", "component")
