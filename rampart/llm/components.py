"""Connected components by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import discard, gathered, written


def components(edges: DataFrame) -> DataFrame:
    """id, root: for every vertex of `edges` (a, b) the smallest vertex it is connected to.

    Large and small stars by turns until nothing changes: each round ties a vertex's larger
    neighbours, then its smaller ones, to the smallest.  Every round is a written table and every
    minimum is combined before its shuffle; the number of rounds is not limited."""
    first = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now, before = written(first), None
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    while True:
        both = gathered(now).select(ways.alias("_e")).select("_e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        new = written(large.join(least, "u").select(tied.alias("_e")).select("_e.*").filter("u != v").distinct())
        discard(now)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return new.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                new.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        now, before = new, mark
