"""Unnesting of computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, name: str, *keep: str) -> DataFrame:
    """`keep` and one row per element of `array` as `name`.

    A plain explode makes the optimizer test the array's size below the projection that
    computes it, so an expensive array would be evaluated twice; the outer form does not."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """Keeps filters above `columns` from copying their expressions below the projection.

    A filter on a projected column is pushed under the projection together with the column's
    expression, which then runs twice or more per row.  It is not pushed under a generator,
    so the finished columns pass through one that yields a single row."""
    once = F.explode_outer(F.array(F.struct(*columns))).alias("_once")
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, once).select(*rest, *[F.col(f"_once.{c}").alias(c) for c in columns])
