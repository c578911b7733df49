"""Sinks and table maintenance."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rampart.session import checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, where every executor can write."""
    return os.path.join(checkpoint_dir(spark), "rampart", f"{name}-{uuid.uuid4().hex}")


def batch_rows(results: DataFrame) -> DataFrame:
    """Results (id, error, verdict, confidence, time_ms, reasons[]) as the columns of the batch report."""
    ok = F.col("error").isNull()
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    return results.select(
        F.col("id").cast("string").alias("ID"), F.when(ok, "Yes").otherwise("No").alias("Success"),
        F.when(ok, F.col("verdict")).otherwise("").alias("Verdict"), F.when(ok, two("confidence")).otherwise("").alias("Confidence"),
        two("time_ms").alias("Processing Time (ms)"), F.when(ok, F.concat_ws("; ", "reasons")).otherwise("").alias("Reasons"),
        F.when(ok, "").otherwise(F.coalesce("error", F.lit("Unknown error"))).alias("Error"),
    )


def write_batch_csv(results: DataFrame, path: str) -> None:
    batch_rows(results).write.mode("overwrite").option("header", True).csv(path)


def exposition(m: DataFrame, prefix: str = "security") -> Column:
    """`name{type="..."} value timestamp` of a metric row."""
    return F.concat(
        F.lit(prefix + "_"), F.col("metric_type"), F.lit("_"), F.col("name"), F.lit('{type="'), F.col("metric_type"), F.lit('"} '),
        F.col("value").cast("string"), F.lit(" "), F.floor(F.col("us") / 1000).cast("string"),
    )


def export_metrics(m: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt == "prometheus":
        m.select(exposition(m).alias("value")).write.mode("overwrite").text(path)
    elif fmt == "csv":
        m.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        m.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def append_experiment_tables(tables: dict[str, DataFrame], base: str) -> None:
    """Appends metrics, results, events or violations, one folder per table, by experiment.

    Rows are spread by experiment and a hash, so one busy experiment is written by many tasks."""
    for name, df in tables.items():
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(16))
        df.repartition("experiment_id", salt).write.mode("append").partitionBy("experiment_id").parquet(f"{base}/{name}")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both tables, the newest per key; the new table wins ties.

    The newest row is a mergeable maximum, so copies of a key are combined before the shuffle."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_r")).select(*keys, "_r.*")


def scan_experiments(df: DataFrame, status: str | None = None, kind: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of experiments, newest first."""
    out = df
    if status:
        out = out.filter(F.col("status") == status)
    if kind:
        out = out.filter(F.col("type") == kind)
    out = out.orderBy(F.desc("created_at"), "experiment_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def partition_by_hour(df: DataFrame, path: str, ts: str = "ts") -> DataFrame:
    """Writes year/month/day/hour folders and returns the rows per folder."""
    parts = {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd"), "hour": F.date_format(ts, "HH")}
    keyed = df.withColumns(parts)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(4))
    keyed.repartition(*parts, salt).write.mode("append").partitionBy(*parts).parquet(path)
    stored = df.sparkSession.read.option("recursiveFileLookup", False).parquet(path)
    return stored.groupBy(*parts).agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")
