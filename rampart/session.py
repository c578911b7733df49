"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """All event times are UTC, and Python gets about four megabytes of rows at a time: a worker holds
    a batch several times over.  Everything else is left as the cluster has it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="rampart-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a new one of this machine only where none is set and all
    work is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files that outlive any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: a scan that would leave half of the cores idle (one
    file, one row group) is dealt out evenly first.  All other inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
