"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space, in Python, Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.  Only a local
    session without that setting, as in tests, gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends there, executors may be lost, and the
    optimizer knows the size of what it joins next."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` made, when nothing will read them any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each that one task deals with sooner than many tasks exchange them.
FEW = 1 << 16


def gathered(table: DataFrame) -> DataFrame:
    """A written table of at most FEW rows as one partition, which needs no exchange for joins and sums on any
    key; a larger one as it is."""
    return table.coalesce(1) if table.count() <= FEW else table


#: A bitmap's words of 64 bits: at most so many rows are broadcast, whatever is in it.
BITMAP_WORDS = 1 << 20


def _slot(number: Column) -> Column:
    return F.pmod(number, F.lit(64 * BITMAP_WORDS))


def bitmap(numbers: DataFrame, column: str) -> DataFrame:
    """_word, _bits: the slots of hashes, a bounded stand-in for them."""
    slot = _slot(F.col(column))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    return numbers.select(F.floor(slot / 64).cast("int").alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def marked(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """`df` with _in: whether the hash may be one of those in the bitmap (it is, or shares a slot with one)."""
    slot = _slot(F.col(column))
    hit = F.call_function("shiftright", F.col("_bits"), (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    joined = df.withColumn("_word", F.floor(slot / 64).cast("int")).join(F.broadcast(bits), "_word", "left")  # at most BITMAP_WORDS rows
    return joined.withColumn("_in", F.coalesce(hit, F.lit(False))).drop("_word", "_bits")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def small_batches(df: DataFrame) -> DataFrame:
    """From now on the session hands Python about four megabytes at a time instead of 64: whole texts
    are long, and a batch is held by the executor and by its Python worker at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so other columns of `docs` may have any names."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, not decoded."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that Python holds few texts at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
