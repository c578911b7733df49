"""Exact dedup by content hash.

Texts are equal when identical after lower-casing A-Z; null counts as empty.  Rows meet on a
128-bit hash; where several rows share one, their bytes are compared, so a collision never joins
two texts.  Of equal texts the row with the smallest id stays (`keep="largest"`: the largest).
A missing id loses to any other; of rows repeated under the id that stays, one stays.  Empty
tables give empty results; columns besides id and text may have any names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import ascii_lower, texts, written

#: Slots of the filter that finds rows with a twin: at most so many numbers are broadcast.
SLOTS = 1 << 20


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _slot(h: str) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(SLOTS)).cast("int").alias("_slot")


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def _twins(hashed: DataFrame) -> DataFrame:
    """The slots of hashes that occur more than once: a bounded stand-in for those hashes."""
    return hashed.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select(_slot("_h")).distinct()


def copies(
    docs: DataFrame, keep: str = "smallest", hash_of: Callable[[Column], Column] = content_hash,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts stay where they are read, except those with a twin: these meet their equals in an
    aggregation on hash and bytes, combined before the shuffle, so thousands of copies cost one
    row per task."""
    best = {"smallest": F.min, "largest": F.max}[keep]("doc_id").alias("_keep")
    rows = texts(docs, id_col, text_col).select("doc_id", _normal(F.col("text")).alias("_norm"))
    rows = rows.withColumn("_h", hash_of(F.col("_norm")))
    hashed = written(rows.select("doc_id", "_h", F.unhex(F.sha2("_norm", 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    suspects = rows.withColumn("_slot", _slot("_h")).join(F.broadcast(_twins(hashed)), "_slot", "left_semi")  # at most SLOTS rows
    same_bytes = suspects.groupBy("_h", "_norm").agg(best, F.count("*").alias("_n"))
    groups = written(
        same_bytes.groupBy("_h").agg(F.count("*").alias("_texts"), F.first("_keep").alias("_keep"), F.first("_n").alias("_n"))
        .filter("_n > 1 or _texts > 1")
    )
    found = hashed.join(groups.filter("_texts = 1").drop("_texts"), "_h", "left")
    collided = groups.filter("_texts > 1").select("_h")
    if not collided.isEmpty():
        by_text = rows.join(collided, "_h", "left_semi").groupBy("_h", "_norm").agg(best, F.count("*").alias("_n"))
        by_sha = by_text.select("_h", F.unhex(F.sha2("_norm", 256)).alias("_sha"), "_keep", "_n")
        found = hashed.join(collided, "_h", "left_semi").join(by_sha, ["_h", "_sha"]).unionByName(
            found.join(collided, "_h", "left_anti").select("_h", "_sha", "doc_id", "_row", "_keep", "_n")
        )
    staying = found.filter("_n > 1 and doc_id <=> _keep").groupBy("_h", "_sha").agg(F.min("_row").alias("_row"))
    staying = staying.select("_row", F.lit(True).alias("_stays"))
    single = F.coalesce(F.col("_n"), F.lit(1)) == 1
    return found.join(staying, "_row", "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (single | F.coalesce("_stays", F.lit(False))).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they are.  Rows without a twin are never moved;
    the others meet on hash and bytes, combined before the shuffle.  Ties on the id are broken by
    the row's other columns."""
    norm = _normal(F.col(text_col))
    hashed = written(docs.select(content_hash(norm).alias("_h")))
    twins = F.broadcast(_twins(hashed))  # at most SLOTS rows
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).cast("long").alias("_id"), norm.alias("_norm"))
    rows = rows.withColumn("_h", content_hash(F.col("_norm"))).withColumn("_slot", _slot("_h"))
    alone = rows.join(twins, "_slot", "left_anti").select("_doc")
    pick, order = (F.max_by, F.struct("_id", F.xxhash64("_doc"))) if keep == "largest" else (F.min_by, F.struct(F.col("_id").isNull(), "_id", F.xxhash64("_doc")))
    met = rows.join(twins, "_slot", "left_semi").groupBy("_h", "_norm").agg(pick("_doc", order).alias("_doc"))
    return alone.unionByName(met.select("_doc")).select("_doc.*")
