"""Sharding by vector bin packing.

Documents with equal texts form a group.  Groups become lots: a group of more than one lot's
share is dealt into pieces, small groups share a lot by their hash.  Rows of a large group that are
alike in their id too (repeated rows, rows without an id) are numbered, and dealt out in turn.  The
lots, a bounded number, are placed largest first into the shard where the dot product of the lot (bytes, tokens, rows)
with the shard's residual capacity is highest.

Null text has no bytes and no words.  Rows without an id and repeated rows are placed like any
other.  An empty table gives an empty result; columns besides id and text are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.llm.common import WORD, texts, written

#: Bytes that every document costs beside its text.
OVERHEAD = 16
#: Rows alike in id and text are dealt out in turn if together they have over one such part of a lot's share.
PART = 8


def place(lots: np.ndarray, shards: int, weights: tuple[float, ...]) -> np.ndarray:
    """The shard of each lot (rows: bytes, tokens, rows).  Largest first by bytes; the shard with
    the highest weighted dot product of the lot with the residual capacities, among those whose
    bytes have room for it (if there are none, the one with the most bytes free)."""
    total = lots.sum(axis=0, dtype=np.float64)
    share = lots / np.where(total > 0, total, 1) * shards  # a shard's capacity is 1 in every dimension
    free = np.ones((shards, lots.shape[1]))
    out = np.zeros(len(lots), np.int32)
    for i in np.argsort(-lots[:, 0], kind="stable"):
        fits = free[:, 0] >= share[i, 0]
        score = free @ (share[i] * weights) if fits.any() else free[:, 0]
        out[i] = s = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        free[s] -= share[i]
    return out


def shard(
    docs: DataFrame, shards: int = 40, lots_per_shard: int = 256, weights: tuple[float, float, float] = (1.0, 0.2, 0.2),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot; slots of a shard run from 0 without gaps.

    Only lots reach the driver: at most three times shards x lots_per_shard rows of sums.  Slots
    come from ranks within a lot and the lots' counts, so no task holds a shard."""
    n_lots = shards * lots_per_shard
    text = F.coalesce("text", F.lit(""))
    rows = texts(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.md5(text)).alias("_group"),
    )
    rows = written(rows)
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    total = rows.agg(F.sum("size").alias("_total"))
    pieces = F.ceil(F.col("_bytes") * n_lots / F.col("_total")).cast("long")
    large = groups.join(F.broadcast(total)).select("_group", pieces.alias("_pieces")).filter("_pieces > 1")  # fewer than n_lots groups
    alike = ["_group", "doc_id", "size", "tokens", "text_crc32"]
    repeated = rows.join(F.broadcast(large), "_group").groupBy(*alike, "_pieces").agg(F.count("*").alias("_n"))
    repeated = repeated.join(F.broadcast(total)).filter(F.col("_n") > 1).filter(F.col("_n") * F.col("size") * (PART * n_lots) > F.col("_total"))
    repeated = written(repeated.select(*alike, "_pieces", "_n"))  # fewer than PART * n_lots rows
    same = F.lit(True)
    for c in alike:
        same = same & rows[c].eqNullSafe(repeated[c])
    single = rows.join(F.broadcast(repeated), same, "left_anti").join(F.broadcast(large), "_group", "left").withColumn("_turn", F.lit(0).cast("long"))
    # what is alike is made again from its count, in blocks, so no task numbers all of it
    blocks = repeated.select("*", F.explode(F.expr("sequence(0L, (_n - 1) div 4096)")).alias("_block")).repartition(*alike, "_block")
    turns = blocks.select(*alike, "_pieces", F.explode(F.expr("sequence(_block * 4096, least(_block * 4096 + 4095, _n - 1))")).alias("_turn"))
    rows = single.unionByName(turns)
    piece = F.pmod(F.pmod(F.xxhash64("doc_id"), F.col("_pieces")) + F.col("_turn"), F.col("_pieces"))
    small = F.col("_pieces").isNull()
    rows = rows.select(
        "doc_id", "size", "tokens", "text_crc32", F.when(small, F.pmod("_group", F.lit(n_lots))).otherwise(F.col("_group")).alias("a"),
        F.when(small, F.lit(-1).cast("long")).otherwise(piece).alias("b"),
    )
    sums = rows.groupBy("a", "b").agg(F.sum("size").alias("x"), F.sum("tokens").alias("y"), F.count("*").alias("z"))
    lots = sums.orderBy("a", "b").toPandas()  # at most 3 * n_lots rows
    lots["shard"] = place(lots[["x", "y", "z"]].to_numpy(np.float64), shards, weights)
    lots["_first"] = lots.groupby("shard")["z"].cumsum() - lots["z"]
    placed = pd.DataFrame({c: lots[c].astype(k) for c, k in (("a", "int64"), ("b", "int64"), ("shard", "int32"), ("_first", "int64"))})
    table = docs.sparkSession.createDataFrame(placed, "a long, b long, shard int, _first long")
    rank = F.row_number().over(W.partitionBy("a", "b").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("_rank", rank).join(F.broadcast(table), ["a", "b"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot")
    )
