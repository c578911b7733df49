"""An inverted-file index over vectors: the nearest rows for a table of queries.

Centroids are fitted on a bounded sample; every row is then put into the list of its nearest centroid, and
crowded lists are cut into blocks of bounded size.  A query probes the lists whose centroids are most similar
to it: it meets their blocks, in chunks of bounded size, and each meeting returns at most k rows a query.
With all lists probed the result is exact.  Equal vectors, of rows and of queries alike, are compared once.

A vector that is null, of another length or holds anything but finite numbers counts as zero; zero vectors have
similarity 0 to all.  Ties go to the smaller id."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.session import cut_lineage

#: Rows of a list that meet at once, and queries that meet them.
BLOCK_ROWS, CHUNK_QUERIES = 2000, 500
#: The sample has at most so many rows a list and so many numbers in all; that bounds the lists, too.
SAMPLE_PER_LIST, SAMPLE_NUMBERS, LEAST_PER_LIST = 64, 8 << 20, 16
MAX_LISTS = 4096
ROUNDS = 8


@dataclass(frozen=True)
class VectorIndex:
    """lists: list, block, key, vid (the smallest id), vector; members: key, id; blocks: list, n_blocks."""

    dim: int
    centroids: np.ndarray
    lists: DataFrame
    members: DataFrame
    blocks: DataFrame


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, dim))
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _clean(vector: Column, dim: int) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(v) == dim) & finite, v).otherwise(F.array_repeat(F.lit(0.0), dim))


def _keyed(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), _clean(F.col(vector), dim).alias("vector"))
    return rows.withColumn("key", F.md5(F.col("vector").cast("string")))


def _fit(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means on the sample, begun from its first rows (they are in hash order)."""
    centroids = sample[:lists].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centroids)
    return centroids


def build_index(df: DataFrame, id_col: str, vector: str, lists: int | None = None) -> VectorIndex:
    """An index over every row of `df`; by default about as many lists as the root of the distinct vectors."""
    spark = df.sparkSession
    dim = df.agg(F.max(F.size(vector))).first()[0]
    dim = dim if dim and dim > 0 else 1
    rows = cut_lineage(_keyed(df, id_col, vector, dim))
    points = cut_lineage(rows.groupBy("key").agg(F.min("id").alias("vid"), F.max("vector").alias("vector")))
    n = points.count()
    most = min(MAX_LISTS, max(1, SAMPLE_NUMBERS // (dim * LEAST_PER_LIST)))
    lists = max(1, min(lists or math.ceil(math.sqrt(n)), most, max(n, 1)))
    size = min(lists * SAMPLE_PER_LIST, max(lists, SAMPLE_NUMBERS // dim))
    sample = points.select("vector").orderBy("key").limit(size).toPandas()  # at most SAMPLE_NUMBERS numbers
    centroids = _fit(_matrix(sample["vector"], dim), lists) if n else np.zeros((1, dim))

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series((_matrix(vectors, dim) @ centroids.T).argmax(axis=1), dtype="int32")

    placed = cut_lineage(points.withColumn("list", F.pandas_udf(place, "int")("vector")))
    blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("n_blocks"))
    blocks = spark.createDataFrame(blocks.collect(), "list int, n_blocks long")  # at most MAX_LISTS rows
    block = F.pmod(F.xxhash64("key"), F.col("n_blocks")).alias("block")
    cut = placed.join(F.broadcast(blocks), "list").select("list", block, "key", "vid", "vector")
    return VectorIndex(dim, centroids, cut, rows.select("key", "id"), blocks)


def search(index: VectorIndex, queries: DataFrame, query_id: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, id, similarity, rank (from 1), probe (which list of the query held it, from 0): the `k` most
    similar rows of the index for each query, out of the `probes` nearest lists (all of them if None).  Equal
    rows of `queries` are answered once."""
    dim, centroids = index.dim, index.centroids
    probes = min(probes or len(centroids), len(centroids))
    asked = cut_lineage(_keyed(queries, query_id, vector, dim).withColumnsRenamed({"id": "query_id", "key": "qkey", "vector": "qvector"}))
    points = asked.groupBy("qkey").agg(F.max("qvector").alias("qvector"))

    def nearest_lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            order = np.argsort(-(_matrix(vectors, dim) @ centroids.T), axis=1, kind="stable")[:, :probes]
            yield pd.Series(list(order.astype("int32")))

    wanted = points.withColumn("lists", F.pandas_udf(nearest_lists, "array<int>")("qvector"))
    wanted = cut_lineage(wanted.select("qkey", "qvector", F.posexplode("lists").alias("probe", "list")))
    chunks = wanted.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("long").alias("n_chunks"))
    met = F.broadcast(index.blocks.join(chunks, "list"))  # at most MAX_LISTS rows
    key = ["list", "block", "chunk"]
    left = index.lists.join(met, "list").withColumn("chunk", F.explode(F.expr("sequence(0L, n_chunks - 1)")))
    right = wanted.join(met, "list").withColumn("block", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    right = right.withColumn("chunk", F.pmod(F.xxhash64("qkey"), F.col("n_chunks")))

    def meet(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asking):
            sims = np.round(_matrix(asking["qvector"], dim) @ _matrix(rows["vector"], dim).T, 12)
            vid = rows["vid"].fillna(np.iinfo(np.int64).max).to_numpy("int64")
            keys, n = rows["key"].to_numpy(str), min(k, len(rows))
            least = np.partition(sims, len(rows) - n, axis=1)[:, len(rows) - n]  # the n-th best; all that reach it are compared
            for i, (qkey, probe) in enumerate(zip(asking["qkey"], asking["probe"])):
                close = np.flatnonzero(sims[i] >= least[i])
                best = close[np.lexsort((keys[close], vid[close], -sims[i][close]))[:n]]
                found.append((np.repeat(qkey, len(best)), np.repeat(probe, len(best)), keys[best], sims[i][best], vid[best]))
        names = ["qkey", "probe", "key", "similarity", "vid"]
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in zip(names, list(zip(*found)) or [()] * len(names))})

    sides = left.select(*key, "key", "vid", "vector").groupBy(*key), right.select(*key, "qkey", "qvector", "probe").groupBy(*key)
    hits = sides[0].cogroup(sides[1]).applyInPandas(meet, "qkey string, probe int, key string, similarity double, vid long")
    first = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("similarity"), "vid", "key"))
    hits = hits.withColumn("_n", first).filter(F.col("_n") <= k).drop("_n", "vid")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("id")))
    ids = index.members.withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n")  # of equal vectors no more can be asked for
    rank = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("similarity"), F.asc_nulls_last("id"), "key"))
    ranked = hits.join(ids, "key").withColumn("rank", rank).filter(F.col("rank") <= k)
    return asked.select("query_id", "qkey").distinct().join(ranked, "qkey").select("query_id", "id", "similarity", "rank", "probe")


def probes_for(index: VectorIndex, queries: DataFrame, query_id: str, vector: str, k: int = 10, recall: float = 0.95, sample: int = 64) -> int:
    """The number of lists to probe so that `recall` of the exact answers of up to `sample` queries are found."""
    some = queries.orderBy(F.xxhash64(query_id), query_id).limit(sample)
    exact = search(index, some, query_id, vector, k)
    at = exact.groupBy("probe").count().orderBy("probe").collect()  # at most MAX_LISTS rows
    total, found = sum(r["count"] for r in at), 0
    for r in at:
        found += r["count"]
        if found >= recall * total:
            return r["probe"] + 1
    return 1
