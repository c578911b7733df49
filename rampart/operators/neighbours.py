"""Cosine neighbourhoods of vectors: density clusters, k-distances, nearest vectors.

Vectors are put into cells around a bounded number of pivots; crowded cells are cut into
blocks of bounded size.  Two blocks meet in one task, and only if the triangle inequality
allows a neighbour between their cells, so the search is exact.  A meeting returns a number
or a label per vector, never the pairs.  Equal vectors are one weighted vector throughout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.operators.components import connected_components
from rampart.operators.slices import previous_value, value_slices
from rampart.session import cut_lineage

MAX_PIVOTS = 256
BLOCK_ROWS = 2000
#: Blocks get larger rather than more: a vector is sent to each block, so that is what is shuffled.
MAX_BLOCKS = 16
STRIPE = 1 << 22
TINY = 1e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def distinct_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vid, vector, weight): one row per distinct vector, named by its smallest id."""
    return df.groupBy(F.col(vector).cast("array<double>").alias("vector")).agg(
        F.min(id_col).cast("long").alias("vid"), F.count("*").alias("weight")
    )


def _cells(points: DataFrame) -> tuple[DataFrame, list[tuple[int, float, int]], np.ndarray]:
    """Points with cell and block; per cell radius and number of blocks; pivot angles."""
    n = points.count()
    rows = max(BLOCK_ROWS, math.ceil(n / MAX_BLOCKS))
    wanted = min(MAX_PIVOTS, max(1, math.ceil(2 * n / rows)))
    head = points.orderBy(F.xxhash64("vid"), "vid").limit(wanted).select("vector").collect()
    pivots = _unit(pd.Series([r[0] for r in head]))

    def place(vectors: pd.Series) -> pd.DataFrame:
        sims = np.clip(_unit(vectors) @ pivots.T, -1.0, 1.0)
        best = sims.argmax(axis=1)
        return pd.DataFrame({"cell": best.astype("int32"), "angle": np.arccos(sims[np.arange(len(best)), best])})

    placed = points.withColumn("p", F.pandas_udf(place, "cell int, angle double")("vector")).select("vid", "vector", "weight", "p.*")
    sizes = placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()  # at most MAX_PIVOTS rows
    info = [(s["cell"], s["r"], max(1, math.ceil(s["n"] / rows))) for s in sizes]
    n_blocks = F.create_map(*[F.lit(x) for c, _, b in info for x in (c, b)])
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("vid"), n_blocks[F.col("cell")]).cast("int"))
    return blocked, info, np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))


def _meetings(points: DataFrame, max_angle: float) -> DataFrame:
    """Rows once per block pair they take part in: (pair, side 0/1, ...)."""
    blocked, info, angles = _cells(points)
    partners: dict[int, list[tuple[int, int]]] = {}
    for c, r, _ in info:
        partners[c] = [(d, nb) for d, q, nb in info if angles[c, d] - r - q <= max_angle + 1e-9]
    listed = F.create_map(*[
        x for c, ps in partners.items()
        for x in (F.lit(c), F.array(*[F.struct(F.lit(d).alias("cell"), F.lit(nb).alias("blocks")) for d, nb in ps]))
    ])
    met = blocked.withColumn("o", F.explode(listed[F.col("cell")])).withColumn(
        "ob", F.explode(F.sequence(F.lit(0), F.col("o.blocks") - 1))
    )
    mine = F.struct("cell", "block")
    other = F.struct(F.col("o.cell").alias("cell"), F.col("ob").alias("block"))
    pair = F.concat_ws("_", F.least(mine, other)["cell"], F.least(mine, other)["block"], F.greatest(mine, other)["cell"], F.greatest(mine, other)["block"])
    side = F.when(mine == other, 2).when(mine < other, 0).otherwise(1)
    return met.select("vid", "vector", "weight", pair.alias("pair"), side.alias("side"), *([] if "core" not in blocked.columns else ["core"]))


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    if (pdf["side"] == 2).all():
        return pdf, pdf, True
    return pdf[pdf["side"] == 0], pdf[pdf["side"] == 1], False


def _stripes(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Similarities of all of `a` to all of `b`, few rows of `a` at a time."""
    step = max(1, STRIPE // max(1, len(b)))
    for i in range(0, len(a), step):
        yield slice(i, i + step), a[i : i + step] @ b.T


def _per_pair(met: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return met.groupBy("pair").applyInPandas(fn, schema)


def neighbour_weights(points: DataFrame, eps: float) -> DataFrame:
    """(vid, near): how many vectors lie within cosine distance eps, itself and copies included."""
    met = _meetings(points, math.acos(max(-1.0, 1.0 - eps)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(pdf)
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"vid": [], "near": []})
        wa, wb = a["weight"].to_numpy(), b["weight"].to_numpy()
        na, nb = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for part, sims in _stripes(_unit(a["vector"]), _unit(b["vector"])):
            x, y = np.nonzero(sims >= 1.0 - eps - TINY)
            np.add.at(na[part], x, wb[y])
            if not same:
                np.add.at(nb, y, wa[part][x])
        out = pd.DataFrame({"vid": a["vid"].to_numpy(), "near": na})
        return out if same else pd.concat([out, pd.DataFrame({"vid": b["vid"].to_numpy(), "near": nb})])

    return _per_pair(met, count, "vid long, near long").groupBy("vid").agg(F.sum("near").alias("near"))


def _local_labels(ua: np.ndarray, ub: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id each vector of either side is connected to within the meeting, by similarities
    of `least` or more."""
    la, lb = ids_a.copy(), ids_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na, nb = la.copy(), lb.copy()
        for part, sims in _stripes(ua, ub):
            close = sims >= least
            na[part] = np.minimum(na[part], np.where(close, nb[None, :], top).min(axis=1, initial=top))
            nb = np.minimum(nb, np.where(close, na[part][:, None], top).min(axis=0, initial=top))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def density_clusters(
    df: DataFrame, id_col: str, vector: str, eps: float = 0.3, min_samples: int = 3, min_size: int = 5
) -> DataFrame:
    """(id, cluster): density clusters under cosine distance; -1 is noise or a cluster too small.

    Vectors with at least `min_samples` vectors within eps are core; connected cores are a
    cluster; another vector joins the cluster of its nearest core within eps (ties to the
    smaller id)."""
    base = df.select(F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias("vector"))
    points = cut_lineage(distinct_vectors(base, id_col, "vector"))
    near = neighbour_weights(points, eps)
    cored = cut_lineage(points.join(near, "vid").withColumn("core", F.col("near") >= min_samples).drop("near"))
    max_angle = math.acos(max(-1.0, 1.0 - eps))
    cores = cored.filter("core").select("vid", "vector", "weight")
    empty = cored.sparkSession.createDataFrame([], "a long, b long")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = _sides(pdf)
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"a": [], "b": []})
        ia, ib = a["vid"].to_numpy(dtype="int64"), b["vid"].to_numpy(dtype="int64")
        la, lb = _local_labels(_unit(a["vector"]), _unit(b["vector"]), ia, ib, 1.0 - eps - TINY)
        return pd.DataFrame({"a": np.concatenate([ia, ib]), "b": np.concatenate([la, lb])}).drop_duplicates()

    edges = _per_pair(_meetings(cores, max_angle), link, "a long, b long") if not cores.isEmpty() else empty
    comp = connected_components(edges).select(F.col("id").alias("vid"), "component")

    # others: nearest core within eps, from meetings of all vectors in which cores are marked by a negative weight
    signed = cored.withColumn("weight", F.when(F.col("core"), -F.col("weight")).otherwise(F.col("weight"))).drop("core")

    def attach(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(pdf)
        rows = []
        for x, y in ([(a, b)] if same else [(a, b), (b, a)]):
            x, y = x[x["weight"] > 0], y[y["weight"] < 0].sort_values("vid")
            if len(x) and len(y):
                best, top = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
                for part, sims in _stripes(_unit(x["vector"]), _unit(y["vector"])):
                    best[part] = sims.argmax(axis=1)
                    top[part] = sims.max(axis=1)
                ok = top >= 1.0 - eps - TINY
                rows.append(pd.DataFrame({"vid": x["vid"].to_numpy()[ok], "core_id": y["vid"].to_numpy()[best[ok]], "sim": top[ok]}))
        return pd.concat(rows) if rows else pd.DataFrame({"vid": [], "core_id": [], "sim": []})

    border = _per_pair(_meetings(signed, max_angle), attach, "vid long, core_id long, sim double")
    nearest = border.groupBy("vid").agg(F.min_by("core_id", F.struct(-F.round("sim", 9), F.col("core_id"))).alias("core_id"))
    joined_border = nearest.join(comp.withColumnRenamed("vid", "core_id"), "core_id").select("vid", "component")
    labelled = points.join(comp.unionByName(joined_border), "vid", "left")
    sizes = labelled.filter("component is not null").groupBy("component").agg(F.sum("weight").alias("_size"))
    kept = labelled.join(sizes, "component", "left").select(
        "vector", F.when(F.col("_size") >= min_size, F.col("component")).otherwise(F.lit(-1)).alias("cluster")
    )
    return base.join(kept, "vector").select(id_col, "cluster")


def k_distances(df: DataFrame, id_col: str, vector: str, k: int = 4) -> DataFrame:
    """(vid, kdist): cosine distance to the k-th nearest vector, the vector itself being the first.

    Equal vectors are measured once, and each id that has them gets the distance; a row that comes
    twice is named once.  A null vector is no one's neighbour, its distance is null."""
    named = df.select(F.col(id_col).cast("long").alias("vid"), F.col(vector).cast("array<double>").alias("vector"))
    known = named.filter("vector is not null")
    points = cut_lineage(distinct_vectors(known, "vid", "vector").withColumn("vid", F.monotonically_increasing_id()))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(pdf)
        rows = []
        for x, y in ([(a, b)] if same else [(a, b), (b, a)]):
            if len(x) and len(y):
                take = min(k, len(y))
                ids, weights = x["vid"].to_numpy(), np.minimum(y["weight"].to_numpy(), k)
                for part, sims in _stripes(_unit(x["vector"]), _unit(y["vector"])):
                    dist = np.maximum(0.0, 1.0 - sims)
                    idx = np.argpartition(dist, take - 1, axis=1)[:, :take]
                    rows.append(pd.DataFrame({
                        "vid": np.repeat(ids[part], take), "d": np.take_along_axis(dist, idx, axis=1).ravel(), "w": weights[idx].ravel(),
                    }))
        return pd.concat(rows) if rows else pd.DataFrame({"vid": [], "d": [], "w": []})

    found = _per_pair(_meetings(points, math.pi), nearest, "vid long, d double, w long")
    w = Window.partitionBy("vid").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    ranked = found.withColumn("upto", F.sum("w").over(w))
    dist = ranked.filter(F.col("upto") >= k).groupBy("vid").agg(F.min("d").alias("kdist"))
    measured = known.distinct().join(points.join(dist, "vid").drop("vid"), "vector").select("vid", "weight", "kdist")
    unknown = named.filter("vector is null").groupBy("vid").agg(F.count("*").alias("weight"))
    return measured.unionByName(unknown.withColumn("kdist", F.lit(None).cast("double")))


def suggest_eps(df: DataFrame, id_col: str, vector: str, k: int = 4) -> DataFrame:
    """The k-distance before the largest jump of the sorted curve; sorted by value ranges."""
    d = cut_lineage(k_distances(df, id_col, vector, k).filter("kdist is not null")).select("vid", F.round("kdist", 9).alias("kdist"))
    sliced = value_slices(d, [], "kdist").withColumnRenamed("__slice", "vs")
    lagged = previous_value(sliced, [], F.col("vs"), ["kdist", "vid"], {"before": F.col("kdist")})
    return lagged.filter("before is not null").agg(
        F.max_by("before", F.struct(F.round(F.col("kdist") - F.col("before"), 9), -F.col("before"))).alias("eps"), F.max(F.col("kdist") - F.col("before")).alias("jump")
    )


def mean_pair_distance(df: DataFrame, group: str, id_col: str, vector: str) -> DataFrame:
    """(group, pairs, mean): mean Euclidean distance of all pairs within a group.

    A group is cut into blocks of bounded size; block pairs return one sum each."""
    sized = df.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    rows = df.select(group, F.col(id_col).alias("vid"), F.col(vector).cast("array<double>").alias("vector")).join(sized, group)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("vid"), F.col("_blocks")).cast("int"))
    met = blocked.withColumn("ob", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    keyed = met.select(
        group, "vector", F.least("block", "ob").alias("b0"), F.greatest("block", "ob").alias("b1"),
        F.when(F.col("block") == F.col("ob"), 2).when(F.col("block") < F.col("ob"), 0).otherwise(1).alias("side"),
    )
    kind = dict(df.dtypes)[group]

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(pdf)
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({group: [key[0]], "s": [0.0], "n": [0]})
        x = np.array([np.asarray(v, dtype=np.float64) for v in a["vector"]])
        y = np.array([np.asarray(v, dtype=np.float64) for v in b["vector"]])
        sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        d = np.sqrt(np.maximum(sq, 0.0))
        if same:
            np.fill_diagonal(d, 0.0)
            return pd.DataFrame({group: [key[0]], "s": [d.sum() / 2], "n": [len(x) * (len(x) - 1) // 2]})
        return pd.DataFrame({group: [key[0]], "s": [d.sum()], "n": [d.size]})

    sums = keyed.groupBy(group, "b0", "b1").applyInPandas(total, f"{group} {kind}, s double, n long")
    return sums.groupBy(group).agg(F.sum("n").alias("pairs"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean_distance"))


def cosine(a, b):
    """Cosine similarity of two array columns."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def nearest(df: DataFrame, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """The `k` vectors most similar to one query vector: a scan and a top-k, limited per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("similarity", cosine(F.col(vector), q)).orderBy(F.desc("similarity")).limit(k)
