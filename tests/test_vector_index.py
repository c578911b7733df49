"""Nearest rows through the inverted-file index, against a plain search."""

import numpy as np
import pytest

from rampart.operators import vector_index as VI

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, asked, k):
    def unit(v, dim):
        ok = v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)
        v = np.array(v, np.float64) if ok else np.zeros(dim)
        n = np.linalg.norm(v)
        return v / n if n else v

    dim = max([len(v) for _, v in rows if v is not None], default=1)
    last = lambda i: (i is None, i or 0)
    units = [(i, unit(v, dim)) for i, v in rows]
    out = set()
    for q, v in asked:
        u = unit(v, dim)
        best = sorted(((-round(float(u @ w), 9), last(i)) for i, w in units))[:k]
        out |= {(q, n + 1, None if i[0] else i[1], 0.0 - s) for n, (s, i) in enumerate(best)}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in df.collect()}


AWKWARD = [
    (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [None, 1.0]),
    (8, [float("nan"), 1.0]), (9, [-1.0, 0.5]), (None, [1.0, 0.0]), (10, [0.5, 0.5]), (11, []), (12, [float("inf"), 1.0]),
]


@pytest.mark.parametrize("k", [1, 4, 20])
def test_awkward_vectors(spark, k):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    index = VI.build_index(df, "vec_id", "embedding", lists=3)
    assert found(VI.search(index, df, "vec_id", "embedding", k)) == plain(AWKWARD, AWKWARD, k)


def test_empty_tables(spark):
    some, none = spark.createDataFrame(AWKWARD, SCHEMA), spark.createDataFrame([], SCHEMA)
    for rows, asked in ((some, none), (none, some), (none, none)):
        index = VI.build_index(rows, "vec_id", "embedding")
        assert VI.search(index, asked, "vec_id", "embedding").count() == 0
        assert VI.probes_for(index, asked, "vec_id", "embedding") == 1


def test_many_equal_vectors_in_blocks(spark, monkeypatch):
    """A third of the rows are one vector, blocks and chunks are small: the same rows, and no group beyond a block."""
    monkeypatch.setattr(VI, "BLOCK_ROWS", 20)
    monkeypatch.setattr(VI, "CHUNK_QUERIES", 5)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3).astype("float32")]) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = VI.build_index(df, "vec_id", "embedding", lists=4)
    assert index.lists.filter("vid = 0").count() == 1
    assert max(r["count"] for r in index.lists.groupBy("list", "block").count().collect()) <= 60
    asked = rows[::20]
    assert found(VI.search(index, spark.createDataFrame(asked, SCHEMA), "vec_id", "embedding", 7)) == plain(rows, asked, 7)


def test_recall_of_probed_lists(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    asked = df.filter("vec_id % 50 = 0")
    index = VI.build_index(df, "vec_id", "embedding")
    probes = VI.probes_for(index, asked, "vec_id", "embedding", sample=20)
    exact = {x[:1] + x[2:3] for x in found(VI.search(index, asked, "vec_id", "embedding"))}
    probed = {x[:1] + x[2:3] for x in found(VI.search(index, asked, "vec_id", "embedding", probes=probes))}
    print("lists", len(index.centroids), "probes", probes, "recall", len(exact & probed) / len(exact))
    assert len(exact) == 10 * asked.count() and len(exact & probed) >= 0.9 * len(exact)
