from collections import Counter, defaultdict
import zlib

import brute
import numpy as np

from rampart.llm import shards


def check(df, n, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = shards.shard(df, n, **options).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), len((t or "").encode().split())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.tokens) for r in out) == want
    slots, load = defaultdict(list), [0] * n
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < n for s in slots)
    return load


def test_every_row_has_one_slot(spark):
    check(brute.awkward(spark), 4)
    check(brute.empty(spark), 4)


def test_bytes_are_near_equal(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    load = check(df, 10)
    assert max(load) - min(load) < 0.01 * sum(load) / len(load)


def test_a_hot_group_is_dealt_out(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id, repeat(' x', id % 50))) as text")
    load = check(df, 8, lots_per_shard=64)
    assert max(load) - min(load) < 0.02 * sum(load) / len(load)


def test_rows_alike_in_id_and_text_are_dealt_out(spark):
    """No id at all, or one id for all: the pieces of the group stay equal."""
    for same in ("null", "7L"):
        df = spark.range(4400).selectExpr(f"if(id < 4000, {same}, id) as doc_id", "if(id < 4000, 'fourteen bytes', concat('text ', id)) as text")
        load = check(df, 8, lots_per_shard=64)
        assert max(load) - min(load) < 0.02 * sum(load) / len(load)


def test_partitions_do_not_change_the_shards(spark):
    df = spark.range(3000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text")
    results = [Counter(shards.shard(d, 8, lots_per_shard=64).collect()) for d in (df, df.repartition(13), df.orderBy("text"))]
    assert results[0] == results[1] == results[2]


def test_each_lot_goes_where_a_plain_search_would_put_it(spark):
    """Every choice is replayed: no shard with room scores higher (sums may differ in the last digits)."""
    rng, weights = np.random.default_rng(3), (1.0, 0.2, 0.2)
    for n in (1, 3, 8):
        lots = [[float(x) for x in rng.integers(1, 1000, 3)] for _ in range(200)]
        total, free, chosen = [sum(c) for c in zip(*lots)], [[1.0] * 3 for _ in range(n)], shards.place(np.array(lots), n, weights)
        for i in sorted(range(len(lots)), key=lambda i: -lots[i][0]):
            share = [x / t * n for x, t in zip(lots[i], total)]
            room = [s for s in range(n) if free[s][0] >= share[0]]
            score = {s: sum(f * x * w for f, x, w in zip(free[s], share, weights)) for s in room} or {s: free[s][0] for s in range(n)}
            assert score[chosen[i]] >= max(score.values()) - 1e-9
            free[chosen[i]] = [f - x for f, x in zip(free[chosen[i]], share)]
