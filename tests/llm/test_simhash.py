import random
from collections import Counter

import brute
import numpy as np
import pytest

from rampart.llm import simhash


def test_near_copies_agree_with_brute_force(spark, sample):
    for df in (brute.awkward(spark), brute.empty(spark), sample):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(df).collect())
        assert got == Counter(brute.near_copies(rows))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("paired", [64, 1])
def test_links_connect_all_pairs_within_two_bits(spark, paired):
    """Dense clusters and chains; `paired=1` sends every shared key through the numbers nearby."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.id: r.root for r in simhash.components(simhash.links(df, paired=paired)).collect()}
    of = brute.classes(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for i, f in enumerate(fps):
        assert got.get(signed(f), signed(f)) == min(signed(fps[j]) for j in of[i])


def test_chain_theorem():
    """Any difference of at most t bits has a chain within its budgets that starts somewhere."""
    rng = random.Random(1)
    for m in (5, 7):
        masks, budgets = simhash.segments(m), simhash.chain_budgets(m, 2)
        assert sum(x & ((1 << 64) - 1) for x in masks) == (1 << 64) - 1
        for _ in range(500):
            d = sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2])))
            bits = [(d & x).bit_count() for x in masks]
            assert any(all(sum(bits[(i + j) % m] for j in range(n + 1)) <= budgets[n] for n in range(m)) for i in range(m))


def test_long_text_in_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join(map(str, rng.integers(0, 500, 1000)))
    monkeypatch.setattr(simhash, "CHUNK", 37)
    assert simhash.fingerprint(text.encode(), 3) == signed(brute.fingerprint(text))


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {(r.id, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(300)}
