import random

import brute
import numpy as np
import pytest

from rampart.llm import resemblance, simhash


def near_texts(groups=8, copies=14, words=60, seed=3):
    """Groups of copies with a few words changed each, passages in common, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(words)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(words)] + (common if g % 2 else [])
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    return [*enumerate(out), (len(out), " ".join(common)), (len(out) + 1, ""), (len(out) + 2, "a b")]


@pytest.mark.parametrize("paired", [32, 3])
def test_one_of_each_group_of_near_copies(spark, paired):
    """`paired=3` sends nearly every band through chosen texts."""
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(df, paired=paired).collect()}
    assert got == {min(rows[k][0] for k in group) for group in brute.resembling(rows).values()}
    assert 8 <= len(got) < len(rows) // 2


def test_awkward_rows_keep_one_of_each(spark):
    df = brute.awkward(spark)
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    # 1, 2 and both 3 are one class, so are 4, 5, 6 and the row without anything
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == [-1, 1, 4, 7, 8, 9]
    assert simhash.one_of_each(brute.empty(spark)).count() == 0


def test_shingles_are_sets_and_bands_rarely_miss():
    for text in ("", " ", "one", "One two", "a b c d e a b c d e a b", "x " * 1000):
        assert len(resemblance.shingles(text.encode(), 5)) == len(brute.shingle_set(text))
    assert (resemblance.shingles(b"A b C", 5) == resemblance.shingles(b"a\tB c", 5)).all()
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 450, np.uint64)
        y = np.concatenate((x[:400], rng.integers(0, 1 << 63, 50, np.uint64)))  # 400 of 500 shared
        missed += not (resemblance.bands(x) == resemblance.bands(y)).any()
    assert missed <= 1
