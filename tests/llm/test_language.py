import math
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from rampart.llm import language


def test_held_out_accuracy_and_independence_of_labels(spark, sample):
    out = language.identify(sample)
    rows = {r.doc_id: r for r in out.collect()}
    lang = {r.doc_id: r.lang for r in sample.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert len(rows) == len(lang) and held
    assert np.mean([rows[i].lang_pred == lang[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    # labels and sources of held-out rows, and the order of the rows, change nothing
    other = sample.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z")).repartition(5)
    for r in language.identify(other).collect():
        assert r.lang_pred == rows[r.doc_id].lang_pred and math.isclose(r.score, rows[r.doc_id].score, rel_tol=1e-6)


def test_awkward_rows(spark):
    got = Counter((r.doc_id, r.lang_pred == "und", r.score == 0) for r in language.identify(brute.awkward(spark)).collect())
    und = {(4, True, True), (5, True, True), (6, True, True), (9, True, True)}
    assert und <= set(got) and sum(got.values()) == len(brute.AWKWARD)
    assert sum(n for (_, u, _), n in got.items() if u) == 5  # the row without anything is the fifth
    assert language.identify(brute.empty(spark)).count() == 0
    bare = brute.awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(bare).collect()} == {("und", 0.0)}


def test_known_language_keeps_rows_whole(spark):
    df = brute.awkward(spark)
    out = language.known_language(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 3, 7, 8]
    assert all(r.lang is not None for r in out.collect())


def naive(text):
    line = " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or line[-1] != " ":
            line += c
    line += "" if line[-1] == " " else " "
    out = np.zeros(language.FEATURES, np.int64)
    for n in (1, 2, 3):
        for i in range(1 if n == 1 else 0, len(line) - n + 1):
            h = 0
            for c in line[i : i + n]:
                h = (h * 1_000_003 + ord(c)) % 2**64
            h += n << 50 if n > 1 else 0
            out[(h * 0x9E3779B97F4A7C15) % 2**64 >> 49] += 1
    return out


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "Ab c  dé 12 ñ.Zz\n東京 x"
    want = language.counts(text)
    assert (want == naive(text)).all()
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language, "SLICE", size)
        assert (language.counts(text) == want).all()


def test_penalties_give_zeros_and_temperature_calibrates():
    z = np.array([0.5, -0.5, 2.0, -2.0])
    w = language.weights(z, np.ones(4), 1.0, 1.0, 0.0)
    assert (w[:2] == 0).all() and w[2] < 0 < w[3]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 3))
    y = np.array([rng.choice(3, p=p) for p in language.softmax(x)])
    assert 2.7 < language.temperature(x * 3, y) < 3.3
