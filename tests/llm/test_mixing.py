from collections import defaultdict

import brute
import pytest

from rampart.llm import mixing
from pyspark.sql import functions as F


def test_margins_are_met(spark, sample):
    cells = mixing.mix(sample).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("_t"))
    out = mixing.rake(cells, 30, 0.5, {"lang": {"en": 0.4}}).collect()
    total = sum(r["_t"] for r in out)
    for margin in mixing.MARGINS:
        own, raked = defaultdict(float), defaultdict(float)
        for r in out:
            own[r[margin]] += r["_t"] / total
            raked[r[margin]] += r["_w"]
        want = {k: v**0.5 for k, v in own.items() if v}
        if margin == "lang":
            rest = sum(v for k, v in want.items() if k != "en")
            want = {k: 0.4 if k == "en" else v / rest * 0.6 for k, v in want.items()}
        norm = sum(want.values())
        for k, v in want.items():
            assert raked[k] == pytest.approx(v / norm, rel=0.02)


def test_expected_tokens_are_the_share(spark, sample):
    for share in (0.2, 0.8, 1.0):
        rows = mixing.mix(sample, share=share).collect()
        total = sum(r.tokens for r in rows)
        assert sum(r.tokens * r.probability for r in rows) == pytest.approx(share * total, rel=0.02)
        assert all(0 <= r.probability <= 1 for r in rows)
    taken = mixing.sample(sample, share=0.8)
    assert sorted(r.doc_id for r in taken.collect()) == sorted(r.doc_id for r in mixing.mix(sample, share=0.8).collect() if r.chosen)


def test_awkward_rows(spark):
    df = brute.awkward(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(brute.AWKWARD) and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.sample(df, share=1.0).columns == df.columns
    assert mixing.mix(brute.empty(spark)).count() == 0 and mixing.sample(brute.empty(spark)).count() == 0
    blank = brute.awkward(spark).withColumn("text", F.lit(None).cast("string"))
    assert {r.probability for r in mixing.mix(blank, share=0.5).collect()} == {0.5}


def test_no_python_on_the_main_path(spark, sample):
    for df in (mixing.mix(sample), mixing.sample(sample)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_topics(spark):
    df = spark.createDataFrame([("a License", "legal"), ("x | y", "tabular"), ("me@home", "contact"), ("x|y", "prose"), ("", "prose")], "t string, w string")
    assert all(r.w == r.g for r in df.select("w", mixing.topic_of(F.col("t")).alias("g")).collect())


def test_capped_raking_meets_what_can_be_reached(spark):
    """Topic legal cannot reach its target at 0.8; sources and languages can, and cells not full make up for it."""
    tokens = {("a", "en", "prose"): 60000, ("a", "de", "prose"): 20000, ("b", "en", "prose"): 9000, ("b", "de", "prose"): 7000, ("a", "en", "legal"): 500, ("b", "de", "legal"): 3500}
    cells = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "source string, lang string, topic string, _t long")
    aims = {"source": {"a": 0.77, "b": 0.23}, "lang": {"en": 0.65, "de": 0.35}, "topic": {"legal": 0.1}}
    rows = {(r.margin, r["value"]): r for r in mixing.expected(cells, 0.8, targets=aims, rounds=30, capped=True).collect()}
    cut = {(r.margin, r["value"]): r for r in mixing.expected(cells, 0.8, targets=aims).collect()}
    for k in (("source", "a"), ("source", "b"), ("lang", "en"), ("lang", "de")):
        assert rows[k].sample == pytest.approx(rows[k].target, abs=1e-3)
    assert abs(cut["source", "a"].sample - cut["source", "a"].target) > 0.005
    assert rows["topic", "legal"].target == pytest.approx(0.1) and rows["topic", "legal"].sample == pytest.approx(0.05, abs=1e-3)  # 4 % / 0.8
    table = mixing.chance(cells, 0.8, 30, 0.7, aims, True).collect()
    assert sum(r.probability * tokens[r.source, r.lang, r.topic] for r in table) == pytest.approx(80000)
    assert all(0 <= r.probability <= 1 for r in table)
