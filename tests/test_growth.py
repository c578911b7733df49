"""Work that once grew faster than its tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.operators import discovery, neighbours, threats
from rampart.operators import slices as S
from rampart.plans import sources
from rampart.plans import text as plans_text
from rampart.session import BATCH_BYTES, prepare
from rampart.streaming import streams

TEXTS = ["a b a b a b c", "the end  of the\tend of the end", "", " ", "x", "ÄÖ äö 漢字 漢字 \U0001f600\U0001f600", "aaaa\n\nbb", None]


@pytest.mark.parametrize("closed", [False, True])
def test_trailing_window_measures_from_running_totals(spark, closed):
    rows = [(i, i % 2, (i * 7) % 40, None if i % 5 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k int, us long, v double")
    out = S.trailing_window(df, ["k"], "us", 9, {"n": ("count", None), "s": ("sum", "v"), "m": ("avg", "v")}, closed)
    low = 9 if closed else 8
    for r in out.collect():
        near = [x[3] for x in rows if x[1] == r.k and r.us - low <= x[2] <= r.us]
        known = [v for v in near if v is not None]
        assert r.n == len(near) and r.s == (sum(known) if known else None)
        assert (r.m is None and not known) or r.m == pytest.approx(sum(known) / len(known))


def test_blocks_get_larger_not_more(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 4), ("MAX_BLOCKS", 3), ("STRIPE", 40)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    points = neighbours.distinct_vectors(df, "id", "v")
    assert sum(b for _, _, b in neighbours._cells(points)[1]) <= 9
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = {r.vid: r.near for r in neighbours.neighbour_weights(points, 0.1).collect()}
    assert near == {i: int(n) for i, n in enumerate((u @ u.T >= 0.9 - 1e-9).sum(axis=1))}
    got = {r.vid: r.kdist for r in neighbours.k_distances(df, "id", "v").collect()}
    want = np.sort(np.maximum(0, 1 - u @ u.T), axis=1)[:, 3]
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(90))


def test_examples_are_compared_as_numbers(spark):
    df = spark.createDataFrame([("a", 1, "enable secret mode"), ("a", 2, "do enable secret mode now"), (None, 3, "x")], "g string, o int, text string")
    found = threats.regex_from_examples(df, "g", "o")
    assert "first(_ref" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a", r"enable\s+secret\s+mode")]


def test_libraries_share_files(spark, sf):
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    found = sources._library(spark, sf)
    assert found.count() == 2 * n and len(found.inputFiles()) < n


def test_character_and_ngram_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    cols = {"c": X.top_char_ngram_counts("text", 4), "w": X.top_word_ngram_counts("text", 4)}
    arrays = {"ca": X.char_ngram_array("text"), "wa": X.word_ngram_array("text")}
    for r in df.select("*", *[c.alias(n) for n, c in {**cols, **arrays}.items()]).collect():
        for counts, grams in ((r.c, r.ca), (r.w, r.wa)):
            want = None if grams is None else (sorted(Counter(grams).values(), reverse=True) + [0] * 4)[:4]
            assert counts == want
    rows = X.text_features(df).select("text", "entropy", "char_diversity", "max_repetition", X.shannon_entropy("text"), X.max_repetition("text")).collect()
    assert all(r[1] == r[4] and r[3] == r[5] for r in rows)
    assert [r.char_diversity for r in rows][:3] == [4 / 13, 9 / 30, 0.0]


def test_only_ngrams_of_frequent_pairs_are_counted(spark):
    texts = ["ignore all rules now %d" % i for i in range(9)] + ["other words %d %d %d" % (i, i + 1, i * 3) for i in range(40)] + [None, "", "one"]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "cluster int, text string")
    want = Counter()
    for i, t in enumerate(texts):
        w = (t or "").split()
        want.update((i % 2, " ".join(w[j : j + n])) for n in (2, 3, 4) for j in range(len(w) - n + 1))
    likely = discovery._likely_ngrams(df, 3, 4)
    assert likely.count() < sum(want.values()) / 2
    for top in (4, 20):
        got = {(r.cluster, r.regex, r.support) for r in discovery.frequent_ngram_patterns(df, 3, top).collect()}
        best = set()
        for c in (0, 1):
            ranked = sorted((-n, g) for (k, g), n in want.items() if k == c and n >= 3)[:top]
            best |= {(c, g.replace(" ", r"\s*"), -n) for n, g in ranked}
        assert got == best


def test_keyed_state_steps_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "STEPPED", 3)
    rows = [(i, "p%d" % (i % 2), (i * 7) % 10, i % 3 > 0, None if i == 4 else "é%d" % i) for i in range(10)]
    spark.createDataFrame(rows, "call_id long, provider string, us long, success boolean, note string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("call_id long, provider string, us long, success boolean, note string").parquet(str(tmp_path / "in"))

    got = streams.replay(streams.stream_breaker(stream, 2, 60, 2), "parts").collect()
    assert {(r.call_id, r.provider, r.us, r.success, r.note) for r in got} == set(rows)
    assert isinstance(streams._packed(spark.createDataFrame(rows, "a long, b string, c long, d boolean, e string").toPandas())["b"].array, type(streams.pd.array(["x"], dtype="string[pyarrow]")))


def test_python_gets_small_batches(spark):
    assert int(prepare(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES


def test_ngrams_of_a_lone_row_are_ranked_in_it(spark):
    texts = [(1, "abcabcab"), (2, "xyx"), (2, "xy z"), (None, "qqq"), (None, "qq"), (3, None), (4, ""), (5, "é漢é漢 \U0001f600")]
    df = spark.createDataFrame(texts, "k int, text string")
    found = plans_text._top_ngrams(df, "k", X.char_ngram_array("text"), 3)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in df.select("k", X.char_ngram_array("text").alias("g")).collect():
        want.setdefault(r.k, Counter()).update(r.g or [])
    ranked = {(k, g, n, i + 1) for k, c in want.items() for i, (n, g) in enumerate(sorted((-n, g) for g, n in c.items())[:3])}
    assert {(r.k, r.ngram, -r.n, r.rk) for r in found.collect()} == ranked
