"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from rampart.operators import limits as L
from rampart.plans import inputs as I
from rampart.plans import streams as P
from rampart.streaming import streams as S


def test_breaker_stream_equals_batch(spark, sf):
    got = {r.call_id: (r.met, r.state) for r in P._breaker(spark, sf).collect()}
    calls = I.api_calls(spark, sf).select("call_id", "provider", "us", "success")
    want = {r.call_id: (r.met, r.state) for r in L.breaker_replay(calls, failures=2, recovery_s=1800, successes=2).collect()}
    assert got == want


def test_token_bucket_stream_equals_batch(spark, sf):
    got = {r.request_id: r.allowed for r in P._bucket(spark, sf).collect()}
    reqs = I.requests(spark, sf).select("request_id", "client", "us").withColumn("tokens", F.lit(0).cast("long"))
    want = {r.request_id: r.allowed for r in L.token_bucket_replay(reqs, rate=1, token_rate=10**6).collect()}
    assert got == want


def test_files_in_two_batches_keep_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, times in enumerate([[0, 10], [20, 4000]]):
        rows = [(100 * i + j, "a", t * 1_000_000) for j, t in enumerate(times)]
        spark.createDataFrame(rows, "id long, k string, us long").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id long, k string, us long").option("maxFilesPerTrigger", 1).parquet(folder)
    out = S.replay(S.stream_alert_throttle(stream, ["k"]), "two")
    assert sorted(r.us // 1_000_000 for r in out.filter("sent").collect()) == [0, 4000]
