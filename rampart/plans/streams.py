"""Streaming queries, replayed over the stored tables.

A window is only in the result once the watermark (newest time less the delay) has passed
its end; the oracles apply the same rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators.usage import with_cost
from rampart.plans import inputs as I
from rampart.plans.experiments import guardrails
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import ORACLES, query
from rampart.plans.usage import rounded
from rampart.session import prepare
from rampart.sources import sinks as K
from rampart.streaming import streams as S


def event_stream(spark, path):
    e = S.table_stream(prepare(spark), path, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))


@query("stream_detect", ORACLES.get("analyze"))
def _detect(spark, path):
    c = S.table_stream(prepare(spark), path, "conversations")
    m = c.select("conv_id", "turn", "role", I._planted(F.col("conv_id") + F.col("turn"), F.col("text")).alias("text"))
    return S.replay(S.stream_detect(m), "detect").withColumn("confidence", F.round("confidence", 6))


@query("read_event_stream", "SELECT count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS bad FROM events")
def _read(spark, path):
    folder = K.work_folder(spark, "lines")
    e = I.events(spark, path).select("event_id", "event_type")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event'))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    e.select(line.alias("value")).write.text(folder)
    good, bad = S.read_event_stream(spark, folder, "event_id long, event_type string")
    g, b = S.replay(good, "good"), S.replay(bad, "bad")
    return g.agg(F.count("event_id").alias("good")).join(F.broadcast(b.agg(F.count("*").alias("bad"))))  # one row


def call_stream(spark, path):
    e = event_stream(spark, path)
    slot = (F.col("event_id") % 5 + 1).cast("int")
    calls = e.select(
        F.col("event_id").alias("call_id"), "ts", "us", F.element_at(F.array(*[F.lit(p) for p in I.PROVIDERS]), slot).alias("provider"),
        F.element_at(F.array(*[F.lit(p) for p in I.MODELS]), slot).alias("model"), F.floor(F.col("value") * 10).cast("long").alias("prompt_tokens"),
        (F.col("event_id") % 400).alias("completion_tokens"), (F.col("event_type") != "error").alias("success"),
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return with_cost(calls)


_CLOSED = "{end} <= (SELECT max(us) // 1000 * 1000 - {delay} FROM {t})"


@query("stream_usage", with_ctes("api_calls", f"""SELECT us // 3600000000 * 3600000000 AS window_us, provider, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens, round(sum(cost_usd), 6) AS cost FROM api_calls
  WHERE {_CLOSED.format(end='us // 3600000000 * 3600000000 + 3600000000', delay=600000000, t='api_calls')} GROUP BY ALL"""))
def _usage(spark, path):
    return rounded(S.replay(S.stream_usage(call_stream(spark, path)), "usage"))


@query("stream_thresholds", with_ctes("security_metrics", f""", s AS (SELECT (us // 1800000000 - k) * 1800000000 AS window_us, metric_type, name, us FROM security_metrics, (SELECT unnest([0, 1]) AS k))
  SELECT window_us, metric_type, name, count(*) AS n, CASE metric_type WHEN 'injection_attempts' THEN 'critical' ELSE 'high' END AS severity FROM s WHERE metric_type IN ('injection_attempts', 'authentication')
  AND {_CLOSED.format(end='window_us + 3600000000', delay=60000000, t='security_metrics')} GROUP BY ALL HAVING count(*) > 3"""))
def _thresholds(spark, path):
    e = event_stream(spark, path)
    kind = F.create_map(*[F.lit(x) for k, v in I.METRIC_OF.items() for x in (k, v[0])])
    name = F.create_map(*[F.lit(x) for k, v in I.METRIC_OF.items() for x in (k, v[1])])
    m = e.select("ts", kind[F.col("event_type")].alias("metric_type"), name[F.col("event_type")].alias("name"))
    t = spark.createDataFrame(
        [("injection_attempts", "injection_detected", 3, "critical"), ("authentication", "failed_authentications", 3, "high")],
        "metric_type string, name string, threshold int, severity string",
    )
    return S.replay(S.stream_thresholds(m, t, "1 hour", "30 minutes"), "thresholds")


@query("stream_alert_throttle", with_ctes("ev", """, a AS (SELECT event_type, us FROM ev WHERE value > 100), f AS (SELECT count(DISTINCT event_type) AS kinds FROM a)
  SELECT (SELECT count(*) FROM a) AS n, (SELECT kinds FROM f) AS kinds, true AS spaced"""))
def _throttle(spark, path):
    a = event_stream(spark, path).filter("value > 100").select("event_id", "event_type", "us")
    out = S.replay(S.stream_alert_throttle(a, ["event_type"], 7200), "throttle")
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("us")
    sent = out.filter("sent").withColumn("gap", F.col("us") - F.lag("us").over(w))
    spaced = sent.agg(F.bool_and(F.coalesce(F.col("gap") >= 7_200_000_000, F.lit(True))).alias("spaced"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")).join(F.broadcast(spaced))  # one row


@query("stream_dedupe", "SELECT count(DISTINCT text) AS n FROM documents")
def _dedupe(spark, path):
    d = S.table_stream(prepare(spark), path, "documents").select("doc_id", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"))
    return S.replay(S.stream_dedupe(d, ["text"], "30 days"), "dedupe").agg(F.count("*").alias("n"))


@query("stream_sessions", with_ctes("requests", """, g AS (SELECT client, us, CASE WHEN us - lag(us) OVER (PARTITION BY client ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS new FROM requests),
  s AS (SELECT client, us, sum(new) OVER (PARTITION BY client ORDER BY us) AS sid FROM g), t AS (SELECT client, count(*) AS messages, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY client, sid)
  SELECT client, messages, first_us, last_us, round((last_us - first_us) / 1e6, 6) AS duration_s FROM t WHERE last_us + 21600000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM requests)"""))
def _sessions(spark, path):
    r = event_stream(spark, path).select(F.col("user_id").alias("client"), "ts", "us")
    return rounded(S.replay(S.stream_sessions(r, gap="6 hours"), "sessions"))


@query("stream_token_bucket")
def _bucket(spark, path):
    r = event_stream(spark, path).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "us")
    return S.replay(S.stream_token_bucket(r, 1), "bucket")


@query("stream_breaker")
def _breaker(spark, path):
    c = call_stream(spark, path).select("call_id", "provider", "us", "success")
    return S.replay(S.stream_breaker(c, 2, 1800, 2), "breaker")


@query("stream_guardrails", with_ctes("experiment_metrics", f""", w AS (SELECT metric_name, us // 3600000000 * 3600000000 AS window_us, avg(value) AS value FROM experiment_metrics WHERE {_CLOSED.format(end='us // 3600000000 * 3600000000 + 3600000000', delay=60000000, t='experiment_metrics')} GROUP BY ALL)
  SELECT window_us, metric_name, round(value, 6) AS value FROM w WHERE (metric_name = 'error' AND value > 60) OR (metric_name = 'click' AND value > 100) OR (metric_name = 'view' AND value < 25)"""))
def _guardrails(spark, path):
    m = event_stream(spark, path).select(F.lit("exp1").alias("experiment_id"), F.col("event_type").alias("metric_name"), "value", "ts")
    out = S.replay(S.stream_guardrails(m, guardrails(spark), "1 hour", "1 hour"), "guardrails")
    return rounded(out.select("window_us", "metric_name", "value"))


@query("stream_rule_feedback", "SELECT user_id, epoch_us(ts) AS us, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def _feedback(spark, path):
    base = K.work_folder(spark, "feedback")
    e = event_stream(spark, path).select("user_id", "us", "event_type")
    S.replay(e, "feedback", batch=S.feedback_writer(spark, base, ["user_id"], "us"))
    return S.newest_version(spark, base)


@query("late_data", "SELECT count(*) FILTER (epoch_us(ts) >= m - 86400000000) AS on_time, count(*) FILTER (epoch_us(ts) < m - 86400000000) AS late FROM events, (SELECT max(epoch_us(ts)) AS m FROM events)")
def _late(spark, path):
    base = K.work_folder(spark, "late")
    S.replay(event_stream(spark, path).select("event_id", "us"), "late", batch=S.late_writer(f"{base}/ok", f"{base}/late", 86_400_000_000))
    ok = spark.read.parquet(f"{base}/ok").agg(F.count("*").alias("on_time"))
    return ok.join(F.broadcast(spark.read.parquet(f"{base}/late").agg(F.count("*").alias("late"))))  # one row


@query("windowed_stream", with_ctes("ev", f"""SELECT us // 3600000000 * 3600000000 AS window_us, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM ev
  WHERE {_CLOSED.format(end='us // 3600000000 * 3600000000 + 3600000000', delay=600000000, t='ev')} GROUP BY ALL"""))
def _windowed(spark, path):
    return rounded(S.replay(S.stream_window_counts(event_stream(spark, path), "1 hour", None, ["event_type"], "value"), "windowed"))
