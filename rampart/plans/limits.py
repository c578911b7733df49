"""Queries over rate limits and abuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import limits as L
from rampart.plans import inputs as I
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import query
from rampart.plans.usage import rounded


@query("token_bucket_replay")
def _bucket(spark, path):
    r = L.token_bucket_replay(I.requests(spark, path).select("request_id", "client", "us", "tokens"), rate=1, token_rate=60)
    return rounded(r.select("request_id", "client", "allowed", "wait_s"))


# with one client per request nothing is ever refused twice, which has a closed form
@query("token_bucket_single", with_ctes("requests", "SELECT request_id, tokens <= 60 AS allowed FROM requests"))
def _bucket_single(spark, path):
    r = I.requests(spark, path).select("request_id", F.col("request_id").alias("client"), "us", "tokens")
    return L.token_bucket_replay(r, rate=20, token_rate=60).select("request_id", "allowed")


@query("global_bucket_replay")
def _global(spark, path):
    return L.global_bucket_replay(I.requests(spark, path).select("us", "tokens"), rate=1, token_rate=100)


@query("sliding_window_counts", with_ctes("requests", """, p AS (SELECT client, us // 600000000 AS sub, count(*) AS n FROM requests GROUP BY ALL)
  SELECT client, sub::BIGINT AS sub, n, (sum(n) OVER w)::BIGINT AS in_window, sum(n) OVER w > 1 AS would_exceed FROM p WINDOW w AS (PARTITION BY client ORDER BY sub RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)"""))
def _counts(spark, path):
    return L.sliding_window_counts(I.requests(spark, path), sub_s=600, limit=1)


@query("sliding_window_replay")
def _replay(spark, path):
    return L.sliding_window_replay(I.requests(spark, path).select("request_id", "client", "us"), window_s=36000, limit=3)


@query("rate_metrics", with_ctes("requests", """SELECT count(*) AS total_requests, count(*) FILTER (tokens <= 60) AS accepted, count(*) FILTER (tokens > 60) AS rejected,
  round(count(*) FILTER (tokens <= 60) / count(*)::DOUBLE, 6) AS acceptance_rate, sum(tokens)::BIGINT AS total_tokens, count(DISTINCT client) AS active_clients,
  round(count(*) FILTER (tokens <= 60) / 90.0::DOUBLE / ((max(us) - min(us)) / 6e7), 6) AS current_load FROM requests"""))
def _metrics(spark, path):
    d = I.requests(spark, path).withColumn("allowed", F.col("tokens") <= 60)
    return rounded(L.rate_metrics(d))


@query("adaptive_rates", with_ctes("requests", """, l AS (SELECT us // 3600000000 AS interval, count(*) / 30.0::DOUBLE AS load FROM requests GROUP BY 1),
  a AS (SELECT interval, load, avg(load) OVER (ORDER BY interval ROWS 9 PRECEDING) AS avg_load FROM l)
  SELECT interval::BIGINT AS interval, round(load, 6) AS load, round(avg_load, 6) AS avg_load, round(CASE WHEN avg_load > 0.8 THEN greatest(0.5, 1 - (avg_load - 0.8)) WHEN avg_load < 0.3 THEN least(1.5, 1 + (0.3 - avg_load)) ELSE 1 END, 6) AS adjustment FROM a"""))
def _adaptive(spark, path):
    load = I.requests(spark, path).groupBy(F.floor(F.col("us") / 3_600_000_000).alias("interval")).agg((F.count("*") / 30.0).alias("load"))
    return rounded(L.adaptive_rates(load))


@query("flood_levels", with_ctes("requests", """, c AS (SELECT *, count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS in_rapid,
   count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS in_burst FROM requests)
  SELECT request_id, in_rapid, in_burst, CASE WHEN in_rapid > 4 THEN 'critical' WHEN in_burst > 1 THEN 'high' WHEN user_agent = '' OR contains(user_agent, 'python-requests') THEN 'medium' ELSE 'low' END AS level FROM c"""))
def _flood(spark, path):
    f = L.flood_levels(I.requests(spark, path), rapid=4, rapid_s=36000, burst=1, burst_s=7200)
    return f.select("request_id", "in_rapid", "in_burst", "level")


@query("suspicion_blocks")
def _suspicion(spark, path):
    f = L.flood_levels(I.requests(spark, path), rapid=4, rapid_s=36000, burst=1, burst_s=7200)
    return L.suspicion_blocks(f.select("request_id", "client", "us", "level"), short_s=20000, long_s=80000, memory_s=80000)


@query("breaker_replay")
def _breaker(spark, path):
    c = I.api_calls(spark, path).select("call_id", "provider", "us", "success")
    return L.breaker_replay(c, failures=2, recovery_s=1800, successes=2)


@query("breaker_summary")
def _breaker_summary(spark, path):
    c = I.api_calls(spark, path).select("call_id", "provider", "us", "success")
    return L.breaker_summary(L.breaker_replay(c, failures=2, recovery_s=1800, successes=2))


@query("endpoint_limits", with_ctes("requests", """SELECT request_id, CASE event_type WHEN 'view' THEN 60 WHEN 'error' THEN 10 END::INT AS base_rpm, CASE event_type WHEN 'view' THEN 1.2 WHEN 'error' THEN 1.3 END::DOUBLE AS burst,
   CASE event_type WHEN 'view' THEN 1.5 WHEN 'error' THEN 1.0 END::DOUBLE AS weight FROM requests"""))
def _endpoints(spark, path):
    renamed = F.when(F.col("event_type") == "view", "/api/v1/detect/x").when(F.col("event_type") == "error", "/api/v1/batch").otherwise(F.col("path"))
    r = I.requests(spark, path).withColumn("path", renamed)
    return L.endpoint_limits(r).select("request_id", "base_rpm", "burst", "weight")
