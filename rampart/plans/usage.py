"""Queries over usage, cost and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import usage as U
from rampart.plans import inputs as I
from rampart.plans.inputs import NOW, with_ctes
from rampart.plans.registry import query

LIMITS = {"hour": 0.05, "day": 0.8, "month": 20.0}


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def text_time(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("token_cost", with_ctes("api_calls", "SELECT call_id, provider, model, cost_usd FROM api_calls"))
def _cost(spark, path):
    return I.api_calls(spark, path).select("call_id", "provider", "model", "cost_usd")


_SUMMARY = """count(*) AS total_requests, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, sum(total_tokens)::BIGINT AS total_tokens,
   round(sum(cost_usd), 6) AS total_cost, round(avg(latency_ms), 6) AS avg_latency_ms, count(*) FILTER (provider = 'cache') AS cache_hits,
   round(count(*) FILTER (provider = 'cache') / count(*)::DOUBLE, 6) AS cache_hit_rate, round(count(*) / ((max(us) - min(us)) / 6e7), 6) AS requests_per_minute,
   round(sum(total_tokens) / ((max(us) - min(us)) / 6e7), 6) AS tokens_per_minute, round(sum(cost_usd) / ((max(us) - min(us)) / 3.6e9), 6) AS cost_per_hour"""


@query("usage_summary", with_ctes("api_calls", f"SELECT {_SUMMARY} FROM api_calls"))
def _summary(spark, path):
    return rounded(U.usage_summary(I.api_calls(spark, path)))


@query("usage_summary_window", with_ctes("api_calls", f"SELECT {_SUMMARY} FROM api_calls WHERE ts > TIMESTAMP '2024-01-24 00:00:00'"))
def _summary_window(spark, path):
    return rounded(U.usage_summary(I.api_calls(spark, path), "2024-01-24 00:00:00"))


@query("provider_breakdown", with_ctes("api_calls", """SELECT provider, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens, round(sum(cost_usd), 6) AS cost, round(avg(latency_ms), 6) AS avg_latency_ms,
   round(avg(success::INT), 6) AS success_rate FROM api_calls WHERE provider <> 'cache' GROUP BY provider"""))
def _providers(spark, path):
    return rounded(U.provider_breakdown(I.api_calls(spark, path)))


@query("cost_breakdown", with_ctes("api_calls", "SELECT provider, model, round(sum(cost_usd), 6) AS cost, count(*) AS n FROM api_calls GROUP BY ROLLUP (provider, model)"))
def _breakdown(spark, path):
    return rounded(U.cost_breakdown(I.api_calls(spark, path)))


def _trend(period, limit):
    def run(spark, path):
        return text_time(rounded(U.usage_trend(I.api_calls(spark, path), period, limit)), "bucket")

    return run


for _period, _limit in (("hour", 24), ("day", None), ("minute", 100)):
    query(f"usage_trend_{_period}", with_ctes("api_calls", f"""SELECT strftime(date_trunc('{_period}', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens, round(sum(cost_usd), 6) AS cost,
      round(avg(latency_ms), 6) AS avg_latency_ms FROM api_calls GROUP BY 1 ORDER BY 1 DESC {f'LIMIT {_limit}' if _limit else ''}"""))(_trend(_period, _limit))


_PERIOD = ", ".join(
    f"round(sum(cost_usd) OVER (PARTITION BY date_trunc('{p}', ts) ORDER BY us, call_id ROWS UNBOUNDED PRECEDING), 6) AS {p}_cost, "
    f"count(*) OVER (PARTITION BY date_trunc('{p}', ts) ORDER BY us, call_id ROWS UNBOUNDED PRECEDING) AS {p}_requests" for p in ("minute", "hour", "day", "month"))


@query("period_cost", with_ctes("api_calls", f"SELECT call_id, {_PERIOD} FROM api_calls"))
def _period_cost(spark, path):
    p = U.period_cost(I.api_calls(spark, path))
    return rounded(p.select("call_id", *[f"{x}_{w}" for x in ("minute", "hour", "day", "month") for w in ("cost", "requests")]))


@query("daily_usage", with_ctes("api_calls", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens, round(sum(cost_usd), 6) AS cost FROM api_calls GROUP BY 1"))
def _daily(spark, path):
    return rounded(U.daily_usage(I.api_calls(spark, path)).withColumn("day", F.col("day").cast("string")))


@query("high_cost_calls", with_ctes("api_calls", "SELECT call_id, provider, cost_usd FROM api_calls WHERE cost_usd > 0.03"))
def _high(spark, path):
    return U.high_cost_calls(I.api_calls(spark, path), 0.03).select("call_id", "provider", "cost_usd")


@query("drop_old", with_ctes("api_calls", f"SELECT call_id FROM api_calls WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 168 HOUR"))
def _old(spark, path):
    return U.drop_old(I.api_calls(spark, path), NOW).select("call_id")


_ALERTS = f""", c AS (SELECT call_id, us, {', '.join(f"sum(cost_usd) OVER (PARTITION BY date_trunc('{p}', ts) ORDER BY us, call_id ROWS UNBOUNDED PRECEDING) AS {p}_cost" for p in LIMITS)} FROM api_calls),
  l AS ({' UNION ALL '.join(f"SELECT call_id, us, '{p}' AS period, {p}_cost AS cur, {v}::DOUBLE AS lim FROM c" for p, v in LIMITS.items())}),
  al AS (SELECT call_id, us, period, CASE WHEN cur / lim >= 1 THEN 'exceeded' WHEN cur / lim >= 0.9 THEN 'critical' WHEN cur / lim >= 0.75 THEN 'warning' END AS level, cur / lim * 100 AS percentage FROM l)"""


def _costs(spark, path):
    return U.period_cost(I.api_calls(spark, path)).select("call_id", "us", "hour_cost", "day_cost", "month_cost")


@query("budget_alerts", with_ctes("api_calls", _ALERTS + " SELECT period, level, count(*) AS n, round(max(percentage), 6) AS worst FROM al WHERE level IS NOT NULL GROUP BY ALL"))
def _alerts(spark, path):
    a = U.budget_alerts(_costs(spark, path), LIMITS)
    return a.groupBy("period", "level").agg(F.count("*").alias("n"), F.round(F.max("percentage"), 6).alias("worst"))


_AT = "2024-01-20 15:30:00"


@query("budget_status", with_ctes("api_calls", f""", g AS (SELECT coalesce(sum(cost_usd) FILTER (date_trunc('hour', ts) = TIMESTAMP '2024-01-20 15:00:00'), 0) AS hour_cost,
   coalesce(sum(cost_usd) FILTER (date_trunc('day', ts) = TIMESTAMP '2024-01-20'), 0) AS day_cost, coalesce(sum(cost_usd), 0) AS month_cost FROM api_calls WHERE ts <= TIMESTAMP '{_AT}' AND date_trunc('month', ts) = TIMESTAMP '2024-01-01')
  SELECT round(hour_cost, 6) AS hour_cost, round(day_cost, 6) AS day_cost, round(month_cost, 6) AS month_cost, round(0.05 - hour_cost, 6) AS hour_remaining, round(0.8 - day_cost, 6) AS day_remaining,
   round(20 - month_cost, 6) AS month_remaining, round(day_cost + hour_cost * 9, 6) AS projected_day, round(month_cost + day_cost * 10, 6) AS projected_month,
   hour_cost < 0.05 AND day_cost < 0.8 AND month_cost < 20 AS within_budget FROM g"""))
def _status(spark, path):
    return rounded(U.budget_status(I.api_calls(spark, path), LIMITS, _AT))


def throttle_sql(alerts: str, key: str, first: str, window_s: int) -> str:
    """CTE `throttled`: `alerts` with `sent`; from one alert that goes out to the next of its key."""
    on = " AND ".join(f"a.{k.strip()} = g.{k.strip()}" for k in key.split(","))
    own = ", ".join(f"a.{k.strip()}" for k in key.split(","))
    return f""", out AS (WITH RECURSIVE g AS (SELECT {key}, min(us) AS us FROM {alerts} GROUP BY ALL
      UNION ALL SELECT {own}, min(a.us) AS us FROM g JOIN {alerts} a ON {on} AND a.us >= g.us + {window_s * 1_000_000} GROUP BY {own}) SELECT * FROM g),
   throttled AS (SELECT a.*, o.us IS NOT NULL AND row_number() OVER (PARTITION BY {own}, a.us ORDER BY {first}) = 1 AS sent FROM {alerts} a LEFT JOIN out o ON {on.replace('g.', 'o.')} AND a.us = o.us)"""


@query("alert_throttle", with_ctes("api_calls", _ALERTS + ", raised AS (SELECT call_id, us, period, level FROM al WHERE level IS NOT NULL)" + throttle_sql("raised", "period, level", "call_id", 3600) + " SELECT call_id, us, period, level, sent FROM throttled"))
def _throttle(spark, path):
    a = U.budget_alerts(_costs(spark, path), LIMITS)
    return U.alert_throttle(a.select("call_id", "us", "period", "level"), ["period", "level"])


@query("should_block", with_ctes("api_calls", _ALERTS.split(",\n  al AS")[0] + " SELECT period, arg_min(call_id, us) AS first_call FROM l WHERE cur > lim GROUP BY period"))
def _block(spark, path):
    return U.should_block(U.period_cost(I.api_calls(spark, path)), LIMITS)


@query("cost_suggestions", with_ctes("api_calls", """, t AS (SELECT count(*) AS n, count(*) FILTER (success) AS ok, sum(total_tokens) AS tokens, sum(cost_usd) AS cost, count(*) FILTER (provider = 'cache') AS hits FROM api_calls),
  u AS (SELECT 'low cache hit rate' AS finding, NULL AS provider, hits / n::DOUBLE AS value FROM t WHERE hits / n::DOUBLE < 0.3
   UNION ALL SELECT 'high failure rate', NULL, n - ok FROM t WHERE n - ok > ok * 0.1 UNION ALL SELECT 'high token usage', NULL, tokens / n FROM t WHERE tokens / n > 1000
   UNION ALL SELECT 'dominant provider', p.provider, p.c / t.cost FROM (SELECT provider, sum(cost_usd) AS c FROM api_calls WHERE provider <> 'cache' GROUP BY provider) p, t WHERE p.c > t.cost * 0.5)
  SELECT finding, provider, round(value, 6) AS value FROM u"""))
def _suggestions(spark, path):
    return rounded(U.cost_suggestions(I.api_calls(spark, path)))


@query("cache_report", with_ctes("ev", """, c AS (SELECT CASE event_id % 3 WHEN 0 THEN 'detection' WHEN 1 THEN 'llm' ELSE 'pii' END AS cache_type, CASE WHEN user_id % 2 = 0 THEN 'memory' ELSE 'shared' END AS tier, event_type AS prefix, value > 50 AS hit FROM ev)
  SELECT cache_type, tier, prefix, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS hit_rate FROM c
  GROUP BY GROUPING SETS ((cache_type), (tier), (prefix), ())"""))
def _cache(spark, path):
    e = I.events(spark, path).select(
        F.expr("CASE event_id % 3 WHEN 0 THEN 'detection' WHEN 1 THEN 'llm' ELSE 'pii' END").alias("cache_type"),
        F.when(F.col("user_id") % 2 == 0, "memory").otherwise("shared").alias("tier"), F.col("event_type").alias("prefix"), (F.col("value") > 50).alias("hit"),
    )
    return rounded(U.cache_report(e).drop("gid"))


@query("dated_prices", with_ctes("api_calls", """, pr AS (SELECT p_brand, p_size, (DATE '2024-01-01' + CAST(p_size % 28 AS INT))::TIMESTAMP AS valid_from, max(p_retailprice) / 1e6 AS price FROM part GROUP BY ALL),
   one AS (SELECT valid_from, max(price) AS price FROM pr GROUP BY valid_from)
   SELECT call_id, round(price, 6) AS price FROM api_calls ASOF JOIN one ON ts >= valid_from"""))
def _dated(spark, path):
    """Price in force at the time of the call: the as-of join as an equi-join on the day."""
    from pyspark.sql import Window

    p = I.table(spark, path, "part").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") % 28).cast("int")).alias("d"), (F.col("p_retailprice") / 1e6).alias("price")
    )
    prices = p.groupBy("d").agg(F.max("price").alias("price"))
    # one row per day of the calls' span, with the last price set on or before it
    span = I.api_calls(spark, path).groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    days = span.select("d").join(prices, "d", "full")
    filled = days.withColumn("price", F.last("price", ignorenulls=True).over(Window.partitionBy().orderBy("d")))
    calls = I.api_calls(spark, path).withColumn("d", F.to_date("ts"))
    return calls.join(filled.filter(F.col("price").isNotNull()), "d").select("call_id", F.round("price", 6).alias("price"))
