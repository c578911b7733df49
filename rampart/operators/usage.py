"""Usage, cost and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.operators.slices import ordered_fold, split_by_gaps

# fixed values: USD per 1000 tokens (input, output)
PRICES = [
    ("anthropic", "claude-3-haiku-20240307", 0.00025, 0.00125),
    ("anthropic", "claude-3-sonnet-20240229", 0.003, 0.015),
    ("anthropic", "claude-3-opus-20240229", 0.015, 0.075),
    ("openai", "gpt-4-turbo-preview", 0.01, 0.03),
    ("openai", "gpt-4", 0.03, 0.06),
    ("openai", "gpt-3.5-turbo", 0.0005, 0.0015),
    ("gemini", "gemini-1.5-flash", 0.00035, 0.0021),
    ("gemini", "gemini-1.5-pro", 0.007, 0.021),
    ("gemini", "gemini-pro", 0.0005, 0.0015),
]
DEFAULT_PRICE = (0.001, 0.002)
FREE = ["heuristic", "cache"]


def with_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds cost_usd, rounded per call (halves up).  The built-in prices are nine literals, so no join."""
    if prices is None:
        key = F.concat_ws("/", "provider", "model")
        table_in = F.create_map(*[F.lit(x) for p, m, i, _ in PRICES for x in (f"{p}/{m}", i)])
        table_out = F.create_map(*[F.lit(x) for p, m, _, o in PRICES for x in (f"{p}/{m}", o)])
        priced = calls.withColumns({"_in": F.try_element_at(table_in, key), "_out": F.try_element_at(table_out, key)})
    else:
        p = prices.select("provider", "model", F.col("input").alias("_in"), F.col("output").alias("_out"))
        priced = calls.join(p, ["provider", "model"], "left")
    cost = (
        F.col("prompt_tokens") / 1000.0 * F.coalesce("_in", F.lit(DEFAULT_PRICE[0]))
        + F.col("completion_tokens") / 1000.0 * F.coalesce("_out", F.lit(DEFAULT_PRICE[1]))
    )
    return priced.withColumn(
        "cost_usd", F.when(F.col("provider").isin(FREE), F.lit(0.0)).otherwise(F.round(cost + 1e-10, 6))
    ).drop("_in", "_out")


# --- usage -----------------------------------------------------------------------------------
def usage_summary(calls: DataFrame, since: str | None = None) -> DataFrame:
    """One row: totals, rates and the cache share; rates over the observed span."""
    c = calls.filter(F.col("ts") > F.to_timestamp(F.lit(since))) if since else calls
    span = (F.max("us") - F.min("us")) / 1e6
    total = F.count("*")
    return c.agg(
        total.alias("total_requests"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("total_cost"), F.avg("latency_ms").alias("avg_latency_ms"),
        F.count_if(F.col("provider") == "cache").alias("cache_hits"),
        F.try_divide(F.count_if(F.col("provider") == "cache"), total).alias("cache_hit_rate"),
        F.try_divide(total, span / 60).alias("requests_per_minute"),
        F.try_divide(F.sum("total_tokens"), span / 60).alias("tokens_per_minute"),
        F.try_divide(F.sum("cost_usd"), span / 3600).alias("cost_per_hour"),
    )


def provider_breakdown(calls: DataFrame) -> DataFrame:
    return calls.filter(F.col("provider") != "cache").groupBy("provider").agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.avg(F.col("success").cast("double")).alias("success_rate"),
    )


def cost_breakdown(calls: DataFrame) -> DataFrame:
    """Cost by provider, by provider and model, and in all, in one pass."""
    return calls.rollup("provider", "model").agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("n"))


def usage_trend(calls: DataFrame, period: str = "hour", limit: int | None = 24) -> DataFrame:
    """Buckets with traffic; the newest `limit` of them, oldest first."""
    g = calls.groupBy(F.date_trunc(period, "ts").alias("bucket")).agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
    return g.orderBy(F.desc("bucket")).limit(limit).orderBy("bucket") if limit else g


def period_cost(calls: DataFrame, id_col: str = "call_id") -> DataFrame:
    """Adds cost and requests so far in the call's minute, hour, day and month.

    A month of traffic is never one sorted group: rows are sorted within their minute, and
    the minutes before it are added from a table with one row per minute.
    """
    rows = calls.withColumn("_minute", F.date_trunc("minute", "ts"))
    per_minute = rows.groupBy("_minute").agg(F.sum("cost_usd").alias("_c"), F.count("*").alias("_n"))
    before = {}
    for p in ("hour", "day", "month"):
        w = Window.partitionBy(F.date_trunc(p, "_minute")).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
        before[f"_c_{p}"] = F.coalesce(F.sum("_c").over(w), F.lit(0.0))
        before[f"_n_{p}"] = F.coalesce(F.sum("_n").over(w), F.lit(0))
    offsets = per_minute.withColumns(before).drop("_c", "_n")
    inside = Window.partitionBy("_minute").orderBy("us", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(offsets, "_minute").withColumns({
        "minute_cost": F.sum("cost_usd").over(inside), "minute_requests": F.count("*").over(inside),
    })
    return joined.withColumns({
        f"{p}_{what}": F.col(f"_{col}_{p}") + F.col(f"minute_{what}")
        for p in ("hour", "day", "month") for what, col in (("cost", "c"), ("requests", "n"))
    }).drop("_minute", *before)


def daily_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost")
    )


def high_cost_calls(calls: DataFrame, above: float = 0.10) -> DataFrame:
    return calls.filter(F.col("cost_usd") > above)


def drop_old(calls: DataFrame, now: str, hours: int = 168) -> DataFrame:
    return calls.filter(F.col("ts") > F.to_timestamp(F.lit(now)) - F.make_interval(hours=F.lit(hours)))


# --- budgets -----------------------------------------------------------------------------------
def alert_level(share, warning: float = 0.75, critical: float = 0.9):
    return F.when(share >= 1.0, "exceeded").when(share >= critical, "critical").when(share >= warning, "warning")


def budget_alerts(costs: DataFrame, limits: dict[str, float], estimate: float = 0.0) -> DataFrame:
    """Alerts for rows with hour_cost, day_cost and month_cost: one row per period that warns."""
    ids = [c for c in costs.columns if c not in ("hour_cost", "day_cost", "month_cost")]
    entries = F.array(*[
        F.struct(F.lit(p).alias("period"), F.col(f"{p}_cost").alias("current"), F.lit(float(v)).alias("limit"))
        for p, v in limits.items()
    ])
    long = costs.select(*ids, F.explode(entries).alias("e")).select(*ids, "e.*")
    share = (F.col("current") + estimate) / F.col("limit")
    return long.withColumn("level", alert_level(share)).withColumn("percentage", share * 100).filter(F.col("level").isNotNull())


def budget_status(calls: DataFrame, limits: dict[str, float], now: str) -> DataFrame:
    """Cost in the current hour, day and month of `now`, what is left, and projections."""
    at = F.to_timestamp(F.lit(now))
    upto = calls.filter(F.col("ts") <= at)
    month = upto.filter(F.date_trunc("month", "ts") == F.date_trunc("month", at))
    same = lambda p: F.date_trunc(p, F.col("ts")) == F.date_trunc(p, at)
    g = month.agg(
        F.coalesce(F.sum(F.when(same("hour"), F.col("cost_usd"))), F.lit(0.0)).alias("hour_cost"),
        F.coalesce(F.sum(F.when(same("day"), F.col("cost_usd"))), F.lit(0.0)).alias("day_cost"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("month_cost"),
    )
    levels = [alert_level(F.col(f"{p}_cost") / v) for p, v in limits.items()]
    exceeded = F.exists(F.array(*levels), lambda x: F.coalesce(x == "exceeded", F.lit(False)))
    return g.select(
        "*", *[(F.lit(v) - F.col(f"{p}_cost")).alias(f"{p}_remaining") for p, v in limits.items()],
        (F.col("day_cost") + F.col("hour_cost") * (24 - F.hour(at))).alias("projected_day"),
        (F.col("month_cost") + F.col("day_cost") * (30 - F.dayofmonth(at))).alias("projected_month"),
        (~exceeded).alias("within_budget"),
    )


def alert_throttle(alerts: DataFrame, keys: list[str], window_s: int = 3600) -> DataFrame:
    """Adds `sent`: an alert goes out unless one of its key did less than `window_s` ago.

    After a quiet gap of the window the first alert always goes out, so the key's stretches
    between such gaps are folded independently of each other.
    """
    gap = window_s * 1_000_000
    parts = split_by_gaps(alerts, keys, "us", gap)

    def step(state: list, row: tuple) -> tuple:
        send = state[0] is None or row[0] - state[0] >= gap
        if send:
            state[0] = row[0]
        return (send,)

    rest = [c for c in alerts.columns if c not in keys and c != "us"]  # ties go by the other columns
    return ordered_fold(parts, [*keys, "island"], ["us", *rest], ["us"], lambda: [None], step, "sent boolean").drop("island")


def should_block(costed: DataFrame, limits: dict[str, float], id_col: str = "call_id") -> DataFrame:
    """First call that goes over a limit, per limit, from `period_cost` rows."""
    over = [
        costed.filter(F.col(f"{p}_cost") > v).agg(F.min_by(id_col, F.struct("us", id_col)).alias("first_call")).select(
            F.lit(p).alias("period"), "first_call"
        )
        for p, v in limits.items()
    ]
    out = over[0]
    for o in over[1:]:
        out = out.unionByName(o)
    return out.filter(F.col("first_call").isNotNull())


def cost_suggestions(calls: DataFrame) -> DataFrame:
    """Findings on cache use, dominant providers, failures and prompt size."""
    s = calls.groupBy("provider").agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost")
    )
    total = s.agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
        F.sum(F.when(F.col("provider") == "cache", F.col("n")).otherwise(0)).alias("hits"),
    )
    finding = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("finding"), value.cast("double").alias("value")))
    c = F.col
    general = total.select(F.explode(F.array_compact(F.array(
        finding(c("hits") / c("n") < 0.3, "low cache hit rate", c("hits") / c("n")),
        finding(c("n") - c("ok") > c("ok") * 0.1, "high failure rate", c("n") - c("ok")),
        finding(c("tokens") / c("n") > 1000, "high token usage", c("tokens") / c("n")),
    ))).alias("f")).select("f.finding", F.lit(None).cast("string").alias("provider"), "f.value")
    costs = s.filter(c("provider") != "cache").join(F.broadcast(total.select(c("cost").alias("all_cost"))))  # one row
    dominant = costs.filter(c("cost") > c("all_cost") * 0.5).select(
        F.lit("dominant provider").alias("finding"), "provider", (c("cost") / c("all_cost")).alias("value")
    )
    return general.unionByName(dominant)


def cache_report(events: DataFrame) -> DataFrame:
    """Hits and misses by cache type, tier and key prefix, and in all; one pass."""
    g = events.groupingSets([[F.col("cache_type")], [F.col("tier")], [F.col("prefix")], []], "cache_type", "tier", "prefix").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.grouping_id().alias("gid")
    )
    return g.withColumn("misses", F.col("n") - F.col("hits")).withColumn("hit_rate", F.col("hits") / F.col("n"))
