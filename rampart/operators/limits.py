"""Rate limits and abuse, replayed over a request log.

Decisions depend on earlier decisions, so replays are ordered folds.  A pause long enough to
reset the state (a full refill, an expired window) makes what follows independent of what
came before; busy clients are cut at such pauses first and their stretches run in parallel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.operators.slices import ordered_fold, split_by_gaps, trailing_window

SECOND = 1_000_000

# fixed values: per-minute rates and burst
CLIENT_REQUESTS, CLIENT_TOKENS = 20, 5000
GLOBAL_REQUESTS, GLOBAL_TOKENS = 60, 10000
BURST = 1.5


class Bucket:
    """Tokens refilled over time, at most `rate * BURST`, first filled with `rate`."""

    def __init__(self, rate: float, full: bool):
        self.capacity, self.per_second = rate * BURST, rate / 60.0
        self.tokens, self.at = (self.capacity if full else float(rate)), None

    def refill(self, us: int) -> None:
        if self.at is not None and us > self.at:
            self.tokens = min(self.capacity, self.tokens + (us - self.at) / SECOND * self.per_second)
        self.at = us if self.at is None else max(self.at, us)

    def wait(self, n: float) -> float:
        return 0.0 if self.tokens >= n else (n - self.tokens) / self.per_second


def token_bucket_replay(
    requests: DataFrame, rate: int = CLIENT_REQUESTS, token_rate: int = CLIENT_TOKENS, client: str = "client"
) -> DataFrame:
    """Adds allowed and wait_s per request (client, us, request_id, tokens)."""
    refill_us = int(60 * BURST * SECOND)  # from empty to full
    parts = split_by_gaps(requests, [client], "us", refill_us)
    first = requests.groupBy(client).agg(F.min("us").alias("_first"))
    known = parts.join(first, client).withColumn("_full", F.col("island") != F.col("_first")).drop("_first")

    def step(state: list, row: tuple) -> tuple:
        us, tokens, full = row
        if not state:
            state += [Bucket(rate, full), Bucket(token_rate, full)]
        calls, size = state
        calls.refill(us)
        size.refill(us)
        wait = max(calls.wait(1), size.wait(tokens) if tokens > 0 else 0.0)
        if wait > 0:
            # the first bucket that refuses names the wait
            return (False, calls.wait(1) if calls.wait(1) > 0 else size.wait(tokens))
        calls.tokens -= 1
        size.tokens -= max(tokens, 0)
        return (True, 0.0)

    return ordered_fold(
        known, [client, "island"], ["us", "request_id"], ["us", "tokens", "_full"], list, step, "allowed boolean, wait_s double"
    ).drop("island", "_full")


def global_bucket_replay(requests: DataFrame, rate: int = GLOBAL_REQUESTS, token_rate: int = GLOBAL_TOKENS) -> DataFrame:
    """The bucket all clients share, per second: arrived, admitted, refused.

    It is one state for all traffic, so requests are first added up per second; the fold sees
    one row per second, and seconds after a pause that refills the bucket start afresh.
    """
    per = requests.groupBy(F.floor(F.col("us") / SECOND).alias("second")).agg(
        F.count("*").alias("arrived"), F.sum("tokens").alias("tokens")
    ).withColumn("us", F.col("second") * SECOND)
    parts = split_by_gaps(per, [], "us", int(60 * BURST * SECOND), slice_us=3600 * SECOND)
    first = per.agg(F.min("us").alias("_first"))
    known = parts.join(F.broadcast(first)).withColumn("_full", F.col("island") != F.col("_first")).drop("_first")  # one row

    def step(state: list, row: tuple) -> tuple:
        us, arrived, tokens, full = row
        if not state:
            state += [Bucket(rate, full), Bucket(token_rate, full)]
        calls, size = state
        calls.refill(us)
        size.refill(us)
        mean = tokens / arrived
        fit = int(min(arrived, calls.tokens, size.tokens / mean if mean > 0 else arrived))
        calls.tokens -= fit
        size.tokens -= fit * mean
        return (fit, int(arrived) - fit)

    return ordered_fold(
        known, ["island"], ["us"], ["us", "arrived", "tokens", "_full"], list, step, "admitted bigint, refused bigint"
    ).select("second", "arrived", "tokens", "admitted", "refused")


def sliding_window_counts(
    requests: DataFrame, sub_s: int = 10, subs: int = 6, limit: int = 100, client: str = "client", current_only: bool = False
) -> DataFrame:
    """Requests per client and sub-window, the sum of the trailing window, and if it is over.

    Summed on one row per sub-window; `current_only` counts the newest sub-window alone, as a
    parity option."""
    per = requests.groupBy(client, F.floor(F.col("us") / (sub_s * SECOND)).alias("sub")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(client).orderBy("sub").rangeBetween(0 if current_only else -(subs - 1), 0)
    return per.withColumn("in_window", F.sum("n").over(w)).withColumn("would_exceed", F.col("in_window") > limit)


def sliding_window_replay(
    requests: DataFrame, window_s: int = 60, subs: int = 6, limit: int = 100, client: str = "client"
) -> DataFrame:
    """Exact decisions: refused requests are not counted.  Adds allowed and counted."""
    sub_us = window_s * SECOND // subs
    parts = split_by_gaps(requests, [client], "us", (window_s + window_s // subs) * SECOND)

    def step(state: list, row: tuple) -> tuple:
        now = row[0] // sub_us
        while state and state[0][0] <= now - subs:
            state.pop(0)
        total = sum(n for _, n in state)
        if total >= limit:
            return (False, total)
        if state and state[-1][0] == now:
            state[-1][1] += 1
        else:
            state.append([now, 1])
        return (True, total + 1)

    return ordered_fold(
        parts, [client, "island"], ["us", "request_id"], ["us"], list, step, "allowed boolean, counted bigint"
    ).drop("island")


def rate_metrics(decisions: DataFrame, client: str = "client", capacity: float = GLOBAL_REQUESTS * BURST) -> DataFrame:
    minutes = (F.max("us") - F.min("us")) / (60.0 * SECOND)
    accepted = F.count_if("allowed")
    return decisions.agg(
        F.count("*").alias("total_requests"), accepted.alias("accepted"), F.count_if(~F.col("allowed")).alias("rejected"),
        F.coalesce(F.try_divide(accepted, F.count("*")), F.lit(1.0)).alias("acceptance_rate"), F.sum("tokens").alias("total_tokens"),
        F.count_distinct(client).alias("active_clients"),
        F.coalesce(F.try_divide(accepted / F.lit(capacity), minutes), F.lit(0.0)).alias("current_load"),
    )


def adaptive_rates(load: DataFrame, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """Adjustment per interval (interval, load) from the mean of the last ten loads.

    One row per interval, so the single ordered window is as long as the observed time."""
    w = Window.partitionBy().orderBy("interval").rowsBetween(-9, 0)
    mean = F.avg("load").over(w)
    out = load.withColumn("avg_load", mean)
    a = F.col("avg_load")
    adjust = (
        F.when(a > 0.8, F.greatest(F.lit(low), F.lit(1.0) - (a - 0.8)))
        .when(a < 0.3, F.least(F.lit(high), F.lit(1.0) + (F.lit(0.3) - a))).otherwise(1.0)
    )
    return out.withColumn("adjustment", adjust)


# fixed values: agents and path parts that raise the level
SUSPICIOUS_AGENTS = ["python-requests", "curl", "wget", "bot", "crawler", "scanner", "scraper"]
SUSPICIOUS_PATHS = ["admin", "wp-admin", ".env", "config", "backup", "sql", "database"]
LEVELS = ["low", "medium", "high", "critical"]


def flood_levels(
    requests: DataFrame, rapid: int = 100, rapid_s: int = 60, burst: int = 30, burst_s: int = 10, client: str = "client"
) -> DataFrame:
    """Adds counts of the trailing windows and the threat level of each request."""
    a = trailing_window(requests, [client], "us", rapid_s * SECOND, {"in_rapid": ("count", None)})
    b = trailing_window(a, [client], "us", burst_s * SECOND, {"in_burst": ("count", None)})
    agent, path = F.lower("user_agent"), F.lower("path")
    odd = (
        X.contains_any(agent, SUSPICIOUS_AGENTS) | X.contains_any(path, SUSPICIOUS_PATHS)
        | (F.coalesce("user_agent", F.lit("")) == "") | (F.coalesce("accept", F.lit("")) == "")
    )
    rank = F.greatest(
        F.when(F.col("in_rapid") > rapid, 3).otherwise(0), F.when(F.col("in_burst") > burst, 2).otherwise(0),
        F.when(odd, 1).otherwise(0),
    )
    return b.withColumn("level", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1))


def suspicion_blocks(
    levels: DataFrame, client: str = "client", short_s: int = 300, long_s: int = 3600, memory_s: int = 3600
) -> DataFrame:
    """Adds suspicion and blocked: high adds .3 and blocks from .8 on, critical blocks for an hour.

    All memory ends after an hour without requests, which is where a client's log is cut."""
    longest = max(long_s, memory_s) * SECOND
    parts = split_by_gaps(levels, [client], "us", longest)

    def step(state: list, row: tuple) -> tuple:
        us, level = row
        score, score_until, blocked_until = state
        if us < blocked_until:
            return (score if us < score_until else 0.0, True)
        if us >= score_until:
            score = 0.0
        blocked = False
        if level == "critical":
            blocked_until, blocked = us + long_s * SECOND, True
        elif level == "high":
            score, score_until = min(1.0, score + 0.3), us + memory_s * SECOND
            if score >= 0.8:
                blocked_until, blocked = us + short_s * SECOND, True
        state[:] = [score, score_until, blocked_until]
        return (float(score), blocked)

    return ordered_fold(
        parts, [client, "island"], ["us", "request_id"], ["us", "level"], lambda: [0.0, 0, 0], step,
        "suspicion double, blocked boolean",
    ).drop("island")


def breaker_step(state: list, success: bool, counted: bool, us: int, failures: int = 5, recovery_s: int = 60, successes: int = 3) -> str:
    """One call through a breaker; state = [name, failures, successes, last failure]. Returns the state the call met."""
    if state[0] == "open":
        if state[3] is not None and us - state[3] < recovery_s * SECOND:
            return "open"
        state[0], state[2] = "half_open", 0
    met = state[0]
    if success:
        if met == "half_open":
            state[2] += 1
            if state[2] >= successes:
                state[:3] = ["closed", 0, 0]
        else:
            state[1] = 0
    elif counted:
        state[1] += 1
        state[3] = us
        if met == "half_open" or state[1] >= failures:
            state[0] = "open"
    return met


def breaker_replay(
    calls: DataFrame, provider: str = "provider", id_col: str = "call_id", failures: int = 5, recovery_s: int = 60, successes: int = 3
) -> DataFrame:
    """Adds the state each call met and the state after it, per provider.

    The state is four numbers and rows stream past it, so a provider may have any number of
    calls; providers run side by side."""

    def step(state: list, row: tuple) -> tuple:
        us, ok = row
        met = breaker_step(state, bool(ok), True, us, failures, recovery_s, successes)
        return (met, state[0], int(state[1]), met != "open")

    return ordered_fold(
        calls, [provider], ["us", id_col], ["us", "success"], lambda: ["closed", 0, 0, None], step,
        "met string, state string, failure_count int, executed boolean",
    )


def breaker_summary(replayed: DataFrame, provider: str = "provider", id_col: str = "call_id") -> DataFrame:
    """Per provider: calls, successes, openings, last state and its health."""
    g = replayed.groupBy(provider).agg(
        F.count("*").alias("total"), F.count_if(F.col("executed") & F.col("success")).alias("successful"),
        F.count_if(F.col("executed") & ~F.col("success")).alias("failed"),
        F.count_if(F.col("executed") & (F.col("state") == "open") & (F.col("met") != "open")).alias("openings"),
        F.max_by("state", F.struct("us", id_col)).alias("state"),
    )
    health = F.when(F.col("state") == "closed", "healthy").when(F.col("state") == "half_open", "recovering").otherwise("unhealthy")
    return g.withColumn("health", health)


# fixed values: endpoint, requests per minute, burst factor, priority weight
ENDPOINTS = [
    ("/api/v1/detect", 60, 1.2, 1.5), ("/api/v1/analyze", 30, 1.1, 2.0),
    ("/api/v1/batch", 10, 1.3, 1.0), ("/api/v1/health", 300, 2.0, 0.5),
]


def endpoint_limits(requests: DataFrame, endpoints: list[tuple] | None = None) -> DataFrame:
    """Adds base_rpm, burst and weight of the endpoint the path starts with (null: no limit)."""
    rows = endpoints or ENDPOINTS

    def pick(i: int) -> Column:
        whens = [F.when(F.col("path").startswith(e[0]), F.lit(e[i])) for e in rows]
        return reduce(lambda a, b: F.coalesce(a, b), whens)

    return requests.withColumns({"base_rpm": pick(1), "burst": pick(2), "weight": pick(3)})
