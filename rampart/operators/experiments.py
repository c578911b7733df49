"""A/B experiments: assignment, metrics, statistics, safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions import stats as S
from rampart.operators.slices import order_statistics, ranked_counts
from rampart.operators.verdicts import by_name


# --- assignment ----------------------------------------------------------------------------
def md5_bucket(key: Column) -> Column:
    """md5 as a 128-bit number modulo 10000, from four 32-bit parts (2**32 % 10000 = 7296)."""
    digest = F.md5(key.cast("binary"))
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    return reduce(lambda acc, i: (acc * 7296 + part(i)) % 10000, range(1, 4), part(0) % 10000)


def _key(exp: Column, user: Column, *more: str | Column) -> Column:
    parts = [exp, user.cast("string"), *[m if isinstance(m, Column) else F.lit(m) for m in more]]
    return F.concat_ws(":", *parts)


def in_sample(users: DataFrame, exp: Column, target: Column | float, user: str = "user_id") -> Column:
    share = target if isinstance(target, Column) else F.lit(float(target))
    return (share >= 1.0) | (md5_bucket(_key(exp, F.col(user), "sample")) / 10000.0 < share)


def traffic_ranges(variants: DataFrame) -> DataFrame:
    """Variants (experiment_id, variant_id, position, traffic, is_control) of each experiment as one
    sorted array with cumulated shares; an experiment has a handful of variants."""
    w = Window.partitionBy("experiment_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    upto = variants.withColumn("upto", F.sum("traffic").over(w))
    return upto.groupBy("experiment_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "upto", "variant_id"))).alias("ranges"),
        F.max(F.when(F.col("is_control"), F.col("variant_id"))).alias("control_id"),
    )


def pick_variant(bucket: Column, ranges: Column, control: Column) -> Column:
    first = F.filter(ranges, lambda r: bucket < r["upto"] * 10000)
    return F.coalesce(F.try_element_at(F.transform(first, lambda r: r["variant_id"]), F.lit(1)), control)


def assign_hash(users: DataFrame, variants: DataFrame, segment: str | None = None, user: str = "user_id") -> DataFrame:
    """Variant by hash bucket for rows with experiment_id; `segment` stratifies the key."""
    e, u = F.col("experiment_id"), F.col(user)
    key = _key(e, u, F.coalesce(F.col(segment), F.lit("default")), "stratified") if segment else _key(e, u, "variant")
    joined = users.join(traffic_ranges(variants), "experiment_id")
    bucketed = joined.withColumn("bucket", md5_bucket(key))
    return bucketed.withColumn("variant_id", pick_variant(F.col("bucket"), F.col("ranges"), F.col("control_id"))).drop("ranges", "control_id")


def assign_weighted(users: DataFrame, variants: DataFrame, seed: int | None = None, user: str = "user_id") -> DataFrame:
    """Weighted choice: by a hash of the user (stable), or by `rand(seed)` when a seed is given."""
    draw = (
        F.rand(seed) if seed is not None
        else F.pmod(F.xxhash64(_key(F.col("experiment_id"), F.col(user))), F.lit(1 << 52)) / float(1 << 52)
    )
    joined = users.join(traffic_ranges(variants), "experiment_id").withColumn("_b", draw * 10000)
    return joined.withColumn("variant_id", pick_variant(F.col("_b"), F.col("ranges"), F.col("control_id"))).drop("ranges", "control_id", "_b")


def target_users(users: DataFrame, filters: dict) -> DataFrame:
    """Users that pass min_requests, user_type, region (one or several) and all feature_flags."""
    out = users
    if "min_requests" in filters:
        out = out.filter(F.coalesce("total_requests", F.lit(0)) >= filters["min_requests"])
    if "user_type" in filters:
        out = out.filter(F.coalesce("user_type", F.lit("free")) == filters["user_type"])
    if "region" in filters:
        regions = filters["region"] if isinstance(filters["region"], list) else [filters["region"]]
        out = out.filter(F.coalesce("region", F.lit("unknown")).isin(regions))
    if "feature_flags" in filters:
        flags = filters["feature_flags"] if isinstance(filters["feature_flags"], list) else [filters["feature_flags"]]
        needed = F.array(*[F.lit(f) for f in flags])
        out = out.filter(F.size(F.array_except(needed, F.coalesce("feature_flags", F.array().cast("array<string>")))) == 0)
    return out


def is_active(now: str) -> Column:
    at = F.to_timestamp(F.lit(now))
    return (
        (F.col("status") == "running")
        & (F.col("start_time").isNull() | (at >= F.col("start_time"))) & (F.col("end_time").isNull() | (at <= F.col("end_time")))
    )


def assign(
    candidates: DataFrame, experiments: DataFrame, variants: DataFrame, existing: DataFrame, now: str, user: str = "user_id"
) -> DataFrame:
    """Assignments after offering (experiment_id, user) pairs: existing ones stay, new ones are
    sampled and bucketed for active experiments only."""
    active = experiments.filter(is_active(now)).select("experiment_id", "target_percentage")
    fresh = candidates.join(existing.select("experiment_id", user), ["experiment_id", user], "left_anti")
    offered = fresh.join(active, "experiment_id")
    sampled = offered.filter(in_sample(offered, F.col("experiment_id"), F.col("target_percentage"), user))
    new = assign_hash(sampled, variants, user=user).select("experiment_id", user, "variant_id").withColumn("is_new", F.lit(True))
    kept = existing.select("experiment_id", user, "variant_id").withColumn("is_new", F.lit(False))
    return kept.unionByName(new)


def assignment_stats(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("experiment_id", "variant_id").agg(F.count("*").alias("n"))


def check_experiments(experiments: DataFrame, variants: DataFrame) -> DataFrame:
    """Experiments with `problems` of their configuration."""
    v = variants.groupBy("experiment_id").agg(
        F.count("*").alias("n"), F.count_if("is_control").alias("controls"), F.sum("traffic").alias("traffic"),
        F.count_distinct("variant_id").alias("ids"),
    )
    c = F.col
    problems = F.array_compact(F.array(
        F.when(F.coalesce(c("n"), F.lit(0)) < 2, "fewer than two variants"),
        F.when(F.coalesce(c("controls"), F.lit(0)) != 1, "not exactly one control"),
        F.when(F.abs(F.coalesce(c("traffic"), F.lit(0.0)) - 1.0) > 0.001, "traffic does not sum to one"),
        F.when(c("ids") < c("n"), "variant ids repeat"),
        F.when(c("end_time") <= c("start_time"), "ends before it starts"),
        F.when((c("duration_hours") <= 0) | (c("duration_hours") > 8760), "bad duration"),
    ))
    return experiments.join(v, "experiment_id", "left").select("experiment_id", problems.alias("problems"))


# --- metrics -------------------------------------------------------------------------------
def explode_detection_metrics(events: DataFrame) -> DataFrame:
    """One row per metric of a detection (variant_id, user_id, time_ms, confidence, verdict, provider, cache_hit, pii)."""
    entry = lambda n, v: F.struct(n if isinstance(n, Column) else F.lit(n).alias("metric_name"), v.cast("double").alias("value"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    rows = F.array(
        entry("response_time_ms", F.col("time_ms")), entry("confidence", F.col("confidence")),
        entry("blocked", flag(F.col("verdict") == "block")), entry("cache_hit", flag(F.col("cache_hit"))),
        entry("pii_detected", flag(F.col("pii"))),
        entry(F.concat(F.lit("provider_"), F.col("provider")).alias("metric_name"), F.lit(1.0)),
    )
    ids = [c for c in ("experiment_id", "variant_id", "user_id", "ts") if c in events.columns]
    return events.select(*ids, F.explode(rows).alias("m")).select(*ids, "m.*")


PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def metric_aggregates(m: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, sum, mean, extremes, sample deviation and exact linear percentiles per key.

    The percentiles come from counts per distinct value, cumulated over value ranges, so a
    key of any size is spread over many tasks and none holds its values."""
    basic = m.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )
    return basic.join(order_statistics(m, keys, value, PERCENTILES), keys)


def variant_performance(m: DataFrame) -> DataFrame:
    g = m.groupBy("experiment_id", "variant_id").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )
    return g.withColumn("events_per_user", F.col("events") / F.col("users"))


def filter_metrics(
    m: DataFrame, experiment: str | None = None, variants: list[str] | None = None, names: list[str] | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    tests = []
    if experiment:
        tests.append(F.col("experiment_id") == experiment)
    if variants:
        tests.append(F.col("variant_id").isin(variants))
    if names:
        tests.append(F.col("metric_name").isin(names))
    if start:
        tests.append(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end:
        tests.append(F.col("ts") <= F.to_timestamp(F.lit(end)))
    return m.filter(reduce(lambda a, b: a & b, tests)) if tests else m


# --- statistics -----------------------------------------------------------------------------
def arms(m: DataFrame) -> DataFrame:
    """Control and treatment figures side by side: one row per metric and treatment.

    The control is the first variant by name that says so, else the first by name; only a few
    aggregated rows per metric are joined."""
    g = m.groupBy("experiment_id", "metric_name", "variant_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"), F.sum("value").alias("sum"),
    )
    v = F.col("variant_id")
    named = F.lower(v).contains("control") | v.endswith("_0")
    w = Window.partitionBy("experiment_id", "metric_name").orderBy(F.when(named, 0).otherwise(1), "variant_id")
    marked = g.withColumn("rk", F.row_number().over(w))
    side = lambda p, cond: marked.filter(cond).select(
        "experiment_id", "metric_name", *[F.col(c).alias(f"{p}_{c}") for c in ("variant_id", "n", "mean", "var", "sum")]
    )
    return side("c", F.col("rk") == 1).join(side("t", F.col("rk") > 1), ["experiment_id", "metric_name"])


def welch_t(a: DataFrame) -> DataFrame:
    """Adds t, df and p_value of Welch's test to `arms` rows."""
    c = F.col
    s1, s2 = c("c_var") / c("c_n"), c("t_var") / c("t_n")
    se = F.sqrt(s1 + s2)
    ok = (c("c_n") > 1) & (c("t_n") > 1) & (se > 0)
    t = F.when(ok, (c("t_mean") - c("c_mean")) / se).otherwise(0.0)
    df = F.when(ok, (s1 + s2) * (s1 + s2) / (s1 * s1 / (c("c_n") - 1) + s2 * s2 / (c("t_n") - 1)))
    out = a.withColumns({"t": t, "df": df})
    p = F.when(c("df").isNull(), 1.0).otherwise((F.lit(1.0) - S.t_cdf(F.abs("t"), c("df"))) * 2)
    return out.withColumn("p_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def proportion_z(a: DataFrame) -> DataFrame:
    c = F.col
    pooled = (c("c_sum") + c("t_sum")) / (c("c_n") + c("t_n"))
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / c("c_n") + F.lit(1.0) / c("t_n")))
    z = F.when(se > 0, (c("t_sum") / c("t_n") - c("c_sum") / c("c_n")) / se).otherwise(0.0)
    out = a.withColumn("z", z)
    p = F.when(se > 0, (F.lit(1.0) - S.normal_cdf(F.abs(c("z")))) * 2).otherwise(1.0)
    return out.withColumn("p_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def mann_whitney(m: DataFrame, control: str, treatment: str) -> DataFrame:
    """U, z and p per metric of two variants, with mid-ranks.

    Values are counted per distinct value first; ranks are running counts over value ranges."""
    keys = ["experiment_id", "metric_name"]
    two = m.filter(F.col("variant_id").isin(control, treatment))
    ranked = ranked_counts(two, keys, "value", {"n_c": F.when(F.col("variant_id") == control, 1).otherwise(0)})
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    g = ranked.groupBy(*keys).agg(
        F.sum(mid * F.col("n_c")).alias("r1"), F.sum("n_c").alias("n1"), F.sum(F.col("n") - F.col("n_c")).alias("n2")
    )
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    out = g.withColumn("u", F.least(u1, n1 * n2 - u1))
    sigma = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    z = F.when(sigma > 0, (F.col("u") - n1 * n2 / 2.0) / sigma).otherwise(0.0)
    out = out.withColumn("z", z)
    p = F.when((n1 > 20) | (n2 > 20), (F.lit(1.0) - S.normal_cdf(F.abs("z"))) * 2).otherwise(0.5)
    return out.withColumn("p_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).drop("r1")


def effect_size(a: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adds Cohen's d, Cohen's h (for shares) and the interval of d."""
    c = F.col
    n = c("c_n") + c("t_n")
    pooled = F.sqrt(((c("c_n") - 1) * c("c_var") + (c("t_n") - 1) * c("t_var")) / (n - 2))
    d = F.when(pooled > 0, (c("t_mean") - c("c_mean")) / pooled).otherwise(0.0)
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    h = (F.asin(F.sqrt(share(c("t_mean")))) - F.asin(F.sqrt(share(c("c_mean"))))) * 2
    se = F.sqrt(n / (c("c_n") * c("t_n")) + F.lit(0.5) / (n - 2))
    z = S.normal_ppf(1 - (1 - confidence) / 2)
    out = a.withColumns({"cohens_d": d, "cohens_h": h})
    return out.withColumns({"d_low": F.col("cohens_d") - se * z, "d_high": F.col("cohens_d") + se * z})


def power_and_size(a: DataFrame, effect: str = "cohens_d", alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    c = F.col
    z_alpha, z_beta = S.normal_ppf(1 - alpha / 2), S.normal_ppf(power)
    ncp = F.abs(c(effect)) * F.sqrt(c("c_n") * c("t_n") / (c("c_n") + c("t_n")))
    reached = F.lit(1.0) - S.normal_cdf(F.lit(z_alpha) - ncp) + S.normal_cdf(F.lit(-z_alpha) - ncp)
    need = F.ceil(F.pow(F.lit(z_alpha + z_beta) / c(effect), F.lit(2.0)) * 2).cast("long")
    return a.withColumns({
        "power": F.when((c("c_n") > 1) & (c("t_n") > 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), reached))).otherwise(0.0),
        "required_n": F.when(F.abs(c(effect)) < 1e-6, 10000).otherwise(F.greatest(F.lit(10), need)),
    })


def analyze_experiment(
    m: DataFrame, min_sample: int = 100, confidence: float = 0.95, binary: list[str] | None = None, min_effect: float = 0.05
) -> DataFrame:
    """Every treatment against its control: share metrics by z, others by Welch (rank test for
    small samples), with effect, interval, power and the two significance flags."""
    a = arms(m).filter((F.col("c_n") >= min_sample) & (F.col("t_n") >= min_sample))
    is_share = F.col("metric_name").isin(binary or [])
    w = welch_t(a).withColumnRenamed("p_value", "p_t")
    z = proportion_z(w).withColumnRenamed("p_value", "p_z")
    sized = effect_size(z, confidence).withColumn("effect", F.when(is_share, F.col("cohens_h")).otherwise(F.col("cohens_d")))
    out = power_and_size(sized, "effect", 1 - confidence)
    p = F.when(is_share, F.col("p_z")).otherwise(F.col("p_t"))
    small = (F.col("c_n") < 30) | (F.col("t_n") < 30)
    test = F.when(is_share, "z_test").when(~small, "t_test").otherwise("mann_whitney")
    done = out.withColumns({"test": test, "p_value": p, "statistic": F.when(is_share, F.col("z")).otherwise(F.col("t"))})
    if min_sample < 30:
        done = _with_rank_test(done, m)
    return done.withColumns({
        "significant": F.col("p_value") < 1 - confidence, "practical": F.abs("effect") >= min_effect,
    }).drop("p_t", "p_z", "t", "z")


def _with_rank_test(a: DataFrame, m: DataFrame) -> DataFrame:
    """Rank test for the pairs that are too small for t, keyed by the pair itself."""
    pairs = a.filter(F.col("test") == "mann_whitney").select("experiment_id", "metric_name", "c_variant_id", "t_variant_id")
    rows = m.join(pairs, ["experiment_id", "metric_name"]).filter(
        (F.col("variant_id") == F.col("c_variant_id")) | (F.col("variant_id") == F.col("t_variant_id"))
    )
    keyed = rows.select(
        F.col("experiment_id"), F.concat_ws("\t", "metric_name", "c_variant_id", "t_variant_id").alias("metric_name"), "value",
        F.when(F.col("variant_id") == F.col("c_variant_id"), "c").otherwise("t").alias("variant_id"),
    )
    u = mann_whitney(keyed, "c", "t").select(
        "experiment_id", F.split("metric_name", "\t").alias("k"), F.col("u").alias("_u"), F.col("p_value").alias("_p")
    ).select("experiment_id", F.col("k")[0].alias("metric_name"), F.col("k")[2].alias("t_variant_id"), "_u", "_p")
    j = a.join(u, ["experiment_id", "metric_name", "t_variant_id"], "left")
    return j.withColumns({"p_value": F.coalesce("_p", "p_value"), "statistic": F.coalesce("_u", "statistic")}).drop("_u", "_p")


def result_summary(results: DataFrame) -> DataFrame:
    c = F.col
    improvement = F.when(c("c_mean") != 0, (c("t_mean") - c("c_mean")) / c("c_mean") * 100).otherwise(0.0)
    return results.select(
        "experiment_id", "metric_name", "t_variant_id", F.round(improvement, 2).alias("improvement_percent"), "significant", "practical",
        F.round("p_value", 4).alias("p_value"), F.round("effect", 4).alias("effect_size"), F.round("power", 3).alias("power"),
        F.round("c_mean", 4).alias("control_mean"), F.round("t_mean", 4).alias("treatment_mean"), "c_n", "t_n",
    )


# --- safety ---------------------------------------------------------------------------------
# fixed values: metric, kind, threshold, window in minutes, action
DEFAULT_GUARDRAILS = [
    ("error_rate", "max", 0.05, 5, "pause"), ("response_time_p95", "max", 2000.0, 5, "pause"),
    ("success_rate", "min", 0.95, 5, "pause"), ("cpu_usage", "max", 0.9, 10, "terminate"), ("memory_usage", "max", 0.9, 10, "terminate"),
]
ACTIONS = {"pause": "pause_experiment", "terminate": "terminate_experiment", "reduce": "reduce_traffic"}
PENALTY = {"critical": 0.5, "high": 0.3, "medium": 0.2, "low": 0.1}


def guardrail_severity(kind: Column, value: Column, threshold: Column) -> Column:
    over = F.when(value > threshold * 2, "critical").when(value > threshold * 1.5, "high").when(value > threshold * 1.2, "medium").otherwise("low")
    under = F.when(value < threshold * 0.5, "critical").when(value < threshold * 0.7, "high").when(value < threshold * 0.8, "medium").otherwise("low")
    return F.when(kind == "max", over).otherwise(under)


def window_values(m: DataFrame, minutes: int) -> DataFrame:
    """Mean value per experiment, metric and tumbling window."""
    w = F.window("ts", f"{minutes} minutes")
    return m.groupBy("experiment_id", "metric_name", w.alias("w")).agg(F.avg("value").alias("value")).select(
        "experiment_id", "metric_name", F.col("w.start").alias("checked_at"), "value"
    )


def guardrail_violations(values: DataFrame, guardrails: DataFrame) -> DataFrame:
    """Violations of (metric_name, kind, threshold, action) by checked values."""
    j = values.join(guardrails, "metric_name")
    bad = F.when(F.col("kind") == "max", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return j.filter(bad).select(
        "experiment_id", "metric_name", "kind", "threshold", "value", "checked_at",
        guardrail_severity(F.col("kind"), F.col("value"), F.col("threshold")).alias("severity"),
        by_name(ACTIONS, F.col("action"), "alert").alias("action"),
    )


def experiment_health(checks: DataFrame) -> DataFrame:
    """Health after all checks (experiment_id, at, change): 1.0 at first, then change by change, held in 0..1.

    Adding and clamping compose: each step is x -> min(h, max(l, x + d)), and a run of steps is
    one such step.  So checks are folded per slice of time in parallel, and slices in order.
    """
    span = 86_400_000_000
    sliced = checks.withColumn("_day", F.floor(F.col("at") / span))

    def compose(acc: Column, d: Column) -> Column:
        clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
        return F.struct((acc["d"] + d).alias("d"), clamp(acc["l"] + d).alias("l"), clamp(acc["h"] + d).alias("h"))

    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("l"), F.lit(1.0).alias("h"))
    # hourly checks: a day of one experiment is a short list
    days = sliced.groupBy("experiment_id", "_day").agg(F.array_sort(F.collect_list(F.struct("at", "change"))).alias("c"))
    maps = days.select("experiment_id", "_day", F.aggregate("c", start, lambda a, x: compose(a, x["change"])).alias("m"))
    ordered = maps.groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("_day", "m"))).alias("ms"))
    apply = lambda x, s: F.least(s["m"]["h"], F.greatest(s["m"]["l"], x + s["m"]["d"]))
    return ordered.select("experiment_id", F.aggregate("ms", F.lit(1.0), apply).alias("health"))


def health_changes(violations: DataFrame, checks: DataFrame) -> DataFrame:
    """Change per check time: minus the penalties of its violations, or +.1 when there are none."""
    v = violations.groupBy("experiment_id", "at").agg(F.sum(by_name(PENALTY, F.col("severity"), 0.1)).alias("penalty"))
    return checks.join(v, ["experiment_id", "at"], "left").select(
        "experiment_id", "at", F.when(F.col("penalty").isNull(), 0.1).otherwise(-F.col("penalty")).alias("change")
    )


def safety_report(violations: DataFrame, now: str) -> DataFrame:
    recent = F.col("checked_at") > F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 24 HOURS")
    return violations.groupBy("experiment_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in PENALTY],
        F.count_if(recent).alias("last_24h"), F.max("checked_at").alias("last_violation"),
    )


def last_violations(violations: DataFrame, n: int = 10) -> DataFrame:
    """The newest `n` violations per experiment (a top-k, limited before the shuffle)."""
    w = Window.partitionBy("experiment_id").orderBy(F.desc("checked_at"), "metric_name", "kind")
    return violations.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)


def apply_actions(experiments: DataFrame, violations: DataFrame) -> DataFrame:
    """Experiments after the strongest action their violations ask for."""
    rank = by_name({"terminate_experiment": 3, "pause_experiment": 2, "reduce_traffic": 1}, F.col("action"), 0)
    worst = violations.groupBy("experiment_id").agg(
        F.max(rank).alias("_r"), F.count_if(F.col("action") == "reduce_traffic").alias("_k")
    )
    j = experiments.join(worst, "experiment_id", "left")
    status = F.when(F.col("_r") == 3, "terminated").when(F.col("_r") == 2, "paused").otherwise(F.col("status"))
    reduced = F.when(
        F.col("_k") > 0, F.greatest(F.lit(0.01), F.col("target_percentage") * F.pow(F.lit(0.5), F.col("_k")))
    ).otherwise(F.col("target_percentage"))
    return j.withColumns({"status": status, "target_percentage": reduced}).drop("_r", "_k")


def experiment_stats(experiments: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Long counts: by status, by type, and rows of the other tables."""
    by = lambda c: experiments.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "name", "n")
    out = by("status").unionByName(by("type"))
    for name, df in others.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit("table").alias("kind"), F.lit(name).alias("name"), "n"))
    return out


def promotion_candidates(results: DataFrame) -> DataFrame:
    return results.filter(F.col("significant") & F.col("practical") & (F.col("effect") > 0))


def experiment_status(
    experiments: DataFrame, assignments: DataFrame, violations: DataFrame, results: DataFrame, now: str
) -> DataFrame:
    """One row per experiment: active flag, assignments, violations and significant results."""
    a = assignments.groupBy("experiment_id").agg(F.count("*").alias("n_assigned"))
    s = safety_report(violations, now).select("experiment_id", F.col("total").alias("n_violations"))
    r = results.groupBy("experiment_id").agg(F.count("*").alias("n_results"), F.count_if("significant").alias("n_significant"))
    j = experiments.withColumn("active", is_active(now))
    for part in (a, s, r):
        j = j.join(part, "experiment_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_assigned", "n_violations", "n_results", "n_significant")}
    return j.withColumns(zero)
