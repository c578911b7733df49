"""Security metrics, alerts, audit events, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.operators.slices import trailing_window
from rampart.operators.usage import alert_throttle
from rampart.operators.verdicts import by_name

METRIC_TYPES = [
    "authentication", "rate_limiting", "injection_attempts", "circuit_breaker", "encryption",
    "data_access", "api_usage", "threat_detection", "compliance", "performance",
]
# fixed values: name, metric type, metric name, threshold, minutes, severity, aggregate
THRESHOLDS = [
    ("failed_auth_rate", "authentication", "failed_authentications", 10.0, 1, "high", "count"),
    ("injection_attempts", "injection_attempts", "injection_detected", 5.0, 1, "critical", "count"),
    ("rate_limit_breaches", "rate_limiting", "rate_limit_exceeded", 20.0, 1, "medium", "count"),
    ("circuit_breaker_trips", "circuit_breaker", "circuit_breaker_opened", 3.0, 5, "high", "count"),
    ("encryption_failures", "encryption", "encryption_failed", 1.0, 60, "critical", "count"),
    ("unauthorized_data_access", "data_access", "unauthorized_access", 1.0, 1, "critical", "count"),
    ("api_error_rate", "api_usage", "api_errors", 50.0, 1, "medium", "count"),
    ("threat_detection", "threat_detection", "threat_detected", 1.0, 1, "critical", "count"),
    ("compliance_violation", "compliance", "compliance_violation", 1.0, 60, "high", "count"),
    ("response_time_degradation", "performance", "response_time_ms", 1000.0, 5, "medium", "mean"),
]
KEY_METRICS = [
    ("authentication", "failed_authentications"), ("injection_attempts", "injection_detected"),
    ("rate_limiting", "rate_limit_exceeded"), ("api_usage", "api_requests"), ("performance", "response_time_ms"),
]


def metric_statistics(m: DataFrame, minutes: int = 5) -> DataFrame:
    """Per metric and window: count, mean, extremes, sum and sample deviation."""
    w = F.window("ts", f"{minutes} minutes")
    g = m.groupBy("metric_type", "name", w.alias("w")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum("value").alias("sum"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_dev"),
    )
    return g.withColumn("window_us", F.unix_micros("w.start")).drop("w")


def threshold_alerts(m: DataFrame, thresholds: list[tuple] | None = None) -> DataFrame:
    """An alert for every metric row at which its trailing window is over the threshold.

    Rows of one window length are handled together; see `trailing_window` for hot metrics."""
    rows = thresholds or THRESHOLDS
    out = None
    for minutes in sorted({t[4] for t in rows}):
        mine = [t for t in rows if t[4] == minutes]
        key = F.concat_ws("/", "metric_type", "name")
        pick = lambda i: by_name({f"{t[1]}/{t[2]}": t[i] for t in mine}, key)  # noqa: E731, B023
        kept = m.filter(key.isin([f"{t[1]}/{t[2]}" for t in mine])).withColumns({
            "threshold_name": pick(0), "threshold": pick(3), "severity": pick(5), "aggregate": pick(6),
        })
        counted = trailing_window(
            kept, ["metric_type", "name"], "us", minutes * 60_000_000, {"_n": ("count", None), "_mean": ("avg", "value")}
        )
        actual = F.when(F.col("aggregate") == "count", F.col("_n").cast("double")).otherwise(F.col("_mean"))
        over = counted.withColumn("actual", actual).filter(F.col("actual") > F.col("threshold")).drop("_n", "_mean", "aggregate")
        out = over if out is None else out.unionByName(over)
    return out


def dashboard(m: DataFrame, alerts: DataFrame, now: str, minutes: int = 60) -> DataFrame:
    """Long table (section, name, n, value): last hour by type, key statistics, health."""
    at = F.to_timestamp(F.lit(now))
    recent = m.filter((F.col("ts") > at - F.make_interval(mins=F.lit(minutes))) & (F.col("ts") <= at))
    by_type = recent.groupBy(F.col("metric_type").alias("name")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    keys = [f"{t}.{n}" for t, n in KEY_METRICS]
    key = F.concat_ws(".", "metric_type", "name")
    stats = recent.filter(key.isin(keys)).groupBy(key.alias("name")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    health = alerts.agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h")
    ).select(
        F.when(F.col("c") > 0, "critical").when(F.col("h") > 0, "warning").otherwise("healthy").alias("name"), "n", F.col("c").cast("double").alias("value")
    )
    part = lambda df, s: df.select(F.lit(s).alias("section"), "name", "n", "value")
    return part(by_type, "by_type").unionByName(part(stats, "statistics")).unionByName(part(health, "health"))


def recent_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The newest alerts (a top-k, limited per task before the merge)."""
    return alerts.orderBy(F.desc("us"), "threshold_name", "event_id").limit(n)


def metric_history(m: DataFrame, metric_type: str, name: str, now: str, minutes: int = 60) -> DataFrame:
    at = F.to_timestamp(F.lit(now))
    return m.filter(
        (F.col("metric_type") == metric_type) & (F.col("name") == name)
        & (F.col("ts") > at - F.make_interval(mins=F.lit(minutes))) & (F.col("ts") <= at)
    )


def staleness(m: DataFrame, now_us: int, stale_s: int = 300, types: list[str] | None = None) -> DataFrame:
    """Every metric type with its last update; stale when that is older than `stale_s`."""
    spark = m.sparkSession
    known = spark.createDataFrame([(t,) for t in (types or METRIC_TYPES)], "metric_type string")
    last = m.groupBy("metric_type").agg(F.max("us").alias("last_us"))
    status = F.when(F.col("last_us").isNull(), "none").when(F.lit(now_us) - F.col("last_us") > stale_s * 1_000_000, "stale").otherwise("healthy")
    return known.join(last, "metric_type", "left").withColumn("status", status)


AUDITED = ["/api/v1/detect", "/api/v1/analyze", "/api/v1/batch", "/api/v1/client", "/api/v1/admin"]


def audit_events(requests: DataFrame) -> DataFrame:
    """Requests as audit events: type, severity, client address, cleaned headers.

    Columns: path, status, auth_ok, pattern_confidence, pii_count, invalid, headers, remote (null where
    not known).  Requests that call for no event are dropped."""
    c = F.col
    audited = F.lit(False)
    for p in AUDITED:
        audited = audited | c("path").startswith(p)
    kinds = [
        (c("status") == 429, "rate_limit_exceeded", F.lit("medium")),
        (c("status").isin(401, 403, 413), "access_denied", F.lit("medium")),
        (c("auth_ok") == F.lit(False), "auth_failure", F.lit("medium")),
        (c("invalid"), "invalid_input", F.lit("medium")),
        (c("pattern_confidence").isNotNull(), "suspicious_pattern",
         F.when(c("pattern_confidence") >= 0.9, "high").when(c("pattern_confidence") >= 0.7, "medium").otherwise("low")),
        (c("pii_count") > 0, "pii_detected", F.lit("medium")),
        (audited & (c("status") < 400), "access_granted", F.lit("low")),
        (c("auth_ok"), "auth_success", F.lit("low")),
    ]
    event = severity = None
    for test, name, level in kinds:
        event = F.when(test, name) if event is None else event.when(test, name)
        severity = F.when(test, level) if severity is None else severity.when(test, level)
    out = requests.withColumns({"event_type": event, "severity": severity}).filter(F.col("event_type").isNotNull())
    return out.withColumns({"client_ip": X.client_ip("headers", "remote"), "headers": X.sanitize_headers("headers")})


def rule_alerts(m: DataFrame, rules: dict[str, tuple[str, str]], window_s: int = 300) -> DataFrame:
    """User conditions (SQL text -> severity) over metric rows, one alert per rule and window at most."""
    tests = F.array(*[F.when(F.expr(cond), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (cond, s) in rules.items()])
    fired = m.withColumn("r", F.explode(F.array_compact(tests))).select(*m.columns, "r.rule", "r.severity")
    return alert_throttle(fired, ["rule"], window_s).filter("sent").drop("sent")


def alert_summary(alerts: DataFrame, resolved: DataFrame, key: str = "event_id") -> DataFrame:
    """Active and fired alerts by severity, and the level one step up."""
    order = ["info", "warning", "error", "critical"]
    fired = alerts.groupBy("severity").agg(F.count("*").alias("fired"))
    active = alerts.join(resolved.select(key), key, "left_anti").groupBy("severity").agg(F.count("*").alias("active"))
    up = by_name(dict(zip(order, order[1:] + order[-1:])), F.col("severity"))
    return fired.join(active, "severity", "left").select("severity", "fired", F.coalesce("active", F.lit(0)).alias("active"), up.alias("escalated"))


# fixed values: upper bounds of the histogram buckets
DURATION_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
SHARE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def bucket(value: Column, bounds: list[float]) -> Column:
    """Smallest upper bound that holds the value, null above the last."""
    out = None
    for b in bounds:
        out = F.when(value <= b, b) if out is None else out.when(value <= b, b)
    return out


def detection_counts(events: DataFrame) -> DataFrame:
    """Counts over all combinations of attack type, severity and method."""
    return events.cube("attack_type", "severity", "method").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def histograms(events: DataFrame, columns: dict[str, list[float]], by: str) -> DataFrame:
    """Bucket counts of several measures in one pass: (measure, by, le, n, total)."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("measure"), bucket(F.col(c), b).alias("le"), F.col(c).cast("double").alias("v")) for c, b in columns.items()
    ])
    return events.select(by, F.explode(entries).alias("e")).groupBy(by, "e.measure", "e.le").agg(
        F.count("*").alias("n"), F.sum("e.v").alias("total")
    )
