"""Queries over security metrics, alerts and audit events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import security as S
from rampart.plans import inputs as I
from rampart.plans.inputs import NOW, NOW_US, with_ctes
from rampart.plans.registry import query
from rampart.plans.text import request_headers
from rampart.plans.usage import rounded, throttle_sql

# thresholds in hours, fitting a month of a small log
_TH = [
    ("failed_auth_rate", "authentication", "failed_authentications", 4.0, 120, "high", "count"),
    ("injection_attempts", "injection_attempts", "injection_detected", 3.0, 60, "critical", "count"),
    ("rate_limit_breaches", "rate_limiting", "rate_limit_exceeded", 5.0, 120, "medium", "count"),
    ("response_time_degradation", "performance", "response_time_ms", 90.0, 60, "medium", "mean"),
]


@query("metric_statistics", with_ctes("security_metrics", """SELECT metric_type, name, epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
  round(sum(value), 6) AS sum, round(coalesce(stddev_samp(value), 0), 6) AS std_dev FROM security_metrics GROUP BY ALL"""))
def _stats(spark, path):
    return rounded(S.metric_statistics(I.security_metrics(spark, path), 60))


_ALERT = ", al AS (" + " UNION ALL ".join(
    f"""SELECT event_id, metric_type, us, '{n}' AS threshold_name, '{sev}' AS severity, {'c::DOUBLE' if agg == 'count' else 'm'} AS actual, {th}::DOUBLE AS threshold FROM
     (SELECT *, count(*) OVER w AS c, avg(value) OVER w AS m FROM security_metrics WHERE metric_type = '{t}' WINDOW w AS (ORDER BY us RANGE BETWEEN {mins * 60_000_000 - 1} PRECEDING AND CURRENT ROW)) WHERE {'c' if agg == 'count' else 'm'} > {th}"""
    for n, t, _, th, mins, sev, agg in _TH) + ")"


def alerts(spark, path):
    return S.threshold_alerts(I.security_metrics(spark, path), _TH)


@query("threshold_alerts", with_ctes("security_metrics", _ALERT + " SELECT event_id, threshold_name, severity, round(actual, 6) AS actual FROM al"))
def _alerts(spark, path):
    return rounded(alerts(spark, path).select("event_id", "threshold_name", "severity", "actual"))


_AT = "2024-01-20 15:30:00"


@query("dashboard", with_ctes("security_metrics", _ALERT + f""", rc AS (SELECT * FROM security_metrics WHERE ts > TIMESTAMP '{_AT}' - INTERVAL 60 MINUTE AND ts <= TIMESTAMP '{_AT}')
  SELECT 'by_type' AS section, metric_type AS name, count(*) AS n, round(avg(value), 6) AS value FROM rc GROUP BY metric_type
  UNION ALL SELECT 'statistics', metric_type || '.' || name, count(*), round(sum(value), 6) FROM rc GROUP BY 2
  UNION ALL SELECT 'health', CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'warning' ELSE 'healthy' END, count(*), count(*) FILTER (severity = 'critical') FROM al"""))
def _dashboard(spark, path):
    return rounded(S.dashboard(I.security_metrics(spark, path), alerts(spark, path), _AT))


@query("recent_alerts", with_ctes("security_metrics", _ALERT + " SELECT event_id, threshold_name, severity FROM al ORDER BY us DESC, threshold_name, event_id LIMIT 10"))
def _recent(spark, path):
    return S.recent_alerts(alerts(spark, path)).select("event_id", "threshold_name", "severity")


@query("metric_history", with_ctes("security_metrics", f"SELECT event_id, us, value FROM security_metrics WHERE metric_type = 'performance' AND name = 'response_time_ms' AND ts > TIMESTAMP '{_AT}' - INTERVAL 600 MINUTE AND ts <= TIMESTAMP '{_AT}'"))
def _history(spark, path):
    return S.metric_history(I.security_metrics(spark, path), "performance", "response_time_ms", _AT, 600).select("event_id", "us", "value")


@query("staleness", with_ctes("security_metrics", f""", t AS (SELECT unnest([{', '.join(repr(x) for x in S.METRIC_TYPES)}]) AS metric_type), l AS (SELECT metric_type, max(us) AS last_us FROM security_metrics GROUP BY 1)
  SELECT metric_type, last_us, CASE WHEN last_us IS NULL THEN 'none' WHEN {NOW_US} - last_us > 1000000000 THEN 'stale' ELSE 'healthy' END AS status FROM t LEFT JOIN l USING (metric_type)"""))
def _stale(spark, path):
    return S.staleness(I.security_metrics(spark, path), NOW_US, 1000)


@query("audit_events", with_ctes("requests", """, a AS (SELECT request_id, path, CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 403 ELSE 200 END AS status, request_id % 5 <> 0 AS auth_ok,
    CASE WHEN request_id % 7 = 0 THEN (request_id % 100) / 100.0 END AS pc, request_id % 3 AS pii, request_id % 19 = 0 AS invalid, client FROM requests),
  c AS (SELECT *, CASE WHEN status = 429 THEN 'rate_limit_exceeded' WHEN status = 403 THEN 'access_denied' WHEN NOT auth_ok THEN 'auth_failure' WHEN invalid THEN 'invalid_input' WHEN pc IS NOT NULL THEN 'suspicious_pattern'
    WHEN pii > 0 THEN 'pii_detected' WHEN starts_with(path, '/api/v1/client') THEN 'access_granted' WHEN auth_ok THEN 'auth_success' END AS event_type FROM a)
  SELECT request_id, event_type, CASE event_type WHEN 'suspicious_pattern' THEN CASE WHEN pc >= 0.9 THEN 'high' WHEN pc >= 0.7 THEN 'medium' ELSE 'low' END WHEN 'access_granted' THEN 'low' WHEN 'auth_success' THEN 'low' ELSE 'medium' END AS severity,
   CASE request_id % 3 WHEN 0 THEN '10.0.0.' || (client % 250) WHEN 1 THEN '10.2.0.' || (client % 250) ELSE 'unknown' END AS client_ip, '[REDACTED]' AS authorization FROM c"""))
def _audit(spark, path):
    k = F.col("request_id")
    r = I.requests(spark, path).select(
        "request_id", "path", F.expr("CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 403 ELSE 200 END").alias("status"), (k % 5 != 0).alias("auth_ok"),
        F.when(k % 7 == 0, (k % 100) / 100.0).alias("pattern_confidence"), (k % 3).alias("pii_count"), (k % 19 == 0).alias("invalid"),
        request_headers().alias("headers"), F.lit(None).cast("string").alias("remote"),
    )
    return S.audit_events(r).select("request_id", "event_type", "severity", "client_ip", F.col("headers")["Authorization"].alias("authorization"))


@query("rule_alerts", with_ctes("security_metrics", """, al AS (SELECT event_id, metric_type, name, value, us, 'slow' AS rule, 'warning' AS severity FROM security_metrics WHERE name = 'response_time_ms' AND value > 150
   UNION ALL SELECT event_id, metric_type, name, value, us, 'attack', 'critical' FROM security_metrics WHERE metric_type = 'injection_attempts' AND value > 100)""" + throttle_sql("al", "rule", "event_id", 36000)
   + " SELECT event_id, metric_type, name, value, us, rule, severity FROM throttled WHERE sent"))
def _rule_alerts(spark, path):
    rules = {"slow": ("name = 'response_time_ms' AND value > 150", "warning"), "attack": ("metric_type = 'injection_attempts' AND value > 100", "critical")}
    return S.rule_alerts(I.security_metrics(spark, path).select("event_id", "metric_type", "name", "value", "us"), rules, 36000)


@query("alert_summary", with_ctes("security_metrics", """, a AS (SELECT event_id, CASE WHEN value > 150 THEN 'critical' WHEN value > 100 THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity FROM security_metrics)
  SELECT severity, count(*) AS fired, count(*) FILTER (event_id % 3 <> 0) AS active, CASE severity WHEN 'info' THEN 'warning' WHEN 'warning' THEN 'error' ELSE 'critical' END AS escalated FROM a GROUP BY severity"""))
def _alert_summary(spark, path):
    m = I.security_metrics(spark, path)
    level = F.when(F.col("value") > 150, "critical").when(F.col("value") > 100, "error").when(F.col("value") > 50, "warning").otherwise("info")
    return S.alert_summary(m.select("event_id", level.alias("severity")), m.filter("event_id % 3 = 0"))


_DET = "det AS (SELECT event_type AS attack_type, CASE WHEN value > 100 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN user_id % 2 = 0 THEN 'heuristic' ELSE 'llm' END AS method, value / 500 AS duration_s, (event_id % 100) / 100.0::DOUBLE AS confidence FROM ev)"


def detections(spark, path):
    return I.events(spark, path).select(
        F.col("event_type").alias("attack_type"), F.when(F.col("value") > 100, "high").when(F.col("value") > 30, "medium").otherwise("low").alias("severity"),
        F.when(F.col("user_id") % 2 == 0, "heuristic").otherwise("llm").alias("method"), (F.col("value") / 500).alias("duration_s"), ((F.col("event_id") % 100) / 100.0).alias("confidence"),
    )


@query("detection_counts", with_ctes("ev", f", {_DET} SELECT attack_type, severity, method, count(*) AS n FROM det GROUP BY CUBE (attack_type, severity, method)"))
def _counts(spark, path):
    return S.detection_counts(detections(spark, path)).drop("gid")


def _le(col, bounds):
    return "CASE " + " ".join(f"WHEN {col} <= {b} THEN {b}::DOUBLE" for b in bounds) + " END"


@query("detection_histograms", with_ctes("ev", f", {_DET} SELECT method, 'duration_s' AS measure, {_le('duration_s', S.DURATION_BUCKETS)} AS le, count(*) AS n, round(sum(duration_s), 6) AS total FROM det GROUP BY ALL UNION ALL SELECT method, 'confidence', {_le('confidence', S.SHARE_BUCKETS)}, count(*), round(sum(confidence), 6) FROM det GROUP BY ALL"))
def _hist(spark, path):
    return rounded(S.histograms(detections(spark, path), {"duration_s": S.DURATION_BUCKETS, "confidence": S.SHARE_BUCKETS}, "method"))
