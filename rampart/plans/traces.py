"""Queries over logs and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import traces as T
from rampart.plans import inputs as I
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import query
from rampart.plans.usage import rounded


def typed_logs(spark, path):
    kind = F.expr("CASE user_id % 6 WHEN 0 THEN 'Timeout waiting' WHEN 1 THEN 'connection reset' WHEN 2 THEN 'Forbidden' WHEN 3 THEN 'Not found' WHEN 4 THEN 'permission missing' ELSE 'other' END")
    return I.logs(spark, path).withColumn("message", F.concat_ws(" ", kind, "message"))


_TYPED = "tl AS (SELECT request_id, us, level, CASE user_id % 6 WHEN 0 THEN 'Timeout waiting' WHEN 1 THEN 'connection reset' WHEN 2 THEN 'Forbidden' WHEN 3 THEN 'Not found' WHEN 4 THEN 'permission missing' ELSE 'other' END || ' ' || message AS message FROM logs)"


@query("log_patterns", with_ctes("logs", f", {_TYPED} SELECT regexp_replace(message, '\\d+', 'N', 'g') AS template, count(*) AS n FROM tl GROUP BY 1 ORDER BY n DESC, template LIMIT 5"))
def _patterns(spark, path):
    return T.log_patterns(typed_logs(spark, path))


@query("error_clusters", with_ctes("logs", f""", {_TYPED} SELECT CASE WHEN contains(lower(message), 'timeout') THEN 'timeout_errors' WHEN contains(lower(message), 'connection') THEN 'connection_errors'
  WHEN contains(lower(message), 'permission') OR contains(lower(message), 'forbidden') THEN 'permission_errors' WHEN contains(lower(message), 'not found') THEN 'not_found_errors' ELSE 'other_errors' END AS cluster, count(*) AS n FROM tl WHERE level = 'ERROR' GROUP BY 1"""))
def _clusters(spark, path):
    return T.error_clusters(typed_logs(spark, path))


@query("gap_anomalies", with_ctes("logs", """, g AS (SELECT request_id, (us - lag(us) OVER (ORDER BY us, request_id)) / 1e6 AS gap_s FROM logs), p AS (SELECT * FROM g WHERE gap_s > 0),
  b AS (SELECT avg(gap_s) AS m, stddev_pop(gap_s) AS s FROM p) SELECT request_id, round(gap_s, 6) AS gap_s, round(m, 6) AS mean_gap FROM p, b WHERE abs(gap_s - m) > 2 * s"""))
def _gaps(spark, path):
    return rounded(T.gap_anomalies(I.logs(spark, path)))


@query("error_spikes", with_ctes("logs", """, p AS (SELECT us // 60000000 AS minute, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1), b AS (SELECT avg(n) AS m FROM p)
  SELECT minute::BIGINT AS minute, n, round(m, 6) AS mean_errors FROM p, b WHERE n > m * 1.5"""))
def _spikes(spark, path):
    return rounded(T.error_spikes(I.logs(spark, path), 1.5))


@query("metric_summary", with_ctes("ev", """, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM ev)
  SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, max(value) FILTER (i = floor(c * 0.5 + 1e-9)) AS p50, max(value) FILTER (i = floor(c * 0.95 + 1e-9)) AS p95, max(value) FILTER (i = floor(c * 0.99 + 1e-9)) AS p99 FROM r GROUP BY 1"""))
def _summary(spark, path):
    return rounded(T.metric_summary(I.events(spark, path), ["event_type"]))


@query("request_data", with_ctes("logs", "SELECT request_id, level, message FROM logs WHERE request_id = 77"))
def _request(spark, path):
    return T.request_data(I.logs(spark, path), 77).select("request_id", "level", "message")


@query("span_statistics", with_ctes("spans", "SELECT trace_id, count(*) AS n, round(sum(duration), 6) AS total, round(avg(duration), 6) AS mean, min(duration) AS min, max(duration) AS max, list_sort(list(DISTINCT name)) AS names FROM spans GROUP BY 1"))
def _span_stats(spark, path):
    return rounded(T.span_statistics(I.spans(spark, path)))


@query("dependency_graph", with_ctes("spans", "SELECT p.name AS parent, c.name AS child, count(*) AS n FROM spans c JOIN spans p ON c.parent_id = p.span_id AND c.trace_id = p.trace_id GROUP BY ALL"))
def _graph(spark, path):
    return T.dependency_graph(I.spans(spark, path))


@query("bottlenecks", with_ctes("spans", """, r AS (SELECT *, row_number() OVER (ORDER BY duration) - 1 AS i, count(*) OVER () AS n FROM spans), c AS (SELECT max(duration) AS cut FROM r WHERE i = floor(n * 0.95 + 1e-9))
  SELECT span_id, duration FROM spans, c WHERE duration >= cut"""))
def _bottlenecks(spark, path):
    return T.bottlenecks(I.spans(spark, path)).select("span_id", "duration")


@query("span_errors", with_ctes("spans", "SELECT name, count(*) FILTER (status = 'error') AS errors, count(*) AS n, round(avg((status = 'error')::INT), 6) AS rate FROM spans GROUP BY 1"))
def _errors(spark, path):
    return rounded(T.span_errors(I.spans(spark, path)))


@query("critical_path", with_ctes("spans", """, leaf AS (SELECT s.* FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.parent_id = s.span_id AND c.trace_id = s.trace_id)),
  up AS (WITH RECURSIVE u AS (SELECT trace_id, span_id AS leaf, parent_id, duration AS total, 1 AS depth FROM leaf
     UNION ALL SELECT u.trace_id, u.leaf, p.parent_id, u.total + p.duration, u.depth + 1 FROM u JOIN spans p ON p.span_id = u.parent_id AND p.trace_id = u.trace_id) SELECT * FROM u WHERE parent_id IS NULL)
  SELECT trace_id, round(max(total), 6) AS total, arg_max(depth, total) AS depth FROM up GROUP BY trace_id"""))
def _critical(spark, path):
    return rounded(T.critical_path(I.spans(spark, path)).select("trace_id", "total", F.size("path").alias("depth")))
