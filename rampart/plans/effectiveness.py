"""Queries over rule effectiveness and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions.unnest import unnest
from rampart.functions import rule_tables as R
from rampart.operators import effectiveness as X
from rampart.operators import rules
from rampart.plans import inputs as I
from rampart.plans.inputs import NOW_US, with_ctes
from rampart.plans.registry import query
from rampart.plans.rules import any_of, matches
from rampart.plans.usage import rounded


def checks(spark, path):
    e = I.events(spark, path)
    return e.select(F.col("event_id").alias("check_id"), F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("rule_id"), "us",
                    (F.col("value") > 60).alias("hit"), (F.col("value") / 400).alias("time_ms"))


def feedback(spark, path):
    e = I.events(spark, path).filter("event_id % 17 = 0 or event_id % 23 = 0")
    return e.select(F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("rule_id"), (F.col("event_id") % 17 != 0).alias("true_positive"))


_CHECKS = "ck AS (SELECT event_id AS check_id, event_type || (user_id % 7) AS rule_id, us, value > 60 AS hit, value / 400 AS time_ms FROM ev)"
_STATS = f""", {_CHECKS}, tt AS (SELECT rule_id, count(*) AS checks, count(*) FILTER (hit) AS hits, sum(time_ms) AS time_ms, max(us) FILTER (hit) AS last_hit_us FROM ck GROUP BY 1),
  nw AS (SELECT rule_id, avg(hit::INT) * 100 AS recent_hit_rate FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY us DESC, check_id DESC) AS rk FROM ck) WHERE rk <= 100 GROUP BY 1),
  stt AS (SELECT *, hits / checks::DOUBLE * 100 AS hit_rate, time_ms / checks AS avg_time_ms FROM tt JOIN nw USING (rule_id)),
  fb AS (SELECT event_type || (user_id % 7) AS rule_id, count(*) FILTER (event_id % 17 <> 0) AS tp, count(*) FILTER (event_id % 17 = 0) AS fp FROM ev WHERE event_id % 17 = 0 OR event_id % 23 = 0 GROUP BY 1),
  ef AS (SELECT stt.*, hit_rate / 100 * 0.3::DOUBLE + CASE WHEN coalesce(tp, 0) + coalesce(fp, 0) > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.5 END * 0.4::DOUBLE
    + CASE WHEN {NOW_US} - last_hit_us < 3600000000 THEN 1.0 ELSE 0.8 END * 0.2::DOUBLE + CASE WHEN avg_time_ms < 0.1 THEN 1.0 ELSE 0.1 / avg_time_ms END * 0.1::DOUBLE AS score FROM stt LEFT JOIN fb USING (rule_id))"""


def scored(spark, path):
    return X.rule_effectiveness(X.rule_stats(checks(spark, path)), feedback(spark, path), NOW_US)


@query("rule_stats", with_ctes("ev", _STATS + " SELECT rule_id, checks, hits, round(time_ms, 6) AS time_ms, last_hit_us, round(recent_hit_rate, 6) AS recent_hit_rate, round(hit_rate, 6) AS hit_rate, round(avg_time_ms, 6) AS avg_time_ms FROM stt"))
def _stats(spark, path):
    return rounded(X.rule_stats(checks(spark, path)))


@query("running_hit_rate", with_ctes("ev", f", {_CHECKS} SELECT check_id, round(avg(hit::INT) OVER (PARTITION BY rule_id ORDER BY us, check_id ROWS 99 PRECEDING) * 100, 6) AS rate FROM ck"))
def _running(spark, path):
    return rounded(X.running_hit_rate(checks(spark, path)).select("check_id", "rate"))


@query("rule_effectiveness", with_ctes("ev", _STATS + " SELECT rule_id, round(score, 6) AS score FROM ef"))
def _eff(spark, path):
    return rounded(scored(spark, path).select("rule_id", "score"))


@query("reorder_rules", with_ctes("ev", _STATS + " SELECT rule_id, row_number() OVER (ORDER BY CASE WHEN checks > 10 THEN 0 ELSE 1 END, CASE WHEN checks > 10 THEN round(score, 9) END DESC, rule_id) AS position FROM ef"))
def _reorder(spark, path):
    s = scored(spark, path).withColumn("score", F.round("score", 9))
    return X.reorder_rules(s).select("rule_id", "position")


@query("prune_rules", with_ctes("ev", _STATS + " SELECT rule_id FROM ef WHERE checks >= 100 AND score < 0.55"))
def _prune(spark, path):
    return X.prune_rules(scored(spark, path), 0.55).select("rule_id")


@query("top_bottom_rules", with_ctes("ev", _STATS + """, r AS (SELECT rule_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, rule_id) AS a, row_number() OVER (ORDER BY round(score, 6), rule_id) AS b FROM ef)
  SELECT 'top' AS side, a AS rk, rule_id, score FROM r WHERE a <= 5 UNION ALL SELECT 'bottom', b, rule_id, score FROM r WHERE b <= 5"""))
def _top(spark, path):
    return X.top_bottom_rules(scored(spark, path).withColumn("score", F.round("score", 6)))


@query("reweighted_rules", with_ctes("ev", _STATS + " SELECT rule_id, left(rule_id, 3) AS category, round(0.9::DOUBLE * score, 6) AS confidence FROM ef WHERE score >= 0.5"))
def _reweighted(spark, path):
    r = checks(spark, path).select("rule_id").distinct().select("rule_id", F.left("rule_id", F.lit(3)).alias("category"), F.lit(0.9).alias("confidence"))
    return rounded(X.reweighted_rules(r, scored(spark, path), 0.5))


_CTX = "CASE " + " ".join(f"WHEN {any_of('lower(text)', ws)} THEN '{label}'" for label, ws in R.CONTEXT_WORDS.items()) + " ELSE 'general' END"
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{rid}' AS rule_id FROM prompts WHERE {matches('text', r.pattern, ignore_case=True)}" for rid, _, r in R.adaptive_rules())


@query("context_rules", with_ctes("prompts", f""", c AS (SELECT doc_id, {_CTX} AS context FROM prompts), h AS ({_HITS}),
  g AS (SELECT context, rule_id, count(*) AS n FROM h JOIN c USING (doc_id) GROUP BY ALL)
  SELECT * FROM (SELECT context, rule_id, n, row_number() OVER (PARTITION BY context ORDER BY n DESC, rule_id) AS rk FROM g) WHERE rk <= 20"""))
def _context(spark, path):
    a = rules.adaptive_scan(I.prompts(spark, path))
    return X.context_rules(unnest(a, "hits", "h", "context").select("context", "h.rule_id"))


@query("apply_feedback", with_ctes("ev", """, f AS (SELECT event_id % 1000 AS event_id, us, event_type AS label, event_id % 17 = 0 AS fp, event_id % 23 = 0 AS fn FROM ev WHERE event_id % 17 = 0 OR event_id % 23 = 0),
  l AS (SELECT event_id, arg_max(label, us) AS label, arg_max(fp, us) AS fp, arg_max(fn, us) AS fn FROM f GROUP BY 1)
  SELECT event_id, label, coalesce(fp, false) AS is_false_positive, coalesce(fn, false) AS is_false_negative FROM ev LEFT JOIN l USING (event_id)"""))
def _feedback(spark, path):
    e = I.events(spark, path)
    f = e.filter("event_id % 17 = 0 or event_id % 23 = 0").select(
        (F.col("event_id") % 1000).alias("event_id"), "us", F.col("event_type").alias("label"),
        (F.col("event_id") % 17 == 0).alias("is_false_positive"), (F.col("event_id") % 23 == 0).alias("is_false_negative"),
    )
    return X.apply_feedback(e.select("event_id"), f)
