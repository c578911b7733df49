"""Queries over A/B experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions import stats as S
from rampart.operators import experiments as E
from rampart.plans import inputs as I
from rampart.plans.inputs import NOW, with_ctes
from rampart.plans.registry import query
from rampart.plans.usage import rounded

BUCKET = """((((('0x' || substr(md5({k}), 1, 8))::BIGINT % 10000) * 7296 + ('0x' || substr(md5({k}), 9, 8))::BIGINT) % 10000 * 7296
  + ('0x' || substr(md5({k}), 17, 8))::BIGINT) % 10000 * 7296 + ('0x' || substr(md5({k}), 25, 8))::BIGINT) % 10000"""


# experiments come from suppliers, their variants from the supplier number, users are customers
def experiments(spark, path):
    s = I.table(spark, path, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("exp"), k.cast("string")).alias("experiment_id"),
        F.when(k % 4 == 0, "draft").when(k % 4 == 1, "paused").otherwise("running").alias("status"),
        F.when(k % 3 == 0, "strategy").otherwise("threshold").alias("type"),
        (F.lit(0.2) + (k % 5) * 0.2).alias("target_percentage"),
        F.when(k % 7 == 0, F.to_timestamp(F.lit("2024-02-10 00:00:00"))).otherwise(F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("start_time"),
        F.when(k % 11 == 0, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("end_time"), (k % 10 * 1000).alias("duration_hours"), k,
    )


def variants(spark, path):
    s = I.table(spark, path, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    shares = F.when(k % 2 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)))
    v = s.select("s_suppkey", F.posexplode(shares).alias("position", "traffic"))
    return v.select(
        F.concat(F.lit("exp"), k.cast("string")).alias("experiment_id"), F.concat(F.lit("v"), F.col("position").cast("string")).alias("variant_id"),
        "position", "traffic", (F.col("position") == 0).alias("is_control"),
    )


_EXPS = """exps AS (SELECT 'exp' || s_suppkey AS experiment_id, CASE s_suppkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'paused' ELSE 'running' END AS status,
  CASE WHEN s_suppkey % 3 = 0 THEN 'strategy' ELSE 'threshold' END AS type, 0.2::DOUBLE + (s_suppkey % 5) * 0.2::DOUBLE AS target_percentage,
  CASE WHEN s_suppkey % 7 = 0 THEN TIMESTAMP '2024-02-10' ELSE TIMESTAMP '2024-01-01' END AS start_time, CASE WHEN s_suppkey % 11 = 0 THEN TIMESTAMP '2024-01-15' END AS end_time,
  s_suppkey % 10 * 1000 AS duration_hours, s_suppkey FROM supplier)"""
# one experiment per customer, by nation, so that pairs stay one per user
_PAIRS = "pairs AS (SELECT 'exp' || (c_custkey % (SELECT count(*) FROM supplier)) AS experiment_id, c_custkey % (SELECT count(*) FROM supplier) AS k, c_custkey AS user_id, c_mktsegment AS segment FROM customer)"


def pairs(spark, path):
    n = I.table(spark, path, "supplier").agg(F.count("*").alias("n"))
    c = I.table(spark, path, "customer").join(F.broadcast(n))  # one row
    return c.select(
        F.concat(F.lit("exp"), (F.col("c_custkey") % F.col("n")).cast("string")).alias("experiment_id"),
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
    )


@query("in_sample", f"WITH {_PAIRS} SELECT experiment_id, user_id, {BUCKET.format(k=chr(39).join(['experiment_id || ', ':', ' || user_id || ', ':sample', '']))} / 10000.0 < 0.3 AS sampled FROM pairs".replace("':sample' ", "':sample'"))
def _sample(spark, path):
    p = pairs(spark, path)
    return p.select("experiment_id", "user_id", E.in_sample(p, F.col("experiment_id"), 0.3).alias("sampled"))


def _variant_sql(key: str) -> str:
    return f"""WITH {_PAIRS}, b AS (SELECT experiment_id, user_id, k, {BUCKET.format(k=key)} AS bucket FROM pairs)
      SELECT experiment_id, user_id, bucket::BIGINT AS bucket, CASE WHEN k % 2 = 0 THEN CASE WHEN bucket < 5000 THEN 'v0' ELSE 'v1' END
        ELSE CASE WHEN bucket < 2000 THEN 'v0' WHEN bucket < 5000 THEN 'v1' ELSE 'v2' END END AS variant_id FROM b"""


@query("assign_hash", _variant_sql("experiment_id || ':' || user_id || ':variant'"))
def _hash(spark, path):
    return E.assign_hash(pairs(spark, path), variants(spark, path)).select("experiment_id", "user_id", "bucket", "variant_id")


@query("assign_stratified", _variant_sql("experiment_id || ':' || user_id || ':' || segment || ':stratified'"))
def _strat(spark, path):
    return E.assign_hash(pairs(spark, path), variants(spark, path), "segment").select("experiment_id", "user_id", "bucket", "variant_id")


@query("assign_weighted")
def _weighted(spark, path):
    return E.assign_weighted(pairs(spark, path), variants(spark, path)).select("experiment_id", "user_id", "variant_id")


@query("assign_random")
def _random(spark, path):
    return E.assign_weighted(pairs(spark, path), variants(spark, path), seed=42).groupBy("variant_id").agg(F.count("*").alias("n"))


def users(spark, path):
    c = I.table(spark, path, "customer")
    n = I.table(spark, path, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("total_requests"))
    return c.join(n, "c_custkey", "left").select(
        F.col("c_custkey").alias("user_id"), "total_requests", F.when(F.col("c_acctbal") > 5000, "premium").otherwise("free").alias("user_type"),
        F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("region"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("beta"), F.lit("fast"))).otherwise(F.array(F.lit("beta"))).alias("feature_flags"),
    )


@query("target_users", """SELECT c_custkey AS user_id FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
  WHERE coalesce(n, 0) >= 8 AND c_acctbal > 5000 AND c_nationkey % 5 IN (1, 2) AND c_custkey % 2 = 0""")
def _target(spark, path):
    f = {"min_requests": 8, "user_type": "premium", "region": ["r1", "r2"], "feature_flags": ["beta", "fast"]}
    return E.target_users(users(spark, path), f).select("user_id")


_ASSIGN = f"""WITH {_PAIRS}, {_EXPS}, existing AS (SELECT experiment_id, user_id, 'v0' AS variant_id FROM pairs WHERE user_id % 9 = 0),
  act AS (SELECT * FROM exps WHERE status = 'running' AND start_time <= TIMESTAMP '{NOW}' AND (end_time IS NULL OR TIMESTAMP '{NOW}' <= end_time)),
  f AS (SELECT p.*, target_percentage FROM pairs p JOIN act USING (experiment_id) WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.experiment_id = p.experiment_id AND e.user_id = p.user_id)),
  s AS (SELECT * FROM f WHERE target_percentage >= 1.0 OR {BUCKET.format(k="experiment_id || ':' || user_id || ':sample'")} / 10000.0::DOUBLE < target_percentage),
  b AS (SELECT *, {BUCKET.format(k="experiment_id || ':' || user_id || ':variant'")} AS bucket FROM s),
  assigned AS (SELECT experiment_id, user_id, variant_id, false AS is_new FROM existing UNION ALL SELECT experiment_id, user_id,
   CASE WHEN k % 2 = 0 THEN CASE WHEN bucket < 5000 THEN 'v0' ELSE 'v1' END ELSE CASE WHEN bucket < 2000 THEN 'v0' WHEN bucket < 5000 THEN 'v1' ELSE 'v2' END END, true FROM b)"""


def assigned(spark, path):
    p = pairs(spark, path).select("experiment_id", "user_id")
    existing = p.filter("user_id % 9 = 0").withColumn("variant_id", F.lit("v0"))
    return E.assign(p, experiments(spark, path), variants(spark, path), existing, NOW)


@query("assign", _ASSIGN + " SELECT * FROM assigned")
def _assign(spark, path):
    return assigned(spark, path)


@query("assignment_stats", _ASSIGN + " SELECT experiment_id, variant_id, count(*) AS n FROM assigned GROUP BY ALL")
def _astats(spark, path):
    return E.assignment_stats(assigned(spark, path))


@query("check_experiments", f"""WITH {_EXPS}, v AS (SELECT s_suppkey AS k, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [0.5, 0.5] ELSE [0.2, 0.3, 0.5] END) + CASE WHEN s_suppkey % 6 = 0 THEN 0.1 ELSE 0 END AS traffic FROM supplier),
  g AS (SELECT k, count(*) AS n, sum(traffic) AS t FROM v GROUP BY k)
  SELECT experiment_id, ((abs(t - 1) > 0.001)::INT + (coalesce(end_time <= start_time, false))::INT + (duration_hours <= 0 OR duration_hours > 8760)::INT + (s_suppkey % 13 = 0)::INT)::INT AS n_problems FROM exps JOIN g ON k = s_suppkey""")
def _check(spark, path):
    v = variants(spark, path)
    k = F.regexp_extract("experiment_id", r"(\d+)", 1).cast("int")
    v = v.withColumns({
        "traffic": F.col("traffic") + F.when(k % 6 == 0, 0.1).otherwise(0.0), "is_control": F.col("is_control") & (k % 13 != 0),
    })
    return E.check_experiments(experiments(spark, path), v).select("experiment_id", F.size("problems").alias("n_problems"))


@query("explode_detection_metrics", with_ctes("ev", """, d AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant_id, user_id, value AS time_ms, (event_id % 100) / 100.0::DOUBLE AS confidence, event_id % 4 = 0 AS blocked,
   event_id % 6 = 0 AS hit, event_id % 10 IN (5, 6) AS pii, event_type AS provider FROM ev),
  l AS (SELECT variant_id, 'response_time_ms' AS metric_name, time_ms AS value FROM d UNION ALL SELECT variant_id, 'confidence', confidence FROM d UNION ALL SELECT variant_id, 'blocked', blocked::INT FROM d
   UNION ALL SELECT variant_id, 'cache_hit', hit::INT FROM d UNION ALL SELECT variant_id, 'pii_detected', pii::INT FROM d UNION ALL SELECT variant_id, 'provider_' || provider, 1 FROM d)
  SELECT variant_id, metric_name, count(*) AS n, round(sum(value), 4) AS total FROM l GROUP BY ALL"""))
def _explode(spark, path):
    e = I.experiment_metrics(spark, path).select(
        "variant_id", "user_id", F.col("value").alias("time_ms"), ((F.col("event_id") % 100) / 100.0).alias("confidence"),
        F.when(F.col("event_id") % 4 == 0, "block").otherwise("allow").alias("verdict"), (F.col("event_id") % 6 == 0).alias("cache_hit"),
        (F.col("event_id") % 10).isin(5, 6).alias("pii"), F.col("metric_name").alias("provider"),
    )
    return E.explode_detection_metrics(e).groupBy("variant_id", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_PCT = ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in E.PERCENTILES.items())


@query("metric_aggregates", with_ctes("experiment_metrics", f"""SELECT variant_id, metric_name, count(*) AS n, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
   round(coalesce(stddev_samp(value), 0), 6) AS std, {_PCT} FROM experiment_metrics GROUP BY ALL"""))
def _aggregates(spark, path):
    return rounded(E.metric_aggregates(I.experiment_metrics(spark, path), ["variant_id", "metric_name"]))


@query("variant_performance", with_ctes("experiment_metrics", """SELECT experiment_id, variant_id, count(*) AS events, count(DISTINCT user_id) AS users, min(us) AS first_us, max(us) AS last_us,
   round(count(*) / count(DISTINCT user_id)::DOUBLE, 6) AS events_per_user FROM experiment_metrics GROUP BY ALL"""))
def _performance(spark, path):
    return rounded(E.variant_performance(I.experiment_metrics(spark, path)))


@query("filter_metrics", with_ctes("experiment_metrics", """SELECT event_id, variant_id, metric_name, value FROM experiment_metrics WHERE variant_id = 'control' AND metric_name IN ('click', 'view')
   AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"""))
def _filter(spark, path):
    m = E.filter_metrics(I.experiment_metrics(spark, path), "exp1", ["control"], ["click", "view"], "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return m.select("event_id", "variant_id", "metric_name", "value")


_ARMS = """, g AS (SELECT experiment_id, metric_name, variant_id, count(*) AS n, avg(value) AS mean, var_samp(value) AS v, sum(value) AS s, avg((value > 50)::INT) AS share, sum((value > 50)::INT) AS hits FROM experiment_metrics GROUP BY ALL),
   a AS (SELECT c.experiment_id, c.metric_name, c.n AS cn, c.mean AS cm, c.v AS cv, c.share AS cs, c.hits AS ch, t.n AS tn, t.mean AS tm, t.v AS tv, t.share AS tsh, t.hits AS th
     FROM g c JOIN g t ON c.metric_name = t.metric_name AND c.variant_id = 'control' AND t.variant_id = 'treatment'),
   st AS (SELECT *, (tm - cm) / sqrt(cv / cn + tv / tn) AS t, (cv / cn + tv / tn) ** 2 / ((cv / cn) ** 2 / (cn - 1) + (tv / tn) ** 2 / (tn - 1)) AS df,
     sqrt(((cn - 1) * cv + (tn - 1) * tv) / (cn + tn - 2)) AS pooled FROM a)"""


@query("welch_t", with_ctes("experiment_metrics", _ARMS + " SELECT metric_name, cn AS c_n, tn AS t_n, round(t, 6) AS t, round(df, 3) AS df FROM st"))
def _welch(spark, path):
    w = E.welch_t(E.arms(I.experiment_metrics(spark, path)))
    return w.select("metric_name", "c_n", "t_n", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


def share_metrics(spark, path):
    return I.experiment_metrics(spark, path).withColumn("value", (F.col("value") > 50).cast("double"))


@query("proportion_z", with_ctes("experiment_metrics", _ARMS + """, p AS (SELECT *, (ch + th) / (cn + tn)::DOUBLE AS pool FROM st)
  SELECT metric_name, round((tsh - csh) / sqrt(pool * (1 - pool) * (1.0 / cn + 1.0 / tn)), 6) AS z FROM (SELECT *, cs AS csh FROM p)"""))
def _z(spark, path):
    return E.proportion_z(E.arms(share_metrics(spark, path))).select("metric_name", F.round("z", 6).alias("z"))


@query("mann_whitney", with_ctes("experiment_metrics", """, r AS (SELECT metric_name, variant_id, rank() OVER (PARTITION BY metric_name ORDER BY value) + (count(*) OVER (PARTITION BY metric_name, value) - 1) / 2.0 AS rk FROM experiment_metrics),
   s AS (SELECT metric_name, sum(rk) FILTER (variant_id = 'control') AS r1, count(*) FILTER (variant_id = 'control') AS n1, count(*) FILTER (variant_id = 'treatment') AS n2 FROM r GROUP BY 1)
   SELECT metric_name, n1, n2, round(least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2))::DOUBLE, 6) AS u FROM s"""))
def _mw(spark, path):
    u = E.mann_whitney(I.experiment_metrics(spark, path), "control", "treatment")
    return u.select("metric_name", "n1", "n2", F.round("u", 6).alias("u"))


@query("effect_size", with_ctes("experiment_metrics", _ARMS + " SELECT metric_name, round((tm - cm) / pooled, 6) AS cohens_d, round(2 * (asin(sqrt(tsh)) - asin(sqrt(cs))), 6) AS cohens_h FROM st"))
def _effect(spark, path):
    d = E.effect_size(E.arms(I.experiment_metrics(spark, path))).select("metric_name", F.round("cohens_d", 6).alias("cohens_d"))
    h = E.effect_size(E.arms(share_metrics(spark, path))).select("metric_name", F.round("cohens_h", 6).alias("cohens_h"))
    return d.join(h, "metric_name")


def analysis(spark, path):
    return E.analyze_experiment(I.experiment_metrics(spark, path), min_effect=0.01)


def _cdf_sql(x: str) -> str:
    z, poly = f"(abs({x}) / sqrt(2))", f"{S._ERFC[-1]}::DOUBLE"
    t = f"(1 / (1 + {z} * 0.5::DOUBLE))"
    for c in reversed(S._ERFC[:-1]):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    half = f"{t} * exp(-{z} * {z} + {poly}) * 0.5::DOUBLE"
    return f"CASE WHEN {x} >= 0 THEN 1 - {half} ELSE {half} END"


def _analysis_sql(metrics: str = "experiment_metrics") -> str:
    """CTE `an` over arms of at least 100 values each."""
    za, zb = repr(S.normal_ppf(0.975)), repr(S.normal_ppf(0.8))
    return _ARMS.replace("experiment_metrics", metrics) + f""", e AS (SELECT *, (tm - cm) / pooled AS d, sqrt((cn + tn) / (cn * tn)::DOUBLE + 0.5::DOUBLE / (cn + tn - 2)) AS se FROM st WHERE cn >= 100 AND tn >= 100),
   k AS (SELECT *, {za}::DOUBLE - abs(d) * sqrt(cn * tn / (cn + tn)::DOUBLE) AS x1, -{za}::DOUBLE - abs(d) * sqrt(cn * tn / (cn + tn)::DOUBLE) AS x2, abs(t) AS x3 FROM e),
   an AS (SELECT experiment_id, metric_name, cn, tn, cm, tm, cv, tv, t, df, d, d - se * {za}::DOUBLE AS d_low, d + se * {za}::DOUBLE AS d_high,
     greatest(0::DOUBLE, least(1::DOUBLE, 1 - ({_cdf_sql('x1')}) + ({_cdf_sql('x2')}))) AS power,
     CASE WHEN abs(d) < 1e-6 THEN 10000 ELSE greatest(10, ceil(power(({za}::DOUBLE + {zb}::DOUBLE) / d, 2) * 2)::BIGINT) END AS required_n,
     greatest(0::DOUBLE, least(1::DOUBLE, (1 - ({_cdf_sql('x3')})) * 2)) AS p_value FROM k)"""


@query("power_and_size", with_ctes("experiment_metrics", _analysis_sql() + " SELECT metric_name, round(power, 6) AS power, required_n, round(d_low, 6) AS d_low, round(d_high, 6) AS d_high FROM an"))
def _power(spark, path):
    return rounded(analysis(spark, path).select("metric_name", "power", "required_n", "d_low", "d_high"))


@query("analyze_experiment", with_ctes("experiment_metrics", _analysis_sql() + """ SELECT experiment_id, metric_name, 'treatment' AS t_variant_id, cn AS c_n, tn AS t_n, round(cm, 6) AS c_mean, round(tm, 6) AS t_mean, round(cv, 6) AS c_var, round(tv, 6) AS t_var,
   't_test' AS test, round(t, 6) AS statistic, round(p_value, 6) AS p_value, round(d, 6) AS effect, round(d_low, 6) AS d_low, round(d_high, 6) AS d_high, round(power, 6) AS power, required_n,
   p_value < 1 - 0.95::DOUBLE AS significant, abs(d) >= 0.01 AS practical FROM an"""))
def _analyze(spark, path):
    return rounded(analysis(spark, path).select(
        "experiment_id", "metric_name", "t_variant_id", "c_n", "t_n", "c_mean", "t_mean", "c_var", "t_var", "test", "statistic", "p_value",
        "effect", "d_low", "d_high", "power", "required_n", "significant", "practical",
    ))


@query("result_summary", with_ctes("experiment_metrics", _ARMS + """ SELECT metric_name, round((tm - cm) / cm * 100, 2) AS improvement_percent, round((tm - cm) / pooled, 4) AS effect_size, round(cm, 4) AS control_mean,
   round(tm, 4) AS treatment_mean, cn AS c_n, tn AS t_n, abs((tm - cm) / pooled) >= 0.01 AS practical FROM st WHERE cn >= 100 AND tn >= 100"""))
def _rsummary(spark, path):
    return E.result_summary(analysis(spark, path)).select("metric_name", "improvement_percent", "effect_size", "control_mean", "treatment_mean", "c_n", "t_n", "practical")


# guardrails: the means of two event types per hour
_RAILS = [("error", "max", 60.0, "pause"), ("click", "max", 100.0, "terminate"), ("view", "min", 25.0, "reduce")]
_VIOL = f""", w AS (SELECT experiment_id, metric_name, date_trunc('hour', ts) AS checked_at, avg(value) AS value FROM experiment_metrics GROUP BY ALL),
  gr AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{k}', {t}::DOUBLE, '{a}')" for m, k, t, a in _RAILS)}) AS t(metric_name, kind, threshold, act)),
  vi AS (SELECT w.*, kind, threshold, CASE act WHEN 'pause' THEN 'pause_experiment' WHEN 'terminate' THEN 'terminate_experiment' ELSE 'reduce_traffic' END AS action,
    CASE WHEN kind = 'max' THEN CASE WHEN value > threshold * 2 THEN 'critical' WHEN value > threshold * 1.5 THEN 'high' WHEN value > threshold * 1.2 THEN 'medium' ELSE 'low' END
     ELSE CASE WHEN value < threshold * 0.5 THEN 'critical' WHEN value < threshold * 0.7 THEN 'high' WHEN value < threshold * 0.8 THEN 'medium' ELSE 'low' END END AS severity
    FROM w JOIN gr USING (metric_name) WHERE CASE WHEN kind = 'max' THEN value > threshold ELSE value < threshold END)"""


def guardrails(spark):
    return spark.createDataFrame(_RAILS, "metric_name string, kind string, threshold double, action string")


def violations(spark, path):
    return E.guardrail_violations(E.window_values(I.experiment_metrics(spark, path), 60), guardrails(spark))


@query("guardrail_violations", with_ctes("experiment_metrics", _VIOL + " SELECT metric_name, kind, severity, action, epoch_us(checked_at) AS at, round(value, 6) AS value FROM vi"))
def _violations(spark, path):
    v = violations(spark, path)
    return v.select("metric_name", "kind", "severity", "action", F.unix_micros("checked_at").alias("at"), F.round("value", 6).alias("value"))


@query("experiment_health", with_ctes("experiment_metrics", _VIOL + """, pen AS (SELECT experiment_id, checked_at, sum(CASE severity WHEN 'critical' THEN 0.5::DOUBLE WHEN 'high' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) AS p FROM vi GROUP BY ALL),
   ch AS (SELECT experiment_id, checked_at, coalesce(-p, 0.1::DOUBLE) AS change, row_number() OVER (PARTITION BY experiment_id ORDER BY checked_at) AS rn
      FROM (SELECT DISTINCT experiment_id, date_trunc('hour', ts) AS checked_at FROM experiment_metrics) LEFT JOIN pen USING (experiment_id, checked_at)),
   h AS (WITH RECURSIVE g AS (SELECT experiment_id, 0::BIGINT AS rn, 1::DOUBLE AS health FROM (SELECT DISTINCT experiment_id FROM ch)
      UNION ALL SELECT ch.experiment_id, ch.rn, least(1::DOUBLE, greatest(0::DOUBLE, g.health + ch.change)) FROM g JOIN ch ON ch.experiment_id = g.experiment_id AND ch.rn = g.rn + 1) SELECT * FROM g)
   SELECT experiment_id, round(arg_max(health, rn), 6) AS health FROM h GROUP BY experiment_id"""))
def _health(spark, path):
    m = I.experiment_metrics(spark, path)
    checks = m.select("experiment_id", F.unix_micros(F.date_trunc("hour", "ts")).alias("at")).distinct()
    v = violations(spark, path).select("experiment_id", F.unix_micros("checked_at").alias("at"), "severity")
    return rounded(E.experiment_health(E.health_changes(v, checks)))


@query("safety_report", with_ctes("experiment_metrics", _VIOL + f""" SELECT experiment_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high,
   count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low, count(*) FILTER (checked_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS last_24h, epoch_us(max(checked_at)) AS last_violation FROM vi GROUP BY 1"""))
def _report(spark, path):
    return E.safety_report(violations(spark, path), NOW).withColumn("last_violation", F.unix_micros("last_violation"))


@query("last_violations", with_ctes("experiment_metrics", _VIOL + " SELECT * FROM (SELECT experiment_id, metric_name, epoch_us(checked_at) AS at, row_number() OVER (PARTITION BY experiment_id ORDER BY checked_at DESC, metric_name, kind) AS rk FROM vi) WHERE rk <= 10"))
def _last(spark, path):
    return E.last_violations(violations(spark, path)).select("experiment_id", "metric_name", F.unix_micros("checked_at").alias("at"), "rk")


# violations of many experiments: one per customer
_CV = "cv AS (SELECT 'exp' || (c_custkey % (SELECT count(*) FROM supplier)) AS experiment_id, CASE c_custkey % 40 WHEN 0 THEN 'terminate_experiment' WHEN 1 THEN 'pause_experiment' WHEN 2 THEN 'reduce_traffic' ELSE 'alert' END AS action FROM customer)"


@query("apply_actions", f"""WITH {_EXPS}, {_CV}, w AS (SELECT experiment_id, max(CASE action WHEN 'terminate_experiment' THEN 3 WHEN 'pause_experiment' THEN 2 WHEN 'reduce_traffic' THEN 1 ELSE 0 END) AS r, count(*) FILTER (action = 'reduce_traffic') AS k FROM cv GROUP BY 1)
  SELECT experiment_id, CASE WHEN r = 3 THEN 'terminated' WHEN r = 2 THEN 'paused' ELSE status END AS status, round(CASE WHEN k > 0 THEN greatest(0.01, target_percentage * 0.5 ** k) ELSE target_percentage END, 6) AS target_percentage FROM exps LEFT JOIN w USING (experiment_id)""")
def _actions(spark, path):
    n = I.table(spark, path, "supplier").agg(F.count("*").alias("n"))
    v = I.table(spark, path, "customer").join(F.broadcast(n)).select(  # one row
        F.concat(F.lit("exp"), (F.col("c_custkey") % F.col("n")).cast("string")).alias("experiment_id"),
        F.expr("CASE c_custkey % 40 WHEN 0 THEN 'terminate_experiment' WHEN 1 THEN 'pause_experiment' WHEN 2 THEN 'reduce_traffic' ELSE 'alert' END").alias("action"),
    )
    return rounded(E.apply_actions(experiments(spark, path), v).select("experiment_id", "status", "target_percentage"))


@query("experiment_stats", _ASSIGN + """ SELECT 'status' AS kind, status AS name, count(*) AS n FROM exps GROUP BY status UNION ALL SELECT 'type', type, count(*) FROM exps GROUP BY type
   UNION ALL SELECT 'table', 'assignments', (SELECT count(*) FROM assigned) UNION ALL SELECT 'table', 'metrics', (SELECT count(*) FROM events)""")
def _estats(spark, path):
    return E.experiment_stats(experiments(spark, path), {"assignments": assigned(spark, path), "metrics": I.experiment_metrics(spark, path)})


# the treatment lifts every metric by a half, so there is something to promote
@query("promotion_candidates", with_ctes("experiment_metrics", """, lifted AS (SELECT * REPLACE (CASE WHEN variant_id = 'treatment' THEN value * 1.5::DOUBLE ELSE value END AS value) FROM experiment_metrics)"""
   + _analysis_sql("lifted") + " SELECT experiment_id, metric_name, 'treatment' AS t_variant_id, round(d, 6) AS effect FROM an WHERE p_value < 1 - 0.95::DOUBLE AND abs(d) >= 0.05 AND d > 0"))
def _promote(spark, path):
    m = I.experiment_metrics(spark, path).withColumn("value", F.when(F.col("variant_id") == "treatment", F.col("value") * 1.5).otherwise(F.col("value")))
    return rounded(E.promotion_candidates(E.analyze_experiment(m)).select("experiment_id", "metric_name", "t_variant_id", "effect"))


@query("experiment_status", _ASSIGN + f""", a AS (SELECT experiment_id, count(*) AS n FROM assigned GROUP BY 1)
  SELECT experiment_id, status, coalesce(status = 'running' AND start_time <= TIMESTAMP '{NOW}' AND (end_time IS NULL OR TIMESTAMP '{NOW}' <= end_time), false) AS active, coalesce(n, 0) AS n_assigned FROM exps LEFT JOIN a USING (experiment_id)""")
def _status(spark, path):
    s = E.experiment_status(experiments(spark, path), assigned(spark, path), violations(spark, path), analysis(spark, path), NOW)
    return s.select("experiment_id", "status", "active", "n_assigned")
