"""Queries over threat indicators.  Indicators are made from the product table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions import rule_tables as R
from rampart.functions.regexes import sql_str
from rampart.operators import threats as T
from rampart.plans import inputs as I
from rampart.plans.inputs import NOW, NOW_US, with_ctes
from rampart.plans.registry import query
from rampart.plans.rules import matches
from rampart.plans.usage import rounded

_TECH = T.TECHNIQUES + ["data_extraction"]
_SEV = list(T.SEVERITIES)
_PHRASES = ["ignore all previous", "developer mode", "show me your prompt", "you must obey"]


def raw_indicators(spark, path):
    p = I.table(spark, path, "part")
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    now = F.to_timestamp(F.lit(NOW))
    return p.select(
        F.col("p_brand").alias("feed_id"), F.when(k % 40 < 4, pick(_PHRASES, k % 40)).otherwise(F.concat("p_name", F.lit(" "), "p_brand")).alias("pattern"),
        pick(_TECH, k % len(_TECH)).alias("technique"), pick(_SEV, F.col("p_size") % 5).alias("severity"), (F.lit(0.5) + (k % 50) / 100.0).alias("confidence"),
        (now - F.make_interval(days=F.col("p_size") * 10)).alias("first_seen"),
        F.when(F.col("p_size") % 3 == 0, now + F.make_interval(days=F.col("p_size") - 25)).alias("expires_at"),
        F.col("p_type").alias("description"), F.array(F.lower("p_type"), F.lit("auto")).alias("tags"), F.array("p_name").alias("iocs"),
        F.array(F.concat(F.lit("please "), F.col("p_name"), F.lit(" "), F.col("p_brand")), F.lit("enable developer mode 2 now")).alias("test_cases"),
        F.when(k % 6 == 0, 0.2).alias("fp_rate"), k.alias("seq"),
    )


def feeds(spark, path):
    b = I.table(spark, path, "part").select(F.col("p_brand").alias("feed_id")).distinct()
    n = F.regexp_extract("feed_id", r"(\d+)", 1).cast("int")
    return b.select(
        "feed_id", F.lit(0.6).alias("min_confidence"), F.lit(300).alias("max_age_days"),
        F.when(n % 2 == 0, F.array(F.lit("critical"), F.lit("high"), F.lit("medium"))).alias("severities"),
        (n % 3 != 0).alias("enabled"), (n * 600).alias("refresh_s"), F.when(n % 4 != 0, F.lit(NOW_US - 7_200_000_000)).alias("last_fetch_us"),
    )


def indicators(spark, path):
    return T.build_indicators(raw_indicators(spark, path), feeds(spark, path), NOW)


_L = lambda xs: "[" + ", ".join(sql_str(x) for x in xs) + "]"
_IND = f"""raw AS (SELECT p_brand AS feed_id, CASE WHEN p_partkey % 40 < 4 THEN {_L(_PHRASES)}[p_partkey % 40 + 1] ELSE p_name || ' ' || p_brand END AS pattern, {_L(_TECH)}[p_partkey % {len(_TECH)} + 1] AS technique0,
   {_L(_SEV)}[p_size % 5 + 1] AS severity, 0.5::DOUBLE + (p_partkey % 50) / 100.0::DOUBLE AS confidence, p_size * 10 AS age, CASE WHEN p_size % 3 = 0 THEN p_size - 25 END AS ttl, p_type AS description, p_name,
   CASE WHEN p_partkey % 6 = 0 THEN 0.2::DOUBLE END AS fp_rate, p_partkey AS seq, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part),
  ok AS (SELECT *, left(sha256(feed_id || ':' || pattern), 16) AS indicator_id, CASE WHEN technique0 = 'data_extraction' THEN 'unknown' ELSE technique0 END AS technique FROM raw
   WHERE confidence >= 0.6 AND age <= 300 AND (n % 2 = 1 OR severity IN ('critical', 'high', 'medium'))),
  ind AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY indicator_id ORDER BY seq DESC) = 1)"""


@query("build_indicators", f"WITH {_IND} SELECT indicator_id, feed_id, pattern, technique, severity, round(confidence, 6) AS confidence FROM ind")
def _build(spark, path):
    return rounded(indicators(spark, path).select("indicator_id", "feed_id", "pattern", "technique", "severity", "confidence"))


@query("validate_indicators")
def _validate(spark, path):
    return T.validate_indicators(indicators(spark, path).drop("fp_rate")).select("indicator_id", "valid", "fp_rate", "detection_rate", "accepted", "consistent", "confidence")


@query("test_pattern", """WITH s AS (SELECT unnest(['Hello, how are you?', 'What''s the weather today?', 'Can you help me with Python?', 'Tell me a joke', 'What is the capital of France?']) AS t)
  SELECT p_partkey, p_name AS pattern, round((SELECT count(*) FROM s WHERE contains(lower(t), lower(w))) / 5.0::DOUBLE, 6) AS fp_rate, (contains(lower(p_type), lower(w))::INT)::DOUBLE AS detection_rate
  FROM (SELECT *, ['joke', 'the', 'you', 'xyz', 'promo'][p_partkey % 5 + 1] AS w FROM part)""")
def _test(spark, path):
    word = F.element_at(F.array(*[F.lit(x) for x in ("joke", "the", "you", "xyz", "promo")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = I.table(spark, path, "part").select("p_partkey", "p_name", word.alias("pattern"), F.array("p_type").alias("test_cases"))
    return rounded(T.probe_patterns(p).select("p_partkey", F.col("p_name").alias("pattern"), "fp_rate", "detection_rate"))


@query("calibrate_confidence", f"""WITH {_IND} SELECT indicator_id, round(greatest(0, least(1, confidence * (1 - coalesce(fp_rate, 0) * 0.5) * (0.5 + (seq % 10) / 10.0 * 0.5) * CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.85 WHEN 'low' THEN 0.7 ELSE 0.5 END)), 6) AS calibrated FROM ind""")
def _calibrate(spark, path):
    i = indicators(spark, path).withColumns({"fp_rate": F.coalesce("fp_rate", F.lit(0.0)), "detection_rate": (F.col("seq") % 10) / 10.0})
    return rounded(T.calibrate_confidence(i).select("indicator_id", "calibrated"))


@query("active_indicators", f"WITH {_IND} SELECT indicator_id, technique, round(confidence, 6) AS confidence FROM ind WHERE technique = 'jailbreak' AND confidence >= 0.7 AND (ttl IS NULL OR ttl >= 0)")
def _active(spark, path):
    return rounded(T.active_indicators(indicators(spark, path), NOW, "jailbreak", 0.7).select("indicator_id", "technique", "confidence"))


@query("search_indicators", f"WITH {_IND} SELECT indicator_id FROM ind WHERE contains(lower(pattern), 'ring') OR contains(lower(description), 'ring') OR contains(lower(p_name), 'ring')")
def _search(spark, path):
    return T.search_indicators(indicators(spark, path), "RING").select("indicator_id")


_HITS = f""", h AS (SELECT doc_id, indicator_id, technique, severity, feed_id, confidence * (1 - coalesce(fp_rate, 0) * 0.5) AS confidence FROM ind JOIN prompts ON contains(lower(text), lower(pattern)))"""


def hits(spark, path, form=None):
    return T.match_indicators(I.prompts(spark, path).select("doc_id", "text"), indicators(spark, path), form)


_MATCH_SQL = with_ctes("prompts", f", {_IND}{_HITS} SELECT doc_id, indicator_id, technique, round(confidence, 6) AS confidence FROM h")


@query("match_indicators", _MATCH_SQL)
def _match(spark, path):
    return rounded(hits(spark, path).select("doc_id", "indicator_id", "technique", "confidence"))


@query("match_indicators_indexed", _MATCH_SQL)
def _match_indexed(spark, path):
    return rounded(hits(spark, path, "indexed").select("doc_id", "indicator_id", "technique", "confidence"))


@query("threat_verdicts", with_ctes("prompts", f", {_IND}{_HITS} SELECT doc_id, round(max(confidence), 6) AS threat_confidence, count(*) AS n_threats, CASE WHEN max(confidence) >= 0.9 THEN 'block' WHEN max(confidence) >= 0.5 THEN 'flag' ELSE 'allow' END AS threat_verdict FROM h GROUP BY doc_id"))
def _verdicts(spark, path):
    return rounded(T.threat_verdicts(hits(spark, path), "doc_id"))


@query("threat_context", with_ctes("prompts", f""", {_IND}{_HITS} SELECT doc_id, count(*) AS n_threats, list_sort(list(DISTINCT technique)) AS techniques, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' ELSE 'low' END AS severity,
   ((CASE WHEN bool_or(severity IN ('critical', 'high')) THEN 3 ELSE 0 END) + (bool_or(technique = 'jailbreak')::INT + bool_or(technique = 'encoding_obfuscation')::INT + bool_or(technique = 'prompt_leaking')::INT) * 2)::INT AS n_advice FROM h GROUP BY doc_id"""))
def _context(spark, path):
    return T.threat_context(hits(spark, path), "doc_id").withColumn("n_advice", F.size("recommendations")).drop("recommendations")


# reports: one per line item of the part behind an indicator
def reports(spark, path):
    li = I.table(spark, path, "lineitem").select(
        F.col("l_partkey").alias("seq0"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_quantity") > 20).alias("true_positive")
    )
    i = indicators(spark, path).select("indicator_id", F.col("seq").alias("seq0"))
    return li.join(i, "seq0").select("indicator_id", "us", "seq", "true_positive")


@query("indicator_feedback", f"""WITH RECURSIVE {_IND}, rp AS (SELECT indicator_id, l_quantity > 20 AS tp, row_number() OVER (PARTITION BY indicator_id ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem JOIN ind ON l_partkey = seq),
  fold AS (SELECT indicator_id, 0::BIGINT AS rn, confidence AS c, coalesce(fp_rate, 0) AS r FROM ind
   UNION ALL SELECT f.indicator_id, f.rn + 1, CASE WHEN tp THEN least(1, c * 1.02::DOUBLE) ELSE c * 0.95::DOUBLE END, CASE WHEN tp THEN r ELSE least(1, r * 0.9::DOUBLE + 0.1::DOUBLE) END FROM fold f JOIN rp ON rp.indicator_id = f.indicator_id AND rp.rn = f.rn + 1)
  SELECT indicator_id, round(arg_max(c, rn), 6) AS confidence, round(arg_max(r, rn), 6) AS fp_rate FROM fold GROUP BY indicator_id""")
def _feedback(spark, path):
    f = T.indicator_feedback(indicators(spark, path), reports(spark, path))
    return rounded(f.select("indicator_id", "confidence", F.coalesce("fp_rate", F.lit(0.0)).alias("fp_rate")))


@query("feed_statistics", f"""WITH {_IND}, g AS (SELECT feed_id, count(*) AS received FROM raw GROUP BY 1), k AS (SELECT feed_id, count(*) AS accepted, count(*) FILTER (ttl IS NULL OR ttl >= 0) AS active, avg(confidence) AS c FROM ind GROUP BY 1)
  SELECT feed_id, received, coalesce(accepted, 0) AS accepted, received - coalesce(accepted, 0) AS rejected, coalesce(active, 0) AS active, round(c, 6) AS avg_confidence FROM g LEFT JOIN k USING (feed_id)""")
def _feed_stats(spark, path):
    return rounded(T.feed_statistics(raw_indicators(spark, path), indicators(spark, path), NOW))


@query("feeds_due", f"""SELECT feed_id FROM (SELECT DISTINCT p_brand AS feed_id, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part) WHERE n % 3 <> 0 AND (n % 4 = 0 OR 7200 >= n * 600)""")
def _due(spark, path):
    return T.feeds_due(feeds(spark, path), NOW_US).select("feed_id")


@query("remove_feed", f"WITH {_IND} SELECT indicator_id FROM ind WHERE n % 3 <> 0")
def _remove(spark, path):
    gone = feeds(spark, path).filter(~F.col("enabled"))
    return T.remove_feed(indicators(spark, path), gone).select("indicator_id")


_SCORES = {t: " + ".join(f"({matches('lower(text)', p, ignore_case=True)})::INT" for p in ps) for t, ps in R.TECHNIQUE_RULES.items()}


@query("classify_technique", with_ctes("prompts", ", s AS (SELECT doc_id, [" + ", ".join(_SCORES.values()) + "] AS sc FROM prompts) SELECT doc_id, CASE WHEN list_max(sc) = 0 THEN 'unknown' ELSE " + _L(list(_SCORES)) + "[list_position(sc, list_max(sc))] END AS technique FROM s"))
def _technique(spark, path):
    return I.prompts(spark, path).select("doc_id", T.classify_technique("text").alias("technique"))


@query("extract_indicator_patterns")
def _extract(spark, path):
    return T.extract_indicator_patterns(indicators(spark, path))


@query("regex_from_examples")
def _examples(spark, path):
    p = I.table(spark, path, "part").select(
        F.concat("p_brand", F.lit("/"), "p_type").alias("grp"), "p_partkey", F.concat(F.lit("enable "), "p_type", F.lit(" mode for "), "p_name").alias("text")
    )
    return T.regex_from_examples(p, "grp", "p_partkey")
