"""Queries over scoring, verdicts, composite detection and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions.unnest import unnest
from rampart.functions import rule_tables as R
from rampart.functions.regexes import sql_regex, sql_str
from rampart.functions.text import BASE64_RUN
from rampart.operators import pii as P
from rampart.operators import rules
from rampart.operators import verdicts as V
from rampart.plans import inputs as I
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import query
from rampart.plans.rules import any_of, family_tests, hit_count_sql, matches, max_conf_sql
from rampart.plans.spans import SHOWN, luhn_sql, replaced_ctes, span_ctes
from rampart.plans.text import SPECIAL, complexity_sql, sanitize_sql

TESTS = family_tests(rules.FAMILY_NAMES)
PROMPT_TESTS = family_tests(rules.FAMILY_NAMES, role="'user'")


def mode_sql(conf: str, n: str, mode: str) -> str:
    block, strip, flag = R.MODE_THRESHOLDS[mode]
    return f"CASE WHEN {n} = 0 THEN 'allow' WHEN {conf} >= {block}::DOUBLE THEN 'block' WHEN {conf} >= {strip}::DOUBLE THEN 'strip' WHEN {conf} >= {flag}::DOUBLE THEN 'flag' ELSE 'allow' END"


def scored_cte(name: str, table: str, key: str, tests) -> str:
    return f"{name} AS (SELECT {key}, ({hit_count_sql(tests)}) AS n, {max_conf_sql(tests)} AS c FROM {table})"


def heuristic_cte(mode: str) -> str:
    return f""", sc AS (SELECT conv_id, turn, role, ({hit_count_sql(TESTS)}) AS n, {max_conf_sql(TESTS)} AS c FROM messages),
      hc AS (SELECT conv_id, sum(n)::BIGINT AS n_reasons, greatest(0::DOUBLE, max(c) - {R.MODE_SHIFT[mode]}::DOUBLE) AS confidence FROM sc GROUP BY conv_id),
      heur AS (SELECT conv_id, n_reasons, confidence, {mode_sql('confidence', 'n_reasons', mode)} AS verdict FROM hc)"""


@query("verdicts_by_role", with_ctes("messages", f""", sc AS (SELECT conv_id, turn, role, ({hit_count_sql(TESTS)}) AS n, {max_conf_sql(TESTS)} AS c FROM messages),
   v AS (SELECT role, greatest(0::DOUBLE, c - 0.1::DOUBLE) AS c, n FROM sc)
   SELECT role, {mode_sql('c', 'n', 'moderate')} AS verdict, count(*) AS n, round(avg(c), 6) AS avg_confidence FROM v GROUP BY ALL"""))
def verdicts_by_role(spark, path):
    m = rules.with_reasons(I.messages(spark, path)).select(
        "role", F.size("reasons").alias("n"),
        F.greatest(F.lit(0.0), V.max_confidence(F.col("reasons")) - 0.1).alias("c"),
    )
    v = m.select("role", "c", V.mode_verdict(F.col("c"), F.col("n"), "moderate").alias("verdict"))
    return v.groupBy("role", "verdict").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("avg_confidence"))


def _heur(mode):
    def run(spark, path):
        h = V.heuristic_verdict(I.messages(spark, path), mode)
        return h.select("conv_id", "n_reasons", F.round("confidence", 6).alias("confidence"), "verdict")

    return run


for _mode in R.MODE_SHIFT:
    query(
        "heuristic_verdict" if _mode == "moderate" else f"heuristic_verdict_{_mode}",
        with_ctes("messages", heuristic_cte(_mode) + " SELECT conv_id, n_reasons, round(confidence, 6) AS confidence, verdict FROM heur"),
    )(_heur(_mode))


RANK = "CASE {v} WHEN 'block' THEN 5 WHEN 'redact' THEN 4 WHEN 'strip' THEN 3 WHEN 'flag' THEN 2 ELSE 1 END"
UNRANK = "CASE {r} WHEN 5 THEN 'block' WHEN 4 THEN 'redact' WHEN 3 THEN 'strip' WHEN 2 THEN 'flag' ELSE 'allow' END"


def combine_sql(h: str, m: str, p: str, hc: str, mc: str) -> tuple[str, str]:
    """(mean, verdict) in SQL; `mean` is also used inside verdict by name."""
    mean0 = f"CASE WHEN ({hc} > 0)::INT + ({mc} > 0)::INT = 0 THEN 0::DOUBLE ELSE (CASE WHEN {hc} > 0 THEN {hc} ELSE 0 END + CASE WHEN {mc} > 0 THEN {mc} ELSE 0 END) / (({hc} > 0)::INT + ({mc} > 0)::INT) END"
    mean = f"CASE WHEN {h} <> 'allow' AND {h} = {m} THEN least(1::DOUBLE, ({mean0}) * 1.15::DOUBLE) ELSE {mean0} END"
    ranks = ", ".join("(" + RANK.format(v=x) + ")" for x in (h, m, p))
    worst = f"greatest({ranks})"
    verdict = f"CASE WHEN mean < 0.7 AND worst = 5 THEN 'strip' WHEN mean < 0.7 AND worst = 3 THEN 'flag' ELSE {UNRANK.format(r='worst')} END"
    return f"{mean} AS mean, {worst} AS worst", verdict


# stored answers of one model per conversation, from the conversation number
_ANS = """ans AS (SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'strip' WHEN 2 THEN 'flag' ELSE 'allow' END AS model_verdict,
  (CASE WHEN conv_id % 5 = 4 THEN 0 ELSE 0.4 + (conv_id % 7) / 10.0 END)::DOUBLE AS model_confidence FROM (SELECT DISTINCT conv_id FROM conversations))"""


def stored_answers(spark, path):
    c = I.table(spark, path, "conversations").select("conv_id").distinct()
    return c.select(
        "conv_id", V.by_name({0: "block", 1: "strip", 2: "flag"}, F.col("conv_id") % 5, "allow").alias("model_verdict"),
        F.when(F.col("conv_id") % 5 == 4, 0.0).otherwise(F.lit(0.4) + (F.col("conv_id") % 7) / 10.0).alias("model_confidence"),
    )


_PARTS, _VERDICT = combine_sql("h.verdict", "a.model_verdict", "'allow'", "h.confidence", "a.model_confidence")


@query("combine_verdicts", with_ctes("messages", heuristic_cte("moderate") + f""", {_ANS},
  x AS (SELECT conv_id, {_PARTS} FROM heur h JOIN ans a USING (conv_id))
  SELECT conv_id, round(mean, 6) AS confidence, {_VERDICT} AS verdict FROM x"""))
def _combine(spark, path):
    h = V.heuristic_verdict(I.messages(spark, path)).select(
        "conv_id", F.col("verdict").alias("heuristic_verdict"), F.col("confidence").alias("heuristic_confidence")
    )
    out = V.combine_verdicts(h.join(stored_answers(spark, path), "conv_id"))
    return out.select("conv_id", F.round("confidence", 6).alias("confidence"), "verdict")


def reported_sql(text: str = "text") -> str:
    """Does the text hold a reported item?  Overlap removal cannot drop the last one of a place,
    but a low one may shadow a reported one, so oracles only use it on texts of one type."""
    parts = []
    for p in P.PATTERNS:
        if p.kind == "credit_card":
            if p.confidence >= 0.7:
                found = f"regexp_extract_all({text}, {sql_str(sql_regex(p.pattern, ignore_case=True))})"
                parts.append(f"len(list_filter({found}, lambda x: {luhn_sql('x')})) > 0")
        elif p.confidence >= 0.7:
            parts.append(matches(text, p.pattern, ignore_case=True))
    return "(" + " OR ".join(parts) + ")"


_WP, _WV = combine_sql("hv", "mv", "pv", "hc", "mc")


@query("detect", with_ctes("messages", heuristic_cte("moderate") + span_ctes("messages", "conv_id, turn") + f""", {_ANS},
   shape AS (SELECT conv_id, count(*) AS message_count, count(*) FILTER (role = 'system') = 1 AND coalesce(max(turn) FILTER (role = 'system') < min(turn) FILTER (role = 'user'), true) AS format_valid FROM messages GROUP BY conv_id),
   reported AS (SELECT conv_id, count(*) AS pii_count FROM kept WHERE confidence >= 0.7 GROUP BY conv_id),
   d AS (SELECT conv_id, message_count, format_valid, n_reasons, coalesce(pii_count, 0) AS pii_count, h.verdict AS hv, h.confidence AS hc, model_verdict AS mv, model_confidence AS mc,
      CASE WHEN pii_count > 0 THEN 'redact' ELSE 'allow' END AS pv FROM heur h JOIN shape USING (conv_id) JOIN ans USING (conv_id) LEFT JOIN reported USING (conv_id)),
   x AS (SELECT *, {_WP} FROM d)
   SELECT conv_id, message_count, n_reasons + (pii_count > 0)::INT AS n_reasons, pii_count, hv AS heuristic_verdict, pv AS pii_verdict, format_valid, round(mean, 6) AS confidence, {_WV} AS verdict FROM x"""))
def _detect(spark, path):
    d = V.detect(I.messages(spark, path), answers=stored_answers(spark, path))
    return d.select(
        "conv_id", "message_count", "n_reasons", "pii_count", "heuristic_verdict", "pii_verdict", "format_valid",
        F.round("confidence", 6).alias("confidence"), "verdict",
    )


_HP, _HV = combine_sql("v", "'allow'", "'allow'", "c", "0::DOUBLE")


@query("detect_heuristic", with_ctes("messages", heuristic_cte("moderate") + f""", x AS (SELECT conv_id, {_HP.replace("(c ", "(c ")} FROM (SELECT conv_id, confidence AS c, verdict AS v FROM heur))
  SELECT conv_id, round(mean, 6) AS confidence, {_HV} AS verdict FROM x"""))
def _detect_heuristic(spark, path):
    d = V.detect(I.messages(spark, path), pii=False)
    return d.select("conv_id", F.round("confidence", 6).alias("confidence"), "verdict")


# prompts, rules and personal data together; rows whose text is changed by overlap are the same on both sides
_DP, _DV = combine_sql("v", "'allow'", "pv", "c", "0::DOUBLE")


@query("detect_prompts", with_ctes("prompts", f""", s AS (SELECT doc_id, ({hit_count_sql(PROMPT_TESTS)}) AS n, {max_conf_sql(PROMPT_TESTS)} AS c0, {reported_sql()} AS has_pii FROM prompts),
   t AS (SELECT doc_id, n, greatest(0::DOUBLE, c0 - 0.1::DOUBLE) AS c, CASE WHEN has_pii THEN 'redact' ELSE 'allow' END AS pv FROM s),
   u AS (SELECT *, {mode_sql('c', 'n', 'moderate')} AS v FROM t), x AS (SELECT doc_id, pv, {_DP} FROM u)
   SELECT doc_id, pv AS pii_verdict, round(mean, 6) AS confidence, {_DV} AS verdict FROM x"""))
def _detect_prompts(spark, path):
    d = V.detect(I.prompt_messages(spark, path))
    return d.select(F.col("conv_id").alias("doc_id"), "pii_verdict", F.round("confidence", 6).alias("confidence"), "verdict")


@query("detect_off", "SELECT conv_id, count(*) AS message_count, 'allow' AS verdict, 0.0::DOUBLE AS confidence, 'benign' AS category FROM conversations GROUP BY conv_id")
def _detect_off(spark, path):
    return V.detect(I.messages(spark, path), heuristics=False, pii=False)


_RP, _RV = combine_sql("hv", "'allow'", "pv", "hc", "0::DOUBLE")


@query("rewrite", with_ctes("messages", heuristic_cte("moderate") + span_ctes("messages", "conv_id, turn") + replaced_ctes("messages", "conv_id, turn", SHOWN) + f""",
   reported AS (SELECT DISTINCT conv_id FROM kept WHERE confidence >= 0.7),
   d AS (SELECT h.conv_id, h.verdict AS hv, h.confidence AS hc, CASE WHEN r.conv_id IS NULL THEN 'allow' ELSE 'redact' END AS pv FROM heur h LEFT JOIN reported r ON r.conv_id = h.conv_id),
   x AS (SELECT conv_id, {_RP} FROM d), v AS (SELECT conv_id, {_RV} AS verdict FROM x), w AS (SELECT conv_id, max(c) > 0.8 AS aggressive FROM sc GROUP BY conv_id)
   SELECT m.conv_id, m.turn, CASE WHEN verdict IN ('strip', 'redact') THEN verdict END AS verdict,
     CASE verdict WHEN 'strip' THEN {sanitize_sql('m.text', 'coalesce(aggressive, false)')} WHEN 'redact' THEN r.changed END AS modified
   FROM messages m JOIN v USING (conv_id) JOIN w USING (conv_id) JOIN replaced r ON r.conv_id = m.conv_id AND r.turn = m.turn"""))
def _rewrite(spark, path):
    m = I.messages(spark, path)
    return V.rewrite(m, V.detect(m)).select("conv_id", "turn", "verdict", "modified")


@query("batch_statistics", with_ctes("ev", """, r AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' END AS error, value AS time_ms, (event_id % 100) / 100.0::DOUBLE AS confidence,
    CASE event_id % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'flag' WHEN 2 THEN 'strip' ELSE 'allow' END AS verdict, event_id % 6 = 0 AS cache_hit FROM ev)
  SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, min(time_ms) AS min_time_ms,
   round(avg(time_ms), 6) AS avg_time_ms, max(time_ms) AS max_time_ms, round(avg(confidence) FILTER (error IS NULL), 6) AS avg_confidence,
   round(count(*) FILTER (error IS NULL AND cache_hit) / count(*) FILTER (error IS NULL)::DOUBLE, 6) AS cache_hit_rate,
   count(*) FILTER (error IS NULL AND verdict = 'allow') AS n_allow, count(*) FILTER (error IS NULL AND verdict = 'flag') AS n_flag,
   count(*) FILTER (error IS NULL AND verdict = 'strip') AS n_strip, count(*) FILTER (error IS NULL AND verdict = 'redact') AS n_redact,
   count(*) FILTER (error IS NULL AND verdict = 'block') AS n_block FROM r"""))
def _batch(spark, path):
    e = I.events(spark, path).select(
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("time_ms"),
        ((F.col("event_id") % 100) / 100.0).alias("confidence"),
        V.by_name({0: "block", 1: "flag", 2: "strip"}, F.col("event_id") % 4, "allow").alias("verdict"), (F.col("event_id") % 6 == 0).alias("cache_hit"),
    )
    out = V.batch_statistics(e)
    return out.select(*[F.round(c, 6).alias(c) if c in ("avg_time_ms", "avg_confidence", "cache_hit_rate") else F.col(c) for c in out.columns])


_AP, _AV = combine_sql("v", "'allow'", "pv", "c", "0::DOUBLE")
_ANALYZE = f""", s AS (SELECT conv_id, turn, role, ({hit_count_sql(TESTS)}) AS n, {max_conf_sql(TESTS)} AS c0, {reported_sql()} AS has_pii FROM messages),
   t AS (SELECT *, greatest(0::DOUBLE, c0 - 0.1::DOUBLE) AS c, CASE WHEN has_pii THEN 'redact' ELSE 'allow' END AS pv FROM s),
   u AS (SELECT *, {mode_sql('c', 'n', 'moderate')} AS v FROM t), x AS (SELECT conv_id, turn, role, n + has_pii::INT AS n_reasons, {_AP} FROM u),
   an AS (SELECT conv_id, turn, role, n_reasons, {_AV} AS verdict, mean AS confidence FROM x)"""


@query("analyze", with_ctes("messages", _ANALYZE + " SELECT conv_id, turn, role, n_reasons::INT AS n_reasons, verdict, round(confidence, 6) AS confidence FROM an"))
def _analyze(spark, path):
    return V.analyze(I.messages(spark, path)).withColumn("confidence", F.round("confidence", 6))


@query("overall_risk", with_ctes("messages", _ANALYZE + """ SELECT conv_id, round(max(confidence), 6) AS overall_risk, bool_or(role = 'system') AS has_system, bool_or(role = 'user') AS has_user,
   bool_or(role = 'system') AND bool_or(role = 'user') AND coalesce(max(turn) FILTER (role = 'system') < min(turn) FILTER (role = 'user'), true) AS properly_formatted FROM an GROUP BY conv_id"""))
def _risk(spark, path):
    m = I.messages(spark, path)
    return V.overall_risk(V.analyze(m), m).withColumn("overall_risk", F.round("overall_risk", 6))


_LONG = " UNION ALL ".join(f"SELECT conv_id, '{cat}' AS category, 'heuristic' AS source, {conf}::DOUBLE AS confidence FROM messages WHERE {cond}" for cond, cat, conf in TESTS)


@query("risk_assessment", with_ctes("messages", heuristic_cte("moderate") + f""", lr AS ({_LONG}),
  p AS (SELECT conv_id, avg(confidence) AS m, (bool_or(category = 'direct_injection'))::INT + (bool_or(category = 'jailbreak'))::INT AS k FROM lr GROUP BY conv_id)
  SELECT conv_id, verdict, CASE verdict WHEN 'block' THEN 'high' WHEN 'strip' THEN 'medium' WHEN 'flag' THEN 'low' ELSE 'none' END AS threat_level,
   round(m, 6) AS heuristic_mean, greatest(coalesce(k, 0), 1)::INT AS n_suggestions FROM heur LEFT JOIN p USING (conv_id)"""))
def _assessment(spark, path):
    m = I.messages(spark, path)
    long = unnest(rules.with_reasons(m), "reasons", "r", "conv_id").select("conv_id", "r.*")
    a = V.risk_assessment(V.heuristic_verdict(m), long)
    return a.select("conv_id", "verdict", "threat_level", F.round("heuristic_mean", 6).alias("heuristic_mean"), F.size("suggestions").alias("n_suggestions"))


def provider_answers(spark, path):
    """Three providers' answers for every document, by document number."""
    d = I.table(spark, path, "documents").select("doc_id")
    cats = F.array(*[F.lit(c) for c in R.CATEGORY_SEVERITY])
    one = d.select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    return one.select(
        "doc_id", F.element_at(F.array(F.lit("anthropic"), F.lit("openai"), F.lit("gemini")), F.col("i") + 1).alias("provider"),
        F.element_at(cats, (F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 8).otherwise((F.col("doc_id") + F.col("i") * 3) % 8) + 1).cast("int")).alias("category"),
        ((F.col("doc_id") * 7 + F.col("i") * 13) % 100 / 100.0).alias("confidence"),
        ((F.col("doc_id") + F.col("i")) % 4 != 0).alias("success"),
    )


_CATS = "[" + ", ".join(sql_str(c) for c in R.CATEGORY_SEVERITY) + "]"
_PANS = f"""pa AS (SELECT doc_id, i, ['anthropic', 'openai', 'gemini'][i + 1] AS provider,
   {_CATS}[CASE WHEN doc_id % 3 = 0 THEN doc_id % 8 ELSE (doc_id + i * 3) % 8 END + 1] AS category,
   ((doc_id * 7 + i * 13) % 100) / 100.0::DOUBLE AS confidence, (doc_id + i) % 4 <> 0 AS success FROM documents, (SELECT unnest([0, 1, 2]) AS i))"""


@query("consensus", f"""WITH {_PANS}, g AS (SELECT doc_id, count(*) AS n_answers, avg(confidence) AS m, count(DISTINCT category) AS k, min(list_position({_CATS}, category)) AS r FROM pa WHERE success GROUP BY doc_id),
  c AS (SELECT doc_id, n_answers, {_CATS}[r] AS category, CASE WHEN k = 1 AND r < 8 THEN least(1::DOUBLE, m * 1.2::DOUBLE) ELSE m END AS confidence FROM g)
  SELECT doc_id, n_answers, category, round(confidence, 6) AS confidence, CASE WHEN category = 'benign' THEN 'allow'
    WHEN category IN ('direct_injection', 'jailbreak', 'prompt_leak') THEN CASE WHEN confidence >= 0.7 THEN 'block' WHEN confidence >= 0.5 THEN 'strip' ELSE 'flag' END
    WHEN category IN ('indirect_injection', 'role_manipulation', 'context_switching') THEN CASE WHEN confidence >= 0.8 THEN 'block' WHEN confidence >= 0.6 THEN 'strip' ELSE 'flag' END
    ELSE CASE WHEN confidence >= 0.9 THEN 'strip' WHEN confidence >= 0.7 THEN 'flag' ELSE 'allow' END END AS verdict FROM c""")
def _consensus(spark, path):
    return V.consensus(provider_answers(spark, path).filter("success"), "doc_id").withColumn("confidence", F.round("confidence", 6))


@query("failover_pick", f"WITH {_PANS} SELECT doc_id, provider, category, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rk FROM pa WHERE success) WHERE rk = 1")
def _failover(spark, path):
    return V.failover_pick(provider_answers(spark, path), "doc_id", ["anthropic", "openai", "gemini"])


@query("full_analysis", with_ctes("messages", heuristic_cte("moderate") + f""", {_ANS},
  hx AS (SELECT conv_id, confidence, CASE WHEN confidence < 0.7 AND verdict = 'block' THEN 'strip' WHEN confidence < 0.7 AND verdict = 'strip' THEN 'flag' ELSE verdict END AS verdict FROM heur),
  mx AS (SELECT conv_id, model_confidence AS confidence, CASE WHEN model_confidence < 0.7 AND model_verdict = 'block' THEN 'strip' WHEN model_confidence < 0.7 AND model_verdict = 'strip' THEN 'flag' ELSE model_verdict END AS verdict FROM ans),
  u AS (SELECT * FROM hx UNION ALL SELECT * FROM mx), g AS (SELECT conv_id, max(confidence) AS confidence, max({RANK.format(v='verdict')}) AS r FROM u GROUP BY conv_id)
  SELECT conv_id, round(confidence, 6) AS confidence, {UNRANK.format(r='r')} AS verdict FROM g"""))
def _full(spark, path):
    m = I.messages(spark, path)
    h = V.detect(m, pii=False)
    a = V.detect(m, heuristics=False, pii=False, answers=stored_answers(spark, path))
    return V.full_analysis([h, a]).withColumn("confidence", F.round("confidence", 6))


def _score_sql() -> str:
    t, low = "text", "lower(text)"
    m = lambda p, **f: matches(t, p, **f)
    zero = " OR ".join(f"contains({t}, chr({c}))" for c in (8203, 8204, 8205, 65279))
    flags = {
        "boosts": f"({m('[^\\x00-\\x7F]')})::INT + ({m('[\\x00-\\x1F\\x7F]')})::INT + ({m('{{.*?}}')})::INT + ({m(chr(92) + '${.*?}')})::INT + ({m('`.*?`')})::INT",
        "hex": m(r"(?:\\x[0-9a-fA-F]{2}){3,}"), "uni": m(r"(?:\\u[0-9a-fA-F]{4}){3,}"), "url": m(r"(?:%[0-9a-fA-F]{2}){3,}"),
        "obf": f"({zero} OR {m(chr(92) + 's{10,}')} OR {m('(?:[a-z][A-Z]|[A-Z][a-z]){5,}')})",
        "overrides": " + ".join(f"({m(p, ignore_case=True)})::INT" for p in R.OVERRIDE_RULES),
        "code": " + ".join(f"({m(p, ignore_case=True)})::INT" for p in R.CODE_INJECTION_RULES),
        "role_hits": " + ".join(f"(contains({low}, {sql_str(w)}))::INT" for w in R.ROLE_WORDS),
        "sys_in_user": any_of(low, ["system:", "[system]", "<system>"]),
        "n": f"length({t})", "w": f"len(regexp_extract_all({t}, '\\S+'))", "sp": f"length(regexp_replace({t}, {sql_str(SPECIAL)}, '', 'g'))",
        "b64": f"regexp_extract_all({t}, {sql_str(BASE64_RUN)})",
    }
    cols = ", ".join(f"{v} AS {k}" for k, v in flags.items())
    return f""", f AS (SELECT doc_id, {cols} FROM prompts),
     l0 AS (SELECT *, (CASE WHEN n < 100 THEN 0.1 WHEN n < 500 THEN 0.3 WHEN n < 1000 THEN 0.5 WHEN n < 5000 THEN 0.7 ELSE least(1::DOUBLE, 0.7::DOUBLE + (n - 5000) / 10000::DOUBLE) END)::DOUBLE AS len0 FROM f),
     s AS (SELECT *, CASE WHEN n / greatest(w, 1)::DOUBLE > 10 THEN least(1::DOUBLE, len0 * 1.2::DOUBLE) ELSE len0 END AS length_score,
       least(1::DOUBLE, least(1::DOUBLE, sp / n::DOUBLE * 3) + boosts * 0.1::DOUBLE) AS special_char_score,
       least(1::DOUBLE, least(len(b64), 3) * 0.3::DOUBLE + hex::INT * 0.3::DOUBLE + uni::INT * 0.2::DOUBLE + url::INT * 0.2::DOUBLE + obf::INT * 0.3::DOUBLE) AS encoding_score,
       least(1::DOUBLE, least(role_hits, 2) * 0.3::DOUBLE + sys_in_user::INT * 0.3::DOUBLE) AS semantic_score,
       overrides > 0 OR code > 0 OR role_hits > 0 OR sys_in_user AS critical,
       len(b64) > 2 OR coalesce(list_max(list_transform(b64, lambda x: length(x))), 0) > 100 OR hex OR uni OR url AS enc_risk FROM l0),
     cs AS (SELECT * FROM s)"""


_SCORE = _score_sql()


# The block-repetition test has no affordable SQL form, so the oracle covers the other factors
# and the whole score is checked against a plain computation in the tests.
@query("complexity_factors", with_ctes("prompts", _SCORE + """ SELECT doc_id, critical, enc_risk, overrides > 0 AS overrides, code > 0 AS code, obf AS obfuscated, round(length_score, 6) AS length_score,
   round(special_char_score, 6) AS special_char_score, round(encoding_score, 6) AS encoding_score, round(semantic_score, 6) AS semantic_score FROM cs"""))
def _factors(spark, path):
    s = V.complexity_score(I.prompt_messages(spark, path), single=True)
    risk = lambda name: F.array_contains("risks", name)
    return s.select(
        F.col("conv_id").alias("doc_id"), "critical", risk("encoding").alias("enc_risk"), risk("instruction_override").alias("overrides"),
        risk("code_injection").alias("code"), risk("obfuscation").alias("obfuscated"),
        *[F.round(c, 6).alias(c) for c in R.FACTOR_WEIGHTS if c != "pattern_score"],
    )


@query("complexity_score")
def _complexity(spark, path):
    s = V.complexity_score(I.prompt_messages(spark, path), single=True)
    return s.select(F.col("conv_id").alias("doc_id"), "level", "critical", *[F.round(c, 6).alias(c) for c in ("score", *R.FACTOR_WEIGHTS)])


@query("conversation_complexity_score")
def _conv_complexity(spark, path):
    s = V.complexity_score(I.messages(spark, path))
    return s.select("conv_id", "level", "critical", F.round("score", 6).alias("score"), "risks")


# scores of routed calls come from the event log
_SCORED = """, sc AS (SELECT event_id, (event_id * 37 % 1000) / 1000.0::DOUBLE AS score, event_id % 7 = 0 AS critical, event_id % 5 = 0 AS enc_risk, value AS latency_ms FROM ev),
  lv AS (SELECT *, CASE WHEN score < 0.1 THEN 'trivial' WHEN score < 0.3 THEN 'simple' WHEN score < 0.5 THEN 'moderate' WHEN score < 0.7 THEN 'complex' ELSE 'critical' END AS level FROM sc)"""
_BASE = "CASE level WHEN 'trivial' THEN 'heuristic_cached' WHEN 'simple' THEN 'heuristic_cached' WHEN 'moderate' THEN 'heuristic_llm_cached' WHEN 'complex' THEN 'heuristic_llm_pii' ELSE 'full_analysis' END"
_ROUTE = _SCORED + f""", b AS (SELECT *, {_BASE} AS base FROM lv),
   rt AS (SELECT *, CASE WHEN critical AND base IN ('heuristic_cached', 'heuristic_llm_cached') THEN 'heuristic_llm_pii' ELSE base END AS strategy FROM b)"""


def scored_calls(spark, path):
    e = I.events(spark, path)
    score = (F.col("event_id") * 37 % 1000) / 1000.0
    level = None
    for name, below in R.COMPLEXITY_LEVELS:
        level = F.when(F.col("score") < below, name) if level is None else level.when(F.col("score") < below, name)
    risks = F.array_compact(F.array(F.when(F.col("event_id") % 5 == 0, "encoding"), F.when(F.col("critical"), "code_injection")))
    return (
        e.select("event_id", score.alias("score"), (F.col("event_id") % 7 == 0).alias("critical"), F.col("value").alias("latency_ms"))
        .withColumns({"level": level.otherwise("critical"), "risks": risks})
    )


_MS = "(CASE strategy WHEN 'heuristic_only' THEN 10 WHEN 'heuristic_cached' THEN 15 WHEN 'heuristic_llm_cached' THEN 50 WHEN 'heuristic_llm_pii' THEN 500 ELSE 2000 END)::INT"


@query("route", with_ctes("ev", _ROUTE + f" SELECT event_id, level, strategy, {_MS} AS target_ms, strategy <> 'full_analysis' AND NOT enc_risk AS cache_eligible FROM rt"))
def _route(spark, path):
    return V.route(scored_calls(spark, path)).select("event_id", "level", "strategy", "target_ms", "cache_eligible")


@query("route_performance_mode", with_ctes("ev", _SCORED + f""", rt AS (SELECT *, CASE level WHEN 'trivial' THEN 'heuristic_only' WHEN 'simple' THEN 'heuristic_cached' WHEN 'moderate' THEN 'heuristic_llm_cached' ELSE 'heuristic_llm_pii' END AS strategy FROM lv)
   SELECT event_id, strategy, {_MS} AS target_ms FROM rt"""))
def _route_fast(spark, path):
    return V.route(scored_calls(spark, path), performance_mode=True).select("event_id", "strategy", "target_ms")


@query("route_without_model", with_ctes("ev", _SCORED + f""", b AS (SELECT *, {_BASE} AS base FROM lv),
   rt AS (SELECT *, CASE WHEN critical AND base IN ('heuristic_cached', 'heuristic_llm_cached') THEN 'heuristic_llm_pii' WHEN base <> 'heuristic_cached' THEN 'heuristic_only' ELSE base END AS strategy FROM b)
   SELECT strategy, count(*) AS n FROM rt GROUP BY strategy"""))
def _route_no_model(spark, path):
    return V.route(scored_calls(spark, path), model=False).groupBy("strategy").agg(F.count("*").alias("n"))


@query("routing_metrics", with_ctes("ev", _ROUTE + """ SELECT strategy, level, count(*) AS n, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(score), 6) AS avg_score,
   round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share_pct FROM rt GROUP BY strategy, level"""))
def _routing_metrics(spark, path):
    m = V.routing_metrics(V.route(scored_calls(spark, path)))
    return m.select("strategy", "level", "n", *[F.round(c, 6).alias(c) for c in ("avg_latency_ms", "avg_score", "share_pct")])


@query("route_prompts")
def _route_prompts(spark, path):
    r = V.route(V.complexity_score(I.prompt_messages(spark, path), single=True))
    return r.select(F.col("conv_id").alias("doc_id"), "level", "strategy", "target_ms", "cache_eligible")


def _lowered(v: str, c: str) -> str:
    return f"CASE WHEN {c} < 0.7 AND {v} = 'block' THEN 'strip' WHEN {c} < 0.7 AND {v} = 'strip' THEN 'flag' ELSE {v} END"


def _variant(name: str, m: str, p: str, mc: str) -> str:
    parts, verdict = combine_sql("hv", m, p, "hc", mc)
    return f"{name} AS (SELECT conv_id, {verdict} AS verdict, round(mean, 6) AS confidence FROM (SELECT conv_id, {parts} FROM d))"


_BY_STRATEGY = {"heuristic_only": "s1", "heuristic_cached": "s1", "heuristic_llm_cached": "s2", "heuristic_llm_pii": "s3", "full_analysis": "s4"}


@query("strategy_comparison", with_ctes("messages", heuristic_cte("moderate") + span_ctes("messages", "conv_id, turn") + f""", {_ANS}, reported AS (SELECT DISTINCT conv_id FROM kept WHERE confidence >= 0.7),
   d AS (SELECT h.conv_id, h.verdict AS hv, h.confidence AS hc, model_verdict AS mv, model_confidence AS mc, CASE WHEN r.conv_id IS NULL THEN 'allow' ELSE 'redact' END AS pv
      FROM heur h JOIN ans a ON a.conv_id = h.conv_id LEFT JOIN reported r ON r.conv_id = h.conv_id),
   {_variant('s1', "'allow'", "'allow'", "0::DOUBLE")}, {_variant('s2', 'mv', "'allow'", 'mc')}, {_variant('s3', 'mv', 'pv', 'mc')},
   f AS (SELECT conv_id, round(greatest(hc, mc), 6) AS confidence, greatest({RANK.format(v='(' + _lowered('hv', 'hc') + ')')}, {RANK.format(v='(' + _lowered('mv', 'mc') + ')')}, {RANK.format(v='pv')}) AS r FROM d),
   s4 AS (SELECT conv_id, {UNRANK.format(r='r')} AS verdict, confidence FROM f)
   SELECT s1.conv_id, """ + ", ".join(f"{t}.verdict AS {s}_verdict, {t}.confidence AS {s}_confidence" for s, t in _BY_STRATEGY.items())
   + " FROM s1 JOIN s2 USING (conv_id) JOIN s3 USING (conv_id) JOIN s4 USING (conv_id)"))
def _comparison(spark, path):
    out = V.strategy_comparison(I.messages(spark, path), stored_answers(spark, path))
    return out.select("conv_id", *[F.round(c, 6).alias(c) if c.endswith("_confidence") else F.col(c) for c in out.columns if c != "conv_id"])


_INTENT = "CASE doc_id % 5 WHEN 0 THEN 'customer_service' WHEN 1 THEN 'code_assistant' WHEN 2 THEN 'creative_writing' WHEN 3 THEN 'poetry' END"


@query("format_assist", with_ctes("prompts", f""", c AS (SELECT doc_id, text, {complexity_sql()} FROM prompts)
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN {sql_str(R.INTENT_PROMPTS['customer_service'])} WHEN 1 THEN {sql_str(R.INTENT_PROMPTS['code_assistant'])} WHEN 2 THEN {sql_str(R.INTENT_PROMPTS['creative_writing'])}
    WHEN 3 THEN {sql_str(R.INTENT_PROMPTS['general'])} ELSE {sql_str(R.NO_INTENT_PROMPT)} END AS system_prompt,
    ((special_char_ratio > 0.3)::INT + (has_base64 OR has_hex)::INT + ({' OR '.join(matches('lower(text)', p) for p in R.ROLE_CONFUSION)} OR {any_of('lower(text)', ['system:', 'user:', 'assistant:'])})::INT)::INT AS n_recommendations FROM c"""))
def _assist(spark, path):
    p = I.prompts(spark, path).withColumn("intent", F.expr(_INTENT))
    return V.format_assist(p).select("doc_id", "system_prompt", F.size("recommendations").alias("n_recommendations"))


@query("detect_once", f"""WITH m AS (SELECT doc_id, 'user' AS role, text FROM documents), k AS (SELECT doc_id, left(sha256('user:' || text), 16) AS content_key, role, text FROM m),
  s AS (SELECT doc_id, content_key, ({hit_count_sql(TESTS)})::INT AS n_reasons, {max_conf_sql(TESTS)} AS confidence FROM k)
  SELECT doc_id, content_key, n_reasons, confidence, doc_id <> min(doc_id) OVER (PARTITION BY content_key) AS cache_hit FROM s""")
def _once(spark, path):
    d = I.table(spark, path, "documents").select("doc_id", F.lit("user").alias("role"), "text")
    return V.detect_once(d, "doc_id")


@query("message_statistics", """SELECT role, count(*) AS n_messages, 'moderate' AS mode, 38 AS rules_direct, 9 AS rules_jailbreak, 5 AS rules_encoding, 8 AS rules_context FROM conversations GROUP BY role""")
def _statistics(spark, path):
    return V.message_statistics(I.messages(spark, path))


@query("segments_by_role", "SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position, text FROM conversations WHERE role IN ('system', 'user', 'assistant')")
def _segments(spark, path):
    return rules.segments_by_role(I.table(spark, path, "conversations"))
