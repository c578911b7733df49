"""Queries over personal data, masking and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions.unnest import unnest
from rampart.functions.regexes import sql_regex, sql_str
from rampart.operators import pii as P
from rampart.operators import privacy as V
from rampart.plans import inputs as I
from rampart.plans.inputs import NOW, with_ctes
from rampart.plans.registry import query
from rampart.plans.rules import matches
from rampart.plans.spans import HASHED, MASKS, RISK, SHOWN, luhn_sql, replaced_ctes, span_ctes
from rampart.session import cut_lineage


def _all_sql(text: str, p: P.Pattern) -> str:
    return f"regexp_extract_all({text}, {sql_str(sql_regex(p.pattern, ignore_case=True))})"


@query("pii_types", with_ctes("prompts", "SELECT * FROM (SELECT doc_id, " + ", ".join(
    "(" + " OR ".join(matches("text", p.pattern, ignore_case=True) for p in P.PATTERNS if p.kind == kind) + f") AS has_{kind}" for kind in P.TYPES) + " FROM prompts)"))
def _types(spark, path):
    f = P.type_flags(I.prompts(spark, path))
    return f.select("doc_id", *[f"has_{k}" for k in P.TYPES])


def _spans_sql() -> str:
    """Positions found independently: each match is located from the end of the one before.

    Restricted to the types whose expressions cannot overlap another listed type."""
    kinds = [p for p in P.PATTERNS if p.kind in ("ssn", "email")]
    parts = []
    for i, p in enumerate(kinds):
        rx = sql_str("(?i)^(?s:(.*?))(" + sql_regex(p.pattern) + ")")
        parts.append(f"""SELECT doc_id, {i} AS ord, '{p.kind}' AS type, {p.confidence}::DOUBLE AS confidence, unnest(list_zip(gaps, hits)) AS z, generate_subscripts(hits, 1) AS k
          FROM (SELECT doc_id, {_all_sql('text', p)} AS hits, string_split_regex(text, {sql_str(sql_regex(p.pattern, ignore_case=True))})[1:len({_all_sql('text', p)})] AS gaps FROM prompts WHERE {matches('text', p.pattern, ignore_case=True)})""")
        del rx
    return " UNION ALL ".join(parts)


@query("find_pii", with_ctes("prompts", f""", r AS ({_spans_sql()}),
   l AS (SELECT doc_id, ord, type, confidence, z[1] AS gap, z[2] AS hit, k FROM r),
   s AS (SELECT doc_id, ord, type, confidence, hit, (sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start
      FROM l WINDOW w AS (PARTITION BY doc_id, ord ORDER BY k ROWS UNBOUNDED PRECEDING)),
   o AS (SELECT *, start + length(hit) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, -confidence, ord) AS rn FROM s),
   kept AS (WITH RECURSIVE g AS (SELECT doc_id, rn, type, confidence, start, stop, hit, stop AS last, true AS keep FROM o WHERE rn = 1
      UNION ALL SELECT o.doc_id, o.rn, o.type, o.confidence, o.start, o.stop, o.hit, CASE WHEN o.start < g.last THEN g.last ELSE o.stop END, o.start >= g.last FROM g JOIN o ON o.doc_id = g.doc_id AND o.rn = g.rn + 1)
      SELECT * FROM g WHERE keep)
   SELECT doc_id, type, start::INT AS start, stop::INT AS stop, confidence, hit AS text FROM kept"""))
def _find(spark, path):
    f = unnest(P.find_pii(I.prompts(spark, path), types=["ssn", "email"]), "pii", "p", "doc_id")
    return f.select("doc_id", "p.type", "p.start", F.col("p.end").alias("stop"), "p.confidence", "p.text")


_SPANS = span_ctes("prompts", "doc_id")


@query("find_pii_all", with_ctes("prompts", _SPANS + f""" SELECT doc_id, type, start, stop AS "end", {SHOWN} AS masked, confidence,
   substring(text, greatest(start - 20, 0) + 1, stop + 20 - greatest(start - 20, 0)) AS context, hit AS text, NULL::VARCHAR AS rule FROM kept JOIN prompts USING (doc_id)"""))
def _find_all(spark, path):
    f = unnest(P.find_pii(I.prompts(spark, path)), "pii", "p", "doc_id")
    return f.select("doc_id", "p.*")


def custom_rules(spark, path):
    """A custom rule table: one rule per product brand, plus rules for the planted phrases."""
    brands = I.table(spark, path, "part").select("p_brand").distinct()
    own = brands.select(
        F.concat(F.lit("brand_"), F.regexp_extract("p_brand", r"(\d+)", 1)).alias("name"), F.lit("medium").alias("severity"),
        F.concat(F.lit("page=2&ref="), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(r"[a-z]{2,}")).alias("regex"),
        F.lit(0.85).alias("confidence"), F.lit("PROJ-****-**").alias("mask_format"), F.lit(True).alias("enabled"),
    )
    slots = I.table(spark, path, "documents").select((F.col("doc_id") % 10).alias("s")).distinct()
    planted = slots.filter("s in (5, 6)").select(
        F.concat(F.lit("planted_"), F.col("s").cast("string")).alias("name"), F.lit("high").alias("severity"),
        F.when(F.col("s") == 5, r"number\s+is\s+[0-9]{3}").otherwise("hunter[0-9]secret").alias("regex"),
        F.lit(0.95).alias("confidence"), F.lit("EMP-****").alias("mask_format"), F.lit(True).alias("enabled"),
    )
    return own.unionByName(planted)


@query("find_custom_pii", with_ctes("prompts", r"""SELECT doc_id, 'planted_5' AS rule, 'generic_secret' AS type, unnest(regexp_extract_all(text, '(?i)number\s+is\s+[0-9]{3}')) AS matched, 'EMP-****' AS masked FROM prompts
   UNION ALL SELECT doc_id, 'planted_6', 'generic_secret', unnest(regexp_extract_all(text, '(?i)hunter[0-9]secret')), 'EMP-****' FROM prompts"""))
def _custom(spark, path):
    h = P.find_custom_pii(I.prompts(spark, path).select("doc_id", "text"), custom_rules(spark, path))
    return h.select("doc_id", "rule", "type", "matched", "masked")


@query("dedupe_spans", with_ctes("prompts", _SPANS + """ SELECT doc_id, coalesce(f.n, 0)::INT AS n_found, coalesce(k.n, 0)::INT AS n_kept FROM prompts
   LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY 1) f USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1) k USING (doc_id)"""))
def _dedupe(spark, path):
    d = I.prompts(spark, path).select("doc_id", P._candidates("text").alias("all"))
    return d.select("doc_id", F.size("all").alias("n_found"), F.size(P.dedupe_spans(F.col("all"))).alias("n_kept"))


# the three forms of the type never overlap
@query("redact_ssn", with_ctes("prompts", r"""SELECT doc_id, regexp_replace(text, '\b\d{3}-\d{2}-\d{4}\b|\b\d{3}\s\d{2}\s\d{4}\b|\b\d{9}\b', '[SSN_REMOVED]', 'g') AS redacted FROM prompts"""))
def _redact_ssn(spark, path):
    return I.prompts(spark, path).select("doc_id", P.redact("text", "remove", ["ssn"]).alias("redacted"))


def _redact(mode):
    def run(spark, path):
        return P.redact_rows(I.prompts(spark, path), mode).select("doc_id", "redacted")

    return run


for _name, _mode, _mask in (("redact", "mask", SHOWN), ("redact_hash", "hash", HASHED)):
    query(_name, with_ctes("prompts", _SPANS + replaced_ctes("prompts", "doc_id", _mask) + " SELECT doc_id, changed AS redacted FROM replaced"))(_redact(_mode))


@query("pii_summary", with_ctes("prompts", _SPANS + " SELECT type, count(*) AS n, count(*) FILTER (confidence >= 0.7) AS n_reported FROM kept GROUP BY type"))
def _summary(spark, path):
    return P.pii_summary(I.prompts(spark, path))


_CARD = next(p for p in P.PATTERNS if p.kind == "credit_card")


@query("pii_counts", with_ctes("prompts", f"""SELECT (SELECT count(*) FROM (SELECT unnest(list_filter({_all_sql('text', _CARD)}, lambda x: {luhn_sql('x')})) FROM prompts)) AS n_cards,
   (SELECT count(*) FROM (SELECT unnest({_all_sql('text', next(p for p in P.PATTERNS if p.kind == 'ssn'))}) FROM prompts)) AS n_ssn,
   (SELECT count(*) FROM (SELECT unnest({_all_sql('text', next(p for p in P.PATTERNS if p.kind == 'ip_address'))}) FROM prompts)) AS n_ip"""))
def _counts(spark, path):
    n = lambda kind, i: F.size(P.raw_spans("text", [p for p in P.PATTERNS if p.kind == kind][i].pattern, kind, 0.5, 0))
    from rampart.functions import text as X

    cards = F.filter(P.raw_spans("text", _CARD.pattern, "credit_card", 0.8, 0), lambda s: X.luhn_valid(F.translate(s["text"], "- ", "")))
    return I.prompts(spark, path).agg(
        F.sum(F.size(cards)).alias("n_cards"), F.sum(n("ssn", 0)).alias("n_ssn"), F.sum(n("ip_address", 0)).alias("n_ip")
    )


@query("pii_verdict", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'redact' ELSE 'allow' END AS masked, CASE WHEN doc_id % 3 > 0 THEN 'block' ELSE 'allow' END AS rejected, 'allow' AS passed FROM documents""")
def _verdict(spark, path):
    from rampart.operators.verdicts import pii_verdict

    d = I.table(spark, path, "documents").select("doc_id", (F.col("doc_id") % 3).alias("n"))
    return d.select("doc_id", *[pii_verdict(F.col("n"), m).alias(a) for a, m in (("masked", "mask"), ("rejected", "reject"), ("passed", "pass-alert"))])


for _s in ("redact", "hash", "partial", "remove", "anonymize", "tokenize"):
    def _masked(spark, path, _s=_s):
        m = V.mask_prompts(I.prompts(spark, path), _s)
        return m.select("doc_id", "masked_text", "masked_count")

    query(f"mask_prompts_{_s}", with_ctes("prompts", _SPANS + replaced_ctes("prompts", "doc_id", MASKS[_s]) + " SELECT doc_id, changed AS masked_text, n AS masked_count FROM replaced"))(_masked)


@query("token_round_trip", "SELECT count(*) AS n, count(*) AS n_restored FROM documents")
def _tokens(spark, path):
    p = I.prompts(spark, path).select("doc_id", "text")
    replaced, vault = V.tokenize_values(p)
    stored = cut_lineage(replaced.select("doc_id", "masked_text"))
    back = V.detokenize(stored, "doc_id", vault)
    joined = p.join(back, "doc_id")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("restored")).alias("n_restored"))


@query("token_vault", """SELECT 'TOKEN_' || left(sha256(c_mktsegment), 24) AS token, c_mktsegment AS value FROM customer GROUP BY c_mktsegment""")
def _vault(spark, path):
    c = I.table(spark, path, "customer")
    return c.select(V.token(F.col("c_mktsegment")).alias("token"), F.col("c_mktsegment").alias("value")).distinct()


@query("privacy_report", with_ctes("prompts", _SPANS + f""", g AS (SELECT doc_id, sum({RISK} * confidence) AS w, sum(stop - start) AS covered, count(*) AS n, list_sort(list(DISTINCT type)) AS types FROM kept GROUP BY doc_id),
   r AS (SELECT doc_id, length(text) AS chars, least(100::DOUBLE, coalesce(w, 0) * 20)::DOUBLE AS risk, coalesce(covered, 0) AS covered, coalesce(n, 0)::INT AS pii_count, coalesce(types, []) AS types FROM prompts LEFT JOIN g USING (doc_id))
   SELECT doc_id, round(risk, 2) AS risk_score, CASE WHEN risk > 80 THEN 'HIGH' WHEN risk > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN risk > 80 THEN 'redact' WHEN risk > 50 THEN 'partial' WHEN risk > 20 THEN 'anonymize' ELSE 'partial' END AS strategy, pii_count, types,
    CASE WHEN chars > 0 THEN round(covered / chars::DOUBLE * 100, 2) ELSE 0::DOUBLE END AS sensitive_pct FROM r"""))
def _report(spark, path):
    return V.privacy_report(I.prompts(spark, path), "doc_id")


@query("validate_pii_rules", """SELECT p_partkey, (p_partkey % 6 = 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0 AND p_partkey % 5 <> 0)::INT + (p_partkey % 4 = 0)::INT + (p_partkey % 11 = 0)::INT AS n_problems FROM part""")
def _validate(spark, path):
    k = F.col("p_partkey")
    rules = I.table(spark, path, "part").select(
        "p_partkey", F.when(k % 6 != 0, F.col("p_name")).otherwise("").alias("name"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "(unclosed").otherwise("EMP[0-9]{6}").alias("regex"),
        F.when(k % 4 == 0, "urgent").otherwise("high").alias("severity"), F.when(k % 11 == 0, 1.5).otherwise(0.9).alias("confidence"),
    )
    return P.validate_pii_rules(rules).select("p_partkey", F.size("problems").alias("n_problems"))


@query("test_pii_rules", with_ctes("prompts", r"""SELECT rule, count(*) AS n_hits, count(DISTINCT doc_id) AS n_texts FROM (
   SELECT 'planted_5' AS rule, doc_id, unnest(regexp_extract_all(text, '(?i)number\s+is\s+[0-9]{3}')) FROM prompts
   UNION ALL SELECT 'planted_6', doc_id, unnest(regexp_extract_all(text, '(?i)hunter[0-9]secret')) FROM prompts) GROUP BY rule"""))
def _test_rules(spark, path):
    h = P.find_custom_pii(I.prompts(spark, path).select("doc_id", "text"), custom_rules(spark, path))
    return h.groupBy("rule").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_texts"))


# --- retention ------------------------------------------------------------------------------
_CATEGORIES = [p[0] for p in V.RETENTION_POLICIES]
_RECORDS_SQL = "rec AS (SELECT o_orderkey, o_custkey, [" + ", ".join(sql_str(c) for c in _CATEGORIES) + """][o_orderkey % 8 + 1] AS category,
  o_orderdate + INTERVAL 8400 DAY AS created_at, o_orderpriority AS note FROM orders),
  pol AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({sql_str(c)}, {d}, {sql_str(a)}, {'NULL' if n is None else n}, {str(h).lower()})" for c, d, a, n, h in V.RETENTION_POLICIES
) + f""") AS t(category, retention_days, act, anonymization_days, legal_hold)),
  j AS (SELECT rec.*, pol.* EXCLUDE (category), epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at) AS age FROM rec JOIN pol USING (category)),
  acted AS (SELECT *, age > retention_days * 86400000000 AS expired, CASE WHEN legal_hold THEN 'keep' WHEN age > retention_days * 86400000000 THEN act
     WHEN anonymization_days IS NOT NULL AND age > anonymization_days * 86400000000 THEN 'anonymize' ELSE 'keep' END AS action FROM j)"""


def records(spark, path):
    o = I.table(spark, path, "orders")
    return o.select(
        "o_orderkey", "o_custkey",
        F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("category"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 8400 DAY")).alias("created_at"), F.col("o_orderpriority").alias("note"),
    )


@query("retention_actions", f"WITH {_RECORDS_SQL} SELECT o_orderkey, category, action, expired FROM acted")
def _retention(spark, path):
    return V.retention_actions(records(spark, path), V.default_policies(spark), NOW).select("o_orderkey", "category", "action", "expired")


@query("apply_retention", f"""WITH {_RECORDS_SQL} SELECT o_orderkey, category, action, CASE WHEN action = 'anonymize' THEN left(sha256(note), 16) ELSE note END AS note FROM acted
   WHERE NOT (action = 'delete' OR (expired AND action = 'anonymize'))""")
def _apply(spark, path):
    return V.apply_retention(records(spark, path), V.default_policies(spark), NOW, ["note"]).select("o_orderkey", "category", "action", "note")


@query("retention_summary", f"""WITH {_RECORDS_SQL}, g AS (SELECT *, action = 'delete' OR (expired AND action = 'anonymize') AS gone FROM acted)
  SELECT category, count(*) AS n, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (NOT gone AND action = 'anonymize') AS n_anonymized,
   count(*) FILTER (action IN ('archive', 'review')) AS n_held, count(*) FILTER (action = 'keep') AS n_kept FROM g GROUP BY category""")
def _retention_summary(spark, path):
    return V.retention_summary(records(spark, path), V.default_policies(spark), NOW)


def subject_requests(spark, path):
    return I.table(spark, path, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))


@query("erase_subject", f"WITH {_RECORDS_SQL} SELECT o_orderkey, category FROM j WHERE legal_hold OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _erase(spark, path):
    e = V.erase_subject(records(spark, path), subject_requests(spark, path), V.default_policies(spark), "o_custkey")
    return e.select("o_orderkey", "category")


@query("erasure_audit", f"""WITH {_RECORDS_SQL} SELECT o_custkey, category, count(*) FILTER (NOT legal_hold) AS erased, count(*) FILTER (legal_hold) AS held FROM j
   WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL""")
def _audit(spark, path):
    return V.erasure_audit(records(spark, path), subject_requests(spark, path), V.default_policies(spark), "o_custkey")


@query("export_subject", f"WITH {_RECORDS_SQL} SELECT o_custkey, category, count(*) AS n FROM rec WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL")
def _export(spark, path):
    e = V.export_subject(records(spark, path), subject_requests(spark, path), "o_custkey")
    return e.filter(F.get_json_object("record", "$.note").isNotNull()).groupBy("o_custkey", "category").agg(F.count("*").alias("n"))


@query("retention_report", f"""WITH {_RECORDS_SQL}, g AS (SELECT category, count(*) AS n, count(*) FILTER (expired) AS n_overdue FROM acted GROUP BY category)
  SELECT category, retention_days, act AS action, legal_hold, coalesce(n, 0) AS n, coalesce(n_overdue, 0) AS n_overdue FROM pol LEFT JOIN g USING (category)""")
def _retention_report(spark, path):
    return V.retention_report(records(spark, path), V.default_policies(spark), NOW)


@query("encryption_round_trip", "SELECT c_custkey, c_name, c_mktsegment, true AS hidden FROM customer")
def _encryption(spark, path):
    c = I.table(spark, path, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.lit("0123456789abcdef")
    e = V.encrypt_columns(c.withColumn("plain", F.col("c_name")), ["c_name", "c_mktsegment"], key)
    d = V.decrypt_columns(e.withColumn("hidden", F.col("c_name") != F.col("plain")), ["c_name", "c_mktsegment"], key)
    return d.drop("plain")
