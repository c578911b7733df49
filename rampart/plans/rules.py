"""Queries over rule-based detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions.unnest import unnest
from rampart.functions import rule_tables as R
from rampart.functions.regexes import sql_regex, sql_str
from rampart.operators import matching, multilingual, rules
from rampart.plans import inputs as I
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import query
from rampart.plans.text import _MOVED_SQL, moved_text

DECODES = """len(list_filter(regexp_extract_all({t}, '[A-Za-z0-9+/]{{20,}}={{0,2}}'), lambda x:
  length(rtrim(x, '=')) % 4 = 0 OR (length(rtrim(x, '=')) % 4 = 2 AND length(x) - length(rtrim(x, '=')) = 2)
  OR (length(rtrim(x, '=')) % 4 = 3 AND length(x) > length(rtrim(x, '='))))) > 0"""


def matches(col: str, pattern: str, **flags: bool) -> str:
    return f"regexp_matches({col}, {sql_str(sql_regex(pattern, **flags))})"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_str(w)})" for w in words) + ")"


def family_tests(families: list[str], text: str = "text", role: str = "role") -> list[tuple[str, str, float]]:
    """(condition, category, confidence) in SQL."""
    low = f"lower({text})"
    out = []
    if "zero_width" in families:
        out.append((any_of(text, R.ZERO_WIDTH), "encoding_attack", 0.9))
    if "direct" in families:
        out += [(f"({role} <> 'system' AND {matches(low, r.pattern)})", "direct_injection", r.confidence) for r in R.DIRECT_INJECTION]
    if "jailbreak" in families:
        out += [(matches(low, r.pattern), "jailbreak", r.confidence) for r in R.JAILBREAK]
    if "encoding" in families:
        for r in R.ENCODING:
            cond = matches(text, r.pattern)
            out.append((cond if r.needs else f"({cond} AND {DECODES.format(t=text)})", "encoding_attack", r.confidence))
    if "context" in families:
        out += [(matches(text, r.pattern, multiline=True), "context_switching", r.confidence) for r in R.CONTEXT_SWITCHING]
    if "role_manipulation" in families:
        out.append((f"({role} = 'user' AND {any_of(low, R.ROLE_MANIPULATION_PHRASES)})", "role_manipulation", 0.85))
    if "prompt_leak" in families:
        out.append((any_of(low, R.PROMPT_LEAK_PHRASES), "prompt_leak", 0.9))
    return out


def hit_count_sql(tests) -> str:
    return " + ".join(f"({c})::INT" for c, _, _ in tests)


def max_conf_sql(tests) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN {c} THEN {f}::DOUBLE ELSE 0 END" for c, _, f in tests) + ", 0::DOUBLE)"


def _family_query(name: str, family: str) -> None:
    tests = family_tests([family])
    sql = with_ctes("messages", f"""SELECT * FROM (SELECT conv_id, turn, ({hit_count_sql(tests)})::INT AS n_hits,
      {max_conf_sql(tests)} AS confidence FROM messages) WHERE n_hits > 0""")

    def run(spark, path):
        m = rules.with_reasons(I.messages(spark, path), [family])
        return m.filter(F.size("reasons") > 0).select(
            "conv_id", "turn", F.size("reasons").alias("n_hits"),
            F.array_max(F.transform("reasons", lambda r: r["confidence"])).alias("confidence"),
        )

    query(name, sql)(run)


for _name, _family in [
    ("direct_injection_rules", "direct"), ("jailbreak_rules", "jailbreak"), ("context_switch_rules", "context"),
    ("encoding_rules", "encoding"), ("role_manipulation_rule", "role_manipulation"), ("prompt_leak_rule", "prompt_leak"),
]:
    _family_query(_name, _family)


# zero-width characters are planted by conversation
@query("zero_width_rule", """SELECT conv_id, turn, 0.9::DOUBLE AS confidence FROM (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN left(text, 10) || chr(8203) || text ELSE text END AS t FROM conversations)
  WHERE contains(t, chr(8203)) OR contains(t, chr(8204)) OR contains(t, chr(8205)) OR contains(t, chr(65279)) OR contains(t, chr(8288))""")
def _zero_width(spark, path):
    c = I.table(spark, path, "conversations")
    hidden = F.when(F.col("conv_id") % 4 == 0, F.concat(F.left("text", F.lit(10)), F.lit(chr(0x200B)), "text")).otherwise(F.col("text"))
    m = rules.with_reasons(c.withColumn("text", hidden), ["zero_width"])
    return m.filter(F.size("reasons") > 0).select("conv_id", "turn", F.col("reasons")[0]["confidence"].alias("confidence"))


_ALL = family_tests(rules.FAMILY_NAMES, role="'user'")


@query("match_rules", with_ctes("prompts", "SELECT category, confidence, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{cat}' AS category, {conf}::DOUBLE AS confidence FROM prompts WHERE {cond}" for cond, cat, conf in _ALL) + ") GROUP BY ALL"))
def _match_rules(spark, path):
    hits = unnest(rules.with_reasons(I.prompt_messages(spark, path)), "reasons", "r")
    return hits.groupBy("r.category", "r.confidence").agg(F.count("*").alias("n"))


# learned patterns: the planted phrases, one per source of document
_LEARNED = "SELECT DISTINCT doc_id % 10 AS slot FROM documents WHERE doc_id % 10 IN (0, 1, 2, 3)"


def learned_patterns(spark, path):
    slots = I.table(spark, path, "documents").select((F.col("doc_id") % 10).alias("slot")).distinct()
    phrase = F.create_map(F.lit(0), F.lit(r"ignore\s+all\s+previous"), F.lit(1), F.lit("developer mode"), F.lit(2), F.lit("show me your prompt"), F.lit(3), F.lit("you must obey"))
    kind = F.create_map(F.lit(0), F.lit("ngram"), F.lit(1), F.lit("jailbreak"), F.lit(2), F.lit("extraction"), F.lit(3), F.lit("role"))
    return slots.filter("slot < 4").select(
        F.concat(F.lit("pat_"), F.col("slot").cast("string")).alias("rule_id"), phrase[F.col("slot").cast("int")].alias("pattern"),
        kind[F.col("slot").cast("int")].alias("kind"), (F.lit(0.7) + F.col("slot") * 0.05).alias("confidence"),
    )


def learned_pattern_rules(texts, patterns, form=None):
    """Hits of active learned patterns with their detection category."""
    from rampart.operators.verdicts import by_name

    hits = matching.match_patterns(texts, patterns, form=form)
    return hits.join(patterns.select("rule_id", "kind", "confidence"), "rule_id").withColumn(
        "category", by_name(R.LEARNED_CATEGORY, F.col("kind"), "direct_injection")
    )


_LEARNED_SQL = with_ctes("prompts", """SELECT rule_id, category, count(*) AS n, round(max(confidence), 6) AS confidence FROM (
  SELECT 'pat_0' AS rule_id, 'direct_injection' AS category, 0.7::DOUBLE AS confidence FROM prompts WHERE regexp_matches(text, '(?i)ignore\\s+all\\s+previous')
  UNION ALL SELECT 'pat_1', 'jailbreak', 0.75 FROM prompts WHERE contains(lower(text), 'developer mode')
  UNION ALL SELECT 'pat_2', 'prompt_leak', 0.8 FROM prompts WHERE contains(lower(text), 'show me your prompt')
  UNION ALL SELECT 'pat_3', 'role_manipulation', 0.85 FROM prompts WHERE contains(lower(text), 'you must obey')) GROUP BY ALL""")


def _learned(form):
    def run(spark, path):
        hits = learned_pattern_rules(I.prompts(spark, path).select("doc_id", "text"), learned_patterns(spark, path), form)
        return hits.groupBy("rule_id", "category").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("confidence"))

    return run


query("learned_pattern_rules", _LEARNED_SQL)(_learned(None))
query("learned_pattern_rules_listed", _LEARNED_SQL)(_learned("listed"))
query("learned_pattern_rules_indexed", _LEARNED_SQL)(_learned("indexed"))


def _first_strong_sql(mode: str) -> str:
    low = "lower(text)"
    parts = []
    i = 0
    for _, rs in R.FAST_RULES.items():
        for r in rs:
            parts.append(f"CASE WHEN {matches('text', r.pattern, ignore_case=True)} THEN {{'i': {i}, 'c': {rules.scaled(r.confidence, mode)}::DOUBLE}} END")
            i += 1
    listed = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return with_ctes("prompts", f""", h AS (SELECT doc_id, CASE WHEN {any_of(low, rules.scan_keywords())} THEN {listed} ELSE [] END AS hits FROM prompts),
      s AS (SELECT doc_id, hits, list_min(list_transform(list_filter(hits, lambda x: x.c >= 0.9), lambda x: x.i)) AS strong FROM h),
      k AS (SELECT doc_id, list_filter(hits, lambda x: strong IS NULL OR x.i <= strong) AS kept FROM s),
      c AS (SELECT doc_id, len(kept)::INT AS n_reasons, coalesce(list_max(list_transform(kept, lambda x: x.c)), 0)::DOUBLE AS confidence FROM k)
      SELECT doc_id, n_reasons, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.7 THEN 'block' WHEN confidence >= 0.4 THEN 'flag' ELSE 'allow' END AS verdict FROM c""")


def _fast(mode):
    def run(spark, path):
        f = rules.fast_scan(I.prompts(spark, path), mode)
        return f.select("doc_id", F.size("reasons").alias("n_reasons"), F.round("confidence", 6).alias("confidence"), "verdict")

    return run


query("fast_scan", _first_strong_sql("moderate"))(_fast("moderate"))
query("fast_scan_strict", _first_strong_sql("strict"))(_fast("strict"))


def _adaptive_sql(mode: str) -> str:
    tests = [(matches("text", r.pattern, ignore_case=True), "", rules.scaled(r.confidence, mode)) for _, _, r in R.adaptive_rules()]
    block, flag = R.ADAPTIVE_THRESHOLDS[mode]
    ctx = " ".join(f"WHEN {any_of('lower(text)', ws)} THEN '{label}'" for label, ws in R.CONTEXT_WORDS.items())
    return with_ctes("prompts", f""", s AS (SELECT doc_id, ({hit_count_sql(tests)})::INT AS n_hits, {max_conf_sql(tests)} AS confidence, CASE {ctx} ELSE 'general' END AS context FROM prompts)
      SELECT doc_id, n_hits, round(confidence, 6) AS confidence, context, CASE WHEN confidence >= {block} THEN 'block' WHEN confidence >= {flag} THEN 'flag' ELSE 'allow' END AS verdict FROM s""")


def _adaptive(mode):
    def run(spark, path):
        a = rules.adaptive_scan(I.prompts(spark, path), mode)
        return a.select("doc_id", F.size("hits").alias("n_hits"), F.round("confidence", 6).alias("confidence"), "context", "verdict")

    return run


query("adaptive_scan", _adaptive_sql("moderate"))(_adaptive("moderate"))
query("adaptive_scan_permissive", _adaptive_sql("permissive"))(_adaptive("permissive"))


@query("context_label", with_ctes("messages", ", f AS (SELECT conv_id, count(*) AS n, " + ", ".join(
    f"bool_or({any_of('lower(text)', ws)}) AS {label}" for label, ws in R.CONTEXT_WORDS.items()) +
    " FROM messages GROUP BY conv_id) SELECT conv_id, CASE WHEN api_call THEN 'api_call' WHEN code THEN 'code' WHEN chat THEN 'chat' WHEN n > 1 THEN 'conversation' ELSE 'general' END AS context FROM f"))
def _context(spark, path):
    return rules.conversation_context(I.messages(spark, path))


@query("role_confusion", with_ctes("messages", "SELECT conv_id, turn, n_issues FROM (SELECT conv_id, turn, (" + " + ".join(
    [f"(role = 'user' AND {matches('lower(text)', p)})::INT" for p in R.ROLE_CONFUSION]
    + [any_of("lower(text)", ["system:", "user:", "assistant:"]) + "::INT"]) + ")::INT AS n_issues FROM messages)"))
def _confusion(spark, path):
    return rules.role_confusion(I.messages(spark, path)).select("conv_id", "turn", F.size("issues").alias("n_issues"))


@query("role_separation", """WITH g AS (SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'system') AS ns, count(*) FILTER (role = 'user') AS nu,
   max(turn) FILTER (role = 'system') AS ls, min(turn) FILTER (role = 'user') AS fu FROM conversations GROUP BY conv_id)
  SELECT conv_id, n_messages, ns > 0 AS has_system, nu > 0 AS has_user, ns > 0 AND nu > 0 AND coalesce(ls < fu, true) AS properly_formatted,
   CASE WHEN ns = 0 AND nu = 0 THEN 1 ELSE (ns = 0)::INT + coalesce(ls > fu, false)::INT + (ns > 1)::INT END::INT AS n_issues FROM g""")
def _separation(spark, path):
    return rules.role_separation(I.table(spark, path, "conversations")).withColumn("n_issues", F.size("issues")).drop("issues")


_DOC_LANG = {"en": "en", "fr": "fr", "de": "de", "es": "es"}
_ML_PLANT = {"en": "forget everything now. ", "es": "olvida todo ya. ", "de": "neue anweisungen hier. ", "fr": "oubliez tout. "}


def _ml_sql() -> str:
    def own(lang):
        kws, phrases, pats = multilingual.LANGUAGE_RULES[lang]
        return (f"CASE WHEN {' OR '.join(matches('t', p, ignore_case=True) for p in pats)} THEN 0.9 WHEN {any_of('t', [p.lower() for p in phrases])} THEN 0.8 "
                f"WHEN {any_of('t', [k.lower() for k in kws])} THEN 0.6 ELSE 0.0 END")

    from rampart.functions.text import HOMOGLYPHS

    src, dst = "".join(a for a, _ in HOMOGLYPHS), "".join(b for _, b in HOMOGLYPHS)
    plant = "CASE WHEN doc_id % 3 = 0 THEN CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ML_PLANT.items()) + " END ELSE '' END"
    cases = " ".join(f"WHEN '{k}' THEN {own(k)}" for k in _DOC_LANG)
    return f"""WITH d AS (SELECT doc_id, lang, lower(translate({plant} || text, {sql_str(src)}, {sql_str(dst)})) AS t FROM documents),
      s AS (SELECT doc_id, lang, greatest(CASE lang {cases} END, CASE WHEN {any_of('t', multilingual.LANGUAGE_RULES['en'][0])} THEN 0.7 ELSE 0.0 END)::DOUBLE * (0.7::DOUBLE + 0.3::DOUBLE * 0.8::DOUBLE) AS c FROM d)
      SELECT doc_id, lang, round(c, 6) AS confidence, CASE WHEN c >= 0.7 THEN 'block' WHEN c >= 0.4 THEN 'flag' ELSE 'allow' END AS verdict FROM s"""


@query("multilingual_rules", _ml_sql())
def _multilingual(spark, path):
    plant = None
    for k, v in _ML_PLANT.items():
        plant = F.when(F.col("lang") == k, v) if plant is None else plant.when(F.col("lang") == k, v)
    d = I.table(spark, path, "documents").select(
        "doc_id", "lang", F.concat(F.when(F.col("doc_id") % 3 == 0, plant).otherwise(""), "text").alias("text")
    )
    return multilingual.multilingual_rules(d, "lang", 0.8).select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), "verdict")


@query("multilingual_scripts")
def _multilingual_scripts(spark, path):
    from rampart.functions import text as X

    d = I.table(spark, path, "documents").select("doc_id", moved_text().alias("text"))
    known = d.withColumns({"language": X.script_language("text"), "lc": X.script_confidence("text")})
    return multilingual.multilingual_rules(known, "language", F.col("lc")).select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "verdict")


def _mixed_sql() -> str:
    from rampart.functions.text import SCRIPTS

    case = " ".join(f"WHEN regexp_matches(w, {sql_str(p)}) THEN '{lang}'" for p, lang, _ in SCRIPTS)
    best = ["0"]
    for code, (kws, phrases, _) in multilingual.LANGUAGE_RULES.items():
        best.append(f"CASE WHEN list_contains(languages, '{code}') THEN CASE WHEN {any_of('low', [p.lower() for p in phrases])} THEN 0.8 WHEN {any_of('low', [k.lower() for k in kws])} THEN 0.7 ELSE 0 END ELSE 0 END")
    return f"""WITH d AS (SELECT doc_id, {_MOVED_SQL} AS t FROM documents),
      w AS (SELECT doc_id, unnest(regexp_extract_all(t, '\\S+')) AS w FROM d),
      l AS (SELECT doc_id, CASE {case} ELSE 'en' END AS lang, count(*) AS n FROM w WHERE length(w) > 3 GROUP BY ALL),
      g AS (SELECT doc_id, list(lang ORDER BY lang) AS languages, sum(n) AS total FROM l GROUP BY doc_id),
      e AS (SELECT doc_id, -sum(n / total::DOUBLE * log2(n / total::DOUBLE)) AS entropy FROM l JOIN g USING (doc_id) GROUP BY doc_id),
      q AS (SELECT doc_id, lower(t) AS low, len(regexp_extract_all(t, '\\S+')) AS n_words, CASE WHEN len(regexp_extract_all(t, '\\S+')) >= 3 THEN coalesce(languages, []) ELSE [] END AS languages, entropy
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN e USING (doc_id))
      SELECT doc_id, languages, len(languages) > 1 AS mixed, round(CASE WHEN len(languages) > 1 THEN entropy ELSE 0 END, 5) AS entropy,
        (CASE WHEN len(languages) > 1 THEN greatest({', '.join(best)}) ELSE 0 END)::DOUBLE AS confidence FROM q"""


@query("mixed_language", _mixed_sql())
def _mixed(spark, path):
    d = I.table(spark, path, "documents").select("doc_id", moved_text().alias("text"))
    m = multilingual.mixed_language(d, "doc_id")
    return m.select("doc_id", "languages", "mixed", F.round("entropy", 5).alias("entropy"), "confidence")


@query("simple_classifier", with_ctes("prompts", f"""SELECT doc_id, score::DOUBLE AS score, score > 0.5 AS is_injection, n_factors FROM (SELECT doc_id,
   CASE WHEN {any_of('lower(text)', ['ignore all', 'disregard'])} THEN 0.9 WHEN {any_of('lower(text)', ['ignore', 'override', 'system', 'prompt'])} THEN 0.7 ELSE 0.2 END AS score,
   (contains(lower(text), 'ignore')::INT + contains(lower(text), 'system')::INT + contains(lower(text), 'override')::INT)::INT AS n_factors FROM prompts)"""))
def _simple(spark, path):
    s = rules.simple_classifier(I.prompts(spark, path))
    return s.select("doc_id", "score", "is_injection", F.size("factors").alias("n_factors"))


def _kw_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {any_of('t', [w.lower() for w in ws])}" for k, ws in multilingual.KEYWORDS.items())
    return f"""SELECT doc_id, lang, (CASE WHEN CASE lang {cases} ELSE false END THEN 0.8 ELSE 0.0 END)::DOUBLE AS confidence FROM
      (SELECT doc_id, lang, lower(CASE WHEN doc_id % 2 = 0 THEN CASE lang WHEN 'en' THEN 'disregard ' WHEN 'es' THEN 'descartar ' WHEN 'fr' THEN 'oublier ' ELSE 'vergessen ' END ELSE '' END || text) AS t FROM documents)"""


@query("language_keywords", _kw_sql())
def _lang_kw(spark, path):
    word = F.expr("CASE lang WHEN 'en' THEN 'disregard ' WHEN 'es' THEN 'descartar ' WHEN 'fr' THEN 'oublier ' ELSE 'vergessen ' END")
    d = I.table(spark, path, "documents").select("doc_id", "lang", F.concat(F.when(F.col("doc_id") % 2 == 0, word).otherwise(""), "text").alias("text"))
    return multilingual.language_keywords(d, "lang").select("doc_id", "lang", "confidence")


_REQ_SQL = """WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'POST' ELSE 'GET' END AS method,
   regexp_replace(url, '^[a-z]+:/', '') || CASE page_id % 9 WHEN 0 THEN '/.env' ELSE '' END AS path,
   CASE page_id % 8 WHEN 0 THEN 'text/plain' ELSE 'application/json' END AS content_type,
   length(html) * 1000 AS content_length, length(url) * 60 AS header_length, html AS text FROM pages)
 SELECT page_id, list_filter([CASE WHEN content_length > 10000000 THEN 'too_large' END,
   CASE WHEN method IN ('POST', 'PUT', 'PATCH') AND NOT (starts_with(content_type, 'application/json') OR starts_with(content_type, 'application/x-www-form-urlencoded') OR starts_with(content_type, 'multipart/form-data')) THEN 'unsupported_media' END,
   CASE WHEN header_length > 4096 THEN 'header_too_long' END, CASE WHEN contains(path, '..') OR contains(path, '//') THEN 'path_traversal' END,
   CASE WHEN regexp_matches(path, '(\\.env|\\.git|\\.bak|\\.config|\\.sql|\\.db)$') THEN 'bad_extension' END,
   CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]') THEN 'control_characters' END,
   CASE WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 10000 THEN 'line_too_long' END,
   CASE WHEN regexp_matches(text, '(?i)(\\bEXEC\\b.*\\bxp_cmdshell\\b)|(\\bINTO\\b.*\\bOUTFILE\\b)|(\\bLOAD_FILE\\b.*\\()|(;\\s*DROP\\s+DATABASE\\b)') THEN 'dangerous_sql' END], lambda x: x IS NOT NULL) AS failed FROM r"""


@query("request_checks", _REQ_SQL)
def _request_checks(spark, path):
    p = I.table(spark, path, "pages").select(
        "page_id", F.when(F.col("page_id") % 4 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.regexp_replace("url", "^[a-z]+:/", ""), F.when(F.col("page_id") % 9 == 0, "/.env").otherwise("")).alias("path"),
        F.when(F.col("page_id") % 8 == 0, "text/plain").otherwise("application/json").alias("content_type"),
        (F.length("html") * 1000).alias("content_length"), (F.length("url") * 60).alias("header_length"), F.col("html").alias("text"),
    )
    return rules.request_checks(p).select("page_id", "failed")


@query("batch_checks", """WITH i AS (SELECT source AS batch_id, doc_id // 2 AS item_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS t FROM documents),
  p AS (SELECT batch_id, item_id, count(*) AS n, count(*) FILTER (t = '') AS e FROM i GROUP BY ALL),
  g AS (SELECT batch_id, sum(n)::BIGINT AS item_count, max(n) AS c, sum(e)::BIGINT AS empty_items FROM p GROUP BY batch_id)
  SELECT batch_id, item_count, item_count * 50 AS estimated_time_ms, empty_items, c > 1 AS duplicate_ids, item_count > 50 AS large, c <= 1 AS valid FROM g""")
def _batch_checks(spark, path):
    i = I.table(spark, path, "documents").select(
        F.col("source").alias("batch_id"), F.expr("doc_id div 2").alias("item_id"),
        F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text")).alias("text"),
    )
    return rules.batch_checks(i).select(
        "batch_id", "item_count", "estimated_time_ms", "empty_items",
        F.array_contains("errors", "Duplicate item IDs found").alias("duplicate_ids"),
        F.array_contains("warnings", "Large batch size").alias("large"), "valid",
    )
