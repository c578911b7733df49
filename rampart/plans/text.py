"""Queries over scalar text functions."""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from rampart.functions.unnest import unnest
from rampart.functions import rule_tables as R
from rampart.functions import text as X
from rampart.functions.regexes import sql_regex, sql_str
from rampart.plans import inputs as I
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import query


def r6(c, digits: int = 6):
    return F.round(c, digits)


def _has(col: str, pattern: str, **flags: bool) -> str:
    return f"regexp_matches({col}, {sql_str(sql_regex(pattern, **flags))})"


def _stripped(col: str, pattern: str) -> str:
    return f"length(regexp_replace({col}, {sql_str(pattern)}, '', 'g'))"


def _count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {sql_str(sql_regex(pattern))}))"


SPECIAL = r"[\p{L}\p{N}\s\x{A0}\x{0B}]"


def complexity_sql(text: str = "text") -> str:
    code = " + ".join(f"{_has(text, p)}::INT" for p in R.CODE_INDICATORS)
    return f"""length({text})::INT AS length, {_count(text, chr(92) + 'S+')}::INT AS word_count,
      round({_stripped(text, SPECIAL)} / greatest(length({text}), 1)::DOUBLE, 6) AS special_char_ratio,
      {_has(text, X.BASE64_RUN)} AS has_base64, {_has(text, r'\\x[0-9a-fA-F]{2}')} AS has_hex,
      {_has(text, r'\\u[0-9a-fA-F]{4}')} AS has_unicode, {_count(text, r'https?://[^' + chr(92) + 's]+')}::INT AS url_count,
      round(({code}) / 8.0::DOUBLE, 6) AS code_score"""


def sanitize_sql(text: str, aggressive: str) -> str:
    t = rf"regexp_replace(regexp_replace({text}, '\\x[0-9a-fA-F]{{2}}', '', 'g'), '\\u[0-9a-fA-F]{{4}}', '', 'g')"
    t = f"CASE WHEN {aggressive} THEN regexp_replace({t}, '[A-Za-z0-9+/]{{40,}}={{0,2}}', '[REMOVED_ENCODING]', 'g') ELSE {t} END"
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?i)javascript:\S*", r"(?i)data:text/html\S*"):
        t = f"regexp_replace({t}, '{pattern}', '[REMOVED]', 'g')"
    t = rf"translate(regexp_replace({t}, '\s{{10,}}', ' ', 'g'), chr(8203) || chr(8204) || chr(8205) || chr(65279), '')"
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


@query("sanitize", f"SELECT page_id, {sanitize_sql('html', 'false')} AS clean, {sanitize_sql('html', 'true')} AS clean_aggressive FROM pages")
def _sanitize(spark, path):
    p = I.table(spark, path, "pages")
    return p.select("page_id", X.sanitize("html").alias("clean"), X.sanitize("html", True).alias("clean_aggressive"))


@query("complexity_metrics", with_ctes("prompts", f"SELECT doc_id, {complexity_sql()} FROM prompts"))
def _complexity(spark, path):
    cols = X.complexity_metrics("text")
    rounded = ("special_char_ratio", "code_score")
    return I.prompts(spark, path).select(
        "doc_id", *[(r6(c) if n in rounded else c).alias(n) for n, c in cols.items()]
    )


# The joined conversation is never built: its messages are separated by one blank, so
# sums, maxima and ors over messages give the same figures.
@query(
    "conversation_complexity",
    with_ctes("messages", f"""SELECT conv_id, (sum(length(text)) + count(*) - 1)::BIGINT AS length,
      sum({_count('text', chr(92) + 'S+')})::BIGINT AS word_count,
      round(sum({_stripped('text', SPECIAL)}) / greatest(sum(length(text)) + count(*) - 1, 1)::DOUBLE, 6) AS special_char_ratio,
      bool_or({_has('text', X.BASE64_RUN)}) AS has_base64,
      sum({_count('text', r'https?://[^' + chr(92) + 's]+')})::BIGINT AS url_count FROM messages GROUP BY conv_id"""),
)
def _conv_complexity(spark, path):
    m = X.complexity_metrics("text")
    per = I.messages(spark, path).select(
        "conv_id", m["length"].alias("n"), m["word_count"].alias("w"), m["has_base64"].alias("b"),
        m["url_count"].alias("u"), F.round(m["special_char_ratio"] * F.length("text")).cast("long").alias("s"),
    )
    length = F.sum("n") + F.count("*") - 1
    return per.groupBy("conv_id").agg(
        length.alias("length"), F.sum("w").alias("word_count"),
        r6(F.sum("s") / F.greatest(length, F.lit(1))).alias("special_char_ratio"),
        F.bool_or("b").alias("has_base64"), F.sum("u").alias("url_count"),
    )


_FEATURE_SQL = with_ctes("prompts", f""", ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM prompts),
  chn AS (SELECT doc_id, c, count(*) AS n FROM ch GROUP BY doc_id, c),
  tot AS (SELECT doc_id, sum(n) AS t, count(*) AS d FROM chn GROUP BY doc_id),
  ent AS (SELECT doc_id, -sum(n / t::DOUBLE * log2(n / t::DOUBLE)) AS entropy, max(d) AS d FROM chn JOIN tot USING (doc_id) GROUP BY doc_id),
  pos AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM
     (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM prompts)),
  isl AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM pos),
  rep AS (SELECT doc_id, max(n) AS max_repetition FROM (SELECT doc_id, c, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY doc_id),
  w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM prompts)
SELECT p.doc_id, length(text)::INT AS length, len(ws)::INT AS word_count, length(translate(text, ' ' || chr(10), ''))::INT AS char_count,
  (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS line_count, round(entropy, 5) AS entropy,
  round(d / length(text)::DOUBLE, 6) AS char_diversity, round(len(list_distinct(ws)) / greatest(len(ws), 1)::DOUBLE, 6) AS word_diversity,
  round(length(array_to_string(ws, '')) / greatest(len(ws), 1)::DOUBLE, 6) AS avg_word_length,
  round((length(text) - length(translate(text, {sql_str(R.FEATURE_PUNCTUATION)}, ''))) / length(text)::DOUBLE, 6) AS punctuation_ratio,
  round({_stripped('text', SPECIAL)} / length(text)::DOUBLE, 6) AS special_char_ratio,
  round({_stripped('text', chr(92) + 'P{Lu}')} / length(text)::DOUBLE, 6) AS uppercase_ratio,
  round({_stripped('text', chr(92) + 'P{Nd}')} / length(text)::DOUBLE, 6) AS digit_ratio,
  round({_stripped('text', chr(92) + 'S')} / length(text)::DOUBLE, 6) AS whitespace_ratio,
  {_has('text', R.FEATURE_ENCODING)} AS has_encoding, {_has('text', R.FEATURE_DELIMITERS)} AS has_delimiters,
  {_has('lower(text)', R.FEATURE_ROLES)} AS has_role_markers, {_has('lower(text)', R.FEATURE_INSTRUCTIONS)} AS has_instructions,
  max_repetition::INT AS max_repetition
FROM prompts p JOIN ent USING (doc_id) JOIN rep USING (doc_id) JOIN w USING (doc_id)""")


@query("text_features", _FEATURE_SQL)
def _features(spark, path):
    f = X.text_features(I.prompts(spark, path).select("doc_id", "text"))
    doubles = {c for c, t in f.dtypes if t == "double"}
    return f.select("doc_id", *[
        (r6(F.col(c), 5 if c == "entropy" else 6) if c in doubles else F.col(c)).alias(c) for c in X.SCALAR_FEATURES
    ])


@query("shannon_entropy", with_ctes("messages", """, ch AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s).')) AS c FROM messages),
  n AS (SELECT conv_id, turn, c, count(*) AS n FROM ch GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS t FROM n)
  SELECT conv_id, turn, round(-sum(n / t::DOUBLE * log2(n / t::DOUBLE)), 5) AS entropy FROM t GROUP BY conv_id, turn"""))
def _entropy(spark, path):
    return I.messages(spark, path).select("conv_id", "turn", r6(X.shannon_entropy("text"), 5).alias("entropy"))


@query("max_repetition", """WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s).')) AS c, generate_subscripts(regexp_extract_all(html, '(?s).'), 1) AS i FROM pages),
  g AS (SELECT page_id, c, i - row_number() OVER (PARTITION BY page_id, c ORDER BY i) AS g FROM x)
  SELECT page_id, max(n)::INT AS max_repetition FROM (SELECT page_id, c, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY page_id""")
def _max_rep(spark, path):
    return I.table(spark, path, "pages").select("page_id", X.max_repetition("html").alias("max_repetition"))


def _top_ngrams(df, key: str, grams, top: int = 100):
    """Most common n-grams per text.  Where a key has one row, as nearly all have, its n-grams are counted
    and ranked in that row and only the `top` leave it; other keys' counts are put together first."""
    alone = df.groupBy(key).agg(F.count("*").alias("_rows")).filter("_rows = 1").select(key, F.lit(True).alias("_alone"))
    known = df.join(alone, key, "left")

    @F.pandas_udf("array<struct<ngram string, n long>>")
    def ranked(values: pd.Series) -> pd.Series:
        counts = (Counter(v if v is not None else ()) for v in values)
        return pd.Series([[{"ngram": g, "n": n} for n, g in heapq.nsmallest(top, ((-n, g) for g, n in c.items()))] for c in counts])

    found = known.filter("_alone").select(key, F.posexplode_outer(ranked(grams)).alias("_at", "g")).filter("g is not null")
    single = found.select(key, "g.ngram", (-F.col("g.n")).alias("n"), (F.col("_at") + 1).alias("rk"))
    counts = unnest(known.filter("_alone is null"), grams, "ngram", key).groupBy(key, "ngram").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "ngram")
    return single.unionByName(counts.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top))


@query("char_ngrams", with_ctes("messages", """, p AS (SELECT conv_id * 1000 + turn AS msg, lower(text) AS t FROM messages),
  g AS (SELECT msg, substring(t, i, k) AS ngram FROM p, (SELECT unnest([2, 3]) AS k), LATERAL (SELECT unnest(generate_series(1, length(t) - k + 1)) AS i))
  SELECT msg, ngram, n, rk FROM (SELECT msg, ngram, count(*) AS n, row_number() OVER (PARTITION BY msg ORDER BY count(*) DESC, ngram) AS rk
    FROM g WHERE regexp_matches(ngram, '\\S') GROUP BY msg, ngram) WHERE rk <= 100"""))
def _char_ngrams(spark, path):
    m = I.messages(spark, path).select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), "text")
    return _top_ngrams(m, "msg", X.char_ngram_array("text"))


@query("word_ngrams", with_ctes("messages", """, p AS (SELECT conv_id * 1000 + turn AS msg, regexp_extract_all(lower(text), '\\S+') AS w FROM messages),
  g AS (SELECT msg, array_to_string(w[i:i + k - 1], ' ') AS ngram FROM p, (SELECT unnest([2, 3]) AS k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i))
  SELECT msg, ngram, n, rk FROM (SELECT msg, ngram, count(*) AS n, row_number() OVER (PARTITION BY msg ORDER BY count(*) DESC, ngram) AS rk
    FROM g GROUP BY msg, ngram) WHERE rk <= 100"""))
def _word_ngrams(spark, path):
    m = I.messages(spark, path).select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), "text")
    return _top_ngrams(m, "msg", X.word_ngram_array("text"))


@query("normalize_unicode")
def _normalize(spark, path):
    return I.prompts(spark, path).select(
        "doc_id", X.normalize_unicode("text").alias("normalized"), X.normalize_unicode("text", False).alias("native")
    )


_FROM = "".join(a for a, _ in X.HOMOGLYPHS)
_TO = "".join(b for _, b in X.HOMOGLYPHS)


@query("latin_lookalikes", with_ctes("prompts", f"SELECT doc_id, translate(text, {sql_str(_FROM)}, {sql_str(_TO)}) AS latin FROM prompts"))
def _lookalikes(spark, path):
    return I.prompts(spark, path).select("doc_id", X.latin_lookalikes("text").alias("latin"))


_SCRIPT_CASE = " ".join(f"WHEN regexp_matches(w, {sql_str(p)}) THEN '{lang}'" for p, lang, _ in X.SCRIPTS)
_SCRIPT_CONF = " ".join(f"WHEN regexp_matches(w, {sql_str(p)}) THEN {c}" for p, _, c in X.SCRIPTS)
# Latin text is moved into other scripts by source, so that every branch occurs
_MOVED = [("src1", "a", "а"), ("src2", "e", "の"), ("src3", "o", "中"), ("src4", "i", "한"), ("src5", "n", "ع"), ("src6", "r", "ह"), ("src7", "t", "ы")]
_MOVED_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN replace(text, '{a}', '{b}')" for s, a, b in _MOVED) + " ELSE text END"


def moved_text():
    c = None
    for s, a, b in _MOVED:
        v = F.replace(F.col("text"), F.lit(a), F.lit(b))
        c = F.when(F.col("source") == s, v) if c is None else c.when(F.col("source") == s, v)
    return c.otherwise(F.col("text"))


@query("script_language", f"""WITH d AS (SELECT doc_id, {_MOVED_SQL} AS w FROM documents)
  SELECT doc_id, CASE {_SCRIPT_CASE} ELSE 'en' END AS language, CAST(CASE {_SCRIPT_CONF} ELSE 0.4 END AS DOUBLE) AS confidence FROM d""")
def _script(spark, path):
    d = I.table(spark, path, "documents").select("doc_id", moved_text().alias("w"))
    return d.select("doc_id", X.script_language("w").alias("language"), X.script_confidence("w").alias("confidence"))


@query("unicode_profile", f"""WITH d AS (SELECT doc_id, {_MOVED_SQL} AS w FROM documents)
  SELECT doc_id, length(regexp_replace(w, '[^\\p{{P}}\\p{{S}}]', '', 'g'))::INT AS special_char_count,
    length(regexp_replace(w, '[^\\p{{Arabic}}\\p{{Hebrew}}]', '', 'g'))::INT AS rtl_char_count,
    CASE WHEN length(regexp_replace(w, '[^\\p{{Arabic}}\\p{{Hebrew}}]', '', 'g')) > length(w) / 2 THEN 'rtl' ELSE 'ltr' END AS direction,
    regexp_matches(w, '\\p{{So}}') AS has_emoji FROM d""")
def _unicode(spark, path):
    d = I.table(spark, path, "documents").select("doc_id", moved_text().alias("w"))
    p = X.unicode_profile("w")
    return d.select("doc_id", *[p[c].alias(c) for c in ("special_char_count", "rtl_char_count", "direction", "has_emoji")])


@query("scan_window", with_ctes("prompts", """SELECT doc_id, CASE WHEN length(text) > 10000 THEN left(text, 5000) || ' ... ' || right(text, 5000) ELSE text END AS scanned FROM prompts"""))
def _window(spark, path):
    return I.prompts(spark, path).select("doc_id", X.scan_window("text").alias("scanned"))


# card numbers are made from order keys: 13 to 19 digits, some valid
_CARD = "concat(cast(4000000000000 + o_orderkey * 7919 as string), right(cast(o_custkey * 97 + 1000000 as string), cast(o_orderkey % 8 as int)))"


@query("luhn_valid", """WITH o AS (SELECT o_orderkey, CAST(4000000000000 + o_orderkey * 7919 AS VARCHAR) || right(CAST(o_custkey * 97 + 1000000 AS VARCHAR), (o_orderkey % 8)::INT) AS card FROM orders),
  d AS (SELECT o_orderkey, card, unnest(generate_series(1, length(card))) AS i FROM o),
  v AS (SELECT o_orderkey, card, (length(card) - i) % 2 AS odd, CAST(substring(card, i, 1) AS INT) AS x FROM d)
  SELECT o_orderkey, card, (length(card) BETWEEN 13 AND 19) AND sum(CASE WHEN odd = 1 THEN CASE WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END ELSE x END) % 10 = 0 AS valid FROM v GROUP BY o_orderkey, card""")
def _luhn(spark, path):
    o = I.table(spark, path, "orders").select("o_orderkey", F.expr(_CARD).alias("card"))
    return o.select("o_orderkey", "card", X.luhn_valid("card").alias("valid"))


_KINDS = ["email", "credit_card", "ssn", "phone", "api_key"]
_VALUES_SPARK = """CASE c_custkey % 5 WHEN 0 THEN concat(lower(replace(c_name, '#', '.')), '@example.com') WHEN 1 THEN concat('4111-1111-', lpad(cast(c_custkey as string), 8, '0'))
  WHEN 2 THEN '123-45-6789' WHEN 3 THEN concat('555-123-', lpad(cast(c_custkey % 10000 as string), 4, '0')) ELSE left(c_name, cast(c_custkey % 18 as int)) END"""
_VALUES_SQL = _VALUES_SPARK.replace("concat(lower(replace(c_name, '#', '.')), '@example.com')", "lower(replace(c_name, '#', '.')) || '@example.com'")


@query("mask_value", """WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'ssn' WHEN 3 THEN 'phone' ELSE 'api_key' END AS kind,
   CASE c_custkey % 5 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' WHEN 1 THEN '4111-1111-' || lpad(c_custkey::VARCHAR, 8, '0')
   WHEN 2 THEN '123-45-6789' WHEN 3 THEN '555-123-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') ELSE left(c_name, (c_custkey % 18)::INT) END AS value FROM customer)
  SELECT c_custkey, kind, value, CASE WHEN length(value) <= 4 THEN '****'
   WHEN kind = 'email' THEN CASE WHEN length(split_part(value, '@', 1)) > 2 THEN left(value, 2) ELSE '' END || '***@' || split_part(value, '@', 2)
   WHEN kind = 'credit_card' THEN '****-****-****-' || right(replace(value, '-', ''), 4) WHEN kind = 'ssn' THEN '***-**-****'
   WHEN kind = 'phone' THEN left(regexp_replace(value, '\\D', '', 'g'), 3) || '-***-****'
   WHEN length(value) > 6 THEN left(value, 2) || repeat('*', length(value) - 4) || right(value, 2) ELSE repeat('*', length(value)) END AS masked FROM c""")
def _mask(spark, path):
    c = I.table(spark, path, "customer")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("c_custkey") % 5 + 1).cast("int"))
    v = c.select("c_custkey", kind.alias("kind"), F.expr(_VALUES_SPARK).alias("value"))
    return v.select("*", X.mask_value("value", "kind").alias("masked"))


@query("mask_custom", """SELECT c_custkey, m AS mask_format, CASE WHEN len(m) - len(replace(m, '*', '')) > 0 AND len(m) - len(replace(m, '*', '')) >= len(v) THEN repeat('*', len(v)) ELSE m END AS masked
  FROM (SELECT c_custkey, left(c_name, (c_custkey % 18 + 1)::INT) AS v, CASE c_custkey % 3 WHEN 0 THEN 'EMP-****' WHEN 1 THEN '[INTERNAL_KEY]' ELSE 'PROJ-****-**' END AS m FROM customer)""")
def _mask_custom(spark, path):
    c = I.table(spark, path, "customer").select(
        "c_custkey", F.expr("left(c_name, cast(c_custkey % 18 + 1 as int))").alias("v"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'EMP-****' WHEN 1 THEN '[INTERNAL_KEY]' ELSE 'PROJ-****-**' END").alias("mask_format"),
    )
    return c.select("c_custkey", "mask_format", X.mask_custom("v", "mask_format").alias("masked"))


@query("regex_complexity", r"""SELECT page_id, ((len(html) - len(replace(html, '*', ''))) * 10 + (len(html) - len(replace(html, '+', ''))) * 10
   + (len(html) - len(replace(html, '{', ''))) * 5 + (len(html) - len(replace(html, '(?', ''))) // 2 * 15
   + len(regexp_extract_all(html, '\(.*\)\*')) * 20 + len(regexp_extract_all(html, '\(.*\)\+')) * 20
   + CASE WHEN contains(html, '|') AND (contains(html, '*') OR contains(html, '+')) THEN 30 ELSE 0 END)::INT AS complexity FROM pages""")
def _regex_complexity(spark, path):
    return I.table(spark, path, "pages").select("page_id", X.regex_complexity("html").alias("complexity"))


@query("content_keys", with_ctes("messages", """SELECT conv_id, turn, left(sha256(role || ':' || text), 16) AS full_key, left(sha256(text), 16) AS prompt_key,
  left(sha256(role || ':' || left(text, 200)), 16) AS preview_key FROM messages"""))
def _keys(spark, path):
    return I.messages(spark, path).select(
        "conv_id", "turn", X.content_key("role", "text").alias("full_key"),
        X.content_key("role", "text", "prompt").alias("prompt_key"), X.content_key("role", "text", "preview").alias("preview_key"),
    )


_ANSWER = """CASE event_id % 7
  WHEN 0 THEN concat('{"category": "jailbreak", "confidence": ', cast(event_id % 100 as string), 'e-2, "explanation": "plain"}')
  WHEN 1 THEN concat('Sure: {"category": " Prompt_Leak ", "confidence": 0.5, "explanation": "id ', cast(event_id as string), '"} done')
  WHEN 2 THEN '{"category": "nonsense", "confidence": 0.9}'
  WHEN 3 THEN '{"category": "jailbreak", "confidence": 1.5}'
  WHEN 4 THEN 'no object here'
  WHEN 5 THEN 'x {"a": {"b": {"c": 1}}, "category": "benign", "confidence": "0.25"} y'
  ELSE '{"category": "role_manipulation", "confidence": "high"}' END"""


@query("parse_classifier_json", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'jailbreak' WHEN 1 THEN 'prompt_leak' ELSE 'benign' END AS category,
  CAST(CASE event_id % 7 WHEN 0 THEN round((event_id % 100) / 100.0, 2) WHEN 1 THEN 0.5 WHEN 2 THEN 0.9 WHEN 5 THEN 0.25 ELSE 0 END AS DOUBLE) AS confidence,
  CASE event_id % 7 WHEN 0 THEN 'plain' WHEN 1 THEN 'id ' || event_id WHEN 2 THEN '' WHEN 5 THEN '' WHEN 4 THEN 'Could not parse response (parsing error)'
    ELSE 'Response parsing error: invalid confidence value' END AS explanation FROM events""")
def _answers(spark, path):
    a = I.table(spark, path, "events").select("event_id", F.expr(_ANSWER).alias("answer"))
    return a.select("event_id", X.parse_classifier_json("answer").alias("p")).select("event_id", "p.*")


@query("log_template", with_ctes("logs", r"""SELECT request_id, regexp_replace(regexp_replace(regexp_replace(message || ' for u' || user_id || '@mail.example.com in 0a1b2c3d-0000-1111-2222-0123456789ab',
   '[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}', 'UUID', 'g'), '\d+', 'N', 'g'),
   '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', 'EMAIL', 'g') AS template FROM logs"""))
def _template(spark, path):
    m = F.concat("message", F.lit(" for u"), F.col("user_id").cast("string"), F.lit("@mail.example.com in 0a1b2c3d-0000-1111-2222-0123456789ab"))
    return I.logs(spark, path).select("request_id", X.log_template(m).alias("template"))


def request_headers():
    return F.map_from_arrays(
        F.array(F.lit("Authorization"), F.lit("user-agent"), F.lit("x-forwarded-for"), F.lit("x-real-ip"), F.lit("referer")),
        F.array(
            F.lit("Bearer abc"), F.col("user_agent"),
            F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("10.0.0."), (F.col("client") % 250).cast("string"), F.lit(", 10.1.1.1"))).otherwise(""),
            F.when(F.col("request_id") % 3 == 1, F.concat(F.lit("10.2.0."), (F.col("client") % 250).cast("string"))).otherwise(""),
            F.repeat(F.lit("r"), (F.col("request_id") % 300).cast("int")),
        ),
    )


@query("sanitize_headers", with_ctes("requests", """SELECT request_id, '[REDACTED]' AS authorization, user_agent,
   CASE WHEN request_id % 300 > 200 THEN repeat('r', 200) || '...' ELSE repeat('r', (request_id % 300)::INT) END AS referer FROM requests"""))
def _headers(spark, path):
    h = I.requests(spark, path).select("request_id", X.sanitize_headers(request_headers()).alias("h"))
    return h.select("request_id", F.col("h")["Authorization"].alias("authorization"), F.col("h")["user-agent"].alias("user_agent"), F.col("h")["referer"].alias("referer"))


@query("client_ip", with_ctes("requests", """SELECT request_id, CASE request_id % 3 WHEN 0 THEN '10.0.0.' || (client % 250) WHEN 1 THEN '10.2.0.' || (client % 250)
   ELSE '192.168.0.' || (client % 200) END AS ip FROM requests"""))
def _ip(spark, path):
    remote = F.concat(F.lit("192.168.0."), (F.col("client") % 200).cast("string"))
    return I.requests(spark, path).select("request_id", X.client_ip(request_headers(), remote).alias("ip"))


def _lit_count(word: str) -> str:
    return f"((length(text) - length(replace(text, '{word}', ''))) // {len(word)})::INT"


@query("keyword_features", with_ctes("prompts", f"""SELECT doc_id, length(text)::INT AS length, {_lit_count('ignore')} AS n_ignore, {_lit_count('system')} AS n_system,
  {_lit_count('!')} AS n_exclaim, {_lit_count('?')} AS n_question, {_lit_count('<')} AS n_lt, {_lit_count('>')} AS n_gt,
  contains(lower(text), 'override')::INT AS has_override, contains(lower(text), 'instruction')::INT AS has_instruction, contains(lower(text), 'prompt')::INT AS has_prompt FROM prompts"""))
def _keywords(spark, path):
    return I.prompts(spark, path).select("doc_id", *[c.alias(n) for n, c in X.keyword_features("text").items()])


@query("regex_from_text", r"""SELECT p_partkey, regexp_replace(replace(regexp_replace(p_name || ' (' || p_brand || ')', '([\\.^$|?*+()\[\]{}&~#\- ])', '\\\1', 'g'), '\ ', '\s+'), '[0-9]+', '\\d+', 'g') AS regex FROM part""")
def _from_text(spark, path):
    p = I.table(spark, path, "part")
    return p.select("p_partkey", X.regex_from_text(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("regex"))


@query("language_profile")
def _language_profile(spark, path):
    from rampart.operators.language import language_profile

    return language_profile(I.table(spark, path, "documents"), "doc_id", "text", "lang")


@query("sql_functions", with_ctes("messages", """SELECT conv_id, turn, left(sha256(role || ':' || text), 16) AS k, length(CASE WHEN length(text) > 400 THEN left(text, 200) || ' ... ' || right(text, 200) ELSE text END)::INT AS n FROM messages"""))
def _sql_functions(spark, path):
    I.messages(spark, path).createOrReplaceTempView("rampart_messages")
    X.register_sql_functions(spark)
    return spark.sql("SELECT conv_id, turn, rampart_content_key(role, text) AS k, length(rampart_scan_window(text, 200)) AS n FROM rampart_messages")
