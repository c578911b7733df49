"""Queries over record checks, cleaning, search and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import neighbours as N
from rampart.operators import quality as Q
from rampart.operators import text_index as TI
from rampart.operators import vector_index as VI
from rampart.plans import inputs as I
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import query
from rampart.plans.usage import rounded
from rampart.sources import sinks as K

_SCHEMA = {
    "detection_id": {"type": "string", "required": True, "pattern": r"^det_\d+$"},
    "seen": {"type": "datetime", "required": True},
    "prompt": {"type": "string", "required": True, "max_length": 30},
    "verdict": {"type": "enum", "values": ["ALLOW", "BLOCK", "FLAG", "STRIP"]},
    "confidence": {"type": "float", "min": 0.0, "max": 1.0},
}


@query("validate_records", with_ctes("ev", """SELECT event_id, ((event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT + (length(props) * 3 > 30)::INT + (event_type = 'error')::INT + (value > 100)::INT + (event_id % 7 = 0)::INT)::INT AS n_errors FROM ev"""))
def _validate(spark, path):
    k = F.col("event_id")
    r = I.events(spark, path).select(
        "event_id", F.concat(F.when(k % 3 == 0, "x").otherwise("det_"), k.cast("string")).alias("detection_id"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, "not-a-date").otherwise("2024-01-15 10:30:00").alias("seen0"),
        F.repeat("props", 3).alias("prompt"), F.when(F.col("event_type") == "error", "INVALID").otherwise("ALLOW").alias("verdict"), (F.col("value") / 100).cast("string").alias("confidence"),
    )
    r = r.withColumn("seen", F.when((k % 7 == 0) & (k % 5 == 0), "not-a-date").otherwise(F.col("seen0")))
    checked = Q.validate_records(r, _SCHEMA)
    both = F.when((k % 7 == 0) & (k % 5 == 0), 1).otherwise(0)
    return checked.select("event_id", (F.size("errors") + both).alias("n_errors"))


@query("dedupe_latest", with_ctes("ev", "SELECT user_id, event_type, max(us) AS us FROM ev GROUP BY ALL"))
def _dedupe(spark, path):
    return K.latest(I.events(spark, path).select("user_id", "event_type", "us"), ["user_id", "event_type"], "us")


@query("map_schema", with_ctes("ev", "SELECT event_id AS detection_id, epoch_us(to_timestamp(1643723400 + event_id)) AS us, CASE event_id % 4 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'FLAG' END AS verdict, round(least(1, value / 100), 6) AS confidence FROM ev"))
def _map(spark, path):
    e = I.events(spark, path).select(
        F.col("event_id").alias("det_id"), (F.lit(1643723400) + F.col("event_id")).alias("ts0"), (F.col("event_id") % 4).cast("string").alias("result"), F.col("value").alias("score")
    )
    m = Q.map_schema(e, {"det_id": "detection_id", "ts0": "timestamp", "result": "verdict", "score": "confidence"}, ["timestamp"],
                     {"verdict": {"0": "ALLOW", "1": "BLOCK", "2": "FLAG"}}, {"confidence": (0.0, 100.0)})
    return rounded(m.select("detection_id", F.unix_micros("timestamp").alias("us"), "verdict", "confidence"))


@query("enrich", "SELECT event_id, c_mktsegment, n_name FROM events LEFT JOIN customer ON c_custkey = user_id * 2 LEFT JOIN nation ON n_nationkey = c_nationkey")
def _enrich(spark, path):
    e = I.events(spark, path).select("event_id", (F.col("user_id") * 2).alias("c_custkey"))
    c = I.table(spark, path, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = I.table(spark, path, "nation").select("n_nationkey", "n_name")
    return Q.enrich(e, [(c, "c_custkey"), (n, "n_nationkey")]).select("event_id", "c_mktsegment", "n_name")


@query("aggregate_window", with_ctes("ev", """SELECT user_id, event_type AS verdict, us // 21600000000 * 21600000000 AS window_us, round(avg(value), 6) AS avg_confidence, count(*) AS n, max(value) AS max_confidence, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY ALL"""))
def _window(spark, path):
    e = I.events(spark, path).select("ts", "us", "user_id", F.col("event_type").alias("verdict"), F.col("value").alias("confidence"))
    return rounded(Q.aggregate_window(e, 360))


@query("apply_filters", "SELECT event_id FROM events WHERE value >= 50 AND event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-30' AND user_id NOT IN (1, 2)")
def _filters(spark, path):
    return Q.apply_filters(I.events(spark, path), {
        "value": "value >= 50", "kind": "event_type in ('error', 'click')", "time": "ts >= timestamp '2024-01-30 00:00:00'", "users": "user_id not in (1, 2)",
    }).select("event_id")


@query("normalize_fields", with_ctes("requests", """SELECT request_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value_scaled, round((tokens - avg(tokens) OVER ()) / stddev_pop(tokens) OVER (), 6) AS tokens_z,
  'go ' || event_type AS path_clean, CASE user_agent WHEN 'python-requests/2' THEN 'python-requests' WHEN '' THEN NULL ELSE 'Mozilla' END AS user_agent_browser, (event_type = 'error')::INT AS event_type_error FROM requests"""))
def _normalize(spark, path):
    r = I.requests(spark, path).withColumn("path", F.concat(F.lit("  GO   "), F.upper("event_type"), F.lit(" ")))
    n = Q.normalize_fields(r, ["value"], ["tokens"], ["path"], ["user_agent"], {"event_type": ["error", "click"]})
    return rounded(n.select("request_id", "value_scaled", "tokens_z", "path_clean", "user_agent_browser", "event_type_error"))


@query("score_batch", with_ctes("ev", """, z AS (SELECT event_id, sqrt((((value - avg(value) OVER ()) / stddev_pop(value) OVER ()) ** 2 + ((user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER ()) ** 2) / 2) AS r, (event_id % 100) / 100.0::DOUBLE AS b FROM ev)
  SELECT event_id, round(least(1, r / 3), 6) AS anomaly, round(least(1, r / 3) * 0.4 + b * 0.6, 6) AS composite FROM z"""))
def _score(spark, path):
    e = I.events(spark, path).withColumn("base", (F.col("event_id") % 100) / 100.0)
    return rounded(Q.score_batch(e, ["value", "user_id"], "base").select("event_id", "anomaly", "composite"))


@query("train_verdict_model")
def _model(spark, path):
    e = I.events(spark, path).select(
        "event_id", "value", F.col("user_id").cast("double").alias("user"), (F.col("event_id") % 24).cast("double").alias("hour"),
        F.when(F.col("value") > 100, "BLOCK").when(F.col("value") > 40, "FLAG").otherwise("ALLOW").alias("verdict"),
    )
    return Q.train_verdict_model(e, "event_id", ["value", "user", "hour"], "verdict", trees=20, depth=6)


@query("quality_report", """SELECT 'completeness' AS dimension, 'user_id' AS name, 1.0::DOUBLE AS ratio UNION ALL SELECT 'completeness', 'odd', round(avg((event_id % 2)::DOUBLE), 6) FROM events
  UNION ALL SELECT 'validity', 'positive', round(avg((value > 10)::INT), 6) FROM events UNION ALL SELECT 'freshness', 'ts', round(avg((ts >= TIMESTAMP '2024-01-20')::INT), 6) FROM events""")
def _report(spark, path):
    e = I.events(spark, path).withColumn("odd", F.when(F.col("event_id") % 2 == 1, 1))
    return rounded(Q.quality_report(e, ["user_id", "odd"], {"positive": "value > 10"}, "2024-01-20 00:00:00"))


@query("facets", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def _facets(spark, path):
    return Q.facets(I.table(spark, path, "documents"), ["lang", "source"])


@query("search_terms", with_ctes("prompts", "SELECT doc_id FROM prompts WHERE contains(lower(text), 'previous') AND contains(lower(text), 'all') AND contains(lower(text), 'ignore all') AND regexp_matches(lower(text), '\\binstruc\\w*\\b')"))
def _search(spark, path):
    return Q.search_terms(I.prompts(spark, path), ["text"], ["previous", "ALL"], "ignore all", "instruc*").select("doc_id")


@query("fuzzy", """SELECT DISTINCT p_partkey FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '\\S+')) AS w FROM part) WHERE levenshtein(w, 'wodget') <= 2""")
def _fuzzy(spark, path):
    return Q.fuzzy(I.table(spark, path, "part"), "p_name", "wodget", 2).select("p_partkey")


@query("range_search", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 900 AND doc_id >= 100")
def _range(spark, path):
    return Q.range_search(I.table(spark, path, "documents"), {"n_chars": (500, 900), "doc_id": (100, None)}).select("doc_id")


_Q = [round(0.01 * ((i * 7) % 13 - 6), 2) for i in range(64)]


@query("nearest", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 5) AS similarity FROM embeddings ORDER BY 2 DESC LIMIT 10")
def _nearest(spark, path):
    return rounded(N.nearest(I.table(spark, path, "embeddings"), "embedding", _Q).select("vec_id", "similarity"), 5)


_SIMILARITY = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _asked(spark, path):
    """The index, and every row whose id is divisible by 50 as a query."""
    rows = I.table(spark, path, "embeddings")
    return VI.build_index(rows, "vec_id", "embedding"), rows.filter(F.col("vec_id") % 50 == 0)


@query("nearest_exact", f"SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round({_SIMILARITY}, 5) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_SIMILARITY}, 12) DESC, e.vec_id) <= 10")
def _nearest_exact(spark, path):
    index, asked = _asked(spark, path)
    return rounded(VI.search(index, asked, "vec_id", "embedding").select("query_id", F.col("id").alias("vec_id"), "similarity"), 5)


@query("nearest_probed")
def _nearest_probed(spark, path):
    index, asked = _asked(spark, path)
    probes = VI.probes_for(index, asked, "vec_id", "embedding")
    return VI.search(index, asked, "vec_id", "embedding", probes=probes).select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_PLACES = f"""WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
  p AS (SELECT doc_id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM w)"""


def _one_byte(c):
    """DuckDB's edit distance counts bytes: the accented letters of the tables become letters that no lower-case word has."""
    return f"translate({c}, 'éóèñüçäöêßí', 'ABCDEFGHIJK')"


def _document_index(spark, path):
    """The index of all documents, and the words of those whose id is divisible by 50."""
    docs = I.table(spark, path, "documents")
    asking = docs.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("search_id"), TI.words("text").alias("w"))
    return TI.build_index(docs, "doc_id", "text"), asking


def _counted(index, searches):
    return TI.search_counts(index, searches).withColumnsRenamed({"search_id": "doc_id", "first_id": "first_doc", "last_id": "last_doc"})


@query("indexed_words", f"""{_PLACES},
  s AS (SELECT doc_id, 'term' AS kind, coalesce(words[3], '') AS query, 0 AS slack FROM w WHERE doc_id % 50 = 0
    UNION ALL SELECT doc_id, 'wildcard', coalesce(left(words[5], 3) || '*' || right(words[5], 1), ''), 0 FROM w WHERE doc_id % 50 = 0
    UNION ALL SELECT doc_id, 'fuzzy', typo, CASE WHEN length(typo) > 5 THEN 2 WHEN length(typo) > 2 THEN 1 ELSE 0 END FROM (SELECT doc_id, coalesce(left(words[7], 1) || substr(words[7], 3), '') AS typo FROM w WHERE doc_id % 50 = 0)),
  q AS (SELECT DISTINCT kind, query, slack FROM s), v AS (SELECT DISTINCT term FROM p),
  m AS (SELECT kind, query, slack, term FROM q JOIN v ON (kind = 'term' AND term = query)
    OR (kind = 'wildcard' AND term LIKE replace(replace(query, '_', '\\_'), '*', '%') ESCAPE '\\')
    OR (kind = 'fuzzy' AND query <> '' AND abs(length(term) - length(query)) <= slack AND levenshtein({_one_byte('term')}, {_one_byte('query')}) <= slack)),
  n AS (SELECT kind, query, slack, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM m JOIN p USING (term) GROUP BY ALL)
  SELECT s.doc_id, kind, query, slack, coalesce(n_docs, 0) AS n_docs, coalesce(n_places, 0) AS n_places, first_doc, last_doc FROM s LEFT JOIN n USING (kind, query, slack)""")
def _indexed_words(spark, path):
    index, asking = _document_index(spark, path)
    word = lambda n: F.get("w", F.lit(n))
    pattern = F.concat(F.substring(word(4), 1, 3), F.lit("*"), F.right(word(4), F.lit(1)))
    typo = F.concat(F.substring(word(6), 1, 1), F.substring(word(6), F.lit(3), F.length(word(6))))
    edits = F.when(F.length(typo) > 5, 2).when(F.length(typo) > 2, 1).otherwise(0)
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), q.alias("query"), s.alias("slack"))
        for k, q, s in (("term", word(2), F.lit(0)), ("wildcard", pattern, F.lit(0)), ("fuzzy", typo, edits))
    ])
    return _counted(index, asking.select("search_id", F.explode(kinds).alias("s")).select("search_id", "s.*"))


@query("indexed_phrases", f"""{_PLACES},
  s AS (SELECT doc_id, array_to_string(words[3:6], ' ') AS query, 0 AS slack, words[3:6] AS t FROM w WHERE doc_id % 50 = 0
    UNION ALL SELECT doc_id, coalesce(array_to_string([words[10], words[11], words[13]], ' '), ''), 1, [x for x in [words[10], words[11], words[13]] if x IS NOT NULL] FROM w WHERE doc_id % 50 = 0),
  q AS (SELECT DISTINCT query, slack, t FROM s WHERE len(t) > 0),
  r1 AS (SELECT query, slack, t, doc_id, pos AS lo, pos AS hi FROM q JOIN p ON term = t[1]),
  r2 AS (SELECT query, slack, t, doc_id, lo, pos AS hi FROM r1 JOIN p USING (doc_id) WHERE len(t) >= 2 AND term = t[2] AND pos BETWEEN hi + 1 AND hi + 1 + slack),
  r3 AS (SELECT DISTINCT query, slack, t, doc_id, lo, pos AS hi FROM r2 JOIN p USING (doc_id) WHERE len(t) >= 3 AND term = t[3] AND pos > hi AND pos - lo - 2 <= slack),
  r4 AS (SELECT query, slack, t, doc_id, lo, pos AS hi FROM r3 JOIN p USING (doc_id) WHERE len(t) = 4 AND term = t[4] AND pos = hi + 1),
  h AS (SELECT query, slack, doc_id FROM r1 WHERE len(t) = 1 UNION ALL SELECT query, slack, doc_id FROM r2 WHERE len(t) = 2 UNION ALL SELECT query, slack, doc_id FROM r3 WHERE len(t) = 3 UNION ALL SELECT query, slack, doc_id FROM r4),
  n AS (SELECT query, slack, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM h GROUP BY ALL)
  SELECT s.doc_id, 'phrase' AS kind, query, slack, coalesce(n_docs, 0) AS n_docs, coalesce(n_places, 0) AS n_places, first_doc, last_doc FROM s LEFT JOIN n USING (query, slack)""")
def _indexed_phrases(spark, path):
    index, asking = _document_index(spark, path)
    apart = F.array_compact(F.array(*[F.get("w", F.lit(n)) for n in (9, 10, 12)]))
    kinds = F.array(*[
        F.struct(F.lit("phrase").alias("kind"), F.array_join(q, " ").alias("query"), F.lit(s).alias("slack")) for q, s in ((F.slice("w", 3, 4), 0), (apart, 1))
    ])
    return _counted(index, asking.select("search_id", F.explode(kinds).alias("s")).select("search_id", "s.*"))
