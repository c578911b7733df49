"""Queries over events, clustering and pattern discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions import rule_tables as R
from rampart.functions import text as X
from rampart.functions.unnest import computed_once
from rampart.operators import discovery as D
from rampart.operators import neighbours as N
from rampart.operators import rules
from rampart.operators import verdicts as V
from rampart.plans import inputs as I
from rampart.plans.detection import PROMPT_TESTS, mode_sql
from rampart.plans.inputs import NOW_US, with_ctes
from rampart.plans.registry import query
from rampart.plans.rules import hit_count_sql, matches, max_conf_sql
from rampart.plans.text import _FEATURE_SQL
from rampart.plans.usage import rounded


def events(spark, path):
    p = rules.with_reasons(I.prompts(spark, path).withColumn("role", F.lit("user")))
    c = F.greatest(F.lit(0.0), V.max_confidence(F.col("reasons")) - 0.1)
    scored = p.withColumns({"confidence": c, "n_reasons": F.size("reasons")})
    judged = scored.withColumn("verdict", V.mode_verdict(F.col("confidence"), F.col("n_reasons"), "moderate"))
    judged = computed_once(judged, "reasons", "confidence", "verdict")
    return D.collect_events(judged).withColumns({
        "is_false_positive": F.col("doc_id") % 17 == 0, "is_false_negative": F.col("doc_id") % 23 == 0, "us": F.col("doc_id"),
    })


_EVENTS = f""", e0 AS (SELECT doc_id, text, ({hit_count_sql(PROMPT_TESTS)})::INT AS n_reasons, greatest(0::DOUBLE, {max_conf_sql(PROMPT_TESTS)} - 0.1::DOUBLE) AS confidence FROM prompts),
  e AS (SELECT doc_id, left(sha256(text), 16) AS event_key, n_reasons, confidence, {mode_sql('confidence', 'n_reasons', 'moderate')} AS verdict, doc_id % 17 = 0 AS is_false_positive, doc_id % 23 = 0 AS is_false_negative FROM e0)"""


@query("collect_events", with_ctes("prompts", _EVENTS + " SELECT doc_id, event_key, n_reasons, round(confidence, 6) AS confidence, verdict FROM e"))
def _events(spark, path):
    return rounded(events(spark, path).select("doc_id", "event_key", "n_reasons", "confidence", "verdict"))


@query("event_statistics", with_ctes("prompts", _EVENTS + " SELECT count(*) AS total, count(DISTINCT event_key) AS unique_prompts, count(*) FILTER (is_false_positive) AS false_positives, count(*) FILTER (is_false_negative) AS false_negatives, count(*) >= 100 AS ready FROM e"))
def _stats(spark, path):
    return D.event_statistics(events(spark, path))


_CAT = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS name FROM prompts WHERE {cond}" for cond, c, _ in PROMPT_TESTS)


@query("event_counts", with_ctes("prompts", _EVENTS + f", cats AS (SELECT DISTINCT * FROM ({_CAT})) SELECT 'verdict' AS kind, verdict AS name, count(*) AS n FROM e GROUP BY verdict UNION ALL SELECT 'category', name, count(*) FROM cats GROUP BY name"))
def _counts(spark, path):
    return D.event_counts(events(spark, path))


@query("cluster_input", with_ctes("prompts", _EVENTS + " SELECT doc_id, verdict FROM e WHERE confidence >= 0.5 AND verdict IN ('block', 'flag') AND NOT is_false_positive"))
def _input(spark, path):
    return D.cluster_input(events(spark, path)).select("doc_id", "verdict")


@query("feature_matrix")
def _matrix(spark, path):
    return D.feature_matrix(I.prompts(spark, path), "doc_id")


_Z = ["length", "word_count", "entropy", "digit_ratio", "max_repetition"]


@query("zscore", f"WITH f AS ({_FEATURE_SQL}) SELECT doc_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 4) AS {c}" for c in _Z) + " FROM f")
def _zscore(spark, path):
    f = X.text_features(I.prompts(spark, path).select("doc_id", "text")).select(
        "doc_id", "length", "word_count", F.round("entropy", 5).alias("entropy"), F.round("digit_ratio", 6).alias("digit_ratio"), "max_repetition"
    )
    return rounded(D.zscore(f, _Z), 4)


@query("feature_similarity", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _similarity(spark, path):
    e = I.table(spark, path, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


_IMP = ["length", "word_count", "line_count", "max_repetition", "char_count"]


@query("feature_importance", f"WITH f AS ({_FEATURE_SQL}), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM f" for c in _IMP) + ") SELECT feature, round(variance, 3) AS variance, round(variance / max(variance) OVER (), 6) AS importance FROM v")
def _importance(spark, path):
    f = X.text_features(I.prompts(spark, path).select("doc_id", "text"))
    return D.feature_importance(f, _IMP).select("feature", F.round("variance", 3).alias("variance"), F.round("importance", 6).alias("importance"))


@query("kmeans_clusters")
def _kmeans(spark, path):
    return D.kmeans_clusters(I.table(spark, path, "embeddings"), "vec_id", "embedding")


_NEAR = "d AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b)"


@query("neighbour_counts", f"WITH {_NEAR} SELECT x AS vec_id, count(*) AS near FROM d WHERE s >= 0.7 - 1e-9 GROUP BY x")
def _near(spark, path):
    e = I.table(spark, path, "embeddings")
    points = N.distinct_vectors(e, "vec_id", "embedding")
    near = N.neighbour_weights(points, 0.3)
    named = e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).join(points.join(near, "vid"), "vector")
    return named.select("vec_id", "near")


@query("density_clusters")
def _density(spark, path):
    return N.density_clusters(I.table(spark, path, "embeddings"), "vec_id", "embedding", eps=0.3)


@query("suggest_eps")
def _eps(spark, path):
    return N.suggest_eps(I.table(spark, path, "embeddings"), "vec_id", "embedding")


@query("k_distances", f"WITH {_NEAR}, r AS (SELECT x, 1 - s AS d, row_number() OVER (PARTITION BY x ORDER BY s DESC) AS rk FROM d) SELECT x AS vec_id, round(greatest(d, 0), 5) AS kdist FROM r WHERE rk = 4")
def _kdist(spark, path):
    e = I.table(spark, path, "embeddings")
    d = N.k_distances(e, "vec_id", "embedding").withColumnRenamed("vid", "vec_id")
    return d.select("vec_id", F.round(F.greatest("kdist", F.lit(0.0)), 5).alias("kdist"))


@query("cluster_profile", with_ctes("prompts", _EVENTS + f""", cats AS (SELECT DISTINCT * FROM ({_CAT})), c AS (SELECT doc_id, doc_id % 10 AS cluster, confidence FROM e),
  g AS (SELECT cluster, name, count(*) AS n FROM cats JOIN c USING (doc_id) GROUP BY ALL), t AS (SELECT cluster, name FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, name) AS rk FROM g) WHERE rk = 1)
  SELECT c.cluster, count(*) AS size, round(avg(confidence), 6) AS avg_confidence, coalesce(any_value(t.name), 'unknown') AS dominant FROM c LEFT JOIN t ON t.cluster = c.cluster GROUP BY c.cluster"""))
def _profile(spark, path):
    return rounded(D.cluster_profile(events(spark, path).withColumn("cluster", F.col("doc_id") % 10)))


@query("cluster_patterns")
def _cpatterns(spark, path):
    return D.cluster_patterns(events(spark, path).withColumn("cluster", F.col("doc_id") % 10))


@query("cluster_density", """SELECT a.label, count(*) AS pairs, round(avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS mean_distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def _cdensity(spark, path):
    return rounded(N.mean_pair_distance(I.table(spark, path, "embeddings"), "label", "vec_id", "embedding"), 5)


@query("centroids", "SELECT label, (i - 1)::INT AS position, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def _centroids(spark, path):
    return rounded(D.centroids(I.table(spark, path, "embeddings"), "label", "embedding"))


def clustered(spark, path):
    return I.prompts(spark, path).select((F.col("doc_id") % 10).alias("cluster"), "text", F.col("doc_id").alias("prompt_id"))


_NG = r"""SELECT cluster, ngram, n AS support FROM (SELECT cluster, ngram, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, ngram) AS rk FROM
  (SELECT doc_id % 10 AS cluster, array_to_string(w[i:i + k - 1], ' ') AS ngram FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM prompts), (SELECT unnest([2, 3, 4]) AS k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)) GROUP BY cluster, ngram) WHERE rk <= 20 AND n >= 3"""


@query("frequent_ngram_patterns", with_ctes("prompts", f"SELECT cluster, regexp_replace(ngram, '[^a-z]', '', 'g') AS letters, support FROM ({_NG})"))
def _ngrams(spark, path):
    g = D.frequent_ngram_patterns(clustered(spark, path))
    plain = F.regexp_replace(F.replace("regex", F.lit(r"\s*"), F.lit("")), "[^a-z]", "")
    return g.select("cluster", plain.alias("letters"), "support")


@query("common_substring_patterns")
def _substrings(spark, path):
    c = I.messages(spark, path).select((F.col("conv_id") % 10).alias("cluster"), "text")
    return D.common_substring_patterns(c)


@query("template_patterns", with_ctes("prompts", "SELECT cluster, kind, support FROM (" + " UNION ALL ".join(
    f"SELECT doc_id % 10 AS cluster, '{c}' AS kind, count(*) AS support FROM prompts WHERE {matches('text', t, ignore_case=True)} GROUP BY 1" for c, ts in R.TEMPLATES.items() for t in ts) + ") WHERE support >= 3"))
def _templates(spark, path):
    return D.template_patterns(clustered(spark, path)).select("cluster", "kind", "support")


@query("differential_pattern")
def _differential(spark, path):
    return D.differential_pattern(clustered(spark, path))


@query("filter_patterns")
def _filter(spark, path):
    c = clustered(spark, path)
    both = D.template_patterns(c).unionByName(D.frequent_ngram_patterns(c))
    return D.filter_patterns(c, both)


# pattern examples: parts of one brand and size share their examples
@query("merge_patterns", """WITH p AS (SELECT p_partkey AS pattern_id, p_size % 5 + 1 AS n, p_brand || p_type AS grp, p_retailprice AS c FROM part), m AS (SELECT grp, n, min(pattern_id) AS pattern_id, count(*) AS merged_count FROM p WHERE n < 4 GROUP BY ALL
  UNION ALL SELECT grp, 4, min(pattern_id), count(*) FROM p WHERE n >= 4 GROUP BY grp) SELECT pattern_id, merged_count FROM m""")
def _merge(spark, path):
    grp = F.concat("p_brand", "p_type")
    p = I.table(spark, path, "part").select(
        F.col("p_partkey").alias("pattern_id"), F.col("p_name").alias("regex"), (F.col("p_retailprice") / 10000).alias("confidence"), F.col("p_size").alias("support"),
        F.transform(F.sequence(F.lit(1), (F.col("p_size") % 5 + 1).cast("int")), lambda i: F.concat(grp, F.lit(" "), i.cast("string"))).alias("examples"),
    )
    return D.merge_patterns(p).select("pattern_id", "merged_count")


def labelled(spark, path):
    return I.prompts(spark, path).select("text", (F.col("doc_id") % 10 <= 3).alias("malicious"))


@query("evaluate_patterns", with_ctes("prompts", """, l AS (SELECT lower(text) AS t, doc_id % 10 <= 3 AS y FROM prompts),
  h AS (SELECT 'pat_0' AS rule_id, regexp_matches(t, 'ignore\\s+all\\s+previous') AS m, y FROM l UNION ALL SELECT 'pat_1', contains(t, 'developer mode'), y FROM l UNION ALL SELECT 'pat_2', contains(t, 'show me your prompt'), y FROM l UNION ALL SELECT 'pat_3', contains(t, 'you must obey'), y FROM l),
  c AS (SELECT rule_id, count(*) FILTER (m AND y) AS tp, count(*) FILTER (m AND NOT y) AS fp, count(*) FILTER (NOT m AND NOT y) AS tn, count(*) FILTER (NOT m AND y) AS fn FROM h GROUP BY 1)
  SELECT *, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 6) AS f1 FROM c"""))
def _evaluate(spark, path):
    from rampart.plans.rules import learned_patterns

    return rounded(D.evaluate_patterns(learned_patterns(spark, path).select("rule_id", "pattern"), labelled(spark, path)))


_MAN = f"""man AS (SELECT o_orderkey, ['candidate', 'testing', 'active', 'rejected'][o_orderkey % 4 + 1] AS status, epoch_us(o_orderdate + INTERVAL 8000 DAY) AS created_us, o_orderkey % 1500 AS tp, o_orderkey % 130 AS fp, o_orderkey % 900 AS tn, o_orderkey % 700 AS fn FROM orders),
  ms AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM man),
  mf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ms)"""


def managed(spark, path):
    o = I.table(spark, path, "orders")
    k = F.col("o_orderkey")
    m = o.select(
        k, F.element_at(F.array(*[F.lit(s) for s in ("candidate", "testing", "active", "rejected")]), (k % 4 + 1).cast("int")).alias("status"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 8000 DAY")).alias("created_us"),
        (k % 1500).alias("tp"), (k % 130).alias("fp"), (k % 900).alias("tn"), (k % 700).alias("fn"),
    )
    return D.measures(m)


@query("pattern_lifecycle", f"""WITH {_MAN} SELECT o_orderkey, CASE WHEN status = 'candidate' AND tp + fp + tn + fn >= 100 AND precision >= 0.9 AND recall >= 0.5 THEN 'testing'
   WHEN status = 'testing' AND {NOW_US} - created_us > 86400000000 THEN CASE WHEN precision >= 0.9 AND recall >= 0.5 THEN 'active' ELSE 'rejected' END
   WHEN status = 'active' AND tp + fp + tn + fn > 1000 AND (precision < 0.72::DOUBLE OR fp > 2 * tp) THEN 'retired' WHEN status = 'rejected' AND {NOW_US} - created_us > 2592000000000 THEN 'dropped' ELSE status END AS next_status FROM ms""")
def _lifecycle(spark, path):
    return D.pattern_lifecycle(managed(spark, path), NOW_US).select("o_orderkey", "next_status")


@query("pattern_statistics", f"WITH {_MAN} SELECT status, count(*) AS n, round(avg(precision) FILTER (status = 'active'), 6) AS avg_precision, round(avg(recall) FILTER (status = 'active'), 6) AS avg_recall, round(avg(f1) FILTER (status = 'active'), 6) AS avg_f1 FROM mf GROUP BY status")
def _pstats(spark, path):
    return rounded(D.pattern_statistics(managed(spark, path)))


def predictions(spark, path):
    p = rules.simple_classifier(I.prompts(spark, path))
    jitter = (F.col("doc_id") * 31 % 97) / 1000.0
    return p.select("doc_id", (F.col("doc_id") % 10 <= 3).cast("int").alias("label"), F.col("is_injection").cast("int").alias("prediction"), (F.col("score") + jitter).alias("score"))


_PRED = """, pr AS (SELECT doc_id, (doc_id % 10 <= 3)::INT AS label, CASE WHEN regexp_matches(lower(text), 'ignore all|disregard') THEN 0.9::DOUBLE WHEN regexp_matches(lower(text), 'ignore|override|system|prompt') THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS base FROM prompts),
  pp AS (SELECT doc_id, label, (base > 0.5)::INT AS prediction, base + (doc_id * 31 % 97) / 1000.0::DOUBLE AS score FROM pr)"""


@query("binary_metrics", with_ctes("prompts", _PRED + """, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM pp)
  SELECT *, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""))
def _binary(spark, path):
    return rounded(D.binary_metrics(predictions(spark, path)))


@query("confusion_matrix", with_ctes("prompts", _PRED + ' SELECT label, count(*) FILTER (prediction = 0) AS "0", count(*) FILTER (prediction = 1) AS "1" FROM pp GROUP BY label'))
def _confusion(spark, path):
    return D.confusion_matrix(predictions(spark, path))


@query("roc_curve", with_ctes("prompts", _PRED + """, r AS (SELECT round(score, 6) AS score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM pp GROUP BY 1)
  SELECT score, round(sum(p) OVER w / sum(p) OVER ()::DOUBLE, 6) AS tpr, round(sum(q) OVER w / sum(q) OVER ()::DOUBLE, 6) AS fpr FROM r WINDOW w AS (ORDER BY score DESC)"""))
def _roc(spark, path):
    return rounded(D.roc_curve(predictions(spark, path).withColumn("score", F.round("score", 6))))


@query("roc_auc", with_ctes("prompts", _PRED + """, r AS (SELECT label, rank() OVER (ORDER BY round(score, 6)) + (count(*) OVER (PARTITION BY round(score, 6)) - 1) / 2.0 AS rk FROM pp)
  SELECT round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r"""))
def _auc(spark, path):
    return rounded(D.roc_auc(predictions(spark, path).withColumn("score", F.round("score", 6))))


@query("class_labels", "SELECT event_id, (event_type IN ('error', 'click'))::INT AS label FROM events")
def _labels(spark, path):
    named = F.when(F.col("event_type") == "error", "malicious").when(F.col("event_type") == "click", "injection").otherwise("benign")
    return I.table(spark, path, "events").select("event_id", named.alias("label")).select("event_id", D.class_labels(None).alias("label"))


@query("train_classifier")
def _train(spark, path):
    p = I.prompts(spark, path).select("doc_id", "text", (F.col("doc_id") % 10 <= 3).cast("int").alias("label"))
    return D.classify(D.train_classifier(p), p).select("doc_id", "label", "prediction", "score")


@query("cross_validate")
def _cv(spark, path):
    p = I.prompts(spark, path).select("doc_id", "text", (F.col("doc_id") % 10 <= 3).cast("int").alias("label"))
    return D.cross_validate(p, "doc_id")
