"""Events, features, clusters, and patterns found in clusters."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions import rule_tables as R
from rampart.functions import text as X
from rampart.functions.regexes import java_regex
from rampart.functions.unnest import computed_once, unnest
from rampart.operators.components import connected_components
from rampart.operators.matching import hash_bitmap, in_bitmap, match_patterns, matches_by_group
from rampart.operators.slices import ranked_counts
from rampart.operators.substrings import shared_substrings
from rampart.session import checkpoint_dir, cut_lineage


# --- events ----------------------------------------------------------------------------------
def collect_events(detections: DataFrame) -> DataFrame:
    """Detections (text, verdict, confidence, reasons, ...) as events with id, categories and patterns."""
    return detections.withColumns({
        "event_key": F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16),
        "categories": F.array_sort(F.array_distinct(F.transform("reasons", lambda r: r["category"]))),
        "patterns": F.transform("reasons", lambda r: r["pattern"]),
    }).drop("reasons")


def event_statistics(events: DataFrame, ready_at: int = 100, approximate: bool = False) -> DataFrame:
    """One row: totals, distinct prompts, feedback flags, whether there is enough to cluster."""
    distinct = F.approx_count_distinct("event_key") if approximate else F.count_distinct("event_key")
    return events.agg(
        F.count("*").alias("total"), distinct.alias("unique_prompts"), F.count_if("is_false_positive").alias("false_positives"),
        F.count_if("is_false_negative").alias("false_negatives"), (F.count("*") >= ready_at).alias("ready"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Long counts by verdict and by category."""
    by = events.groupBy(F.col("verdict").alias("name")).agg(F.count("*").alias("n")).select(F.lit("verdict").alias("kind"), "name", "n")
    cats = unnest(events, "categories", "name").groupBy("name").agg(F.count("*").alias("n"))
    return by.unionByName(cats.select(F.lit("category").alias("kind"), "name", "n"))


def cluster_input(events: DataFrame, min_confidence: float = 0.5, verdicts: tuple = ("block", "flag"), limit: int | None = None) -> DataFrame:
    """Events worth clustering; `limit` keeps the newest, as a report of that size asks for."""
    kept = events.filter(
        (F.col("confidence") >= min_confidence) & F.col("verdict").isin(*verdicts) & ~F.coalesce("is_false_positive", F.lit(False))
    )
    return kept.orderBy(F.desc("us")).limit(limit) if limit else kept


# --- features --------------------------------------------------------------------------------
def feature_matrix(df: DataFrame, key: str, text: str = "text", top: int = 10) -> DataFrame:
    """(key, features): 18 scalars, then the ten largest character and word n-gram counts."""
    f = X.text_features(df.select(key, F.col(text).alias("text")))
    scalars = F.array(*[F.col(c).cast("double") for c in X.SCALAR_FEATURES])
    chars, words = X.top_char_ngram_counts("text", top), X.top_word_ngram_counts("text", top)
    return f.select(key, F.concat(scalars, chars, words).alias("features"))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised with the population deviation; constant columns become zero."""
    stats = df.agg(*[f(c).alias(f"_{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.join(F.broadcast(stats))  # one row
    out = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns
    }
    return j.withColumns(out).drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def feature_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance per feature over the largest one: (feature, variance, importance)."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])).alias("e")).select("e.*")
    largest = row.select(F.greatest(*[F.col(c) for c in columns]).alias("_max"))
    return long.join(F.broadcast(largest)).select(  # one row
        "feature", "variance", F.coalesce(F.try_divide("variance", F.col("_max")), F.lit(0.0)).alias("importance")
    )


def kmeans_clusters(df: DataFrame, key: str, features: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """(key, cluster) by k-means; k is one per fifty rows, from 2 to 10."""
    rows = df.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    k = k or min(10, max(2, rows.count() // 50))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(key, "cluster")


def cluster_profile(clustered: DataFrame, key: str = "cluster") -> DataFrame:
    """Size, mean confidence and dominant category (ties by name) per cluster."""
    sizes = clustered.groupBy(key).agg(F.count("*").alias("size"), F.avg("confidence").alias("avg_confidence"))
    cats = unnest(clustered, "categories", "category", key).groupBy(key, "category").agg(F.count("*").alias("n"))
    top = cats.groupBy(key).agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("dominant"))
    return sizes.join(top, key, "left").withColumn("dominant", F.coalesce("dominant", F.lit("unknown")))


def cluster_patterns(clustered: DataFrame, key: str = "cluster", top: int = 10) -> DataFrame:
    g = unnest(clustered, "patterns", "pattern", key).groupBy(key, "pattern").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "pattern")
    return g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, position, value): mean of every vector position, combined before the shuffle."""
    return df.select(group, F.posexplode(vector).alias("position", "x")).groupBy(group, "position").agg(F.avg("x").alias("value"))


# --- patterns --------------------------------------------------------------------------------
PATTERN_COLUMNS = ["cluster", "regex", "kind", "confidence", "support"]


def _sizes(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("cluster").agg(F.count("*").alias("_size"))


def _written(df: DataFrame) -> DataFrame:
    """Read back from files: the planner knows the size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/discovery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shaped(g: DataFrame, kind: str | Column) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return g.select("cluster", "regex", k.alias("kind"), (F.col("support") / F.col("_size")).alias("confidence"), "support")


def _likely_ngrams(prompts: DataFrame, min_support: int, top: int) -> DataFrame:
    """(cluster, ngram): all 2- to 4-grams that can be among the `top` of their cluster, repeats included.

    An n-gram is no more frequent than any pair of neighbours in it, and the `top`-th pair is one that
    the `top`-th n-gram has to reach; so pairs are counted first, as hashes."""
    plain = F.regexp_replace(F.lower("text"), java_regex(r"\s+"), " ")
    w, n = F.col("_w"), F.size("_w")
    rest = F.greatest(n - 1, F.lit(0))
    split = computed_once(prompts.select("cluster", F.filter(F.split(plain, " "), lambda x: x != "").alias("_w")), "_w")
    pairs = F.transform(
        F.arrays_zip(F.slice(w, F.lit(1), rest).alias("a"), F.slice(w, F.lit(2), rest).alias("b")),
        lambda p: F.xxhash64(F.col("cluster"), p["a"], p["b"]),
    )
    paired = split.select("cluster", "_w", pairs.alias("_pairs"))
    counts = unnest(paired, "_pairs", "__g", "cluster").groupBy("cluster", "__g").agg(F.count("*").alias("support"))
    counts = cut_lineage(counts.filter(F.col("support") >= min_support))
    best = Window.partitionBy("cluster").orderBy(F.desc("support"), "__g")
    head = counts.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= top)
    least = head.groupBy("cluster").agg(F.max(F.when(F.col("rk") == top, F.col("support"))).alias("_least"))
    bits = hash_bitmap(counts.join(least, "cluster").filter(F.col("support") >= F.coalesce("_least", F.lit(min_support))))

    def likely(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            two = in_bitmap(bits, np.asarray(value if value is not None else [], dtype=np.int64))
            three = two[:-1] & two[1:]
            four = three[:-1] & two[2:]
            out.append(np.concatenate([np.flatnonzero(x) * 8 + size for size, x in ((2, two), (3, three), (4, four))]))
        return pd.Series(out)

    at = unnest(paired, F.pandas_udf(likely, "array<long>")("_pairs"), "_at", "cluster", "_w")
    gram = F.array_join(F.slice("_w", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.pmod("_at", F.lit(8)).cast("int")), " ")
    return at.select("cluster", gram.alias("ngram"))


def frequent_ngram_patterns(prompts: DataFrame, min_support: int = 3, top: int = 20) -> DataFrame:
    """Most frequent 2- to 4-grams of words per cluster (cluster, text), as expressions."""
    counts = _likely_ngrams(prompts, min_support, top).groupBy("cluster", "ngram").agg(F.count("*").alias("support"))
    w = Window.partitionBy("cluster").orderBy(F.desc("support"), "ngram")
    best = counts.withColumn("rk", F.row_number().over(w)).filter((F.col("rk") <= top) & (F.col("support") >= min_support))
    parts = F.transform(F.split("ngram", " "), X.regex_escape)
    shaped = best.withColumn("regex", F.array_join(parts, r"\s*")).join(_sizes(prompts), "cluster")
    return _shaped(shaped, "ngram")


def common_substring_patterns(prompts: DataFrame, min_support: int = 3, size: int = 10, max_length: int | None = None) -> DataFrame:
    """Substrings of at least `size` characters that `min_support` prompts of a cluster share, in lower case, no space at either end.

    All that lie in no longer one of that kind, at one of the places where they stand; support counts the prompts that hold
    them.  `max_length` leaves out longer ones, as `filter_patterns` does for expressions."""
    found = shared_substrings(prompts, "cluster", "text", min_support, size)
    if max_length is not None:
        found = found.filter(F.length("s") <= max_length)
    g = found.select(F.col("group").alias("cluster"), X.regex_escape("s").alias("regex"), "support")
    return _shaped(g.join(_written(_sizes(prompts)), "cluster"), "common_substring")


def template_patterns(prompts: DataFrame, min_support: int = 3) -> DataFrame:
    """Known templates that hit at least `min_support` prompts of a cluster; one count per template."""
    flat = [(c, t) for c, ts in R.TEMPLATES.items() for t in ts]
    g = prompts.groupBy("cluster").agg(
        F.count("*").alias("_size"),
        *[F.count_if(F.col("text").rlike(java_regex(t, ignore_case=True))).alias(f"t{i}") for i, (_, t) in enumerate(flat)],
    )
    entries = F.array(*[
        F.struct(F.lit(t).alias("regex"), F.lit(c).alias("kind"), F.col(f"t{i}").alias("support")) for i, (c, t) in enumerate(flat)
    ])
    long = g.select("cluster", "_size", F.explode(entries).alias("e")).select("cluster", "_size", "e.*")
    return _shaped(long.filter(F.col("support") >= min_support), F.col("kind"))


def differential_pattern(prompts: DataFrame, min_support: int = 3, order: str = "prompt_id", least: int = 6) -> DataFrame:
    """What the first prompt of a cluster shares with each of the next three, joined by `.*?`.

    Shared are the first prompt's longest runs of shingles of `least` characters that all the
    others have, in the first one's order.  Only four prompts per cluster meet (a top-k), three at
    least; support is counted over all of them."""
    w = Window.partitionBy("cluster").orderBy(order)
    four = prompts.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= 4).select("cluster", "_rk", "text")
    sizes = four.groupBy("cluster").agg(F.count("*").alias("_prompts")).filter("_prompts >= 3")
    shingles = F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{{least}}}))"), F.lit(1))
    first = four.filter("_rk = 1").select("cluster", F.posexplode(shingles).alias("pos", "g"))
    others = four.filter("_rk > 1").select("cluster", F.explode(F.array_distinct(shingles)).alias("g"))
    common = others.groupBy("cluster", "g").agg(F.count("*").alias("_in")).join(sizes, "cluster").filter("_in = _prompts - 1")
    along = Window.partitionBy("cluster").orderBy("pos")  # one prompt's shingles
    runs = first.join(common, ["cluster", "g"]).withColumn("_run", F.col("pos") - F.row_number().over(along))
    runs = runs.groupBy("cluster", "_run").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    part = F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start") + least).alias("part")
    parts = runs.join(four.filter("_rk = 1"), "cluster").select("cluster", F.struct("start", part).alias("p"))
    listed = parts.groupBy("cluster").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    regex = F.array_join(F.transform("ps", lambda p: X.regex_escape(p["part"])), ".*?")
    return recount(prompts, listed.select("cluster", regex.alias("regex"), F.lit("differential").alias("kind")), min_support)


def recount(prompts: DataFrame, patterns: DataFrame, min_support: int = 3) -> DataFrame:
    """Patterns (cluster, regex, kind) with support and confidence counted over their cluster's prompts.

    A prompt meets only the patterns of its cluster it has a literal of."""
    patterns = cut_lineage(patterns.select("cluster", "regex", "kind"))
    met = matches_by_group(prompts.select("cluster", "text"), patterns.select("cluster", "regex").distinct(), "cluster", pattern="regex")
    counted = met.groupBy("cluster", "regex").agg(F.count("*").alias("support"))
    kept = patterns.join(counted, ["cluster", "regex"]).filter(F.col("support") >= min_support)
    return _shaped(kept.join(_sizes(prompts), "cluster"), F.col("kind"))


def filter_patterns(
    prompts: DataFrame, patterns: DataFrame, min_confidence: float = 0.7, max_length: int = 200, min_support: int = 3, top: int = 10
) -> DataFrame:
    """Sure enough, unique by their first 50 characters, short enough, recounted; the best per cluster."""
    sure = patterns.filter((F.col("confidence") >= min_confidence) & (F.length("regex") <= max_length))
    head = Window.partitionBy("cluster", F.substring("regex", 1, 50)).orderBy(F.desc("confidence"), F.desc("support"), "regex")
    unique = sure.withColumn("_rk", F.row_number().over(head)).filter("_rk = 1").drop("_rk")
    recounted = recount(prompts, unique, min_support)
    best = Window.partitionBy("cluster").orderBy(F.desc("confidence"), F.desc("support"), "regex")
    return recounted.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= top)


def merge_patterns(patterns: DataFrame, share: float = 0.8) -> DataFrame:
    """Patterns (pattern_id long, confidence, support, examples) merged where `share` of the larger
    example set is common to both.

    Equal sets are tied to their smallest id.  Different sets can only reach the share if they
    have one of their rarest examples in common, n - ceil(share * n) + 1 of each; those that do are
    compared."""
    own = patterns.select("pattern_id", F.array_sort(F.array_distinct("examples")).alias("_ex")).filter(F.size("_ex") > 0)
    own = own.withColumn("_set", F.sha2(F.array_join("_ex", "\x01").cast("binary"), 256))
    sets = own.groupBy("_set").agg(F.min("pattern_id").alias("_hub"), F.first("_ex").alias("_ex"))
    equal = own.join(sets.select("_set", "_hub"), "_set").select(F.col("pattern_id").alias("a"), F.col("_hub").alias("b"))
    items = sets.select("_hub", F.explode("_ex").alias("e"))
    items = items.join(items.groupBy("e").agg(F.count("*").alias("_n")), "e")
    rare = items.groupBy("_hub").agg(F.array_sort(F.collect_list(F.struct("_n", "e"))).alias("_ex"))  # one set's examples
    kept = F.size("_ex") - F.ceil(F.size("_ex") * share - 1e-9) + 1
    posted = rare.select("_hub", F.transform("_ex", lambda x: x["e"]).alias("_ex"), F.explode(F.slice("_ex", F.lit(1), kept.cast("int"))).alias("k"))
    posted = posted.select("_hub", "_ex", F.col("k.e").alias("k"))
    other = posted.select(F.col("_hub").alias("_hub2"), F.col("_ex").alias("_ex2"), "k")
    larger = F.greatest(F.size("_ex"), F.size("_ex2"))
    met = posted.join(other, "k").filter("_hub < _hub2").filter(F.size(F.array_intersect("_ex", "_ex2")) >= larger * share - 1e-9)
    edges = equal.unionByName(met.select(F.col("_hub").alias("a"), F.col("_hub2").alias("b")))
    comp = connected_components(edges).withColumnRenamed("id", "pattern_id")
    j = patterns.join(comp, "pattern_id", "left").withColumn("component", F.coalesce("component", "pattern_id"))
    return j.groupBy("component").agg(
        F.max("confidence").alias("confidence"), F.max("support").alias("support"), F.count("*").alias("merged_count"),
        F.min_by("regex", "pattern_id").alias("regex"),
    ).withColumnRenamed("component", "pattern_id")


def evaluate_patterns(patterns: DataFrame, labelled: DataFrame, form: str | None = None) -> DataFrame:
    """Confusion counts and measures per pattern (rule_id, pattern) over (text, malicious)."""
    totals = labelled.agg(F.count_if("malicious").alias("_pos"), F.count_if(~F.col("malicious")).alias("_neg"))
    hits = match_patterns(labelled.select("text", "malicious"), patterns, form=form)
    g = hits.groupBy("rule_id").agg(F.count_if("malicious").alias("tp"), F.count_if(~F.col("malicious")).alias("fp"))
    zero = F.lit(0).cast("long")
    j = patterns.select(F.col("rule_id").cast("string").alias("rule_id")).join(g, "rule_id", "left").join(F.broadcast(totals))  # one row
    counts = j.select(
        "rule_id", F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp"),
        (F.col("_neg") - F.coalesce("fp", zero)).alias("tn"), (F.col("_pos") - F.coalesce("tp", zero)).alias("fn"),
    )
    return measures(counts)


def measures(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": p, "recall": r, "f1": ratio(p * r * 2, p + r),
    })


def pattern_lifecycle(
    managed: DataFrame, now_us: int, min_samples: int = 100, min_precision: float = 0.9, min_recall: float = 0.5,
    testing_hours: int = 24, rejected_days: int = 30,
) -> DataFrame:
    """Next status of patterns (status, created_us, tp, fp, tn, fn, precision, recall); `dropped` when gone."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    good = (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall)
    age = F.lit(now_us) - F.col("created_us")
    status = F.col("status")
    tested = age > testing_hours * 3_600_000_000
    degraded = (n > 1000) & ((F.col("precision") < min_precision * 0.8) | (F.col("fp") > F.col("tp") * 2))
    return managed.withColumn(
        "next_status",
        F.when((status == "candidate") & (n >= min_samples) & good, "testing")
        .when((status == "testing") & tested & good, "active").when((status == "testing") & tested, "rejected")
        .when((status == "active") & degraded, "retired")
        .when((status == "rejected") & (age > rejected_days * 86_400_000_000), "dropped").otherwise(status),
    )


def pattern_statistics(managed: DataFrame) -> DataFrame:
    """Count per status; mean precision, recall and f1 (of the active ones in the active row)."""
    return managed.groupBy("status").agg(
        F.count("*").alias("n"), *[F.avg(F.when(F.col("status") == "active", F.col(c))).alias(f"avg_{c}") for c in ("precision", "recall", "f1")]
    )


# --- models ----------------------------------------------------------------------------------
def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return measures(df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")
    ))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label).pivot(prediction, [0, 1]).count().na.fill(0)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, tpr, fpr) at every distinct score, from running counts over score ranges."""
    ranked = ranked_counts(df, [], score, {"pos": (F.col(label) == 1).cast("long")})
    total = ranked.agg(F.sum("pos").alias("_p"), F.sum(F.col("n") - F.col("pos")).alias("_q"))
    j = ranked.join(F.broadcast(total))  # one row
    above_pos = F.col("_p") - F.col("upto_pos") + F.col("pos")
    above_neg = F.col("_q") - (F.col("upto") - F.col("upto_pos")) + (F.col("n") - F.col("pos"))
    return j.select(score, (above_pos / F.col("_p")).alias("tpr"), (above_neg / F.col("_q")).alias("fpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve: each negative counts the positives above it, ties by half."""
    ranked = ranked_counts(df, [], score, {"pos": (F.col(label) == 1).cast("long")})
    total = ranked.agg(F.sum("pos").alias("_p"), F.sum(F.col("n") - F.col("pos")).alias("_q"))
    j = ranked.join(F.broadcast(total))  # one row
    neg = F.col("n") - F.col("pos")
    return j.agg(
        (F.sum(neg * (F.col("_p") - F.col("upto_pos") + F.col("pos") / 2)) / (F.max("_p") * F.max("_q").cast("double"))).alias("auc")
    )


def class_labels(df: DataFrame, label: str = "label") -> Column:
    return F.col(label).isin("malicious", "injection").cast("int")


def _vectors(df: DataFrame, text: str) -> DataFrame:
    feats = X.keyword_features(text)
    made = df.withColumns({f"_f_{n}": c.cast("double") for n, c in feats.items()})
    return VectorAssembler(inputCols=[f"_f_{n}" for n in feats], outputCol="_v").transform(made)


def train_classifier(df: DataFrame, text: str = "text", label: str = "label"):
    """Logistic regression on the keyword features."""
    return LogisticRegression(featuresCol="_v", labelCol=label, maxIter=20).fit(_vectors(df, text))


def classify(model, df: DataFrame, text: str = "text") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_vectors(df, text))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "prediction", "score")


def cross_validate(df: DataFrame, key: str, text: str = "text", label: str = "label", folds: int = 5) -> DataFrame:
    """Measures per fold; a row's fold is a hash of its key, so it never changes."""
    split = df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    out = None
    for i in range(folds):
        model = train_classifier(split.filter(F.col("fold") != i), text, label)
        m = binary_metrics(classify(model, split.filter(F.col("fold") == i), text), label).withColumn("fold", F.lit(i))
        out = m if out is None else out.unionByName(m)
    return out
