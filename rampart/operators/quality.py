"""Record checks, cleaning, search and scoring of detection tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_records(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """Adds `errors`, one per rule a column breaks.

    Rules per column: type (string, datetime, float, enum), required, pattern, max_length,
    values, min, max."""
    checks: list[Column] = []
    for name, rule in schema.items():
        c = F.col(name)
        if rule.get("required"):
            checks.append(F.when(c.isNull(), f"{name}: missing"))
        if "pattern" in rule:
            checks.append(F.when(~c.rlike(rule["pattern"]), f"{name}: format"))
        if "max_length" in rule:
            checks.append(F.when(F.length(c) > rule["max_length"], f"{name}: too long"))
        if rule.get("type") == "datetime":
            checks.append(F.when(c.isNotNull() & F.try_to_timestamp(c).isNull(), f"{name}: not a time"))
        if rule.get("type") == "enum":
            checks.append(F.when(~c.isin(rule["values"]), f"{name}: value"))
        if rule.get("type") == "float":
            v = c.try_cast("double")
            checks.append(F.when(c.isNotNull() & v.isNull(), f"{name}: not a number"))
            low, high = rule.get("min"), rule.get("max")
            if low is not None or high is not None:
                out = reduce(lambda a, b: a | b, [t for t in (v < low if low is not None else None, v > high if high is not None else None) if t is not None])
                checks.append(F.when(out, f"{name}: range"))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def map_schema(df: DataFrame, renames: dict[str, str], times: list[str], values: dict[str, dict[str, str]], scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Renamed columns; unix seconds to timestamps, coded values to names, ranges to 0..1."""
    out = df.withColumnsRenamed(renames)
    new: dict[str, Column] = {c: F.timestamp_seconds(c) for c in times}
    for c, mapping in values.items():
        new[c] = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(c))
    for c, (low, high) in scales.items():
        new[c] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - low) / (high - low)))
    return out.withColumns(new)


def enrich(df: DataFrame, dimensions: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins with dimensions by key; whether one is broadcast is left to its measured size."""
    for dim, key in dimensions:
        df = df.join(dim, key, "left")
    return df


def aggregate_window(df: DataFrame, minutes: int = 5, keys: tuple = ("user_id", "verdict")) -> DataFrame:
    g = df.groupBy(*keys, F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.avg("confidence").alias("avg_confidence"), F.count("*").alias("n"), F.max("confidence").alias("max_confidence"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )
    return g.withColumn("window_us", F.unix_micros("w.start")).drop("w")


def apply_filters(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Rows that meet all named SQL conditions."""
    return df.filter(reduce(lambda a, b: a & b, [F.expr(c) for c in conditions.values()]))


def normalize_fields(
    df: DataFrame, min_max: list[str] = (), z_score: list[str] = (), texts: list[str] = (), agents: list[str] = (), one_hot: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Adds scaled numbers, cleaned texts, browser and system, and 0/1 columns."""
    stats = [F.min(c).alias(f"_lo_{c}") for c in min_max] + [F.max(c).alias(f"_hi_{c}") for c in min_max]
    stats += [F.avg(c).alias(f"_m_{c}") for c in z_score] + [F.stddev_pop(c).alias(f"_s_{c}") for c in z_score]
    out = df.join(F.broadcast(df.agg(*stats))) if stats else df  # one row
    new: dict[str, Column] = {}
    for c in min_max:
        new[f"{c}_scaled"] = F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
    for c in z_score:
        new[f"{c}_z"] = F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0))
    for c in texts:
        new[f"{c}_clean"] = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    for c in agents:
        a = F.col(c)
        new[f"{c}_browser"] = F.nullif(F.regexp_extract(a, r"(Firefox|Edg|OPR|Chrome|Safari|AppleWebKit|Mozilla|python-requests|curl)", 1), F.lit(""))
        new[f"{c}_os"] = F.nullif(F.regexp_extract(a, r"(Windows|Android|iPhone|Mac OS X|Linux)", 1), F.lit(""))
    for c, values in (one_hot or {}).items():
        for v in values:
            new[f"{c}_{v}"] = (F.col(c) == v).cast("int")
    return out.withColumns(new).drop(*[f"_{p}_{c}" for c in (*min_max, *z_score) for p in ("lo", "hi", "m", "s")])


def score_batch(df: DataFrame, features: list[str], base: str, weights: tuple = (0.4, 0.6)) -> DataFrame:
    """Anomaly score (root mean square of the z-scores, over 3, at most 1) and the composite with `base`."""
    stats = df.agg(*[f(c).alias(f"_{p}_{c}") for c in features for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.join(F.broadcast(stats))  # one row
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in features]
    rms = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in z]) / len(features))
    out = j.withColumn("anomaly", F.least(F.lit(1.0), rms / 3)).drop(*[f"_{p}_{c}" for c in features for p in "ms"])
    return out.withColumn("composite", F.col("anomaly") * weights[0] + F.col(base) * weights[1])


def train_verdict_model(df: DataFrame, key: str, features: list[str], label: str, trees: int = 100, depth: int = 10) -> DataFrame:
    """Random forest on four fifths (by hash of the key); predictions for the rest."""
    split = df.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(5)))
    steps = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=features, outputCol="_v"),
        RandomForestClassifier(featuresCol="_v", labelCol="_y", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=42),
    ])
    model = steps.fit(split.filter("_fold < 4"))
    labels = model.stages[0].labels
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_p").cast("int") + 1)
    return model.transform(split.filter("_fold = 4")).select(key, label, named.alias("predicted"))


def quality_report(df: DataFrame, columns: list[str], rules: dict[str, str], fresh_after: str, ts: str = "ts") -> DataFrame:
    """(dimension, name, ratio): completeness per column, validity per rule, freshness, uniqueness is left to the caller."""
    n = F.count("*")
    ratio = lambda cond: F.coalesce(F.try_divide(F.count_if(cond), n), F.lit(0.0))
    aggs = {("completeness", c): ratio(F.col(c).isNotNull()) for c in columns}
    aggs |= {("validity", name): ratio(F.expr(cond)) for name, cond in rules.items()}
    aggs[("freshness", ts)] = ratio(F.col(ts) >= F.to_timestamp(F.lit(fresh_after)))
    row = df.agg(*[c.alias(f"v{i}") for i, c in enumerate(aggs.values())])
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(nm).alias("name"), F.col(f"v{i}").alias("ratio")) for i, (d, nm) in enumerate(aggs)
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")


# --- search -----------------------------------------------------------------------------------
def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column, in one pass: (facet, value, n)."""
    entries = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def search_terms(df: DataFrame, columns: list[str], terms: list[str] = (), phrase: str | None = None, wildcard: str | None = None) -> DataFrame:
    """Rows with all terms in some column, the phrase, and a word that fits the wildcard."""
    lows = [F.lower(c) for c in columns]
    some = lambda make: reduce(lambda a, b: a | b, [make(c) for c in lows])
    tests = [some(lambda c, t=t: c.contains(t.lower())) for t in terms]  # noqa: B023
    if phrase:
        tests.append(some(lambda c: c.contains(phrase.lower())))
    if wildcard:
        from rampart.functions.regexes import java_regex

        rx = r"\b" + wildcard.lower().replace("*", r"\w*").replace("?", r"\w") + r"\b"
        tests.append(some(lambda c: c.rlike(java_regex(rx))))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def fuzzy(df: DataFrame, column: str, term: str, distance: int = 2) -> DataFrame:
    """Rows with a word within the edit distance; words of a quite different length are not compared."""
    from rampart.functions import text as X

    near = lambda w: F.abs(F.length(w) - len(term)) <= distance
    hit = F.exists(F.array_distinct(X.words(F.lower(column))), lambda w: F.when(near(w), F.levenshtein(w, F.lit(term.lower())) <= distance).otherwise(False))
    return df.filter(hit)


def range_search(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    tests = []
    for c, (low, high) in ranges.items():
        if low is not None:
            tests.append(F.col(c) >= low)
        if high is not None:
            tests.append(F.col(c) <= high)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
