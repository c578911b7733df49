"""Threat indicators: building, validation, matching, feedback."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions import rule_tables as R
from rampart.functions import text as X
from rampart.functions.regexes import java_regex
from rampart.functions.unnest import unnest
from rampart.operators.matching import compiled, match_patterns
from rampart.operators.slices import running_totals, time_slice
from rampart.operators.verdicts import by_name

SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
TECHNIQUES = list(R.TECHNIQUE_CATEGORY)


def indicator_id(feed: Column, pattern: Column) -> Column:
    return F.substring(F.sha2(F.concat(feed, F.lit(":"), pattern).cast("binary"), 256), 1, 16)


def map_fields(raw: DataFrame, mappings: dict[str, str]) -> DataFrame:
    """Target columns from source columns where the source exists."""
    return raw.withColumns({t: F.col(s) for t, s in mappings.items() if s in raw.columns})


def build_indicators(raw: DataFrame, feeds: DataFrame, now: str) -> DataFrame:
    """Indicators of the feeds that pass their feed's filters, age and confidence limits.

    raw: feed_id, pattern, technique, severity, confidence, first_seen, seq, ...; feeds: feed_id,
    min_confidence, max_age_days, severities (array or null).  Of several rows with one id the
    last (by seq) counts; unknown techniques become `unknown`."""
    f = feeds.select("feed_id", "min_confidence", "max_age_days", "severities")
    j = raw.join(f, "feed_id").withColumn("indicator_id", indicator_id(F.col("feed_id"), F.col("pattern")))
    age = F.floor((F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros("first_seen")) / 86_400_000_000)
    ok = (
        (F.col("severities").isNull() | F.array_contains("severities", F.col("severity")))
        & (age <= F.col("max_age_days")) & (F.col("confidence") >= F.col("min_confidence")) & (F.coalesce("pattern", F.lit("")) != "")
    )
    kept = j.filter(ok).drop("min_confidence", "max_age_days", "severities")
    named = kept.withColumn("technique", F.when(F.col("technique").isin(TECHNIQUES), F.col("technique")).otherwise("unknown"))
    cols = [c for c in named.columns if c != "indicator_id"]
    return named.groupBy("indicator_id").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("_i")).select("indicator_id", "_i.*")


def probe_patterns(df: DataFrame, pattern: str = "pattern", cases: str = "test_cases") -> DataFrame:
    """Adds valid, fp_rate on the safe phrases and detection_rate on the row's own test cases."""
    safe = list(R.SAFE_PHRASES)

    def probe(patterns: pd.Series, tests: pd.Series) -> pd.DataFrame:
        rows = []
        for p, ts in zip(patterns, tests):
            rx = compiled(p) if p else None
            ts = list(ts) if ts is not None else []
            if rx is None:
                rows.append((False, 1.0, 0.0))
            else:
                rows.append((
                    True, sum(bool(rx.search(s)) for s in safe) / len(safe),
                    sum(bool(rx.search(t)) for t in ts) / len(ts) if ts else 1.0,
                ))
        return pd.DataFrame(rows, columns=["valid", "fp_rate", "detection_rate"])

    udf = F.pandas_udf(probe, "valid boolean, fp_rate double, detection_rate double")
    return df.withColumn("_p", udf(pattern, cases)).select(*df.columns, "_p.*")


def validate_indicators(indicators: DataFrame) -> DataFrame:
    """Adds accepted, adjusted confidence and whether severity and confidence fit together."""
    p = probe_patterns(indicators)
    high = F.col("fp_rate") > 0.2
    conf = F.when(F.col("valid") & high, F.col("confidence") * (F.lit(1.0) - F.col("fp_rate"))).otherwise(F.col("confidence"))
    out = p.withColumn("confidence", conf)
    consistent = F.when(F.col("severity") == "critical", F.col("confidence") >= 0.8).when(
        F.col("severity") == "info", F.col("confidence") <= 0.7
    ).otherwise(True)
    return out.withColumns({"accepted": F.col("valid") & (F.col("detection_rate") >= 0.5), "consistent": consistent})


def calibrate_confidence(df: DataFrame) -> DataFrame:
    """Adds calibrated: confidence by false positives, detections and severity, held in 0..1."""
    # fixed values: factor per severity
    factor = by_name({"critical": 1.0, "high": 0.95, "medium": 0.85, "low": 0.7, "info": 0.5}, F.col("severity"), 0.8)
    c = F.col("confidence") * (F.lit(1.0) - F.col("fp_rate") * 0.5) * (F.lit(0.5) + F.col("detection_rate") * 0.5) * factor
    return df.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def active_indicators(df: DataFrame, now: str, technique: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    kept = df.filter(
        (F.col("expires_at").isNull() | (F.col("expires_at") >= F.to_timestamp(F.lit(now)))) & (F.col("confidence") >= min_confidence)
    )
    return kept.filter(F.col("technique") == technique) if technique else kept


def search_indicators(df: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Indicators with the text in pattern, description, a tag or an ioc; the surest `limit` of them."""
    q = query.lower()
    within = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x).contains(q))
    found = df.filter(F.lower("pattern").contains(q) | F.lower("description").contains(q) | within("tags") | within("iocs"))
    return found.orderBy(F.desc("confidence"), "indicator_id").limit(limit) if limit else found


def match_indicators(messages: DataFrame, indicators: DataFrame, form: str | None = None) -> DataFrame:
    """One row per message and indicator that hits: confidence lowered by its false positives, category."""
    keys = [c for c in messages.columns if c != "text"]
    named = indicators.select(F.col("indicator_id").alias("rule_id"), "pattern")
    hits = match_patterns(messages, named, form=form).withColumnRenamed("rule_id", "indicator_id").drop("text")
    meta = indicators.select("indicator_id", "technique", "severity", "feed_id", "confidence", "fp_rate")
    j = hits.join(meta, "indicator_id")
    conf = F.col("confidence") * (F.lit(1.0) - F.coalesce("fp_rate", F.lit(0.0)) * 0.5)
    return j.select(
        *keys, "indicator_id", "technique", "severity", "feed_id", conf.alias("confidence"),
        by_name(R.TECHNIQUE_CATEGORY, F.col("technique"), "direct_injection").alias("category"),
    )


def threat_verdicts(hits: DataFrame, key: str) -> DataFrame:
    g = hits.groupBy(key).agg(F.max("confidence").alias("threat_confidence"), F.count("*").alias("n_threats"))
    c = F.col("threat_confidence")
    return g.withColumn("threat_verdict", F.when(c >= 0.9, "block").when(c >= 0.5, "flag").otherwise("allow"))


def threat_context(hits: DataFrame, key: str) -> DataFrame:
    """Per text: number of threats, techniques, worst severity, recommendations.

    Techniques and severities are few, so the sets stay small whatever the number of hits."""
    rank = by_name(SEVERITIES, F.col("severity"), 0)
    g = hits.groupBy(key).agg(
        F.count("*").alias("n_threats"), F.array_sort(F.collect_set("technique")).alias("techniques"), F.max(rank).alias("_r")
    )
    worst = F.when(F.col("_r") > 2, by_name({v: k for k, v in SEVERITIES.items()}, F.col("_r"), "low")).otherwise("low")
    has = lambda t: F.array_contains("techniques", t)
    some = lambda cond, *texts: F.when(cond, F.array(*[F.lit(t) for t in texts])).otherwise(F.array().cast("array<string>"))
    advice = F.concat(
        some(F.col("severity").isin("critical", "high"), "Block this request immediately", "Review system prompts for vulnerabilities", "Enable strict detection mode"),
        some(has("jailbreak"), "Implement role-based access controls", "Use instruction hierarchies"),
        some(has("encoding_obfuscation"), "Decode and validate all input", "Implement character filtering"),
        some(has("prompt_leaking"), "Sanitize system prompts", "Implement output filtering"),
    )
    return g.withColumn("severity", worst).withColumn("recommendations", advice).drop("_r")


def indicator_feedback(indicators: DataFrame, reports: DataFrame, slice_us: int = 86_400_000_000) -> DataFrame:
    """Confidence and false-positive rate after all reports (indicator_id, us, seq, true_positive), in order.

    A false positive scales confidence by .95, a true one by 1.02 with a cap of 1.  Such steps
    compose: the result is the uncapped product, or less if some capped step, scaled by what
    came after it, is smaller.  What came after is a running count, so no indicator's reports
    are ever folded in one place.
    """
    fp, tp = F.when(F.col("true_positive"), 0).otherwise(1), F.when(F.col("true_positive"), 1).otherwise(0)
    counted = running_totals(reports, ["indicator_id"], time_slice(F.col("us"), slice_us), ["us", "seq"], {"_f": fp.cast("long"), "_t": tp.cast("long")})
    total = reports.groupBy("indicator_id").agg(
        F.sum(fp).alias("n_fp"), F.sum(tp).alias("n_tp"), F.max(F.when(F.col("true_positive"), F.col("us"))).alias("last_tp_us")
    )
    scale = lambda f, t: F.pow(F.lit(0.95), f) * F.pow(F.lit(1.02), t)
    after = counted.filter("true_positive").join(total, "indicator_id").groupBy("indicator_id").agg(
        F.min(scale(F.col("n_fp") - F.col("_f"), F.col("n_tp") - F.col("_t"))).alias("_cap")
    )
    j = indicators.join(total, "indicator_id", "left").join(after, "indicator_id", "left")
    zero = F.lit(0)
    n_fp, n_tp = F.coalesce("n_fp", zero), F.coalesce("n_tp", zero)
    conf = F.least(F.col("confidence") * scale(n_fp, n_tp), F.coalesce("_cap", F.lit(1.0)))
    rate = F.when(n_fp > 0, F.lit(1.0) - (F.lit(1.0) - F.coalesce("fp_rate", F.lit(0.0))) * F.pow(F.lit(0.9), n_fp)).otherwise(F.col("fp_rate"))
    return j.withColumns({"confidence": F.when(n_fp + n_tp > 0, conf).otherwise(F.col("confidence")), "fp_rate": rate}).drop("n_fp", "n_tp", "_cap")


def feed_statistics(raw: DataFrame, indicators: DataFrame, now: str) -> DataFrame:
    """Per feed: received, accepted, rejected, active, mean confidence."""
    got = raw.groupBy("feed_id").agg(F.count("*").alias("received"))
    live = F.col("expires_at").isNull() | (F.col("expires_at") >= F.to_timestamp(F.lit(now)))
    kept = indicators.groupBy("feed_id").agg(
        F.count("*").alias("accepted"), F.count_if(live).alias("active"), F.avg("confidence").alias("avg_confidence")
    )
    j = got.join(kept, "feed_id", "left")
    acc = F.coalesce("accepted", F.lit(0))
    return j.withColumns({"rejected": F.col("received") - acc, "accepted": acc, "active": F.coalesce("active", F.lit(0))})


def feeds_due(feeds: DataFrame, now_us: int) -> DataFrame:
    return feeds.filter(
        F.col("enabled") & (F.col("last_fetch_us").isNull() | (F.lit(now_us) - F.col("last_fetch_us") >= F.col("refresh_s").cast("long") * 1_000_000))
    )


def remove_feed(indicators: DataFrame, feeds: DataFrame) -> DataFrame:
    return indicators.join(feeds.select("feed_id"), "feed_id", "left_anti")


def classify_technique(text: Column | str) -> Column:
    """Technique with most of its expressions hitting; ties to the first, none: unknown."""
    low = F.lower(X.col(text))
    best, score = F.lit("unknown"), F.lit(0)
    scores = {t: X.flag_count([low.rlike(java_regex(p, ignore_case=True)) for p in ps]) for t, ps in R.TECHNIQUE_RULES.items()}
    ranked = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, s) in enumerate(scores.items())])
    top = F.array_max(ranked)
    return F.when(top["s"] > score, top["t"]).otherwise(best)


def extract_indicator_patterns(indicators: DataFrame) -> DataFrame:
    """(indicator_id, pattern, confidence): own patterns, and what the technique's expressions find
    in the test cases, generalised, at .9 of the confidence; distinct."""
    own = indicators.select("indicator_id", "pattern", "confidence")
    cases = indicators.select("indicator_id", "technique", "confidence", F.explode("test_cases").alias("case"))
    known = cases.withColumn("t", F.when(F.col("technique") == "unknown", classify_technique("case")).otherwise(F.col("technique")))
    found = F.array_compact(F.array(*[
        F.when(F.col("t") == t, F.nullif(F.regexp_extract("case", java_regex(p, ignore_case=True), 0), F.lit("")))
        for t, ps in R.TECHNIQUE_RULES.items() for p in ps
    ]))
    made = unnest(known, F.slice(found, 1, 1), "hit", "indicator_id", "confidence").select(
        "indicator_id", X.regex_from_text("hit").alias("pattern"), (F.col("confidence") * 0.9).alias("confidence")
    )
    return own.unionByName(made).groupBy("indicator_id", "pattern").agg(F.max("confidence").alias("confidence"))


def regex_from_examples(examples: DataFrame, group: str, order: str, min_length: int = 5) -> DataFrame:
    """(group, regex): maximal substrings of the first example that all examples of the group share.

    Each example is compared with the first one by itself and returns, per position, how far
    the two agree; the least over the examples is a mergeable minimum."""
    first = examples.groupBy(group).agg(F.min_by(F.lower("text"), order).alias("_ref"), F.count("*").alias("_n"))
    met = examples.select(group, F.lower("text").alias("_t")).join(first.filter("_n >= 2"), group)

    def reach(refs: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for ref, text in zip(refs, texts):
            far, k = [], 0
            for i in range(len(ref)):
                k = max(k - 1, 0)
                while i + k < len(ref) and ref[i : i + k + 1] in text:
                    k += 1
                far.append(k)
            out.append(far)
        return pd.Series(out)

    # numbers only: combined in the task that compares, the first example comes back by its group
    rows = met.select(group, F.posexplode(F.pandas_udf(reach, "array<int>")("_ref", "_t")).alias("i", "k"))
    least = rows.groupBy(group, "i").agg(F.min("k").alias("k")).filter(F.col("k") >= min_length).join(first.select(group, "_ref"), group)
    before = Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    best = least.withColumn("_end", F.max(F.col("i") + F.col("k")).over(before)).filter(
        F.col("_end").isNull() | (F.col("i") + F.col("k") > F.col("_end"))
    )
    parts = best.groupBy(group, F.expr("substring(_ref, i + 1, k)").alias("s")).agg(F.min("i").alias("i"))
    # one list per group, no longer than its first example
    listed = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.length("s")).alias("l"), "i", "s"))).alias("p"))
    texts = listed.select(group, F.transform("p", lambda x: x["s"]).alias("p"))
    kept = F.filter("p", lambda x: ~F.exists("p", lambda y: (y != x) & y.contains(x)))
    made = F.transform(kept, lambda s: F.replace(X.regex_escape(s), F.lit("\\ "), F.lit(r"\s+")))
    return texts.select(group, F.array_join(made, "|").alias("regex"))
