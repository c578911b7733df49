"""How well rules do: statistics of a check log, scores, pruning, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_stats(checks: DataFrame, recent: int = 100, id_col: str = "check_id") -> DataFrame:
    """Per rule over a check log (rule_id, us, hit, time_ms): totals, hit rate, time, last hit and the
    hit rate of the newest `recent` checks.

    There are few rules and each has a row per text, so totals are combined before the shuffle
    and the newest checks are cut to `recent` per task before it."""
    totals = checks.groupBy("rule_id").agg(
        F.count("*").alias("checks"), F.count_if("hit").alias("hits"), F.sum("time_ms").alias("time_ms"),
        F.max(F.when(F.col("hit"), F.col("us"))).alias("last_hit_us"),
    )
    w = Window.partitionBy("rule_id").orderBy(F.desc("us"), F.desc(id_col))
    newest = checks.select("rule_id", "us", "hit", id_col).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= recent)
    rate = newest.groupBy("rule_id").agg((F.avg(F.col("hit").cast("double")) * 100).alias("recent_hit_rate"))
    return totals.join(rate, "rule_id").withColumns({
        "hit_rate": F.col("hits") / F.col("checks") * 100, "avg_time_ms": F.col("time_ms") / F.col("checks"),
    })


def running_hit_rate(checks: DataFrame, recent: int = 100, slice_us: int = 86_400_000_000, id_col: str = "check_id") -> DataFrame:
    """Adds the hit rate of the `recent` checks up to each check.

    Running totals give both ends of the frame: the total at a check less the total `recent`
    checks earlier, found by position; no rule is sorted as a whole."""
    from rampart.operators.slices import running_totals, time_slice

    totals = running_totals(
        checks, ["rule_id"], time_slice(F.col("us"), slice_us), ["us", id_col],
        {"_n": F.lit(1).cast("long"), "_h": F.col("hit").cast("long")},
    )
    earlier = totals.select("rule_id", (F.col("_n") + recent).alias("_n"), F.col("_h").alias("_before"))
    joined = totals.join(earlier, ["rule_id", "_n"], "left")
    seen = F.least(F.col("_n"), F.lit(recent))
    return joined.withColumn("rate", (F.col("_h") - F.coalesce("_before", F.lit(0))) / seen * 100).drop("_n", "_h", "_before")


def rule_effectiveness(stats: DataFrame, feedback: DataFrame, now_us: int) -> DataFrame:
    """Adds score: .3 hit rate + .4 true positive rate + .2 recency + .1 speed."""
    f = feedback.groupBy("rule_id").agg(
        F.count_if("true_positive").alias("tp"), F.count_if(~F.col("true_positive")).alias("fp")
    )
    j = stats.join(f, "rule_id", "left").withColumns({"tp": F.coalesce("tp", F.lit(0)), "fp": F.coalesce("fp", F.lit(0))})
    known = F.col("tp") + F.col("fp")
    tp_rate = F.when(known > 0, F.col("tp") / known).otherwise(0.5)
    recency = F.when(F.lit(now_us) - F.col("last_hit_us") < 3_600_000_000, 1.0).otherwise(0.8)
    t = F.col("avg_time_ms")
    speed = F.when(t < 0.1, 1.0).otherwise(F.lit(0.1) / t)
    return j.withColumn("score", F.col("hit_rate") / 100 * 0.3 + tp_rate * 0.4 + recency * 0.2 + speed * 0.1)


def reorder_rules(scored: DataFrame, min_checks: int = 10) -> DataFrame:
    """Adds position: rules with enough checks by score, the rest after them by name."""
    enough = F.col("checks") > min_checks
    w = Window.orderBy(F.when(enough, 0).otherwise(1), F.desc(F.when(enough, F.col("score"))), "rule_id")
    return scored.withColumn("position", F.row_number().over(w))  # one row per rule


def prune_rules(scored: DataFrame, threshold: float = 0.01, min_checks: int = 100) -> DataFrame:
    """The rules to drop."""
    return scored.filter((F.col("checks") >= min_checks) & (F.col("score") < threshold))


def top_bottom_rules(scored: DataFrame, n: int = 5) -> DataFrame:
    best = Window.orderBy(F.desc("score"), "rule_id")
    worst = Window.orderBy("score", "rule_id")
    cut = lambda w, name: scored.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n).select(
        F.lit(name).alias("side"), "rk", "rule_id", "score"
    )
    return cut(best, "top").unionByName(cut(worst, "bottom"))


def reweighted_rules(rules: DataFrame, scored: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Rules (rule_id, category, pattern, confidence) with confidence times score, weak ones left out."""
    s = scored.filter(F.col("score") >= threshold).select("rule_id", "score")
    return rules.join(s, "rule_id").withColumn("confidence", F.col("confidence") * F.col("score")).drop("score")


def context_rules(hits: DataFrame, top: int = 20) -> DataFrame:
    """Rules that hit per context label, the `top` by their number of hits."""
    g = hits.groupBy("context", "rule_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("context").orderBy(F.desc("n"), "rule_id")
    return g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top)


def apply_feedback(events: DataFrame, feedback: DataFrame, key: str = "event_id") -> DataFrame:
    """Adds label, is_false_positive and is_false_negative of the newest feedback per event."""
    last = feedback.groupBy(key).agg(
        F.max_by(F.struct("label", "is_false_positive", "is_false_negative"), F.col("us")).alias("_f")
    )
    j = events.join(last, key, "left")
    flag = lambda c: F.coalesce(F.col(f"_f.{c}"), F.lit(False))
    return j.withColumns({
        "label": F.col("_f.label"), "is_false_positive": flag("is_false_positive"), "is_false_negative": flag("is_false_negative"),
    }).drop("_f")
