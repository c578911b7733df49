"""Logs and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.operators.slices import order_statistics, previous_value, time_slice
from rampart.session import cut_lineage

HOUR = 3_600_000_000


def log_patterns(logs: DataFrame, top: int | None = 5) -> DataFrame:
    g = logs.groupBy(X.log_template("message").alias("template")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "template").limit(top) if top else g


def error_clusters(logs: DataFrame) -> DataFrame:
    low = F.lower("message")
    status = F.col("status_code").cast("string") if "status_code" in logs.columns else F.lit("")
    kind = (
        F.when(low.contains("timeout"), "timeout_errors").when(low.contains("connection"), "connection_errors")
        .when(low.contains("permission") | low.contains("forbidden"), "permission_errors")
        .when(low.contains("not found") | status.contains("404"), "not_found_errors").otherwise("other_errors")
    )
    return logs.filter(F.col("level") == "ERROR").groupBy(kind.alias("cluster")).agg(F.count("*").alias("n"))


def gap_anomalies(logs: DataFrame, id_col: str = "request_id", sigmas: float = 2.0) -> DataFrame:
    """Logs whose positive gap to the log before is off the mean gap by more than `sigmas` deviations.

    The whole log is one sequence: it is cut into hours, each sorted by itself, and joined at
    the ends.  The mean and deviation are one aggregate row."""
    gaps = previous_value(logs.select(id_col, "us"), [], time_slice(F.col("us"), HOUR), ["us", id_col], {"before": F.col("us")})
    positive = gaps.withColumn("gap_s", (F.col("us") - F.col("before")) / 1e6).filter(F.col("gap_s") > 0)
    base = positive.agg(F.avg("gap_s").alias("mean_gap"), F.stddev_pop("gap_s").alias("std_gap"), F.count("*").alias("_n"))
    j = positive.join(F.broadcast(base))  # one row
    return j.filter((F.col("_n") >= 10) & (F.abs(F.col("gap_s") - F.col("mean_gap")) > F.col("std_gap") * sigmas)).select(
        id_col, "gap_s", "mean_gap"
    )


def error_spikes(logs: DataFrame, factor: float = 3.0) -> DataFrame:
    """Minutes with more than `factor` times the mean errors of minutes that have errors."""
    per = logs.filter(F.col("level") == "ERROR").groupBy(time_slice(F.col("us"), 60_000_000).alias("minute")).agg(F.count("*").alias("n"))
    mean = per.agg(F.avg("n").alias("mean_errors"))
    return per.join(F.broadcast(mean)).filter(F.col("n") > F.col("mean_errors") * factor)  # one row


def metric_summary(m: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, extremes, mean and the p50/p95/p99 rows (by index, not interpolated)."""
    basic = m.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg")
    )
    return basic.join(order_statistics(m, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "index"), keys)


def request_data(logs: DataFrame, request_id) -> DataFrame:
    return logs.filter(F.col("request_id") == request_id)


def span_statistics(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"), F.min("duration").alias("min"),
        F.max("duration").alias("max"), F.array_sort(F.collect_set("name")).alias("names"),
    )


def dependency_graph(spans: DataFrame) -> DataFrame:
    """Distinct (parent name, child name) with the number of calls; names are counted before any set is built."""
    child = spans.select("trace_id", F.col("parent_id").alias("span_id"), F.col("name").alias("child")).filter("span_id is not null")
    parent = spans.select("trace_id", "span_id", F.col("name").alias("parent"))
    return child.join(parent, ["trace_id", "span_id"]).groupBy("parent", "child").agg(F.count("*").alias("n"))


def bottlenecks(spans: DataFrame, p: float = 0.95) -> DataFrame:
    """Spans at least as long as the span at index int(n * p) of all durations."""
    cut = order_statistics(spans, [], "duration", {"cut": p}, "index")
    return spans.join(F.broadcast(cut)).filter(F.col("duration") >= F.col("cut")).drop("cut")  # one row


def span_errors(spans: DataFrame) -> DataFrame:
    return spans.groupBy("name").agg(
        F.count_if(F.col("status") == "error").alias("errors"), F.count("*").alias("n"),
        F.avg((F.col("status") == "error").cast("double")).alias("rate"),
    )


def critical_path(spans: DataFrame) -> DataFrame:
    """Heaviest chain from a root to a leaf per trace; of equal ones that with the smaller leaf.

    A span whose parent is not in its trace is a root, so is one without a parent.  Chains grow
    by one level per round, by an equi-join on (trace, parent), until none grows; a chain never
    meets a span twice.  Spans that only hang on a cycle have no root and are on no chain.  Each
    round is checkpointed."""
    nodes = spans.select("trace_id", "span_id", "parent_id", "duration")
    has_child = nodes.filter("parent_id is not null").select("trace_id", F.col("parent_id").alias("span_id")).distinct()
    marked = nodes.join(has_child.withColumn("_inner", F.lit(True)), ["trace_id", "span_id"], "left")
    present = nodes.select("trace_id", F.col("span_id").alias("parent_id")).distinct()
    roots = marked.join(present, ["trace_id", "parent_id"], "left_anti")
    frontier = cut_lineage(roots.select(
        "trace_id", "span_id", F.col("duration").alias("total"), F.array("span_id").alias("path"), "_inner"
    ))
    children = marked.filter("parent_id is not null").select(
        "trace_id", F.col("parent_id").alias("_up"), F.col("span_id").alias("_next"), F.col("duration").alias("_d"), F.col("_inner").alias("_next_inner")
    )
    done = frontier.filter("_inner is null")
    while True:
        inner = frontier.filter("_inner")
        grown = inner.join(children, (inner["trace_id"] == children["trace_id"]) & (inner["span_id"] == children["_up"]))
        grown = grown.filter(~F.array_contains("path", F.col("_next"))).select(
            inner["trace_id"], F.col("_next").alias("span_id"), (F.col("total") + F.col("_d")).alias("total"),
            F.concat("path", F.array("_next")).alias("path"), F.col("_next_inner").alias("_inner"),
        )
        frontier = cut_lineage(grown)
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier.filter("_inner is null"))
    best = done.groupBy("trace_id").agg(F.max(F.struct("total", (-F.col("span_id")).alias("_tie"), "path")).alias("b"))
    return best.select("trace_id", "b.total", "b.path")
