"""Ordered work over keys of any size.

One key may hold a third of all rows, so nothing here sorts or collects a whole key in one
task.  An ordered key is cut into slices (of time, or of value); work inside a slice is a
plain window, and slices are tied together by one small row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE = "__slice"


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, the exact form event times are compared in."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def time_slice(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us)).cast("long")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys where null equals null; the right copies are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[Column | str],
    totals: dict[str, Column],
) -> DataFrame:
    """Adds running sums over (keys) in `order`; `slice_by` must not decrease along `order`.

    Rows are shuffled once, by (keys, slice).  The per-slice sums are pre-aggregated before
    their shuffle and only those are cumulated per key.
    """
    keys = list(keys)
    sliced = df.withColumn(_SLICE, slice_by).withColumns({f"__v_{n}": c for n, c in totals.items()})
    per_slice = sliced.groupBy(*keys, _SLICE).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys, _SLICE, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in totals]
    )
    inside = (
        Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = sliced.join(offsets, [*keys, _SLICE])
    out = joined.withColumns({n: F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(inside) for n in totals})
    return out.drop(_SLICE, *[f"__{p}_{n}" for p in "vo" for n in totals])


def previous_value(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[Column | str], values: dict[str, Column]
) -> DataFrame:
    """`lag` over a key of any size: inside the slice, else the last row of the slice before."""
    keys = list(keys)
    sliced = df.withColumn(_SLICE, slice_by).withColumns({f"__v_{n}": c for n, c in values.items()})
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    order_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    lasts = sliced.groupBy(*keys, _SLICE).agg(
        *[F.max_by(F.struct(F.col(f"__v_{n}")), order_struct).alias(f"__l_{n}") for n in values]
    )
    over_slices = Window.partitionBy(*keys).orderBy(_SLICE)
    prior = lasts.select(*keys, _SLICE, *[F.lag(f"__l_{n}").over(over_slices).alias(f"__p_{n}") for n in values])
    joined = sliced.join(prior, [*keys, _SLICE]).withColumn("__first", F.row_number().over(inside) == 1)
    out = joined.withColumns({
        n: F.when(F.col("__first"), F.col(f"__p_{n}.__v_{n}")).otherwise(F.lag(f"__v_{n}").over(inside))
        for n in values
    })
    return out.drop(_SLICE, "__first", *[f"__{p}_{n}" for p in "vp" for n in values])


def trailing_window(
    df: DataFrame, keys: Sequence[str], us: str, width_us: int, measures: dict[str, tuple[str, str | None] | Column], closed: bool = False
) -> DataFrame:
    """Aggregates over the trailing `width_us` of each row, (t - width, t] or [t - width, t].

    A row lies in the window of rows of its own slice and the next one only, so each row is
    sent to those two slices; a slice holds at most two window widths of one key.  A window is what
    its slice has up to t and what the slice before has from the window's start on: two running
    totals, so a row costs the same however many rows its window holds.
    `measures` are ("count", None), ("sum", column) or ("avg", column); an aggregate column without a
    window is taken too, but steps through the whole window for each row.
    """
    keys = list(keys)
    given = {n: m for n, m in measures.items() if isinstance(m, Column)}
    measures = {n: m for n, m in measures.items() if n not in given}
    reach = width_us if closed else width_us - 1
    own = time_slice(F.col(us), width_us)
    copies = df.withColumn("__own", own).withColumn(
        _SLICE, F.explode(F.array(F.col("__own"), F.col("__own") + 1))
    )
    mine = F.col("__own") == F.col(_SLICE)
    # a row of the slice before counts for every t up to us + reach
    copies = copies.withColumns({"__mine": mine, "__at": F.when(mine, F.col(us)).otherwise(F.col(us) + reach)})
    base = Window.partitionBy(*keys, _SLICE)
    upto = base.orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = base.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    values = sorted({c for kind, c in measures.values() if kind != "count"})
    parts = {}
    for side, w, here in (("a", upto, F.col("__mine")), ("b", since, ~F.col("__mine"))):
        parts[f"__{side}_n"] = F.count_if(here).over(w)
        for c in values:
            parts[f"__{side}_c_{c}"] = F.count(F.when(here, F.col(c))).over(w)
            parts[f"__{side}_s_{c}"] = F.sum(F.when(here, F.col(c))).over(w)
    sliding = base.orderBy(us).rangeBetween(-reach, Window.currentRow)
    summed = copies.withColumns({**parts, **{n: c.over(sliding) for n, c in given.items()}}).filter(mine)

    def measure(kind: str, c: str | None) -> Column:
        if kind == "count":
            return F.col("__a_n") + F.col("__b_n")
        total = F.coalesce(F.col(f"__a_s_{c}") + F.col(f"__b_s_{c}"), f"__a_s_{c}", f"__b_s_{c}")
        return total if kind == "sum" else total / F.nullif(F.col(f"__a_c_{c}") + F.col(f"__b_c_{c}"), F.lit(0))

    out = summed.withColumns({n: measure(*m) for n, m in measures.items()})
    return out.drop("__own", _SLICE, "__mine", "__at", *parts)


def value_slices(df: DataFrame, keys: Sequence[str], value: str, n: int = 64) -> DataFrame:
    """Adds `__slice`: which of about `n` equally full value ranges of its key a row is in.

    The cut points come from a mergeable quantile sketch, so they only balance the work;
    results never depend on them.
    """
    keys = list(keys)
    probs = [i / n for i in range(1, n)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("__cuts"))
    joined = df.join(cuts, keys) if keys else df.join(F.broadcast(cuts))  # one row
    return joined.withColumn(_SLICE, F.size(F.filter("__cuts", lambda c: c < F.col(value))).cast("long")).drop("__cuts")


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value): its count `n`, and `upto`, rows of the key with value <= it.

    `extra` are per-row numbers to sum along; each gets a running sum `upto_<name>` too.
    """
    keys, extra = list(keys), extra or {}
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), *[F.sum(c).alias(x) for x, c in extra.items()])
    sliced = value_slices(counts, keys, value).withColumnRenamed(_SLICE, "__vs")
    totals = {"upto": F.col("n"), **{f"upto_{x}": F.col(x) for x in extra}}
    return running_totals(sliced, keys, F.col("__vs"), [value], totals).drop("__vs")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], method: str = "linear"
) -> DataFrame:
    """Exact percentiles of keys of any size.

    `linear`: between the two rows around (n - 1) * p.  `index`: row int(n * p), not interpolated.
    """
    keys = list(keys)
    ranked = ranked_counts(df.filter(F.col(value).isNotNull()), keys, value)
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("__total"))
    joined = ranked.join(totals, keys) if keys else ranked.join(F.broadcast(totals))  # one row
    below, upto, total = F.col("upto") - F.col("n"), F.col("upto"), F.col("__total")

    def at(rank: Column) -> Column:
        return F.max(F.when((below <= rank) & (rank < upto), F.col(value)))

    aggs, outs = [], []
    for name, p in probs.items():
        if method == "index":
            rank = F.least(F.floor(total * F.lit(p) + F.lit(1e-9)), total - 1)
            aggs.append(at(rank).alias(name))
            outs.append(F.col(name))
        else:
            k = (total - 1) * F.lit(p)
            low, high = F.floor(k + F.lit(1e-9)), F.ceil(k - F.lit(1e-9))
            aggs += [at(low).alias(f"__lo_{name}"), at(high).alias(f"__hi_{name}"), F.max(k - low).alias(f"__f_{name}")]
            outs.append(
                (
                    F.col(f"__lo_{name}")
                    + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.greatest(F.col(f"__f_{name}"), F.lit(0.0))
                ).alias(name)
            )
    grouped = joined.groupBy(*keys).agg(*aggs)
    return grouped.select(*keys, *outs)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    start: Callable[[], list],
    step: Callable[[list, tuple], tuple],
    output: str,
) -> DataFrame:
    """Sequential state per key, for steps that cannot be merged.

    Keys are hashed over tasks and sorted there; a task streams its rows in Arrow batches and
    holds one key's state (`start()`) at a time, so a key may be larger than memory.
    `step(state, row)` changes the state in place and returns the output values.
    """
    keys, order, inputs = list(keys), list(order), list(inputs)
    names = [part.strip().split(" ")[0] for part in output.split(",")]
    base = df.select(*df.columns)
    passed = [c for c in df.columns if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in passed])
    schema = f"{schema}, {output}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows = []
            key_rows = zip(*[pdf[k] for k in keys]) if keys else ((None,) for _ in range(len(pdf)))
            for key, row in zip(key_rows, zip(*[pdf[c] for c in inputs])):
                if state is None or key != current:
                    current, state = key, start()
                rows.append(step(state, row))
            out = pdf[passed].reset_index(drop=True)
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            for name, values in zip(names, columns):
                out[name] = list(values)
            yield out

    arranged = base.repartition(*keys) if keys else base.repartition(1)
    return arranged.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def split_by_gaps(
    df: DataFrame, keys: Sequence[str], us: str, gap_us: int, name: str = "island", slice_us: int | None = None
) -> DataFrame:
    """Numbers the stretches of a key that are separated by gaps of at least `gap_us`.

    State that a gap of that length resets makes the stretches independent, which splits a
    busy key into many smaller ones before an ordered fold.
    """
    slice_us = slice_us or max(gap_us, 3_600_000_000)
    by = time_slice(F.col(us), slice_us)
    lagged = previous_value(df, keys, by, [us], {"__before": F.col(us)})
    flagged = lagged.withColumn(
        "__new", F.when(F.col("__before").isNull() | (F.col(us) - F.col("__before") >= gap_us), 1).otherwise(0)
    )
    # The stretch is named by its first time: the running maximum of stretch starts, per slice and carried over.
    keys = list(keys)
    sliced = flagged.withColumn(_SLICE, by).withColumn("__start", F.when(F.col("__new") == 1, F.col(us)))
    per = sliced.groupBy(*keys, _SLICE).agg(F.max("__start").alias("__m"))
    prior = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, _SLICE, F.max("__m").over(prior).alias("__c"))
    inside = Window.partitionBy(*keys, _SLICE).orderBy(us).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.join(carried, [*keys, _SLICE]).withColumn(
        name, F.greatest(F.max("__start").over(inside), F.col("__c"))
    )
    return out.drop(_SLICE, "__start", "__c", "__new", "__before")
