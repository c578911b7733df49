"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token weights are raked until
their sums over each of the three meet that margin's target shares; the quotient of raked and own
weight is the cells' correction.  A document's probability is its cell's correction times one scale,
one at most, the scale being such that the expected tokens are the asked share of all tokens.  A
document is taken if a hash of its id falls below its probability.  DataFrame functions only.

Corrections that pass one are cut off there, so the sample misses the targets of every margin.  With
`capped` the raking itself keeps each cell to its own tokens: targets that a margin's tokens cannot reach
at that share give what is left over to the others, and cells that are not full make up for full ones of
the same source, language or topic.  `expected` tells own, target and sample shares.

Missing sources and languages are values of their own.  Null text has no tokens; a cell without
tokens gets the asked share as its probability.  Rows without an id share one hash, so do rows
repeated under one id.  Empty tables give empty results; of other columns any names will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.llm.common import WORD, gathered, written

#: Topic -> expression that a text of it matches somewhere; the first match counts.
TOPICS = {
    "legal": r"(?i)licen[sc]e|copyright",
    "tabular": r" \| ",
    "contact": r"\w@\w",
}
OTHER = "prose"
MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    case = F.when(F.lit(False), F.lit(""))
    for name, pattern in TOPICS.items():
        case = case.when(text.rlike(pattern), F.lit(name))
    return case.otherwise(F.lit(OTHER))


def _cell(text: Column) -> list[Column]:
    return [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic_of(text).alias("topic")]


def _targets(cells: DataFrame, margin: str, alpha: float, given: dict[str | None, float] | None) -> DataFrame:
    """`margin` and `_aim`, shares that add up to one.  Values that `given` names get its shares;
    the others divide what is left as their tokens to the power of alpha."""
    own = cells.groupBy(margin).agg(F.sum("_t").alias("_own")).filter("_own > 0")
    weight = F.pow(F.col("_own"), F.lit(float(alpha)))
    if not given:
        return own.select(margin, (weight / F.sum(weight).over(W.partitionBy())).alias("_aim"))  # a row per value
    left = max(0.0, 1 - sum(given.values()))
    named = own.sparkSession.createDataFrame(list(given.items()), f"{margin}_ string, _given double")
    own = own.join(F.broadcast(named), own[margin].eqNullSafe(named[f"{margin}_"]), "left")
    rest = F.when(F.col("_given").isNull(), weight)
    aim = F.coalesce("_given", rest / F.sum(rest).over(W.partitionBy()) * left)
    own = own.select(margin, aim.alias("_aim"))
    return own.select(margin, (F.col("_aim") / F.sum("_aim").over(W.partitionBy())).alias("_aim"))


def rake(cells: DataFrame, rounds: int, alpha: float, targets: dict[str, dict[str | None, float]]) -> DataFrame:
    """`cells` (margins and tokens _t) with _w, the raked shares, after `rounds` rounds."""
    total = cells.agg(F.sum("_t")).first()[0] or 0
    now = cells.withColumn("_w", F.col("_t") / F.lit(float(total or 1)))
    for margin in MARGINS:
        aim = _targets(cells, margin, alpha, targets.get(margin)).withColumnRenamed(margin, "_m")
        now = now.join(aim.withColumnRenamed("_aim", f"_aim_{margin}"), F.col(margin).eqNullSafe(F.col("_m")), "left").drop("_m")
    now = gathered(written(now))
    for i in range(rounds):
        for margin in MARGINS:
            have = F.sum("_w").over(W.partitionBy(margin))  # cells of a margin's value, not documents
            now = now.withColumn("_w", F.when(have > 0, F.col("_w") * F.col(f"_aim_{margin}") / have).otherwise(F.col("_w")))
        if i % 4 == 3:
            now = gathered(written(now))
    return now.select(*MARGINS, "_t", "_w")


def scale(cells: DataFrame, share: float, steps: int = 8) -> float:
    """The factor by which corrections become probabilities of at most one that take `share` of all
    tokens; each step gives what full cells cannot take to the others."""
    r = cells.agg(F.sum("_t").alias("t"), F.sum(F.col("_t") * F.col("_f")).alias("tf")).first()
    if not r.t or not r.tf:
        return share
    total, factor = float(r.t), share
    for _ in range(steps):
        full = F.col("_f") * factor >= 1
        r = cells.agg(F.sum(F.when(full, F.col("_t"))).alias("full"), F.sum(F.when(~full, F.col("_t") * F.col("_f"))).alias("rest")).first()
        if not r.rest:
            break
        factor = max(factor, (share * total - float(r.full or 0)) / r.rest)
    return factor


def _filled(weight: str, cap: str, total: Column, keys: list[str]) -> Column:
    """min(cap, factor * weight), the factor of each key's rows being such that they add up to `total`;
    the largest of the factors that result if the first 0, 1, ... rows to fill up are full."""
    order = W.partitionBy(*keys).orderBy(F.col(cap) / F.col(weight), *MARGINS)
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(order.rowsBetween(0, W.unboundedFollowing))
    return F.when(F.col(weight) > 0, (total - full) / rest)


def _fill(df: DataFrame, weight: str, cap: str, total: Column, keys: list[str]) -> DataFrame:
    df = df.withColumn("_try", _filled(weight, cap, total, keys))
    most = F.greatest(F.max("_try").over(W.partitionBy(*keys)), F.lit(0.0))
    return df.withColumn(weight, F.least(F.col(cap), F.col(weight) * most)).drop("_try")


def reach(cells: DataFrame, share: float, rounds: int, alpha: float, targets: dict[str, dict[str | None, float]]) -> DataFrame:
    """Cells with tokens, and _w, their shares of a sample of `share` of all tokens that holds none twice."""
    cells = gathered(cells)  # rounds on a few cells need no exchanges
    now = cells.filter("_t > 0").withColumn("_w", F.col("_t") / F.sum("_t").over(W.partitionBy()))  # a row per cell
    now = now.withColumn("_cap", F.col("_w") / float(share))
    for margin in MARGINS:
        aim = _targets(cells, margin, alpha, targets.get(margin)).withColumnRenamed(margin, "_m")
        now = now.join(aim, F.col(margin).eqNullSafe(F.col("_m")), "left").drop("_m")
        most = now.groupBy(F.col(margin).alias("_m")).agg(F.sum("_cap").alias("_room"), F.first("_aim").alias("_goal"))
        most = most.withColumns({m: F.col("_m") for m in MARGINS})  # the order of ties
        most = _fill(most, "_goal", "_room", F.lit(1.0), []).select("_m", F.col("_goal").alias(f"_aim_{margin}"))
        now = gathered(written(now.drop("_aim").join(most, F.col(margin).eqNullSafe(F.col("_m")), "left").drop("_m")))
    for i in range(rounds):
        for margin in MARGINS:
            now = _fill(now, "_w", "_cap", F.col(f"_aim_{margin}"), [margin])
        if i % 2:
            now = gathered(written(now))
    return _fill(now, "_w", "_cap", F.lit(1.0), []).select(*MARGINS, "_t", "_w", "_cap")


def expected(cells: DataFrame, share: float = 0.8, alpha: float = 0.7, rounds: int = 8, targets: dict | None = None, capped: bool = False) -> DataFrame:
    """margin, value, own, target, sample: shares of all tokens, those asked for, and those expected in the
    sample, of the cells (margins and tokens _t)."""
    table = chance(cells, share, rounds, alpha, targets or {}, capped).drop("weight")
    same = [cells[m].eqNullSafe(table[m]) for m in MARGINS]
    taken = cells.join(table, same[0] & same[1] & same[2]).select(*[cells[m] for m in MARGINS], "_t", (F.col("_t") * F.col("probability")).alias("_s"))
    out = None
    for m in MARGINS:
        aim = _targets(cells, m, alpha, (targets or {}).get(m)).withColumnRenamed(m, "_m")
        sums = taken.groupBy(m).agg(F.sum("_t").alias("_t"), F.sum("_s").alias("_s"))
        of = lambda c: F.col(c) / F.sum(c).over(W.partitionBy())
        sums = sums.select(F.lit(m).alias("margin"), F.col(m).alias("value"), of("_t").alias("own"), of("_s").alias("sample"))
        sums = sums.join(aim, F.col("value").eqNullSafe(F.col("_m"))).select("margin", "value", "own", F.col("_aim").alias("target"), "sample")
        out = sums if out is None else out.union(sums)
    return out


def chance(cells: DataFrame, share: float, rounds: int, alpha: float, targets: dict, capped: bool = False) -> DataFrame:
    """Margins, weight (the correction) and probability of every cell."""
    if capped and share > 0:
        full = reach(cells, share, rounds, alpha, targets)
        full = full.select(*[F.col(m).alias(f"_r_{m}") for m in MARGINS], (F.col("_w") / F.col("_cap")).alias("_p"))
        same = [F.col(m).eqNullSafe(F.col(f"_r_{m}")) for m in MARGINS]
        chances = F.coalesce(F.least("_p", F.lit(1.0)), F.lit(float(share)))
        return written(cells.join(full, same[0] & same[1] & same[2], "left").select(*MARGINS, (chances / float(share)).alias("weight"), chances.alias("probability")))
    raked = rake(cells, rounds, alpha, targets)
    total = F.sum("_t").over(W.partitionBy())  # a row per cell
    raked = written(raked.select(*MARGINS, "_t", F.when(F.col("_t") > 0, F.col("_w") * total / F.col("_t")).alias("_f")))
    factor = scale(raked.filter("_t > 0"), share)
    return written(raked.select(
        *MARGINS, F.coalesce("_f", F.lit(1.0)).alias("weight"), F.when(F.col("_f").isNull(), float(share)).otherwise(F.least(F.col("_f") * factor, F.lit(1.0))).alias("probability"),
    ))


def _draw(id_col: Column, seed: str) -> Column:
    """48 bits of a hash of the id, as a number from 0 to below 1."""
    key = F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _on_cell(left: DataFrame, right: DataFrame, prefix: str = "") -> DataFrame:
    """The cells' table is read from files, so its size decides whether it is broadcast."""
    right = right.select(*[F.col(m).alias(f"_r_{m}") for m in MARGINS], "weight", "probability")
    same = [F.col(f"{prefix}{m}").eqNullSafe(F.col(f"_r_{m}")) for m in MARGINS]
    return left.join(right, same[0] & same[1] & same[2])


def mix(
    docs: DataFrame, share: float = 0.8, alpha: float = 0.7, rounds: int = 8, targets: dict[str, dict[str | None, float]] | None = None, seed: str = "mix:",
    capped: bool = False,
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, chosen: one row per row of `docs`."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_cell(F.coalesce(text, F.lit(""))), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))
    rows = written(rows)
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("_t")))
    table = chance(cells, share, rounds, alpha, targets or {}, capped)
    return _on_cell(rows, table).select(
        "doc_id", *MARGINS, "tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"),
        (_draw(F.col("doc_id"), seed) < F.round("probability", 9)).alias("chosen"),
    )


def sample(
    docs: DataFrame, share: float = 0.8, alpha: float = 0.7, rounds: int = 8, targets: dict[str, dict[str | None, float]] | None = None, seed: str = "mix:",
    capped: bool = False,
) -> DataFrame:
    """The rows of `docs` that `mix` takes, all columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cells = docs.select(*_cell(text), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_n")).groupBy(*MARGINS).agg(F.sum("_n").alias("_t"))
    table = chance(written(cells), share, rounds, alpha, targets or {}, capped)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[c.alias(f"_l_{m}") for c, m in zip(_cell(text), MARGINS)])
    taken = _on_cell(rows, table, "_l_").filter(_draw(F.col("_doc.doc_id"), seed) < F.round("probability", 9))
    return taken.select("_doc.*")
