"""Matching texts against a table of expressions (learned patterns, indicators, custom rules).

Three physical forms, chosen by the counted number of expressions:
  * few: literal Spark expressions, one projection, no Python;
  * up to MAX_DRIVER_RULES: the list travels with the task and is compiled once per worker;
  * more: an equi-join on a literal shingle each match must contain, then a check of the
    candidates only; expressions without such a literal go through the second form in passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.functions.regexes import FOLDED, fold, java_regex, required_literals
from rampart.functions.unnest import computed_once, unnest
from rampart.session import cut_lineage

MAX_STATIC_RULES = 100
MAX_DRIVER_RULES = 2000
SHINGLE = 5
BITS = 1 << 26
# constructs whose meaning or spelling differs between `re` and Java
_PYTHON_ONLY = re.compile(r"\(\?P|\(\?\(|\\Z|\(\?[a-zA-Z]+\)|\\N\{|\{,\d|\\0|\\[1-9]\d\d|\\U|\\v|\[[^\]]*(?:\[|&&)")


_COMPILED: dict[str, re.Pattern | None] = {}


def compiled(pattern: str) -> re.Pattern | None:
    """The compiled expression, kept per worker; None if it is not valid."""
    if pattern not in _COMPILED:
        try:
            _COMPILED[pattern] = re.compile(pattern, re.IGNORECASE)
        except (re.error, OverflowError):
            _COMPILED[pattern] = None
    return _COMPILED[pattern]


def is_valid(pattern: str | None) -> bool:
    return bool(pattern) and compiled(pattern) is not None


def _folded(text: str) -> Column:
    return F.translate(F.lower(text), *FOLDED)


def _static(texts: DataFrame, rules: list[tuple[str, str]], text: str, rule_id: str) -> DataFrame:
    low = F.col("__low")
    hits = []
    for rid, pattern in rules:
        test = F.col(text).rlike(java_regex(pattern, ignore_case=True, unicode_case=True))
        needed = required_literals(pattern)
        if needed:
            test = low.contains(needed[0]) & test
        hits.append(F.when(test, F.lit(rid)))
    return unnest(texts.withColumn("__low", _folded(text)), F.array_compact(F.array(*hits)), rule_id, *texts.columns)


def _listed(texts: DataFrame, rules: list[tuple], text: str, rule_id: str, by: str | None = None) -> DataFrame:
    """`rules` are pairs of id and expression; with `by` a third entry names the group of texts they are for."""

    def prepared() -> dict[str, list[tuple]]:
        tests: dict[str, list[tuple]] = {}
        for rid, pattern, *group in rules:
            rx = compiled(pattern)
            if rx is not None:
                needed = required_literals(pattern)
                tests.setdefault(group[0] if by else "", []).append((rid, needed[0] if needed else "", rx))
        return tests

    def hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tests = prepared()
        for values, groups in batches:
            out = []
            for value, group in zip(values, groups):
                low = fold(value) if value is not None else ""
                out.append([rid for rid, lit, rx in tests.get(group, ()) if lit in low and rx.search(value)] if low else [])
            yield pd.Series(out)

    group = F.col(by).cast("string") if by else F.lit("")
    return unnest(texts, F.pandas_udf(hits, "array<string>")(F.col(text), group), rule_id, *texts.columns)


def _matches(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    out = []
    for value, pattern in zip(texts, patterns):
        rx = compiled(pattern) if pattern is not None else None
        out.append(bool(rx.search(value)) if rx is not None and value is not None else False)
    return pd.Series(out, dtype=bool)


def _valid(patterns: pd.Series) -> pd.Series:
    return patterns.map(is_valid).astype(bool)


def _windows(folded: str) -> np.ndarray:
    """A 64-bit hash per run of SHINGLE characters."""
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = max(len(codes) - SHINGLE + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)) ^ (out >> np.uint64(32))


def _shingles(patterns: pd.Series) -> pd.Series:
    def of(pattern: str | None) -> np.ndarray:
        return np.unique(np.concatenate([_windows(lit) for lit in required_literals(pattern or "")] or [_windows("")])).view(np.int64)

    return patterns.map(of)


def hash_bitmap(grams: DataFrame) -> np.ndarray:
    """Which hashes may be among `__g`: a bit for each by its last bits, 8 MB however many there are."""
    at = F.pmod("__g", F.lit(BITS)) + 1
    parts = grams.select(at.alias("__at")).groupBy(F.expr("bitmap_bucket_number(__at)").alias("__part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(__at))").alias("__bits")
    )
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for part, bits in parts.collect():
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & (BITS - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def _present(bits: np.ndarray, folded: Column) -> Column:
    """The distinct shingles of a text that `bits` may hold."""

    def found(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            at = _windows(value or "")
            out.append(np.unique(at[in_bitmap(bits, at.view(np.int64))]).view(np.int64))
        return pd.Series(out)

    return F.pandas_udf(found, "array<long>")(folded)


def _matching_rules(texts: pd.Series, listed: pd.Series) -> pd.Series:
    out = []
    for value, found in zip(texts, listed):
        tests = [(r["__rid"], compiled(r["__p"])) for r in found]
        out.append([rid for rid, rx in tests if rx is not None and rx.search(value)])
    return pd.Series(out)


def pattern_matches(text: Column | str, pattern: Column | str) -> Column:
    """Row by row: does the expression match the text?"""
    return F.pandas_udf(_matches, "boolean")(text, pattern)


def rejected_patterns(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The rules whose expression no form can use; `match_patterns` leaves exactly these out."""
    return rules.filter(~F.coalesce(pattern_is_valid(pattern), F.lit(False)))


def pattern_is_valid(pattern: Column | str) -> Column:
    return F.pandas_udf(_valid, "boolean")(pattern)


def _indexed(texts: DataFrame, rules: DataFrame, text: str, rule_id: str, pattern: str, by: str | None = None) -> DataFrame:
    """Equal texts share one id.  A task passes on a shingle only if some rule has it, so what is
    exchanged are the hits of rules and, once, the texts that have one.  With `by`, rules meet
    the texts of their own group only."""
    group = F.col(by).cast("string") if by else F.lit("")
    keyed = cut_lineage(rules.select(group.alias("__by"), F.col(rule_id).alias("__rid"), F.col(pattern).alias("__p")).filter(
        "__p is not null"
    ).withColumn("__grams", F.pandas_udf(_shingles, "array<long>")("__p")))
    numbered = texts.withColumns({"__by": group, "__tid": F.unhex(F.sha2(F.col(text).cast("binary"), 256))})
    options = keyed.select("__by", "__rid", "__p", F.explode("__grams").alias("__g"))
    # each rule is looked up under its rarest shingle
    seen = unnest(numbered, _present(hash_bitmap(options), _folded(text)), "__g", "__by").groupBy("__by", "__g").agg(F.count("*").alias("__n"))
    ranked = cut_lineage(options.join(seen, ["__by", "__g"], "left").groupBy("__by", "__rid", "__p").agg(
        F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), F.col("__g"))).alias("__g")
    ))
    held = computed_once(numbered.withColumn("__held", _present(hash_bitmap(ranked), _folded(text))), "__held").filter(F.size("__held") > 0)
    posted = unnest(held, "__held", "__g", "__by", "__tid").distinct()
    candidates = posted.join(ranked, ["__by", "__g"]).groupBy("__by", "__tid").agg(
        F.collect_list(F.struct("__rid", "__p")).alias("__rules")  # one text's candidates
    )
    met = held.drop("__held").join(candidates, ["__by", "__tid"])
    indexed = unnest(met, F.pandas_udf(_matching_rules, "array<string>")(F.col(text), F.col("__rules")), rule_id, *texts.columns)
    # expressions without a literal: against every text, a driver-sized list per pass
    loose = keyed.filter(F.size("__grams") == 0).select("__rid", "__p", "__by")
    batch: list[tuple[str, str, str]] = []
    for row in loose.toLocalIterator():
        batch.append((row[0], row[1], row[2]))
        if len(batch) == MAX_DRIVER_RULES:
            indexed = indexed.unionByName(_listed(texts, batch, text, rule_id, by))
            batch = []
    return indexed.unionByName(_listed(texts, batch, text, rule_id, by)) if batch else indexed


def matches_by_group(texts: DataFrame, rules: DataFrame, by: str, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Rows of `texts` with each expression of their own group (`by`) that matches, as `pattern`."""
    return _indexed(texts, rules.select(by, F.col(pattern).cast("string").alias(pattern)), text, pattern, pattern, by)


def match_patterns(
    texts: DataFrame, rules: DataFrame, text: str = "text", rule_id: str = "rule_id", pattern: str = "pattern",
    form: str | None = None,
) -> DataFrame:
    """Rows of `texts` with the id (a string) of each rule that matches; one row per hit."""
    listed = rules.select(F.col(rule_id).cast("string"), F.col(pattern).cast("string"))
    if form is None:
        head = listed.limit(MAX_DRIVER_RULES + 1).collect()
        if len(head) > MAX_DRIVER_RULES:
            return _indexed(texts, listed, text, rule_id, pattern)
        pairs = [(r[0], r[1]) for r in head if is_valid(r[1])]
        plain = not any(_PYTHON_ONLY.search(p) for _, p in pairs)
        form = "static" if len(pairs) <= MAX_STATIC_RULES and plain else "listed"
    elif form == "indexed":
        return _indexed(texts, listed, text, rule_id, pattern)
    else:
        head = listed.limit(MAX_DRIVER_RULES + 1).collect()
        if len(head) > MAX_DRIVER_RULES:
            raise ValueError(f"more than {MAX_DRIVER_RULES} expressions: only the indexed form takes them")
        pairs = [(r[0], r[1]) for r in head if is_valid(r[1])]
    if not pairs:
        return texts.withColumn(rule_id, F.lit(None).cast("string")).filter(F.lit(False))
    return (_static if form == "static" else _listed)(texts, pairs, text, rule_id)
