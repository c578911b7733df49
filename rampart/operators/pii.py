"""Personal data and secrets: spans, overlap removal, masking.  Column expressions only."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.functions.regexes import java_regex, spark_name, spark_str
from rampart.functions.unnest import computed_once, unnest

SPAN = (
    "struct<start:int,neg:double,ord:int,end:int,type:string,confidence:double,text:string>"
)


class Pattern(NamedTuple):
    kind: str
    pattern: str
    confidence: float
    guard: str  # name of the cheap test every match passes, or a literal of the lower-cased text


# fixed values: expressions per type, in order, with their confidence
PATTERNS = [
    Pattern("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9][0-9])[0-9]{12})\b", 0.8, "#d4"),
    Pattern("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", 0.6, "#d4"),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.9, "#d3"),
    Pattern("ssn", r"\b\d{3}\s\d{2}\s\d{4}\b", 0.8, "#d3"),
    Pattern("ssn", r"\b\d{9}\b", 0.3, "#d4"),
    Pattern("email", r"\b[A-Za-z0-9._%+/!#$&'*=?^`{|}~-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95, "@"),
    Pattern("email", r"[^\s]+@[^\s]+\.[^\s]+", 0.6, "@"),
    Pattern("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.8, "#d3"),
    Pattern("phone", r"\b\+\d{1,3}[-.\s]?\d{1,14}\b", 0.7, "+"),
    Pattern("phone", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.7, "#d3"),
    Pattern("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.9, "#dot"),
    Pattern("ip_address", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b", 0.9, "#colon"),
    Pattern("api_key", r"\b[A-Za-z0-9]{32,}\b", 0.4, "#long"),
    Pattern("api_key", r"api[_-]?key[\s=:]+[\'\"]?([A-Za-z0-9\-_]{20,})[\'\"]?", 0.9, "key"),
    Pattern("api_key", r"token[\s=:]+[\'\"]?([A-Za-z0-9\-_]{20,})[\'\"]?", 0.9, "token"),
    Pattern("api_key", r"bearer\s+[A-Za-z0-9\-_\.]+", 0.8, "bearer"),
    Pattern("password", r"password[\s=:]+[\'\"]?([^\s\'\"]{6,})[\'\"]?", 0.9, "password"),
    Pattern("password", r"passwd[\s=:]+[\'\"]?([^\s\'\"]{6,})[\'\"]?", 0.9, "passwd"),
    Pattern("password", r"pwd[\s=:]+[\'\"]?([^\s\'\"]{6,})[\'\"]?", 0.8, "pwd"),
    Pattern("aws_key", r"\bAKIA[0-9A-Z]{16}\b", 0.95, "akia"),
    Pattern("aws_key", r"aws_secret_access_key[\s=:]+[\'\"]?([A-Za-z0-9/+=]{40})[\'\"]?", 0.9, "aws_secret_access_key"),
    Pattern("private_key", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----", 0.99, "-----begin "),
    Pattern("private_key", r"-----BEGIN OPENSSH PRIVATE KEY-----", 0.99, "-----begin "),
    Pattern("private_key", r"-----BEGIN PGP PRIVATE KEY BLOCK-----", 0.99, "-----begin "),
    Pattern("bank_account", r"\b[0-3]\d{8}\b", 0.4, "#d4"),
    Pattern("bank_account", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b", 0.8, "#d4"),
    Pattern("passport", r"\b[A-Z]\d{8}\b", 0.5, "#d4"),
    Pattern("passport", r"passport[\s:#]+([A-Z0-9]{6,9})", 0.8, "passport"),
    Pattern("date_of_birth", r"\b(?:DOB|dob|Date of Birth|date of birth)[\s:]+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", 0.9, "#dob"),
    Pattern("date_of_birth", r"\b(?:born|Born)[\s:]+\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", 0.8, "born"),
    Pattern("generic_secret", r"secret[\s=:]+[\'\"]?([^\s\'\"]{10,})[\'\"]?", 0.8, "secret"),
    Pattern("generic_secret", r"private[\s=:]+[\'\"]?([^\s\'\"]{10,})[\'\"]?", 0.7, "private"),
    Pattern("generic_secret", r"credential[\s=:]+[\'\"]?([^\s\'\"]{10,})[\'\"]?", 0.8, "credential"),
]
TYPES = list(dict.fromkeys(p.kind for p in PATTERNS))


# fixed values: cheap tests by name, over {t} (the text) and {low} (the text in lower case)
GUARDS = {
    "#d3": r"{t} rlike '\\p{{Nd}}{{3}}'",
    "#d4": r"{t} rlike '\\p{{Nd}}{{4}}'",
    "#dot": r"{t} rlike '[0-9]\\.[0-9]{{1,3}}\\.'",
    "#colon": "{t} rlike '(?:[A-Fa-f0-9]{{1,4}}:){{3}}'",
    "#long": "{t} rlike '[A-Za-z0-9]{{32}}'",
    "#dob": "(contains({low}, 'dob') or contains({low}, 'date of birth'))",
}
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def _test(p: Pattern, t: str, low: str) -> str:
    """SQL condition: does the expression match?"""
    guard = GUARDS[p.guard].format(t=t, low=low) if p.guard in GUARDS else f"contains({low}, {spark_str(p.guard)})"
    return f"{guard} and {t} rlike {spark_str(java_regex(p.pattern, ignore_case=True))}"


def _span_sql(t: str, pattern: str, kind: str, confidence: float, order: int) -> str:
    """All matches of one expression with their positions, as SQL text: one call to the JVM.

    The pieces between matches give the gaps, so positions are running sums of lengths."""
    rx = spark_str(java_regex(pattern, ignore_case=True))
    span = (
        f"named_struct('start', a.pos + x.gap, 'neg', {-float(confidence)!r}D, 'ord', {order}, 'end', a.pos + x.gap + length(x.hit), "
        f"'type', {spark_str(kind)}, 'confidence', {float(confidence)!r}D, 'text', x.hit)"
    )
    return (
        f"aggregate(zip_with(split({t}, {rx}, -1), regexp_extract_all({t}, {rx}, 0), (g, h) -> named_struct('gap', length(g), 'hit', h)), "
        f"named_struct('pos', 0, 'out', {NO_SPANS}), (a, x) -> if(x.hit is null, a, "
        f"named_struct('pos', a.pos + x.gap + length(x.hit), 'out', concat(a.out, array({span})))), a -> a.out)"
    )


def raw_spans(text: str, pattern: str, kind: str, confidence: float, order: int) -> Column:
    """All matches of one expression in the column `text`, with their positions."""
    return F.expr(_span_sql(spark_name(text), pattern, kind, confidence, order))


def dedupe_spans(spans: Column) -> Column:
    """By start, then confidence; whatever begins before the last kept end is dropped."""
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{SPAN}>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["last"], acc).otherwise(
            F.struct(s["end"].alias("last"), F.concat(acc["kept"], F.array(s)).alias("kept"))
        )

    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["kept"])


def _candidates(text: str, low: str | None = None, types: list[str] | None = None) -> Column:
    """Matches of all expressions of the types; `low`: the column with the text in lower case, if there is one."""
    t = spark_name(text)
    lowered = f"lower({t})" if low is None else spark_name(low)
    plain, cards = [NO_SPANS], [NO_SPANS]
    for i, p in enumerate(PATTERNS):
        if types is None or p.kind in types:
            found = f"if({_test(p, t, lowered)}, {_span_sql(t, p.pattern, p.kind, p.confidence, i)}, {NO_SPANS})"
            (cards if p.kind == "credit_card" else plain).append(found)
    valid = F.filter(F.expr(f"concat({', '.join(cards)})"), lambda s: X.luhn_valid(F.translate(s["text"], "- ", "")))
    return F.concat(*([valid] if len(cards) > 1 else []), F.expr(f"concat({', '.join(plain)})"))


def spans(text: str, low: str | None = None, types: list[str] | None = None) -> Column:
    """Kept spans of the column `text`, by position."""
    return dedupe_spans(_candidates(text, low, types))


def find_pii(df: DataFrame, text: str = "text", types: list[str] | None = None, custom: list[tuple] | None = None) -> DataFrame:
    """Adds `pii`: array of (type, start, end, masked, confidence, context, text).

    `custom` lists (rule, regex, confidence, mask_format); their hits are reported as
    generic_secret with the rule's own mask, and take part in overlap removal.
    """
    base = df.withColumn("_low", F.lower(text))
    found = _candidates(text, "_low", types)
    custom = custom or []
    for i, (_, regex, confidence, _) in enumerate(custom):
        found = F.concat(found, raw_spans(text, regex, "generic_secret", confidence, 1000 + i))
    kept = base.withColumn("_all", found).withColumn(
        "_kept", F.when(F.size("_all") > 0, dedupe_spans(F.col("_all"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    )
    body = F.col(text)

    def shown(s: Column) -> Column:
        left = F.greatest(s["start"] - 20, F.lit(0))
        masked, rule = X.mask_value(s["text"], s["type"]), F.lit(None).cast("string")
        for i, (name, _, _, fmt) in enumerate(custom):
            mine = s["ord"] == 1000 + i
            masked = F.when(mine, X.mask_custom(s["text"], F.lit(fmt))).otherwise(masked)
            rule = F.when(mine, F.lit(name)).otherwise(rule)
        return F.struct(
            s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), masked.alias("masked"),
            s["confidence"].alias("confidence"), F.substring(body, left + 1, s["end"] + 20 - left).alias("context"),
            s["text"].alias("text"), rule.alias("rule"),
        )

    return computed_once(kept.withColumn("pii", F.transform("_kept", shown)).drop("_low", "_all", "_kept"), "pii")


def reported_confidences(text: str, threshold: float) -> Column:
    """Confidences of the kept spans that are reported."""
    return F.transform(
        F.filter(spans(text), lambda s: s["confidence"] >= threshold), lambda s: s["confidence"]
    )


def replace_spans(text: Column, found: Column, replacement) -> Column:
    """The text with each span exchanged for `replacement(span)`."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(s["end"].alias("pos"), F.concat(acc["out"], before, replacement(s)).alias("out"))

    done = F.aggregate(found, start, step)
    return F.concat(done["out"], F.substring(text, done["pos"] + 1, F.length(text)))


def redaction(mode: str):
    def mask(s: Column) -> Column:
        return X.mask_value(s["text"], s["type"])

    def remove(s: Column) -> Column:
        return F.concat(F.lit("["), F.upper(s["type"]), F.lit("_REMOVED]"))

    def hashed(s: Column) -> Column:
        return F.concat(
            F.lit("["), F.upper(s["type"]), F.lit("_"), F.substring(F.sha2(s["text"].cast("binary"), 256), 1, 8), F.lit("]")
        )

    return {"remove": remove, "hash": hashed}.get(mode, mask)


def redact(text: str, mode: str = "mask", types: list[str] | None = None) -> Column:
    t = F.col(text)
    if mode in ("pass-silent", "pass-alert"):
        return t
    return replace_spans(t, spans(text, types=types), redaction(mode))


def redact_rows(df: DataFrame, mode: str = "mask", text: str = "text") -> DataFrame:
    """Adds `redacted`; spans are found in one projection and used in the next."""
    if mode in ("pass-silent", "pass-alert"):
        return df.withColumn("redacted", F.col(text))
    found = df.withColumn("_spans", spans(text))
    out = F.when(F.size("_spans") > 0, replace_spans(F.col(text), F.col("_spans"), redaction(mode))).otherwise(F.col(text))
    return found.withColumn("redacted", out).drop("_spans")


def pii_summary(df: DataFrame, text: str = "text") -> DataFrame:
    """Spans and rows by type."""
    one = unnest(df, spans(text), "s")
    return one.groupBy(F.col("s.type").alias("type")).agg(
        F.count("*").alias("n"), F.count_if(F.col("s.confidence") >= 0.7).alias("n_reported")
    )


def type_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds one boolean per type: does any of its expressions match (before overlap removal)."""
    t = spark_name(text)
    flags = {f"has_{kind}": F.expr(" or ".join(f"({_test(p, t, '_low')})" for p in PATTERNS if p.kind == kind)) for kind in TYPES}
    return df.withColumn("_low", F.lower(text)).withColumns(flags).drop("_low")


# --- custom rules ---------------------------------------------------------------------------
def custom_rule_list(rules: DataFrame, limit: int = 500) -> list[tuple]:
    """Flat, enabled rules (name, regex, confidence, mask_format) for `find_pii`; the table is counted first."""
    rows = rules.filter("enabled").select("name", "regex", "confidence", "mask_format").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} custom expressions: use find_custom_pii, which matches any number")
    return [tuple(r) for r in rows]


def find_custom_pii(df: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Hits of custom rules in long form, for any number of rules: (columns, rule, regex, matched, masked)."""
    from rampart.operators.matching import match_patterns

    numbered = rules.filter("enabled").withColumn("rule_id", F.xxhash64("name", "regex").cast("string"))
    hits = match_patterns(df, numbered.select("rule_id", F.col("regex").alias("pattern")), text)
    joined = hits.join(numbered.select("rule_id", F.col("name").alias("rule"), "regex", "confidence", "mask_format"), "rule_id")
    found = joined.withColumn("matched", F.explode(_all_matches(F.col(text), F.col("regex"))))
    return found.withColumn("type", F.lit("generic_secret")).withColumn("masked", X.mask_custom("matched", "mask_format")).drop("rule_id")


def _all_matches(text: Column, pattern: Column) -> Column:
    from rampart.operators.matching import compiled

    def run(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        out = []
        for value, p in zip(texts, patterns):
            rx = compiled(p)
            out.append([m.group() for m in rx.finditer(value)] if rx is not None and value is not None else [])
        return pd.Series(out)

    return F.pandas_udf(run, "array<string>")(text, pattern)


def validate_pii_rules(rules: DataFrame) -> DataFrame:
    """Rules (name, severity, regex, confidence) with `problems`."""
    from rampart.operators.matching import pattern_is_valid

    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    problems = F.array_compact(F.array(
        F.when(empty("name"), "missing name"),
        F.when(empty("regex"), "missing regex"),
        F.when(~F.coalesce(F.col("severity"), F.lit("medium")).isin("low", "medium", "high", "critical"), "invalid severity"),
        F.when(~empty("regex") & ~F.col("_valid"), "invalid regex"),
        F.when(~F.coalesce(F.col("confidence"), F.lit(0.0)).between(0.0, 1.0), "confidence outside 0..1"),
    ))
    return rules.withColumn("_valid", pattern_is_valid(F.col("regex"))).withColumn("problems", problems).drop("_valid")
