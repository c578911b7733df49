"""Rule-based detection: static rules as one projection per message, no shuffle, no Python."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions import rule_tables as R
from rampart.functions import text as X
from rampart.functions.regexes import java_regex, spark_name, spark_str
from rampart.functions.unnest import computed_once

REASON = "struct<category:string,description:string,confidence:double,source:string,pattern:string>"
LOWER = "_lower"


def reason(category: str | Column, description: str | Column, confidence: float | Column, pattern: str | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(category).alias("category"), as_col(description).alias("description"),
        as_col(confidence).cast("double").alias("confidence"), F.lit("heuristic").alias("source"),
        as_col(pattern).alias("pattern"),
    )


def rule_test(rule: R.Rule, text: str, lowered: str, **flags: bool) -> str:
    """SQL condition: does the rule match the column `text`?  The literal guard spares the expression on most rows."""
    test = f"{spark_name(text)} rlike {spark_str(java_regex(rule.pattern, **flags))}"
    guard = " or ".join(f"contains({spark_name(lowered)}, {spark_str(n)})" for n in rule.needs)
    return f"({guard}) and {test}" if guard else test


def hit(test: str, category: str, rule: R.Rule, confidence: float | None = None) -> Column:
    """The reason a rule gives where `test` holds, else null; SQL text is one call to the JVM, however long."""
    c = rule.confidence if confidence is None else confidence
    return F.expr(
        f"case when {test} then named_struct('category', {spark_str(category)}, 'description', {spark_str(rule.description)}, "
        f"'confidence', {float(c)!r}D, 'source', 'heuristic', 'pattern', {spark_str(rule.pattern)}) end"
    )


def compact(reasons: list[Column]) -> Column:
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast(f"array<{REASON}>")


def decodes_to_text(text: Column) -> Column:
    """Some base64 run of the text decodes, and to at least one printable byte."""
    runs = F.regexp_extract_all(text, F.lit(X.BASE64_RUN), F.lit(0))

    def ok(run: Column) -> Column:
        core = F.rtrim(run, F.lit("="))
        rest = F.length(core) % 4
        pads = F.length(run) - F.length(core)
        whole = (rest == 0) | ((rest == 2) & (pads == 2)) | ((rest == 3) & (pads >= 1))
        padded = F.rpad(core, F.length(core) + (4 - rest) % 4, "=")
        return whole & F.hex(F.try_to_binary(padded, F.lit("base64"))).rlike(r"^(?:..)*?(?:[2-6][0-9A-F]|7[0-9A-E])")

    return F.exists(runs, ok)


# --- rule families of one message --------------------------------------------------------
def direct_injection_rules(lowered: str, case_fix: bool = False) -> list[Column]:
    return [
        hit(f"role != 'system' and {rule_test(r, lowered, lowered, ignore_case=case_fix)}", "direct_injection", r)
        for r in R.DIRECT_INJECTION
    ]


def jailbreak_rules(lowered: str, case_fix: bool = False) -> list[Column]:
    return [hit(rule_test(r, lowered, lowered, ignore_case=case_fix), "jailbreak", r) for r in R.JAILBREAK]


def encoding_rules(text: str, lowered: str) -> list[Column]:
    out = []
    for r in R.ENCODING:
        found = hit(rule_test(r, text, lowered), "encoding_attack", r)
        # the base64 rule must also decode
        out.append(found if r.needs else F.when(found.isNotNull() & decodes_to_text(F.col(text)), found))
    return out


def context_switch_rules(text: str, lowered: str) -> list[Column]:
    return [hit(rule_test(r, text, lowered, multiline=True), "context_switching", r) for r in R.CONTEXT_SWITCHING]


def zero_width_rule(text: Column) -> Column:
    return F.when(
        X.contains_any(text, R.ZERO_WIDTH),
        reason("encoding_attack", "Zero-width or invisible Unicode characters detected", 0.9, "zero_width_chars"),
    )


def role_manipulation_rule(lowered: Column, role: Column) -> Column:
    return F.when(
        (role == "user") & X.contains_any(lowered, R.ROLE_MANIPULATION_PHRASES),
        reason("role_manipulation", "User message contains system-level instructions", 0.85, "role_manipulation_check"),
    )


def prompt_leak_rule(lowered: Column) -> Column:
    return F.when(
        X.contains_any(lowered, R.PROMPT_LEAK_PHRASES),
        reason("prompt_leak", "Attempt to extract system prompt detected", 0.9, "prompt_leak_check"),
    )


FAMILY_NAMES = ["zero_width", "direct", "jailbreak", "encoding", "context", "role_manipulation", "prompt_leak"]


def with_reasons(
    df: DataFrame, families: list[str] | None = None, window: int | None = None, case_fix: bool = False
) -> DataFrame:
    """Adds `reasons`, one per rule that hits the message (columns role, text).

    Whole texts are scanned; `window` limits the lower-cased and encoding families to the
    head and tail of longer texts, as a latency-bound service does.
    """
    families = families or FAMILY_NAMES
    text, role = F.col("text"), F.col("role")
    scanned = X.scan_window(text, window) if window else text
    base = df.withColumn(LOWER, F.lower(text))
    low = F.col(LOWER)
    if window:
        base = base.withColumns({"_scan": scanned, "_scan_lower": F.lower(scanned)})
        scan, scan_low = "_scan", "_scan_lower"
    else:
        scan, scan_low = "text", LOWER
    parts: list[Column] = []
    if "zero_width" in families:
        parts.append(zero_width_rule(text))
    if "direct" in families:
        parts += direct_injection_rules(scan_low, case_fix)
    if "jailbreak" in families:
        parts += jailbreak_rules(scan_low, case_fix)
    if "encoding" in families:
        parts += encoding_rules(scan, scan_low)
    if "context" in families:
        parts += context_switch_rules("text", LOWER)
    if "role_manipulation" in families:
        parts.append(role_manipulation_rule(low, role))
    if "prompt_leak" in families:
        parts.append(prompt_leak_rule(low))
    return computed_once(base.withColumn("reasons", compact(parts)).drop(LOWER, "_scan", "_scan_lower"), "reasons")


# --- scans over the short rule sets -------------------------------------------------------
def scan_keywords() -> list[str]:
    """Words of the short rules; a text with none of them is passed over."""
    found = []
    for rules in R.FAST_RULES.values():
        for r in rules:
            found += [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]{2,}", r.pattern)]
    return sorted(set(found))


def scaled(confidence: float, mode: str) -> float:
    return min(confidence * 1.2, 1.0) if mode == "strict" else confidence * R.MODE_SCALE[mode]


def scan_verdict(confidence: Column, block: float, flag: float) -> Column:
    return F.when(confidence >= block, "block").when(confidence >= flag, "flag").otherwise("allow")


def fast_scan(df: DataFrame, mode: str = "moderate") -> DataFrame:
    """Adds reasons, confidence and verdict; rules in order, up to the first of at least 0.9."""
    base = df.withColumn(LOWER, F.lower("text"))
    low = F.col(LOWER)
    hits = [
        hit(rule_test(r, "text", LOWER, ignore_case=True), R.SCAN_CATEGORY[c], r, scaled(r.confidence, mode))
        for c, rules in R.FAST_RULES.items() for r in rules
    ]
    found = base.withColumn("_hits", F.when(X.contains_any(low, scan_keywords()), compact(hits)))
    all_hits = F.coalesce(F.col("_hits"), F.array().cast(f"array<{REASON}>"))
    # position of the first strong hit; everything after it is not looked at
    strong = F.array_position(F.transform(all_hits, lambda h: h["confidence"] >= 0.9), F.lit(True)).cast("int")
    kept = F.when(strong > 0, F.slice(all_hits, 1, strong)).otherwise(all_hits)
    out = computed_once(found.withColumn("reasons", kept).drop(LOWER, "_hits"), "reasons")
    confidence = F.coalesce(F.array_max(F.transform("reasons", lambda h: h["confidence"])), F.lit(0.0))
    return (
        out.withColumn("confidence", confidence)
        .withColumn("verdict", scan_verdict(F.col("confidence"), 0.7, 0.4))
    )


def adaptive_hits(text: str, lowered: str, mode: str = "moderate") -> list[Column]:
    """struct(rule_id, category, confidence) per hit of the 28 rules."""
    return [
        F.expr(
            f"case when {rule_test(r, text, lowered, ignore_case=True)} then named_struct('rule_id', {spark_str(rid)}, "
            f"'category', {spark_str(R.SCAN_CATEGORY[c])}, 'confidence', {float(scaled(r.confidence, mode))!r}D) end"
        )
        for rid, c, r in R.adaptive_rules()
    ]


def adaptive_scan(df: DataFrame, mode: str = "moderate") -> DataFrame:
    """Adds hits, confidence, verdict and context of a one-text-per-row table."""
    base = df.withColumn(LOWER, F.lower("text"))
    hits = F.array_compact(F.array(*adaptive_hits("text", LOWER, mode)))
    out = computed_once(base.withColumn("hits", hits), "hits").withColumn(
        "confidence", F.coalesce(F.array_max(F.transform("hits", lambda h: h["confidence"])), F.lit(0.0))
    )
    block, flag = R.ADAPTIVE_THRESHOLDS[mode]
    return (
        out.withColumn("verdict", scan_verdict(F.col("confidence"), block, flag))
        .withColumn("context", context_label(F.col(LOWER), F.lit(1)))
        .drop(LOWER)
    )


def context_label(lowered: Column, n_messages: Column) -> Column:
    out = None
    for label, words in R.CONTEXT_WORDS.items():
        test = X.contains_any(lowered, words)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.when(n_messages > 1, "conversation").otherwise("general")


def conversation_context(messages: DataFrame) -> DataFrame:
    """Label per conversation from flags of its messages; the texts are not joined."""
    low = F.lower("text")
    flags = messages.select(
        "conv_id", *[X.contains_any(low, words).alias(label) for label, words in R.CONTEXT_WORDS.items()]
    )
    per = flags.groupBy("conv_id").agg(F.count("*").alias("n"), *[F.bool_or(c).alias(c) for c in R.CONTEXT_WORDS])
    out = None
    for label in R.CONTEXT_WORDS:
        out = F.when(F.col(label), label) if out is None else out.when(F.col(label), label)
    return per.select("conv_id", out.when(F.col("n") > 1, "conversation").otherwise("general").alias("context"))


# --- structure of conversations -----------------------------------------------------------
def role_confusion(messages: DataFrame) -> DataFrame:
    """Adds `issues`: rule texts that hit a user message, plus role labels in any message."""
    low = F.lower("text")
    user = F.col("role") == "user"
    tests = [F.when(user & X.has(low, p), F.lit(p)) for p in R.ROLE_CONFUSION]
    labels = F.when(X.contains_any(low, ["system:", "user:", "assistant:"]), F.lit("role_indicators"))
    return messages.withColumn("issues", F.array_compact(F.array(*tests, labels)))


def role_separation(messages: DataFrame) -> DataFrame:
    """One row per conversation: has_system, has_user, properly_formatted and what to improve."""
    is_system, is_user = F.col("role") == "system", F.col("role") == "user"
    g = messages.groupBy("conv_id").agg(
        F.count_if(is_system).alias("n_system"), F.count_if(is_user).alias("n_user"),
        F.max(F.when(is_system, F.col("turn"))).alias("last_system"),
        F.min(F.when(is_user, F.col("turn"))).alias("first_user"), F.count("*").alias("n_messages"),
    )
    has_s, has_u = F.col("n_system") > 0, F.col("n_user") > 0
    late = F.coalesce(F.col("last_system") > F.col("first_user"), F.lit(False))
    issues = F.when(~has_s & ~has_u, F.array(F.lit("No role separation detected"))).otherwise(
        F.array_compact(F.array(
            F.when(~has_s, "No system prompt found"),
            F.when(late, "System prompts appear after user prompts"),
            F.when(F.col("n_system") > 1, "Multiple system prompts detected"),
        ))
    )
    return g.select(
        "conv_id", "n_messages", has_s.alias("has_system"), has_u.alias("has_user"),
        (has_s & has_u & ~late).alias("properly_formatted"), issues.alias("issues"),
    )


def segments_by_role(messages: DataFrame, slice_turns: int = 1000) -> DataFrame:
    """Texts of a conversation by role, in order, one row each: (conv_id, role, position, text).

    Kept long instead of as one array per conversation, so that no conversation has to fit
    into a row; positions are counted per slice of turns.
    """
    from rampart.operators.slices import running_totals

    kept = messages.filter(F.col("role").isin("system", "user", "assistant")).select("conv_id", "role", "turn", "text")
    return running_totals(
        kept, ["conv_id", "role"], F.floor(F.col("turn") / slice_turns), ["turn"], {"position": F.lit(1).cast("long")}
    ).select("conv_id", "role", "position", "text")


# --- simple classifiers and request checks -------------------------------------------------
def simple_classifier(df: DataFrame) -> DataFrame:
    low = F.lower("text")
    score = (
        F.when(low.contains("ignore all") | low.contains("disregard"), 0.9)
        .when(X.contains_any(low, ["ignore", "override", "system", "prompt"]), 0.7)
        .otherwise(0.2)
    )
    factors = F.array_compact(F.array(*[
        F.when(low.contains(w), f"Contains '{w}' keyword") for w in ("ignore", "system", "override")
    ]))
    return df.withColumns({"score": score, "is_injection": score > 0.5, "factors": factors})


def request_checks(df: DataFrame) -> DataFrame:
    """Adds `failed`: names of the checks a request (method, path, content_type, content_length,
    header_length, text) does not pass."""
    c = F.col
    text = c("text")
    # the longest line is found from the breaks, without splitting the text
    longest = F.array_max(F.transform(F.split(text, "\n", -1), F.length))
    kinds = ["application/json", "application/x-www-form-urlencoded", "multipart/form-data"]
    media = reduce(lambda a, b: a | b, [c("content_type").startswith(k) for k in kinds])
    endings = reduce(lambda a, b: a | b, [c("path").endswith(e) for e in R.BAD_EXTENSIONS])
    sql = reduce(lambda a, b: a | b, [X.has(text, p, ignore_case=True) for p in R.SQL_ABUSE])
    checks = {
        "too_large": c("content_length") > 10_000_000,
        "unsupported_media": c("method").isin("POST", "PUT", "PATCH") & ~media,
        "header_too_long": c("header_length") > 4096,
        "path_traversal": c("path").contains("..") | c("path").contains("//"),
        "bad_extension": endings,
        "control_characters": text.rlike(r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"),
        "line_too_long": longest > 10000,
        "dangerous_sql": sql,
    }
    return df.withColumn("failed", F.array_compact(F.array(*[F.when(t, n) for n, t in checks.items()])))


def batch_checks(items: DataFrame, mode: str | None = None) -> DataFrame:
    """One row per batch (batch_id, item_id, text): errors, warnings, estimated time."""
    per_id = items.groupBy("batch_id", "item_id").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty")
    )
    g = per_id.groupBy("batch_id").agg(
        F.sum("n").alias("item_count"), F.max("n").alias("copies"), F.sum("empty").alias("empty_items")
    )
    bad_mode = F.lit(mode is not None and mode not in R.MODE_SHIFT)
    errors = F.array_compact(F.array(
        F.when(F.col("copies") > 1, "Duplicate item IDs found"), F.when(bad_mode, "Invalid detection_mode in config")
    ))
    warnings = F.array_compact(F.array(
        F.when(F.col("empty_items") > 0, "Empty content in items"), F.when(F.col("item_count") > 50, "Large batch size")
    ))
    return g.select(
        "batch_id", "item_count", (F.col("item_count") * 50).alias("estimated_time_ms"), "empty_items",
        errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("valid"),
    )
