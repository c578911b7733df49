"""From reasons to verdicts: scoring, combination, the whole detection, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions import rule_tables as R
from rampart.functions import text as X
from rampart.functions.repeats import repeats_a_block
from rampart.operators import pii as P
from rampart.operators import rules


def by_name(mapping: dict, key: Column, default=None) -> Column:
    """Value of a small fixed mapping, as a literal CASE."""
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity(verdict: Column) -> Column:
    return by_name(R.SEVERITY, verdict, 1)


def verdict_of(rank: Column) -> Column:
    return by_name({v: k for k, v in R.SEVERITY.items()}, rank, "allow")


def mode_verdict(confidence: Column, n_reasons: Column, mode: str) -> Column:
    block, strip, flag = R.MODE_THRESHOLDS.get(mode, R.MODE_THRESHOLDS["moderate"])
    return (
        F.when(n_reasons == 0, "allow").when(confidence >= block, "block")
        .when(confidence >= strip, "strip").when(confidence >= flag, "flag").otherwise("allow")
    )


def max_confidence(reasons: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(reasons, lambda r: r["confidence"])), F.lit(0.0))


def heuristic_verdict(messages: DataFrame, mode: str = "moderate", **options) -> DataFrame:
    """Per conversation: strongest reason less the mode's shift, and the verdict it gives.

    Only two numbers per message reach the shuffle; they are combined before it.
    """
    scored = rules.with_reasons(messages, **options).select(
        "conv_id", max_confidence(F.col("reasons")).alias("c"), F.size("reasons").alias("n")
    )
    g = scored.groupBy("conv_id").agg(F.max("c").alias("c"), F.sum("n").alias("n_reasons"))
    confidence = F.greatest(F.lit(0.0), F.col("c") - R.MODE_SHIFT.get(mode, 0.0))
    return g.select(
        "conv_id", "n_reasons", confidence.alias("confidence"), mode_verdict(confidence, F.col("n_reasons"), mode).alias("verdict")
    )


def combine_columns(verdicts: list[Column], confidences: list[Column], agree: tuple[Column, Column] | None) -> tuple[Column, Column]:
    """(verdict, confidence): mean of the non-zero confidences, the most severe verdict,
    one step down if the mean is low."""
    positive = [F.when(c > 0, c).otherwise(0.0) for c in confidences]
    n = reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in confidences])
    mean = F.when(n > 0, reduce(lambda a, b: a + b, positive) / n).otherwise(0.0)
    if agree is not None:
        mean = F.when((agree[0] != "allow") & (agree[0] == agree[1]), F.least(F.lit(1.0), mean * 1.15)).otherwise(mean)
    ranks = [severity(v) for v in verdicts]
    worst = verdict_of(F.greatest(*ranks) if len(ranks) > 1 else ranks[0])
    low = mean < R.CONFIDENCE_THRESHOLD
    lowered = F.when(low & (worst == "block"), "strip").when(low & (worst == "strip"), "flag").otherwise(worst)
    return lowered, mean


def combine_verdicts(df: DataFrame) -> DataFrame:
    """Adds verdict and confidence from heuristic_/model_/pii_verdict and the confidences
    heuristic_confidence, model_confidence, threat_confidence (null or 0: not given)."""
    zero = F.lit(0.0)
    conf = [
        F.coalesce(F.col(c), zero) if c in df.columns else zero
        for c in ("heuristic_confidence", "model_confidence", "threat_confidence")
    ]
    v = [
        F.coalesce(F.col(c), F.lit("allow")) if c in df.columns else F.lit("allow")
        for c in ("heuristic_verdict", "model_verdict", "pii_verdict")
    ]
    verdict, confidence = combine_columns(v, conf, (v[0], v[1]))
    return df.withColumn("confidence", confidence).withColumn("verdict", verdict)


def pii_verdict(n_reported: Column, mode: str) -> Column:
    """`mode` is the redaction mode: reject, pass-silent, pass-alert, or one that redacts."""
    found = {"reject": "block", "pass-silent": "allow", "pass-alert": "allow"}.get(mode, "redact")
    return F.when(n_reported > 0, found).otherwise("allow")


def detect(
    messages: DataFrame,
    mode: str = "moderate",
    heuristics: bool = True,
    pii: bool = True,
    answers: DataFrame | None = None,
    threats: DataFrame | None = None,
    redaction: str = "mask",
    pii_threshold: float = 0.7,
    pii_reject_hard: bool = False,
    **options,
) -> DataFrame:
    """The whole detection, one row per conversation.

    `answers` (conv_id, model_verdict, model_confidence) and `threats` (conv_id,
    threat_confidence) are stored results of other detectors.  One shuffle on conv_id: rules
    and personal data are evaluated in the scan stage and only counters are exchanged.
    """
    if not heuristics and not pii and answers is None:
        return messages.groupBy("conv_id").agg(F.count("*").alias("message_count")).select(
            "conv_id", "message_count", F.lit("allow").alias("verdict"), F.lit(0.0).alias("confidence"),
            F.lit("benign").alias("category"),
        )
    rows = rules.with_reasons(messages, **options) if heuristics else messages.withColumn("reasons", rules.compact([]))
    rows = rows.select(
        "conv_id", "turn", "role", max_confidence(F.col("reasons")).alias("c"), F.size("reasons").alias("n"),
        *([P.reported_confidences("text", pii_threshold).alias("p")] if pii else []),
    )
    is_system, is_user = F.col("role") == "system", F.col("role") == "user"
    g = rows.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.max("c").alias("c"), F.sum("n").alias("n_rules"),
        F.sum(F.size("p") if pii else F.lit(0)).alias("pii_count"),
        F.max(F.array_max("p") if pii else F.lit(None).cast("double")).alias("pii_max"),
        F.count_if(is_system).alias("ns"), F.count_if(is_user).alias("nu"),
        F.max(F.when(is_system, F.col("turn"))).alias("ls"), F.min(F.when(is_user, F.col("turn"))).alias("fu"),
    )
    confidence = F.greatest(F.lit(0.0), F.col("c") - R.MODE_SHIFT.get(mode, 0.0)) if heuristics else F.lit(0.0)
    late = F.coalesce(F.col("ls") > F.col("fu"), F.lit(False))
    parts = g.select(
        "conv_id", "message_count", "pii_count",
        (F.col("n_rules") + F.when(F.col("pii_count") > 0, 1).otherwise(0)).alias("n_reasons"),
        confidence.alias("heuristic_confidence"),
        (mode_verdict(confidence, F.col("n_rules"), mode) if heuristics else F.lit("allow")).alias("heuristic_verdict"),
        pii_verdict(F.col("pii_count"), redaction).alias("pii_verdict"),
        F.col("pii_max").alias("pii_confidence"),
        # no recommendation at all: a system prompt, only one, and before the user
        ((F.col("ns") == 1) & ~late).alias("format_valid"),
    )
    if answers is not None:
        parts = parts.join(answers, "conv_id", "left")
    if threats is not None:
        parts = parts.join(threats, "conv_id", "left")
    out = combine_verdicts(parts)
    if pii_reject_hard:
        out = out.withColumn("verdict", F.when(F.col("pii_verdict") == "block", "block").otherwise(F.col("verdict")))
    return out


def rewrite(messages: DataFrame, verdicts: DataFrame, redaction: str = "mask", **options) -> DataFrame:
    """Adds `modified`: the sanitised text where the verdict is strip, the redacted one where it
    is redact, else null.  Rows stay messages, so no conversation is put together."""
    scored = rules.with_reasons(messages, **options).withColumn("_c", max_confidence(F.col("reasons"))).drop("reasons")
    worst = scored.groupBy("conv_id").agg(F.max("_c").alias("_worst"))
    joined = scored.drop("_c").join(
        verdicts.filter(F.col("verdict").isin("strip", "redact")).select("conv_id", "verdict").join(worst, "conv_id"),
        "conv_id", "left",
    )
    aggressive = F.coalesce(F.col("_worst") > 0.8, F.lit(False))
    modified = F.when(F.col("verdict") == "strip", X.sanitize("text", aggressive)).when(
        F.col("verdict") == "redact", P.redact("text", redaction)
    )
    return joined.withColumn("modified", modified).drop("_worst")


def batch_statistics(results: DataFrame) -> DataFrame:
    """One row over results (verdict, confidence, time_ms, error, cache_hit)."""
    ok = F.col("error").isNull()
    counts = [F.count_if(ok & (F.col("verdict") == v)).alias(f"n_{v}") for v in R.SEVERITY]
    return results.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.min("time_ms").alias("min_time_ms"), F.avg("time_ms").alias("avg_time_ms"), F.max("time_ms").alias("max_time_ms"),
        F.avg(F.when(ok, F.col("confidence"))).alias("avg_confidence"),
        F.coalesce(F.try_divide(F.count_if(ok & F.col("cache_hit")), F.count_if(ok)), F.lit(0.0)).alias("cache_hit_rate"),
        *counts,
    )


def analyze(messages: DataFrame, mode: str = "moderate", redaction: str = "mask", **options) -> DataFrame:
    """Every message judged on its own: (conv_id, turn, role, verdict, confidence, n_reasons)."""
    scored = rules.with_reasons(messages, **options).select(
        "conv_id", "turn", "role", max_confidence(F.col("reasons")).alias("c"), F.size("reasons").alias("n"),
        F.size(P.reported_confidences("text", 0.7)).alias("p"),
    )
    h = F.greatest(F.lit(0.0), F.col("c") - R.MODE_SHIFT[mode])
    parts = scored.select(
        "conv_id", "turn", "role", (F.col("n") + F.when(F.col("p") > 0, 1).otherwise(0)).alias("n_reasons"),
        h.alias("heuristic_confidence"), mode_verdict(h, F.col("n"), mode).alias("heuristic_verdict"),
        pii_verdict(F.col("p"), redaction).alias("pii_verdict"),
    )
    return combine_verdicts(parts).select("conv_id", "turn", "role", "n_reasons", "verdict", "confidence")


def overall_risk(analysis: DataFrame, messages: DataFrame) -> DataFrame:
    """Per conversation: highest message confidence and the format flags."""
    risk = analysis.groupBy("conv_id").agg(F.max("confidence").alias("overall_risk"))
    fmt = rules.role_separation(messages).select("conv_id", "properly_formatted", "has_system", "has_user")
    return risk.join(fmt, "conv_id")


def risk_assessment(verdicts: DataFrame, reasons: DataFrame) -> DataFrame:
    """Threat level by verdict, mean confidence per source, suggestions by category.

    `reasons` is long: (conv_id, category, source, confidence)."""
    per = reasons.groupBy("conv_id").agg(
        F.avg(F.when(F.col("source") == "heuristic", F.col("confidence"))).alias("heuristic_mean"),
        F.avg(F.when(F.col("source") == "llm", F.col("confidence"))).alias("model_mean"),
        F.bool_or(F.col("category") == "direct_injection").alias("i"),
        F.bool_or(F.col("category") == "jailbreak").alias("j"),
        F.bool_or(F.col("category") == "pii_detected").alias("p"),
    )
    named = F.array_compact(F.array(
        F.when(F.col("i"), "Use strict role separation between system and user messages"),
        F.when(F.col("j"), "Implement additional context validation"),
        F.when(F.col("p"), "Enable automatic PII redaction before processing"),
    ))
    suggestions = F.when(
        F.size(named) > 0, named
    ).otherwise(F.array(F.lit("Consider reviewing prompt content for security best practices")))
    level = by_name({"block": "high", "strip": "medium", "flag": "low"}, F.col("verdict"), "none")
    return verdicts.join(per, "conv_id", "left").select(
        "conv_id", "verdict", level.alias("threat_level"), "heuristic_mean", "model_mean", suggestions.alias("suggestions")
    )


def class_verdict(category: Column, confidence: Column) -> Column:
    """Verdict of a model answer by the class of its category."""
    high = category.isin("direct_injection", "jailbreak", "prompt_leak")
    medium = category.isin("indirect_injection", "role_manipulation", "context_switching")

    def steps(block: str, strip: str, rest: str, a: float, b: float) -> Column:
        return F.when(confidence >= a, block).when(confidence >= b, strip).otherwise(rest)

    return (
        F.when(category == "benign", "allow")
        .when(high, steps("block", "strip", "flag", 0.7, 0.5))
        .when(medium, steps("block", "strip", "flag", 0.8, 0.6))
        .otherwise(steps("strip", "flag", "allow", 0.9, 0.7))
    )


def consensus(answers: DataFrame, key: str) -> DataFrame:
    """Several answers per prompt (category, confidence) to one: all mergeable aggregates."""
    rank = by_name({c: i for i, c in enumerate(R.CATEGORY_SEVERITY)}, F.col("category"), 7)
    g = answers.groupBy(key).agg(
        F.avg("confidence").alias("m"), F.min("category").alias("a"), F.max("category").alias("b"),
        F.min(rank).alias("r"), F.count("*").alias("n_answers"),
    )
    agreed = (F.col("a") == F.col("b")) & (F.col("a") != "benign")
    confidence = F.when(agreed, F.least(F.lit(1.0), F.col("m") * 1.2)).otherwise(F.col("m"))
    category = by_name(dict(enumerate(R.CATEGORY_SEVERITY)), F.col("r"), "benign")
    return g.select(
        key, "n_answers", category.alias("category"), confidence.alias("confidence"),
        class_verdict(category, confidence).alias("verdict"),
    )


def failover_pick(answers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First provider in `order` that answered (success, category, confidence)."""
    rank = by_name({p: i for i, p in enumerate(order)}, F.col("provider"), len(order))
    return (
        answers.filter("success")
        .groupBy(key)
        .agg(F.min_by(F.struct("provider", "category", "confidence"), F.struct(rank, F.col("provider"))).alias("pick"))
        .select(key, "pick.*")
    )


def full_analysis(runs: list[DataFrame], keep_all: bool = True) -> DataFrame:
    """Union of separate runs (conv_id, verdict, confidence): highest confidence, worst verdict.

    With keep_all=False only block and flag count, as a parity option."""
    united = reduce(lambda a, b: a.unionByName(b), [r.select("conv_id", "verdict", "confidence") for r in runs])
    v = F.col("verdict")
    rank = severity(v) if keep_all else F.when(v.isin("block", "flag"), severity(v)).otherwise(1)
    return united.groupBy("conv_id").agg(F.max("confidence").alias("confidence"), F.max(rank).alias("r")).select(
        "conv_id", "confidence", verdict_of(F.col("r")).alias("verdict")
    )


# --- complexity and routing ---------------------------------------------------------------
def _message_measures(df: DataFrame) -> DataFrame:
    t = F.col("text")
    base = df.withColumn("_low", F.lower(t))
    low = F.col("_low")
    runs = F.regexp_extract_all(t, F.lit(X.BASE64_RUN), F.lit(0))
    user = F.col("role") == "user"
    pairs = {
        "non_ascii": t.rlike(r"[^\x00-\x7F]"), "control": t.rlike(r"[\x00-\x1F\x7F]"),
        "template": t.contains("{{") & X.has(t, r"{{.*?}}"), "variable": t.contains("${") & X.has(t, r"\${.*?}"),
        "backtick": t.contains("`") & X.has(t, r"`.*?`"),
        "hex": t.contains("\\x") & X.has(t, r"(?:\\x[0-9a-fA-F]{2}){3,}"),
        "uni": t.contains("\\u") & X.has(t, r"(?:\\u[0-9a-fA-F]{4}){3,}"),
        "url": t.contains("%") & X.has(t, r"(?:%[0-9a-fA-F]{2}){3,}"),
        "zero_width": X.contains_any(t, R.ZERO_WIDTH[:4]), "blanks": X.has(t, r"\s{10,}"),
        "mixed_case": t.rlike(r"(?:[a-z][A-Z]|[A-Z][a-z]){5,}"),
        "repeats": repeats_a_block(t),
        "s_latin": t.rlike("[a-zA-Z]"), "s_chinese": t.rlike("[一-鿿]"), "s_cyrillic": t.rlike("[Ѐ-ӿ]"),
        "s_arabic": t.rlike("[؀-ۿ]"), "s_japanese": t.rlike("[぀-ゟ゠-ヿ]"),
        "system_in_user": user & X.contains_any(low, ["system:", "[system]", "<system>"]),
    }
    override_words = ["ignore", "disregard", "forget", "new", "actually"]
    flags = dict(pairs)
    for i, (p, w) in enumerate(zip(R.OVERRIDE_RULES, override_words)):
        flags[f"o{i}"] = low.contains(w) & X.has(t, p, ignore_case=True)
    code_words = ["<script", "javascript:", "eval", "exec", "system", "import", "require"]
    for i, (p, w) in enumerate(zip(R.CODE_INJECTION_RULES, code_words)):
        flags[f"c{i}"] = low.contains(w) & X.has(t, p, ignore_case=True)
    return base.select(
        *[c for c in df.columns if c != "text"],
        F.length(t).alias("n_chars"), F.size(X.words(t)).alias("n_words"),
        F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s\x{A0}]", "")).alias("n_special"),
        F.size(runs).alias("n_b64"), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).alias("max_b64"),
        F.when(user, X.flag_count([low.contains(w) for w in R.ROLE_WORDS])).otherwise(0).alias("role_hits"),
        *[c.alias(n) for n, c in flags.items()],
    )


def _scored(m: DataFrame, keep: list[str]) -> DataFrame:
    c = F.col
    one = lambda x: F.least(F.lit(1.0), x)
    as_int = lambda x: c(x).cast("int")
    n = c("n_chars")
    length = (
        F.when(n < 100, 0.1).when(n < 500, 0.3).when(n < 1000, 0.5).when(n < 5000, 0.7)
        .otherwise(one(F.lit(0.7) + (n - 5000) / 10000))
    )
    length = F.when(n / F.greatest(c("n_words"), F.lit(1)) > 10, one(length * 1.2)).otherwise(length)
    boosts = X.flag_count([c(x) for x in ("non_ascii", "control", "template", "variable", "backtick")])
    special = F.when(n == 0, 0.0).otherwise(one(one(c("n_special") / n * 3) + boosts * 0.1))
    obfuscated = c("zero_width") | c("blanks") | c("mixed_case")
    encoding = one(
        F.least(c("n_b64"), F.lit(3)) * 0.3 + as_int("hex") * 0.3 + as_int("uni") * 0.2 + as_int("url") * 0.2
        + obfuscated.cast("int") * 0.3
    )
    overrides = X.flag_count([c(f"o{i}") for i in range(5)])
    code = X.flag_count([c(f"c{i}") for i in range(7)])
    pattern = one(F.least(overrides, F.lit(2)) * 0.4 + F.least(code, F.lit(3)) * 0.3 + as_int("repeats") * 0.2)
    scripts = X.flag_count([c(f"s_{s}") for s in ("latin", "chinese", "cyrillic", "arabic", "japanese")])
    many = F.when(c("n_messages") > 5, F.least((c("n_messages") - 5) / 5, F.lit(0.3)) * 0.1).otherwise(0.0)
    semantic = one(
        c("role_score") + F.when(scripts > 1, 0.2).otherwise(0.0) + many + as_int("system_in_user") * 0.3
    )
    scores = m.select(
        *keep, length.alias("length_score"), special.alias("special_char_score"), encoding.alias("encoding_score"),
        pattern.alias("pattern_score"), semantic.alias("semantic_score"),
        F.array_compact(F.array(
            F.when((c("n_b64") > 2) | (c("max_b64") > 100) | c("hex") | c("uni") | c("url"), "encoding"),
            F.when(obfuscated, "obfuscation"), F.when(overrides > 0, "instruction_override"),
            F.when(code > 0, "code_injection"), F.when(c("repeats"), "unusual_patterns"),
            F.when((c("role_score") > 0) | c("system_in_user"), "role_manipulation"),
            F.when(scripts > 1, "multi_language"), F.when(length > 0.8, "excessive_length"),
        )).alias("risks"),
    )
    total = reduce(lambda a, b: a + b, [c(k) * w for k, w in R.FACTOR_WEIGHTS.items()])
    critical = F.arrays_overlap("risks", F.array(*[F.lit(x) for x in R.CRITICAL_RISKS]))
    scored = scores.withColumn("critical", critical).withColumn(
        "score", F.when(F.col("critical"), one(total * 1.3)).otherwise(total)
    )
    level = None
    for name, below in R.COMPLEXITY_LEVELS:
        t = F.col("score") < below
        level = F.when(t, name) if level is None else level.when(t, name)
    return scored.withColumn("level", level.otherwise("critical"))


def complexity_score(messages: DataFrame, single: bool = False) -> DataFrame:
    """Scores, risks and level per conv_id.

    `single`: each conversation is one row, so nothing is shuffled.  Otherwise the measures of
    the messages are added up or or-ed; the texts are never joined into one.
    """
    m = _message_measures(messages.select("conv_id", "role", "text"))
    role_score = F.least(F.col("role_hits"), F.lit(2)) * 0.3
    if single:
        return _scored(m.withColumns({"role_score": role_score, "n_messages": F.lit(1)}), ["conv_id"])
    flags = [n for n, t in m.dtypes if t == "boolean"]
    g = m.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), (F.sum("n_chars") + F.count("*") - 1).alias("n_chars"),
        F.sum("n_words").alias("n_words"), F.sum("n_special").alias("n_special"), F.sum("n_b64").alias("n_b64"),
        F.max("max_b64").alias("max_b64"), F.sum(role_score).alias("role_score"),
        *[F.bool_or(x).alias(x) for x in flags],
    )
    return _scored(g, ["conv_id"])


def route(
    scored: DataFrame, performance_mode: bool = False, model: bool = True, pii: bool = True,
    by_rank: bool = True, cache: bool = True,
) -> DataFrame:
    """Adds strategy, target latency and cache eligibility.

    `by_rank` compares strategies by cost; False compares their names, as a parity option."""
    level = F.col("level")
    if performance_mode:
        strategy = by_name(
            {"trivial": "heuristic_only", "simple": "heuristic_cached", "moderate": "heuristic_llm_cached"}, level, "heuristic_llm_pii"
        )
    else:
        base = by_name({
            "trivial": "heuristic_cached", "simple": "heuristic_cached", "moderate": "heuristic_llm_cached",
            "complex": "heuristic_llm_pii",
        }, level, "full_analysis")
        rank = by_name({s: i for i, s in enumerate(R.STRATEGY_LATENCY)}, base, 0)
        below = rank < list(R.STRATEGY_LATENCY).index("heuristic_llm_pii") if by_rank else base < F.lit("heuristic_llm_pii")
        elevated = F.col("critical") & below
        plain = base
        if not model:
            plain = F.when(base.isin("heuristic_llm_cached", "heuristic_llm_pii", "full_analysis"), "heuristic_only").otherwise(base)
        elif not pii:
            plain = F.when(base == "heuristic_llm_pii", "heuristic_llm_cached").otherwise(base)
        strategy = F.when(elevated, "heuristic_llm_pii").otherwise(plain)
    out = scored.withColumn("strategy", strategy)
    eligible = (
        F.col("strategy").isin("heuristic_cached", "heuristic_llm_cached", "heuristic_llm_pii")
        & ~F.array_contains("risks", "encoding")
    ) if cache else F.lit(False)
    return out.withColumns({
        "target_ms": by_name(R.STRATEGY_LATENCY, F.col("strategy"), 2000), "cache_eligible": eligible,
    })


def routing_metrics(routed: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Counts, mean latency and share by strategy and level; shares over a handful of groups."""
    from pyspark.sql import Window

    g = routed.groupBy("strategy", "level").agg(
        F.count("*").alias("n"), F.avg(latency).alias("avg_latency_ms"), F.avg("score").alias("avg_score")
    )
    return g.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def strategy_comparison(messages: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Verdict and confidence of each strategy on the same conversations, side by side.

    The rules are evaluated once; the strategies only differ in which parts they combine."""
    base = detect(messages, answers=answers)
    model_v = F.coalesce(F.col("model_verdict"), F.lit("allow")) if answers is not None else F.lit("allow")
    model_c = F.coalesce(F.col("model_confidence"), F.lit(0.0)) if answers is not None else F.lit(0.0)
    h_v, h_c, p_v = F.col("heuristic_verdict"), F.col("heuristic_confidence"), F.col("pii_verdict")
    allow = F.lit("allow")
    full_rank = F.greatest(
        severity(combine_columns([h_v], [h_c], None)[0]), severity(combine_columns([model_v], [model_c], None)[0]), severity(p_v)
    )
    heuristic = combine_columns([h_v, allow, allow], [h_c], None)
    modelled = combine_columns([h_v, model_v, allow], [h_c, model_c], (h_v, model_v))
    everything = combine_columns([h_v, model_v, p_v], [h_c, model_c], (h_v, model_v))
    variants = {
        "heuristic_only": heuristic, "heuristic_cached": heuristic, "heuristic_llm_cached": modelled,
        "heuristic_llm_pii": everything, "full_analysis": (verdict_of(full_rank), F.greatest(h_c, model_c)),
    }
    return base.select("conv_id", *[
        c.alias(f"{s}_{part}") for s, pair in variants.items() for part, c in zip(("verdict", "confidence"), pair)
    ])


def format_assist(prompts: DataFrame, intent: str = "intent") -> DataFrame:
    """Adds the system prompt for the intent and the formatting recommendations."""
    known = by_name(R.INTENT_PROMPTS, F.col(intent), R.INTENT_PROMPTS["general"])
    system = F.when(F.col(intent).isNull() | (F.col(intent) == ""), R.NO_INTENT_PROMPT).otherwise(known)
    m = X.complexity_metrics("text")
    low = F.lower("text")
    confused = reduce(lambda a, b: a | b, [X.has(low, p) for p in R.ROLE_CONFUSION]) | X.contains_any(
        low, ["system:", "user:", "assistant:"]
    )
    advice = F.array_compact(F.array(
        F.when(m["special_char_ratio"] > 0.3, "High special character ratio"),
        F.when(m["has_base64"] | m["has_hex"], "Encoded content detected"),
        F.when(confused, "Potential role confusion"),
    ))
    return prompts.withColumns({"system_prompt": system, "recommendations": advice})


def detect_once(messages: DataFrame, key: str, **options) -> DataFrame:
    """Scores each distinct (role, text) once and gives every copy the result.

    A copied prompt may hold a third of the rows: the distinct step combines copies before the
    shuffle, and the join back is on a key with one row per prompt on the scored side, which
    adaptive skew handling splits.  `cache_hit` is true for every copy but the first.
    """
    keyed = messages.withColumn("_key", F.sha2(F.concat("role", F.lit(":"), "text"), 256))  # whole, or prompts would collide
    unique = keyed.groupBy("_key").agg(
        F.min(key).alias("_first"), F.first("role").alias("role"), F.first("text").alias("text")
    )
    scored = rules.with_reasons(unique, **options).select(
        "_key", "_first", F.size("reasons").alias("n_reasons"), max_confidence(F.col("reasons")).alias("confidence")
    )
    return keyed.select(key, "_key").join(scored, "_key").select(
        key, F.substring("_key", 1, 16).alias("content_key"), "n_reasons", "confidence", (F.col(key) != F.col("_first")).alias("cache_hit")
    )


def message_statistics(messages: DataFrame, mode: str = "moderate") -> DataFrame:
    checked = {"direct": len(R.DIRECT_INJECTION), "jailbreak": len(R.JAILBREAK), "encoding": len(R.ENCODING), "context": len(R.CONTEXT_SWITCHING)}
    return messages.groupBy("role").agg(F.count("*").alias("n_messages")).select(
        "role", "n_messages", F.lit(mode).alias("mode"), *[F.lit(v).alias(f"rules_{k}") for k, v in checked.items()]
    )
