"""Column expressions over text.  All of them stay inside the JVM except NFKC and counts of characters and n-grams."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions import rule_tables as T
from rampart.functions.regexes import java_regex, spark_str

BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"
WORD = java_regex(r"\S+")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(text: Column, pattern: str, **flags: bool) -> Column:
    return text.rlike(java_regex(pattern, **flags))


def occurrences(text: Column, pattern: str, **flags: bool) -> Column:
    return F.regexp_count(text, F.lit(java_regex(pattern, **flags)))


def literal_count(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal, without a regular expression."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (gone / len(literal)).cast("int")


def contains_any(lowered: Column, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def flag_count(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def characters(text: Column) -> Column:
    """One array element per code point (a plain split would cut surrogate pairs)."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


# --- cleaning --------------------------------------------------------------------------
ENCODED_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
# fixed values: content a browser would run
ACTIVE_CONTENT = (r"<script[^>]*>.*?</script>", r"javascript:.*?(?=\s|$)", r"data:text/html.*?(?=\s|$)")


def sanitize(text: Column | str, aggressive: bool | Column = False) -> Column:
    t = F.regexp_replace(col(text), r"\\x[0-9a-fA-F]{2}", "")
    t = F.regexp_replace(t, r"\\u[0-9a-fA-F]{4}", "")
    strict = F.regexp_replace(t, ENCODED_RUN, "[REMOVED_ENCODING]")
    if isinstance(aggressive, Column):
        t = F.when(aggressive, strict).otherwise(t)
    elif aggressive:
        t = strict
    for pattern in ACTIVE_CONTENT:
        t = F.regexp_replace(t, java_regex(pattern, ignore_case=True, dotall=True), "[REMOVED]")
    t = F.regexp_replace(t, java_regex(r"\s{10,}"), " ")
    t = F.translate(t, "".join(T.ZERO_WIDTH[:4]), "")
    return F.regexp_replace(t, java_regex(r"^\s+|\s+\z"), "")


def scan_window(text: Column | str, n: int = 5000) -> Column:
    """Head and tail of a long text, the form a time-limited scan looks at."""
    t = col(text)
    return F.when(
        F.length(t) > 2 * n, F.concat(F.left(t, F.lit(n)), F.lit(" ... "), F.right(t, F.lit(n)))
    ).otherwise(t)


# NFKC has no built-in function.  Only rows that can change are sent to Python: the
# argument is null for pure ASCII text.
def _nfkc_udf():
    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC")

    return nfkc


# fixed values: look-alike letters and the Latin letter each stands for
HOMOGLYPHS = [
    ("аеорсух", "aeopcyx"),                       # Cyrillic, small
    ("АВЕКМНОРСТУХ", "ABEKMHOPCTYX"),             # Cyrillic, capital
    ("０１２３４５６７８９", "0123456789"),          # full width digits
    ("αορχγ", "aopxy"),                           # Greek, small
    ("ΑΒΕΗΙΚΜΝΟΡΤΧΥ", "ABEHIKMNOPTXY"),           # Greek, capital
    ("ıіíìîïĩį", "iiiiiiii"),
    ("óòôöõø", "oooooo"),
    ("áàâäãå", "aaaaaa"),
    ("éèêëẽ", "eeeee"),
    ("úùûüũ", "uuuuu"),
    ("ñńň", "nnn"),
    ("ćčç", "ccc"),
    ("ğǧ", "gg"),
    ("řŕ", "rr"),
    ("šśş", "sss"),
    ("žźż", "zzz"),
]


def latin_lookalikes(text: Column | str) -> Column:
    return F.translate(col(text), "".join(a for a, _ in HOMOGLYPHS), "".join(b for _, b in HOMOGLYPHS))


def normalize_unicode(text: Column | str, homoglyphs: bool = True) -> Column:
    t = F.translate(col(text), "".join(T.ZERO_WIDTH[:4]), "")
    composed = _nfkc_udf()(F.when(t.rlike(r"[^\x00-\x7F]"), t))
    t = F.coalesce(composed, t)
    return latin_lookalikes(t) if homoglyphs else t


# --- measures --------------------------------------------------------------------------
def shannon_entropy(text: Column | str) -> Column:
    """Bits per character: log2(n) - sum(c * log2(c)) / n over the counts c of distinct characters.

    Sorted characters form one run per distinct character, so one pass of a back-reference
    counts them all.
    """
    t = col(text)
    in_order = F.array_join(F.sort_array(characters(t)), "")
    counts = F.transform(F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1*"), F.lit(0)), F.length)
    return _entropy(F.length(t), counts)


def _entropy(n: Column, counts: Column) -> Column:
    spread = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - spread / n)


def max_repetition(text: Column | str) -> Column:
    """Longest run of one character."""
    t = col(text)
    repeats = F.regexp_extract_all(t, F.lit(r"(?s)(.)\1+"), F.lit(0))
    longest = F.array_max(F.transform(repeats, F.length))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.coalesce(longest, F.lit(1)))


def _codes(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _character_profile():
    """Counts of the distinct characters, in their order, and the longest run of one, in one pass."""

    @F.pandas_udf("counts array<int>, longest int")
    def profile(values: pd.Series) -> pd.DataFrame:
        out = []
        for value in values:
            if not value:
                out.append((None, None) if value is None else ([], 0))
                continue
            codes = _codes(value)
            counts = np.unique(codes, return_counts=True)[1] if codes.max() > 0xFFFF else np.bincount(codes)
            ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
            out.append((counts[counts > 0].astype(np.int32), int(np.diff(ends, prepend=-1).max())))
        return pd.DataFrame(out, columns=["counts", "longest"]).astype({"longest": "Int32"})

    return profile


def _largest(counts: list[np.ndarray], top: int) -> np.ndarray:
    found = np.sort(np.concatenate(counts))[::-1][:top]
    return np.append(found, np.zeros(top - len(found))).astype(np.float64)


# what the regular expressions of the n-gram arrays take for white space
_SPACES = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def top_char_ngram_counts(text: Column | str, top: int) -> Column:
    """The `top` largest counts of `char_ngram_array`, padded with zeros."""

    @F.pandas_udf("array<double>")
    def counts(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            if value is None:
                out.append(None)
                continue
            codes = _codes(value)
            blank = np.isin(codes, _SPACES)
            c = codes.astype(np.int64)
            two = (c[:-1] << 21 | c[1:])[~(blank[:-1] & blank[1:])]
            three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[~(blank[:-2] & blank[1:-1] & blank[2:])]
            out.append(_largest([np.unique(g, return_counts=True)[1] for g in (two, three)], top))
        return pd.Series(out)

    return counts(F.lower(col(text)))


def top_word_ngram_counts(text: Column | str, top: int) -> Column:
    """The `top` largest counts of `word_ngram_array`, padded with zeros."""

    @F.pandas_udf("array<double>")
    def counts(values: pd.Series) -> pd.Series:
        out = []
        for value in values:
            if value is None:
                out.append(None)
                continue
            words = pd.factorize(np.array([w for w in value.split(" ") if w], dtype=object))[0].astype(np.int64)
            n = len(words) + 1
            two, n_two = np.unique(words[:-1] * n + words[1:], return_inverse=True, return_counts=True)[1:]
            n_three = np.unique(two[:-1] * n + words[2:], return_counts=True)[1]
            out.append(_largest([n_two, n_three], top))
        return pd.Series(out)

    return counts(F.regexp_replace(F.lower(col(text)), java_regex(r"\s+"), " "))


def complexity_metrics(text: Column | str) -> dict[str, Column]:
    t = col(text)
    special = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s\x{A0}]", ""))
    return {
        "length": F.length(t),
        "word_count": F.size(words(t)),
        "special_char_ratio": special / F.greatest(F.length(t), F.lit(1)),
        "has_base64": has(t, BASE64_RUN),
        "has_hex": has(t, r"\\x[0-9a-fA-F]{2}"),
        "has_unicode": has(t, r"\\u[0-9a-fA-F]{4}"),
        "url_count": occurrences(t, r"https?://[^\s]+"),
        "code_score": flag_count([has(t, p) for p in T.CODE_INDICATORS]) / len(T.CODE_INDICATORS),
    }


SCALAR_FEATURES = [
    "length", "word_count", "char_count", "line_count", "entropy", "char_diversity",
    "word_diversity", "avg_word_length", "punctuation_ratio", "special_char_ratio",
    "uppercase_ratio", "digit_ratio", "whitespace_ratio", "has_encoding", "has_delimiters",
    "has_role_markers", "has_instructions", "max_repetition",
]


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the 18 scalar features of a prompt."""
    t = F.col(text)
    with_parts = df.withColumns({
        "_words": words(t),
        "_chars": _character_profile()(t),
        "_lower": F.lower(t),
        "_n": F.length(t),
    })
    n = F.greatest(F.col("_n"), F.lit(1))
    n_words = F.greatest(F.size("_words"), F.lit(1))
    # Punctuation is a fixed ASCII set, so removal by `translate` counts it.
    no_punct = F.length(F.translate(t, T.FEATURE_PUNCTUATION, ""))
    space = F.length(F.regexp_replace(t, java_regex(r"[^\s]+"), ""))
    nd = float(1)
    features = {
        "length": F.col("_n"),
        "word_count": F.size("_words"),
        "char_count": F.length(F.translate(t, " \n", "")),
        "line_count": literal_count(t, "\n") + 1,
        "entropy": _entropy(F.col("_n"), F.col("_chars.counts")),
        "char_diversity": F.size("_chars.counts") * nd / n,
        "word_diversity": F.size(F.array_distinct("_words")) * nd / n_words,
        "avg_word_length": F.length(F.array_join("_words", "")) * nd / n_words,
        "punctuation_ratio": (F.col("_n") - no_punct) * nd / n,
        "special_char_ratio": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s\x{A0}]+", "")) * nd / n,
        "uppercase_ratio": F.length(F.regexp_replace(t, r"\P{Lu}+", "")) * nd / n,
        "digit_ratio": F.length(F.regexp_replace(t, r"\P{Nd}+", "")) * nd / n,
        "whitespace_ratio": space * nd / n,
        "has_encoding": has(t, T.FEATURE_ENCODING),
        "has_delimiters": has(t, T.FEATURE_DELIMITERS),
        "has_role_markers": has(F.col("_lower"), T.FEATURE_ROLES),
        "has_instructions": has(F.col("_lower"), T.FEATURE_INSTRUCTIONS),
        "max_repetition": F.coalesce("_chars.longest", F.lit(1)),
    }
    return with_parts.withColumns(features).drop("_words", "_chars", "_lower", "_n")


def keyword_features(text: Column | str) -> dict[str, Column]:
    t = col(text)
    low = F.lower(t)
    return {
        "length": F.length(t),
        "n_ignore": literal_count(t, "ignore"),
        "n_system": literal_count(t, "system"),
        "n_exclaim": literal_count(t, "!"),
        "n_question": literal_count(t, "?"),
        "n_lt": literal_count(t, "<"),
        "n_gt": literal_count(t, ">"),
        "has_override": low.contains("override").cast("int"),
        "has_instruction": low.contains("instruction").cast("int"),
        "has_prompt": low.contains("prompt").cast("int"),
    }


# An empty match at every position whose look-ahead captures the n-gram that starts there:
# linear in the text and one expression, where arrays of positions would be quadratic.
def char_ngram_array(text: Column | str, low: int = 2, high: int = 3) -> Column:
    """All character n-grams of the lower-cased text that are not just white space."""
    t = F.lower(col(text))

    def of_size(n: int) -> Column:
        at = rf"(?sU)(?!\s{{{n}}})(?![\x{{DC00}}-\x{{DFFF}}])(?=({'.' * n}))"
        return F.regexp_extract_all(t, F.lit(at), F.lit(1))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def word_ngram_array(text: Column | str, low: int = 2, high: int = 3) -> Column:
    """All word n-grams of the lower-cased text, joined by one space."""
    t = F.regexp_replace(F.lower(col(text)), java_regex(r"\s+"), " ")

    def of_size(n: int) -> Column:
        gram = " ".join(["[^ ]+"] * n)
        return F.regexp_extract_all(t, F.lit(rf"(?<![^ ])(?=({gram})(?![^ ]))"), F.lit(1))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


# --- scripts and unicode ---------------------------------------------------------------
# fixed values: script ranges, the language each is taken for and the confidence
SCRIPTS = [
    (r"[぀-ゟ゠-ヿ]", "ja", 0.9),
    (r"[ыъэ]", "ru", 0.9),
    (r"[Ѐ-ӿ]", "ru", 0.8),
    (r"[一-鿿]", "zh", 0.8),
    (r"[가-힯]", "ko", 0.8),
    (r"[؀-ۿ]", "ar", 0.8),
    (r"[ऀ-ॿ]", "hi", 0.8),
]


def script_language(text: Column | str) -> Column:
    """Language by script; pure ASCII, the common case, is decided by one cheap test."""
    t = col(text)
    out = F.when(~t.rlike(r"[^\x00-\xFF]"), F.lit("en"))
    for chars, lang, _ in SCRIPTS:
        out = out.when(t.rlike(chars), F.lit(lang))
    return out.otherwise("en")


def script_confidence(text: Column | str) -> Column:
    t = col(text)
    out = F.when(~t.rlike(r"[^\x00-\xFF]"), F.lit(0.4))
    for chars, _, confidence in SCRIPTS:
        out = out.when(t.rlike(chars), F.lit(confidence))
    return out.otherwise(0.4)


def unicode_profile(text: Column | str) -> dict[str, Column]:
    t = col(text)
    emoji = r"[\p{So}\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
    removable = r"[\p{So}\x{1F600}-\x{1F6FF}]"
    rtl = r"[\x{0590}-\x{08FF}&&[\p{L}]]|[\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}&&[\p{L}]]"
    special = F.regexp_replace(t, r"[^\p{P}\p{S}]", "")
    n_rtl = F.regexp_count(t, F.lit(rtl))
    return {
        "has_emoji": t.rlike(emoji),
        "text_without_emoji": F.regexp_replace(t, removable, ""),
        "rtl_char_count": n_rtl,
        "direction": F.when(n_rtl > F.length(t) / 2, "rtl").otherwise("ltr"),
        "special_char_count": F.length(special),
        "special_chars": F.array_sort(F.array_distinct(characters(special))),
    }


# --- values ----------------------------------------------------------------------------
def luhn_valid(value: Column | str) -> Column:
    v = col(value)
    return v.rlike(r"^[0-9]{13,19}\z") & F.call_function("luhn_check", F.when(v.rlike(r"^[0-9]{13,19}\z"), v).otherwise("0"))


def _first_last(value: Column) -> Column:
    n = F.length(value)
    return F.when(
        n > 6, F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2)))
    ).otherwise(F.repeat(F.lit("*"), n))


def mask_value(value: Column | str, kind: Column | str) -> Column:
    v, k = col(value), col(kind)
    at = F.instr(v, "@")
    user, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    one_at = F.length(v) - F.length(F.replace(v, F.lit("@"), F.lit(""))) == 1
    compact = F.translate(v, "- ", "")
    digits = F.regexp_replace(v, r"\D", "")
    return (
        F.when(F.length(v) <= 4, "****")
        .when(
            (k == "email") & one_at & (at > 0),
            F.concat(F.when(F.length(user) > 2, F.left(user, F.lit(2))).otherwise(""), F.lit("***@"), domain),
        )
        .when((k == "credit_card") & (F.length(compact) >= 4), F.concat(F.lit("****-****-****-"), F.right(compact, F.lit(4))))
        .when(k == "ssn", "***-**-****")
        .when((k == "phone") & (F.length(digits) >= 10), F.concat(F.left(digits, F.lit(3)), F.lit("-***-****")))
        .otherwise(_first_last(v))
    )


def mask_custom(value: Column | str, mask_format: Column | str) -> Column:
    v, m = col(value), col(mask_format)
    stars = F.length(m) - F.length(F.translate(m, "*", ""))
    return F.when((stars > 0) & (stars >= F.length(v)), F.repeat(F.lit("*"), F.length(v))).otherwise(m)


def regex_complexity(pattern: Column | str) -> Column:
    p = col(pattern)
    score = (
        literal_count(p, "*") * 10
        + literal_count(p, "+") * 10
        + literal_count(p, "{") * 5
        + literal_count(p, "(?") * 15
        + occurrences(p, r"\(.*\)\*") * 20
        + occurrences(p, r"\(.*\)\+") * 20
    )
    return score + F.when(p.contains("|") & (p.contains("*") | p.contains("+")), 30).otherwise(0)


def content_key(role: Column | str, text: Column | str, mode: str = "full") -> Column:
    """Identity of one message: exact (`full`), prompt text only, short preview, or 64-bit."""
    r, t = col(role), col(text)
    if mode == "fast":
        return F.xxhash64(r, t)
    source = {
        "full": F.concat(r, F.lit(":"), t),
        "prompt": t,
        "preview": F.concat(r, F.lit(":"), F.left(t, F.lit(200))),
    }[mode]
    return F.substring(F.sha2(source.cast("binary"), 256), 1, 16)


def log_template(message: Column | str, uuid_first: bool = True) -> Column:
    m = col(message)

    def uuids(c: Column) -> Column:
        return F.regexp_replace(c, r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "UUID")

    def numbers(c: Column) -> Column:
        return F.regexp_replace(c, r"\d+", "N")

    m = numbers(uuids(m)) if uuid_first else uuids(numbers(m))
    return F.regexp_replace(m, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL")


def sanitize_headers(headers: Column | str) -> Column:
    # fixed values: headers whose value is never kept
    sensitive = ["authorization", "x-api-key", "cookie", "set-cookie", "proxy-authorization"]

    def clean(name: Column, value: Column) -> Column:
        return (
            F.when(F.lower(name).isin(sensitive), "[REDACTED]")
            .when(F.length(value) > 200, F.concat(F.left(value, F.lit(200)), F.lit("...")))
            .otherwise(value)
        )

    return F.transform_values(col(headers), clean)


def client_ip(headers: Column | str, remote: Column | str) -> Column:
    h = col(headers)
    forwarded = F.nullif(F.element_at(h, F.lit("x-forwarded-for")), F.lit(""))
    return F.coalesce(
        F.trim(F.element_at(F.split(forwarded, ","), 1)),
        F.nullif(F.element_at(h, F.lit("x-real-ip")), F.lit("")),
        col(remote),
        F.lit("unknown"),
    )


def regex_escape(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"([\\.^$|?*+()\[\]{}&~#\- ])", r"\\$1")


def regex_from_text(text: Column | str) -> Column:
    """A phrase as an expression: escaped, runs of digits and single blanks generalised."""
    t = regex_escape(text)
    t = F.replace(t, F.lit("\\ "), F.lit(r"\s+"))
    return F.regexp_replace(t, r"[0-9]+", r"\\d+")


# fixed values: categories a classifier answer may name
ANSWER_CATEGORIES = [
    "direct_injection", "indirect_injection", "jailbreak", "prompt_leak", "encoding_attack",
    "context_switching", "role_manipulation", "benign",
]


def first_object(a: Column) -> Column:
    """From the first brace to the one that closes it, nested to any depth; null if none does."""
    from_brace = F.regexp_extract(a, r"(?s)^[^{]*(\{.*)$", 1)
    tokens = F.regexp_extract_all(from_brace, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("done"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        grown = F.struct(F.concat(acc["out"], token).alias("out"), depth.alias("depth"), (depth == 0).alias("done"))
        return F.when(acc["done"], acc).otherwise(grown)

    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["done"], acc["out"]))


def parse_classifier_json(answer: Column | str) -> Column:
    """struct(category, confidence, explanation) of a model answer."""
    a = col(answer)
    doc = F.coalesce(F.try_parse_json(a), F.try_parse_json(first_object(a)))
    name = F.lower(F.trim(F.try_variant_get(doc, "$.category", "string")))
    raw = F.coalesce(F.try_variant_get(doc, "$.confidence", "string"), F.lit("0.0"))
    value = raw.try_cast("double")
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value > 1)
    category = F.when(name.isin(ANSWER_CATEGORIES), name).otherwise("benign")
    missing = F.struct(
        F.lit("benign").alias("category"),
        F.lit(0.0).alias("confidence"),
        F.lit("Could not parse response (parsing error)").alias("explanation"),
    )
    invalid = F.struct(
        F.lit("benign").alias("category"),
        F.lit(0.0).alias("confidence"),
        F.lit("Response parsing error: invalid confidence value").alias("explanation"),
    )
    good = F.struct(
        category.alias("category"),
        value.alias("confidence"),
        F.coalesce(F.try_variant_get(doc, "$.explanation", "string"), F.lit("")).alias("explanation"),
    )
    return F.when(doc.isNull(), missing).when(bad, invalid).otherwise(good)


SQL_FUNCTIONS = {
    # name -> (arguments, SQL body); registered as temporary SQL functions so that Catalyst inlines them
    "rampart_scan_window": (
        "t STRING, n INT",
        "CASE WHEN length(t) > 2 * n THEN concat(left(t, n), ' ... ', right(t, n)) ELSE t END",
    ),
    "rampart_luhn_valid": (
        "v STRING",
        r"v RLIKE '^[0-9]{13,19}$' AND luhn_check(CASE WHEN v RLIKE '^[0-9]{13,19}$' THEN v ELSE '0' END)",
    ),
    "rampart_max_repetition": (
        "t STRING",
        r"CASE WHEN length(t) = 0 THEN 0 ELSE coalesce(array_max(transform(regexp_extract_all(t, '(?s)(.)\\1+', 0), x -> length(x))), 1) END",
    ),
    "rampart_content_key": ("r STRING, t STRING", "substring(sha2(concat(r, ':', t), 256), 1, 16)"),
}




def _sanitize_sql() -> str:
    def without(t: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({t}, {spark_str(pattern)}, {spark_str(by)})"

    t = without(without("t", r"\\x[0-9a-fA-F]{2}"), r"\\u[0-9a-fA-F]{4}")
    t = f"CASE WHEN aggressive THEN {without(t, ENCODED_RUN, '[REMOVED_ENCODING]')} ELSE {t} END"
    for pattern in ACTIVE_CONTENT:
        t = without(t, java_regex(pattern, ignore_case=True, dotall=True), "[REMOVED]")
    t = f"translate({without(t, java_regex(r'\s{10,}'), ' ')}, {spark_str(''.join(T.ZERO_WIDTH[:4]))}, '')"
    return without(t, java_regex(r"^\s+|\s+\z"))


def _complexity_sql() -> str:
    found = lambda pattern: f"t RLIKE {spark_str(java_regex(pattern))}"
    code = " + ".join(f"CAST({found(p)} AS INT)" for p in T.CODE_INDICATORS)
    special = spark_str(r"[\p{L}\p{N}\s\x{A0}]")
    return (
        f"named_struct('length', length(t), 'word_count', size(regexp_extract_all(t, {spark_str(WORD)}, 0)), "
        f"'special_char_ratio', length(regexp_replace(t, {special}, '')) / greatest(length(t), 1), 'has_base64', {found(BASE64_RUN)}, "
        f"'has_hex', {found(r'\\x[0-9a-fA-F]{2}')}, 'has_unicode', {found(r'\\u[0-9a-fA-F]{4}')}, "
        f"'url_count', regexp_count(t, {spark_str(java_regex(r'https?://[^\s]+'))}), 'code_score', ({code}) / {len(T.CODE_INDICATORS)})"
    )


SQL_FUNCTIONS |= {
    "rampart_sanitize": ("t STRING, aggressive BOOLEAN", _sanitize_sql()),
    "rampart_complexity": ("t STRING", _complexity_sql()),
    "rampart_entropy": (
        "t STRING",
        r"CASE WHEN length(t) = 0 THEN 0D ELSE log2(length(t)) - aggregate(transform(regexp_extract_all(array_join(sort_array(regexp_extract_all(t, '(?s).', 0)), ''), "
        r"'(?s)(.)\\1*', 0), x -> length(x)), 0D, (a, c) -> a + c * log2(c)) / length(t) END",
    ),
    "rampart_mask_value": (
        "v STRING, kind STRING",
        r"CASE WHEN length(v) <= 4 THEN '****' "
        r"WHEN kind = 'email' AND length(v) - length(replace(v, '@', '')) = 1 THEN concat(CASE WHEN length(substring_index(v, '@', 1)) > 2 THEN left(v, 2) ELSE '' END, '***@', substring_index(v, '@', -1)) "
        r"WHEN kind = 'credit_card' AND length(translate(v, '- ', '')) >= 4 THEN concat('****-****-****-', right(translate(v, '- ', ''), 4)) "
        r"WHEN kind = 'ssn' THEN '***-**-****' "
        r"WHEN kind = 'phone' AND length(regexp_replace(v, '[^0-9]', '')) >= 10 THEN concat(left(regexp_replace(v, '[^0-9]', ''), 3), '-***-****') "
        r"WHEN length(v) > 6 THEN concat(left(v, 2), repeat('*', length(v) - 4), right(v, 2)) ELSE repeat('*', length(v)) END",
    ),
}


def register_sql_functions(spark) -> None:
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
