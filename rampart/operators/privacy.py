"""Masking strategies, tokens, retention, erasure, export, field encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions.unnest import computed_once, unnest
from rampart.operators import pii as P
from rampart.session import cut_lineage

# fixed values: weight of a type in the privacy risk
RISK_WEIGHTS = {
    "ssn": 1.0, "credit_card": 0.9, "bank_account": 0.9, "password": 0.8, "api_key": 0.8,
    "private_key": 1.0, "email": 0.5, "phone": 0.5, "ip_address": 0.4,
}
# fixed values: category, retention days, action, days until anonymised, legal hold
RETENTION_POLICIES = [
    ("detection_logs", 30, "delete", 7, False),
    ("audit_logs", 2555, "archive", None, False),
    ("pii_processing", 1095, "anonymize", 365, False),
    ("user_consent", 1825, "review", None, True),
    ("api_access_logs", 90, "delete", None, False),
    ("cached_prompts", 1, "delete", None, False),
    ("metrics", 365, "anonymize", 30, False),
    ("temp_data", 0, "delete", None, False),
]


def default_policies(spark) -> DataFrame:
    return spark.createDataFrame(
        RETENTION_POLICIES, "category string, retention_days int, action string, anonymization_days int, legal_hold boolean"
    )


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _octet(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, 2), 16, 10)


def _digits(h: Column, at: int, n: int) -> Column:
    """`n` decimal digits from hex characters, each modulo ten."""
    return F.translate(F.substring(h, at, n), "abcdef", "012345")


def masked(span: Column, strategy: str) -> Column:
    v, kind, h = span["text"], span["type"], _sha(span["text"])
    tail = F.right(v, F.lit(4))
    if strategy == "hash":
        return F.concat(F.lit("[HASH:"), F.substring(h, 1, 16), F.lit("]"))
    if strategy == "tokenize":
        return F.concat(F.lit("["), token(v), F.lit("]"))
    if strategy == "remove":
        return F.lit("")
    generic = F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    if strategy == "partial":
        parts = F.split(v, r"\.")
        return (
            F.when(kind == "email", F.concat(F.left(v, F.lit(2)), F.lit("***@***.***")))
            .when(kind == "phone", F.concat(F.lit("***-***-"), tail))
            .when(kind == "ssn", F.concat(F.lit("***-**-"), tail))
            .when(kind == "credit_card", F.concat(F.lit("****-****-****-"), tail))
            .when(kind == "ip_address", F.concat(F.array_join(F.slice(parts, 1, 2), "."), F.lit(".*.* ")))
            .when(kind == "api_key", F.concat(F.left(v, F.lit(8)), F.lit("..."), tail))
            .when(kind == "password", F.repeat(F.lit("*"), F.least(F.length(v), F.lit(8))))
            .otherwise(generic)
        )
    if strategy == "anonymize":
        dash = F.lit("-")
        card = F.concat_ws("-", *[_digits(h, i, 4) for i in (1, 5, 9, 13)])
        return (
            F.when(kind == "email", F.concat(F.lit("user"), F.substring(h, 1, 8), F.lit("@example.com")))
            .when(kind == "phone", F.concat(F.lit("555-"), F.substring(h, 4, 3), dash, F.substring(h, 7, 4)))
            .when(kind == "ssn", F.concat(F.substring(h, 1, 3), dash, F.substring(h, 4, 2), dash, F.substring(h, 6, 4)))
            .when(kind == "credit_card", card)
            .when(kind == "ip_address", F.concat_ws(".", *[_octet(h, i) for i in (1, 3, 5, 7)]))
            .when(kind == "api_key", F.concat(F.lit("sk-"), F.substring(h, 1, 32)))
            .when(kind == "password", F.lit("[REMOVED]"))
            .otherwise(generic)
        )
    return generic  # redact


def mask_prompts(
    df: DataFrame, strategy: str = "redact", text: str = "text", types: list[str] | None = None,
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """Adds masked_text, masked_count, masked_items (type, position, length, masked value)."""
    return _replaced(computed_once(df.withColumn("_spans", P.spans(text, types=types)), "_spans"), strategy, text, extra)


def _replaced(found: DataFrame, strategy: str, text: str, extra: dict[str, str] | None = None) -> DataFrame:
    """mask_prompts from the spans found."""
    out = F.when(
        F.size("_spans") > 0, P.replace_spans(F.col(text), F.col("_spans"), lambda s: masked(s, strategy))
    ).otherwise(F.col(text))
    items = F.transform("_spans", lambda s: F.struct(
        s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), masked(s, strategy).alias("masked"),
        s["confidence"].alias("confidence"),
    ))
    done = found.withColumns({"masked_text": out, "masked_items": items, "masked_count": F.size("_spans")})
    for pattern, replacement in (extra or {}).items():
        changed = F.regexp_replace("masked_text", "(?i)" + pattern, replacement)
        done = done.withColumn("masked_text", F.when(F.col("masked_count") > 0, changed).otherwise(F.col("masked_text")))
    return done.drop("_spans")


def token(value: Column) -> Column:
    """Stable token of a value.  Made from the value, so no counter has to be shared between tasks."""
    return F.concat(F.lit("TOKEN_"), F.substring(_sha(value), 1, 24))


def tokenize_values(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with tokens, vault of distinct token -> value).  The spans that both are made from are found once and kept."""
    found = cut_lineage(df.withColumn("_low", F.lower(text)).withColumn("_spans", P.spans(text, "_low")).drop("_low"))
    replaced = _replaced(found, "tokenize", text)
    each = unnest(found, "_spans", "s")
    vault = each.select(token(F.col("s.text")).alias("token"), F.col("s.text").alias("value")).distinct()
    return replaced, vault


def detokenize(df: DataFrame, key: str, vault: DataFrame, text: str = "masked_text") -> DataFrame:
    """Puts values back: pieces between tokens are kept in order, tokens joined with the vault.

    Texts without a token pass by; a text's pieces are put together again from a grouping on
    its key and its own number of tokens.
    """
    rx = r"\[TOKEN_[0-9a-f]{24}\]"
    has = F.col(text).rlike(rx)
    pieces = F.split(F.col(text), rx, -1)
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"\[(TOKEN_[0-9a-f]{24})\]"), F.lit(1))
    parts = F.zip_with(pieces, tokens, lambda p, t: F.struct(p.alias("piece"), t.alias("token")))
    rows = df.filter(has).select(key, F.posexplode(parts).alias("at", "part"))
    joined = rows.select(key, "at", "part.piece", "part.token").join(vault, "token", "left")
    built = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "piece", "value", "token"))).alias("parts"))
    restored = F.array_join(
        F.transform("parts", lambda x: F.concat(x["piece"], F.coalesce(x["value"], F.concat(F.lit("["), x["token"], F.lit("]")), F.lit("")))), ""
    )
    done = built.select(key, restored.alias("restored"))
    plain = df.filter(~has).select(key, F.col(text).alias("restored"))
    return done.unionByName(plain)


def privacy_report(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Risk 0..100, level, strategy and share of sensitive characters per text; inside the row."""
    from rampart.operators.verdicts import by_name

    found = df.select(key, F.length(text).alias("_n"), P.spans(text).alias("_spans"))
    risk = F.aggregate(
        "_spans", F.lit(0.0), lambda a, s: a + by_name(RISK_WEIGHTS, s["type"], 0.3).cast("double") * s["confidence"]
    )
    covered = F.aggregate("_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    scored = found.withColumns({
        "risk": F.least(F.lit(100.0), risk * 20), "covered": covered, "pii_count": F.size("_spans"),
        "types": F.array_sort(F.array_distinct(F.transform("_spans", lambda s: s["type"]))),
    })
    r = F.col("risk")
    return scored.select(
        key, F.round("risk", 2).alias("risk_score"),
        F.when(r > 80, "HIGH").when(r > 50, "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.when(r > 80, "redact").when(r > 50, "partial").when(r > 20, "anonymize").otherwise("partial").alias("strategy"),
        "pii_count", "types",
        F.when(F.col("_n") > 0, F.round(F.col("covered") / F.col("_n") * 100, 2)).otherwise(0.0).alias("sensitive_pct"),
    )


# --- retention ------------------------------------------------------------------------------
def retention_actions(records: DataFrame, policies: DataFrame, now: str, created: str = "created_at") -> DataFrame:
    """Adds `action`: what the policy of the record's category asks for at `now`."""
    age = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col(created).cast("timestamp"))
    day = F.lit(86_400_000_000).cast("long")
    joined = records.join(policies, "category", "left")
    expired = age > F.col("retention_days") * day
    stale = F.col("anonymization_days").isNotNull() & (age > F.col("anonymization_days") * day)
    action = (
        F.when(F.col("legal_hold") | F.col("retention_days").isNull(), "keep")
        .when(expired, F.col("action")).when(stale, "anonymize").otherwise("keep")
    )
    return joined.select(*records.columns, action.alias("action"), expired.alias("expired"))


def apply_retention(records: DataFrame, policies: DataFrame, now: str, secret: list[str], created: str = "created_at") -> DataFrame:
    """The records that stay: expired ones to delete are gone, `secret` columns of anonymised ones hashed."""
    acted = retention_actions(records, policies, now, created)
    kept = acted.filter(~((F.col("action") == "delete") | (F.col("expired") & (F.col("action") == "anonymize"))))
    hide = F.col("action") == "anonymize"
    return kept.withColumns({
        c: F.when(hide, F.substring(_sha(F.col(c).cast("string")), 1, 16)).otherwise(F.col(c).cast("string")) for c in secret
    }).drop("expired")


def retention_summary(records: DataFrame, policies: DataFrame, now: str, created: str = "created_at") -> DataFrame:
    acted = retention_actions(records, policies, now, created)
    gone = (F.col("action") == "delete") | (F.col("expired") & (F.col("action") == "anonymize"))
    return acted.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(gone).alias("n_deleted"),
        F.count_if(~gone & (F.col("action") == "anonymize")).alias("n_anonymized"),
        F.count_if(F.col("action").isin("archive", "review")).alias("n_held"),
        F.count_if(F.col("action") == "keep").alias("n_kept"),
    )


def erase_subject(records: DataFrame, requests: DataFrame, policies: DataFrame, subject: str) -> DataFrame:
    """Records left after the erasure requests; records under legal hold stay."""
    held = policies.filter("legal_hold").select("category")
    erasable = records.join(held, "category", "left_anti")
    protected = records.join(held, "category", "left_semi")
    return erasable.join(requests.select(subject).distinct(), subject, "left_anti").unionByName(protected)


def erasure_audit(records: DataFrame, requests: DataFrame, policies: DataFrame, subject: str) -> DataFrame:
    """What each request removed and what legal hold kept, for the audit table."""
    mine = records.join(requests.select(subject).distinct(), subject, "left_semi")
    flagged = mine.join(policies.select("category", "legal_hold"), "category", "left")
    return flagged.groupBy(subject, "category").agg(
        F.count_if(~F.col("legal_hold")).alias("erased"), F.count_if("legal_hold").alias("held")
    )


def export_subject(records: DataFrame, requests: DataFrame, subject: str) -> DataFrame:
    """The records of the subjects that asked for their data, one JSON text per record."""
    mine = records.join(requests.select(subject).distinct(), subject, "left_semi")
    return mine.select(subject, "category", F.to_json(F.struct(*records.columns)).alias("record"))


def retention_report(records: DataFrame, policies: DataFrame, now: str, created: str = "created_at") -> DataFrame:
    """Every policy with its records and how many are overdue."""
    acted = retention_actions(records, policies, now, created)
    counts = acted.groupBy("category").agg(F.count("*").alias("n"), F.count_if("expired").alias("n_overdue"))
    return policies.join(counts, "category", "left").select(
        "category", "retention_days", F.col("action"), "legal_hold",
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_overdue", F.lit(0)).alias("n_overdue"),
    )


# --- field encryption -----------------------------------------------------------------------
def encrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """AES-GCM with a fresh nonce per value; base64 text."""
    return df.withColumns({
        c: F.base64(F.aes_encrypt(F.col(c).cast("string").cast("binary"), key)) for c in columns
    })


def decrypt_columns(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """Null where the value was not made with this key."""
    return df.withColumns({c: F.try_aes_decrypt(F.unbase64(c), key).cast("string") for c in columns})
