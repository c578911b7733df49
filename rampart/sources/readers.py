"""Readers: messages, corpora, pattern libraries, feeds, custom rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ["system", "user", "assistant"]


def clean_role(role: Column) -> Column:
    return F.when(role.isin(ROLES), role).otherwise("user")


def messages_from_prompts(df: DataFrame, key: str, text: str, role: str = "user") -> DataFrame:
    """A plain text is one message."""
    return df.select(F.col(key).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text"))


def messages_from_lists(df: DataFrame, key: str, items: str) -> DataFrame:
    """One row per element of an array of struct(role, content); unknown roles are users."""
    rows = df.select(F.col(key).alias("conv_id"), F.posexplode(items).alias("turn", "m"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), clean_role(F.coalesce("m.role", F.lit("user"))).alias("role"),
        F.coalesce("m.content", F.lit("")).alias("text"),
    )


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored conversations: rows of (conv_id, turn, role, text), or of (conv_id, messages array)."""
    df = spark.read.format(fmt).load(path)
    if "messages" in df.columns:
        return messages_from_lists(df, "conv_id", "messages")
    return df.select("conv_id", "turn", clean_role(F.coalesce("role", F.lit("user"))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def split_blank(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with content, rejected ones)."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return messages.filter(~blank), messages.filter(blank)


CORPUS_SCHEMA = "prompt string, label string, source string, category string, created_at timestamp, metadata map<string,string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a binary label: anything but benign is 1."""
    return spark.read.schema(CORPUS_SCHEMA).json(path).withColumn("is_attack", (F.col("label") != "benign").cast("int"))


LIBRARY_SCHEMA = (
    "metadata struct<name:string,version:string,source:string>, patterns array<struct<id:string,pattern:string,variants:array<string>,"
    "technique:string,severity:string,confidence:double,description:string,tags:array<string>>>"
)


def read_pattern_library(spark: SparkSession, path: str) -> DataFrame:
    """One row per pattern and per variant of JSON files with `patterns`."""
    files = spark.read.schema(LIBRARY_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = files.select(F.col("metadata.name").alias("family"), F.explode("patterns").alias("p"))
    texts = F.concat(F.array("p.pattern"), F.coalesce("p.variants", F.array().cast("array<string>")))
    return rows.select("family", "p.*", F.posexplode(texts).alias("variant", "text")).drop("variants", "pattern")


# --- feeds: one row per document in column `body` ---------------------------------------------
def parse_feed_json(df: DataFrame, body: str = "body", key: str = "indicators", transforms: dict[str, str] | None = None) -> DataFrame:
    """A list of objects, an object with them under `key`, or one object -> rows with map `item`."""
    b = F.col(body)
    many = "array<map<string,string>>"
    nested = F.get_json_object(b, f"$.{key}")
    items = (
        F.when(F.ltrim(b).startswith("["), F.from_json(b, many))
        .when(nested.isNotNull(), F.from_json(nested, many))
        .otherwise(F.array(F.from_json(b, "map<string,string>")))
    )
    rows = df.withColumn("item", F.explode(items)).filter("item is not null")

    def change(name: Column, value: Column) -> Column:
        out = None
        for field, how in (transforms or {}).items():
            new = {"lowercase": F.lower(value), "uppercase": F.upper(value)}.get(how)
            if how == "timestamp":
                new = F.coalesce(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd HH:mm:ss"), value)
            out = F.when(name == field, new) if out is None else out.when(name == field, new)
        return value if out is None else out.otherwise(value)

    return rows.withColumn("item", F.transform_values("item", change)) if transforms else rows


def parse_feed_csv(df: DataFrame, column_map: dict[str, str], include_unmapped: bool = False) -> DataFrame:
    """Mapped columns under their new names; the others only on request."""
    mapped = [F.col(c).alias(n) for c, n in column_map.items() if c in df.columns]
    rest = [F.col(c) for c in df.columns if c not in column_map] if include_unmapped else []
    return df.select(*mapped, *rest)


STIX_SCHEMA = (
    "objects array<struct<type:string,pattern:string,description:string,name:string,confidence:double,valid_from:string,valid_until:string,"
    "labels:array<string>,kill_chain_phases:array<struct<phase_name:string>>>>"
)


def parse_feed_stix(df: DataFrame, body: str = "body") -> DataFrame:
    """Indicator objects of a bundle; confidence out of 100, .7 where missing."""
    objects = F.filter(F.from_json(body, STIX_SCHEMA)["objects"], lambda o: o["type"] == "indicator")
    rows = df.withColumn("o", F.explode(objects))
    c = F.col("o.confidence")
    return rows.select(
        *df.drop(body).columns, F.coalesce("o.pattern", F.lit("")).alias("pattern"),
        F.coalesce("o.description", "o.name", F.lit("")).alias("description"),
        F.when(c.isNull(), 0.7).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / 100))).alias("confidence"),
        F.col("o.valid_from").alias("first_seen"), F.col("o.valid_until").alias("expires_at"), F.col("o.labels").alias("tags"),
        F.transform("o.kill_chain_phases", lambda p: p["phase_name"]).alias("mitre_tactics"),
    )


MISP_SCHEMA = "Event struct<Attribute:array<struct<value:string,comment:string,type:string,Tag:array<string>,first_seen:string,last_seen:string>>>"


def parse_feed_misp(df: DataFrame, body: str = "body") -> DataFrame:
    rows = df.withColumn("a", F.explode(F.from_json(body, MISP_SCHEMA)["Event"]["Attribute"]))
    value = F.coalesce("a.value", F.lit(""))
    return rows.select(
        *df.drop(body).columns, value.alias("pattern"), F.coalesce("a.comment", "a.type", F.lit("")).alias("description"),
        F.coalesce("a.Tag", F.array().cast("array<string>")).alias("tags"), F.col("a.first_seen").alias("first_seen"),
        F.col("a.last_seen").alias("last_seen"), F.array(value).alias("iocs"),
    )


def parse_feed_listing(df: DataFrame, extensions: tuple = (".txt", ".json", ".yaml")) -> DataFrame:
    """Pattern files of a repository listing (type, name, html_url)."""
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.col("name").endswith(e)
    return df.filter((F.col("type") == "file") & ends).select(
        F.lit("").alias("pattern"), F.concat(F.lit("Pattern from "), "name").alias("description"), F.col("html_url").alias("source_url")
    )


RULE_SCHEMA = "name string, severity string, enabled boolean, regex string, confidence double, mask_format string, hash_prefix string"


def load_pii_rules(spark: SparkSession, path: str, max_complexity: int = 100, max_bytes: int = 5_000_000, max_files: int = 100) -> DataFrame:
    """Custom rules of a YAML or JSON file, one row per expression.

    Only versions 1.0 and 1.1; disabled rules are left out, and a rule with one expression that
    is too complex is left out as a whole.  A rule file is configuration: its size is checked
    before it is read on the driver."""
    from rampart.functions import text as X

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    if files.filter(F.col("length") > max_bytes).limit(1).count():
        raise ValueError(f"rule file larger than {max_bytes} bytes")
    rows = []
    head = files.select("content").limit(max_files + 1).collect()
    if len(head) > max_files:
        raise ValueError(f"more than {max_files} rule files")
    for (content,) in head:
        doc = _parse_rules(bytes(content).decode("utf-8"))
        if not doc or str(doc.get("version")) not in ("1.0", "1.1"):
            continue
        for r in doc.get("custom_pii_rules") or []:
            red = r.get("redaction") or {}
            for p in r.get("patterns") or []:
                rows.append((
                    r.get("name"), r.get("severity", "medium"), bool(r.get("enabled", True)), p.get("regex"), float(p.get("confidence", 0)),
                    red.get("mask_format", "****"), red.get("hash_prefix", ""),
                ))
    rules = spark.createDataFrame(rows, RULE_SCHEMA).filter("enabled")
    heavy = rules.filter(X.regex_complexity("regex") > max_complexity).select("name").distinct()
    return rules.join(heavy, "name", "left_anti")


def _parse_rules(text: str) -> dict | None:
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as exc:
        raise ValueError("YAML rules need a YAML parser; give them as JSON") from exc
    return yaml.safe_load(text)
