"""Queries over readers, feed parsers and sinks; documents are derived from the tables, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.plans import inputs as I
from rampart.plans.inputs import with_ctes
from rampart.plans.registry import query
from rampart.plans.usage import rounded
from rampart.sources import readers as S
from rampart.sources import sinks as K


@query("read_messages", "SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND role = 'assistant' THEN 'user' ELSE role END AS role, CASE WHEN turn = 1 AND conv_id % 5 = 0 THEN '' ELSE text END AS text FROM conversations")
def _read(spark, path):
    out = K.work_folder(spark, "messages")
    c = I.table(spark, path, "conversations")
    odd = F.when((F.col("conv_id") % 7 == 0) & (F.col("role") == "assistant"), "bot").otherwise(F.col("role"))
    c.withColumns({"role": odd, "text": F.when((F.col("turn") == 1) & (F.col("conv_id") % 5 == 0), F.lit(None)).otherwise(F.col("text"))}).write.parquet(out)
    return S.read_messages(spark, out)


@query("messages_from_lists", "SELECT doc_id AS conv_id, t::BIGINT AS turn, CASE WHEN t = 0 THEN 'system' ELSE 'user' END AS role, CASE WHEN t = 2 THEN '' WHEN t = 0 THEN lang ELSE text END AS text FROM documents, (SELECT unnest([0, 1, 2]) AS t)")
def _lists(spark, path):
    item = lambda r, c: F.struct(r.alias("role"), c.alias("content"))
    null = F.lit(None).cast("string")
    d = I.table(spark, path, "documents").select("doc_id", F.array(item(F.lit("system"), F.col("lang")), item(F.lit("robot"), F.col("text")), item(null, null)).alias("m"))
    return S.messages_from_lists(d, "doc_id", "m")


@query("split_blank", "SELECT count(*) FILTER (text <> '') AS kept, count(*) FILTER (text = '') AS rejected FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents)")
def _blank(spark, path):
    d = I.table(spark, path, "documents").select(F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text")).alias("text"))
    good, bad = S.split_blank(d)
    return good.agg(F.count("*").alias("kept")).join(F.broadcast(bad.agg(F.count("*").alias("rejected"))))  # one row


@query("read_corpus", "SELECT text AS prompt, CASE WHEN toxic = 1 THEN 'jailbreak' ELSE 'benign' END AS label, toxic::INT AS is_attack FROM documents JOIN labels USING (doc_id)")
def _corpus(spark, path):
    out = K.work_folder(spark, "corpus")
    d = I.table(spark, path, "documents").join(I.table(spark, path, "labels"), "doc_id")
    d.select(F.col("text").alias("prompt"), F.when(F.col("toxic") == 1, "jailbreak").otherwise("benign").alias("label"), "source").write.json(out)
    return S.read_corpus(spark, out).select("prompt", "label", "is_attack")


#: Libraries in a file of JSON documents.
LIBRARIES = 1000


# one library per supplier; a file is a JSON array of up to LIBRARIES of them
@query("read_pattern_library", "SELECT 'lib' || s_suppkey AS family, s_suppkey::VARCHAR AS id, v AS variant, CASE v WHEN 0 THEN s_name ELSE 'variant of ' || s_name END AS text FROM supplier, (SELECT unnest([0, 1]) AS v)")
def _library(spark, path):
    out = K.work_folder(spark, "library")
    one = F.struct(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("pattern"), F.array(F.concat(F.lit("variant of "), "s_name")).alias("variants")
    )
    name = F.struct(F.concat(F.lit("lib"), F.col("s_suppkey").cast("string")).alias("name"))
    doc = F.to_json(F.struct(name.alias("metadata"), F.array(one).alias("patterns")))
    def filed(batches):
        import pandas as pd

        for pdf in batches:
            for i in range(0, len(pdf), LIBRARIES):
                yield pd.DataFrame({"value": ["[" + ",".join(pdf["value"][i : i + LIBRARIES]) + "]"]})

    docs = I.table(spark, path, "supplier").select(doc.alias("value"))
    docs.mapInPandas(filed, "value string").write.option("maxRecordsPerFile", 1).text(out)
    return S.read_pattern_library(spark, out).select("family", "id", "variant", "text")


_FEED_BODY = """CASE p_partkey % 3
  WHEN 0 THEN concat('[{"Pattern": "', p_name, '", "kind": "A"}, {"Pattern": "', p_type, '", "kind": "B"}]')
  WHEN 1 THEN concat('{"indicators": [{"Pattern": "', p_name, '", "kind": "C"}]}')
  ELSE concat('{"Pattern": "', p_name, '", "kind": "D", "seen": "2024-01-05T10:00:00"}') END"""


@query("parse_feed_json", """SELECT p_partkey, p_name AS pattern, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'c' ELSE 'd' END AS kind, CASE WHEN p_partkey % 3 = 2 THEN '2024-01-05 10:00:00' END AS seen FROM part
  UNION ALL SELECT p_partkey, p_type, 'b', NULL FROM part WHERE p_partkey % 3 = 0""")
def _json(spark, path):
    b = I.table(spark, path, "part").select("p_partkey", F.expr(_FEED_BODY).alias("body"))
    items = S.parse_feed_json(b, transforms={"kind": "lowercase", "seen": "timestamp"})
    return items.select("p_partkey", F.col("item")["Pattern"].alias("pattern"), F.col("item")["kind"].alias("kind"), F.col("item")["seen"].alias("seen"))


@query("parse_feed_csv", "SELECT s_name AS pattern, s_suppkey::VARCHAR AS id, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def _csv(spark, path):
    out = K.work_folder(spark, "csv")
    I.table(spark, path, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(out)
    return S.parse_feed_csv(spark.read.option("header", True).csv(out), {"s_name": "pattern", "s_suppkey": "id", "absent": "x"}, True)


_STIX = """concat('{"objects": [{"type": "indicator", "pattern": "', p_name, '", "name": "n", "confidence": ', cast(p_size * 3 as string), ', "labels": ["l1", "l2"], "kill_chain_phases": [{"phase_name": "x"}]},
  {"type": "malware", "pattern": "no"}, {"type": "indicator", "pattern": "', p_type, '", "description": "d"}]}')"""


@query("parse_feed_stix", "SELECT p_partkey, p_name AS pattern, 'n' AS description, least(1, p_size * 3 / 100.0)::DOUBLE AS confidence, 2 AS n_tags FROM part UNION ALL SELECT p_partkey, p_type, 'd', 0.7, -1 FROM part")
def _stix(spark, path):
    b = I.table(spark, path, "part").select("p_partkey", F.expr(_STIX).alias("body"))
    s = S.parse_feed_stix(b)
    return s.select("p_partkey", "pattern", "description", "confidence", F.coalesce(F.size("tags"), F.lit(-1)).alias("n_tags"))


_MISP = """concat('{"Event": {"Attribute": [{"value": "', p_name, '", "comment": "c", "Tag": ["t"]}, {"value": "', p_type, '", "type": "ip"}]}}')"""


@query("parse_feed_misp", "SELECT p_partkey, p_name AS pattern, 'c' AS description, 1 AS n_tags, p_name AS ioc FROM part UNION ALL SELECT p_partkey, p_type, 'ip', 0, p_type FROM part")
def _misp(spark, path):
    b = I.table(spark, path, "part").select("p_partkey", F.expr(_MISP).alias("body"))
    return S.parse_feed_misp(b).select("p_partkey", "pattern", "description", F.size("tags").alias("n_tags"), F.col("iocs")[0].alias("ioc"))


@query("parse_feed_listing", "SELECT 'Pattern from f' || page_id || CASE page_id % 4 WHEN 0 THEN '.txt' ELSE '.json' END AS description, url AS source_url FROM pages WHERE page_id % 4 < 2 AND page_id % 3 <> 0")
def _listing(spark, path):
    k = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".json", ".md", ".py")]), (k % 4 + 1).cast("int"))
    f = I.table(spark, path, "pages").select(
        F.when(k % 3 == 0, "dir").otherwise("file").alias("type"), F.concat(F.lit("f"), k.cast("string"), ending).alias("name"), F.col("url").alias("html_url")
    )
    return S.parse_feed_listing(f).select("description", "source_url")


# a rule file made from the brands: every fifth rule disabled, every fourth too complex
@query("load_pii_rules", "SELECT DISTINCT p_brand AS name, 'BR' || n || '[0-9]{6}' AS regex FROM (SELECT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part) WHERE n % 5 <> 0 AND n % 4 <> 0")
def _rules(spark, path):
    out = K.work_folder(spark, "rules")
    n = F.regexp_extract("p_brand", r"(\d+)", 1)
    b = I.table(spark, path, "part").select("p_brand").distinct()
    extra = F.when(n.cast("int") % 4 == 0, r'{"regex": "(a+)+(b*)*(c+)+d+", "confidence": 0.5},').otherwise("")
    rule = F.concat(
        F.lit('{"version": "1.0", "custom_pii_rules": [{"name": "'), "p_brand", F.lit('", "enabled": '), F.when(n.cast("int") % 5 == 0, "false").otherwise("true"),
        F.lit(', "patterns": ['), extra, F.lit('{"regex": "BR'), n, F.lit('[0-9]{6}", "confidence": 0.9}]}]}'),
    )
    b.select(rule.alias("value")).repartition(25, "value").write.option("maxRecordsPerFile", 1).text(out)
    return S.load_pii_rules(spark, out).select("name", "regex")


_BATCH = "br AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'boom' END AS error, CASE event_id % 2 WHEN 0 THEN 'block' ELSE 'allow' END AS verdict, (event_id % 100) / 100.0 AS confidence, value FROM ev)"


@query("write_batch_csv", with_ctes("ev", f""", {_BATCH} SELECT event_id::VARCHAR AS "ID", CASE WHEN error IS NULL THEN 'Yes' ELSE 'No' END AS "Success", CASE WHEN error IS NULL THEN verdict END AS "Verdict", CASE WHEN error IS NULL THEN printf('%.2f', confidence::DOUBLE) END AS "Confidence",
  CASE WHEN error IS NULL THEN 'a; b' END AS "Reasons", error AS "Error" FROM br"""))
def _batch(spark, path):
    out = K.work_folder(spark, "batch")
    e = I.events(spark, path).select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "boom").alias("error"), F.when(F.col("event_id") % 2 == 0, "block").otherwise("allow").alias("verdict"),
        ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.col("value").alias("time_ms"), F.array(F.lit("a"), F.lit("b")).alias("reasons"),
    )
    K.write_batch_csv(e, out)
    return spark.read.option("header", True).csv(out).drop("Processing Time (ms)")


@query("export_metrics_text", with_ctes("security_metrics", """SELECT split_part(line, '|', 1) AS series, count(*) AS n FROM (SELECT 'security_' || metric_type || '_' || name || '{type="' || metric_type || '"}' || '|' AS line FROM security_metrics) GROUP BY 1"""))
def _export(spark, path):
    out = K.work_folder(spark, "metrics")
    K.export_metrics(I.security_metrics(spark, path), out, "prometheus")
    return spark.read.text(out).groupBy(F.substring_index("value", " ", 1).alias("series")).agg(F.count("*").alias("n"))


def _exported(fmt):
    def run(spark, path):
        out = K.work_folder(spark, "metrics")
        K.export_metrics(I.security_metrics(spark, path).select("event_id", "metric_type", "name", "value"), out, fmt)
        back = spark.read.schema("event_id long, metric_type string, name string, value double")
        return back.json(out) if fmt == "json" else back.option("header", True).csv(out)

    return run


for _fmt in ("json", "csv"):
    query(f"export_metrics_{_fmt}", with_ctes("security_metrics", "SELECT event_id, metric_type, name, value FROM security_metrics"))(_exported(_fmt))


@query("append_experiment_tables", with_ctes("experiment_metrics", "SELECT 'exp' || (event_id % 3) AS experiment_id, 2 * count(*) AS n, round(2 * sum(value), 4) AS total FROM experiment_metrics GROUP BY 1"))
def _append(spark, path):
    base = K.work_folder(spark, "experiments")
    m = I.experiment_metrics(spark, path).withColumn("experiment_id", F.concat(F.lit("exp"), (F.col("event_id") % 3).cast("string")))
    K.append_experiment_tables({"metrics": m}, base)
    K.append_experiment_tables({"metrics": m}, base)
    return spark.read.parquet(f"{base}/metrics").groupBy("experiment_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("upsert_latest", """WITH u AS (SELECT user_id, epoch_us(ts) AS us, event_type, 0 AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, epoch_us(ts), event_type, 1 FROM events WHERE event_id % 2 = 1)
  SELECT user_id, us, event_type FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, n DESC) = 1""")
def _upsert(spark, path):
    e = I.events(spark, path).select("user_id", "us", "event_type", "event_id")
    half = lambda k: e.filter(F.col("event_id") % 2 == k).drop("event_id")
    return K.upsert_latest(half(0), half(1), ["user_id"], "us")


@query("scan_experiments", "SELECT experiment_id FROM (SELECT 'exp' || s_suppkey AS experiment_id, s_acctbal AS created_at FROM supplier WHERE s_suppkey % 4 >= 2 AND s_suppkey % 3 = 0) ORDER BY created_at DESC, experiment_id LIMIT 5 OFFSET 3")
def _scan(spark, path):
    k = F.col("s_suppkey")
    s = I.table(spark, path, "supplier").select(
        F.concat(F.lit("exp"), k.cast("string")).alias("experiment_id"), F.when(k % 4 >= 2, "running").otherwise("draft").alias("status"),
        F.when(k % 3 == 0, "strategy").otherwise("threshold").alias("type"), F.col("s_acctbal").alias("created_at"),
    )
    return K.scan_experiments(s, "running", "strategy", 5, 3).select("experiment_id")


@query("partition_by_hour", "SELECT strftime(ts, '%Y')::INT AS year, strftime(ts, '%m')::INT AS month, strftime(ts, '%d')::INT AS day, strftime(ts, '%H')::INT AS hour, count(*) AS n FROM events GROUP BY ALL")
def _hour(spark, path):
    out = K.work_folder(spark, "hours")
    h = K.partition_by_hour(I.events(spark, path).select("event_id", "ts", "value"), out)
    return h.select(*[F.col(c).cast("int").alias(c) for c in ("year", "month", "day", "hour")], "n")
