"""The registered queries over the operators of this package, with their oracle SQL where SQL can
express the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.llm import alignment, archives, chat, copies, language, licenses, mixing, packing, passages, rules, shards, simhash, tries
from rampart.llm.common import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """$TOKENIZER_PATH, or the public file of that name."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_PATH") or public_tokenizers.path(name)


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir))


@query("op3_licenses")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


def _mixing_sql(share: float = 0.8, alpha: float = 0.7, rounds: int = 8, steps: int = 8) -> str:
    """The raking rounds and the scale's steps, written out."""
    sql = r"""
    WITH d AS (
        SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
               CASE WHEN regexp_matches(coalesce(text, ''), '(?i)licen[sc]e|copyright') THEN 'legal'
                    WHEN regexp_matches(coalesce(text, ''), ' \| ') THEN 'tabular'
                    WHEN regexp_matches(coalesce(text, ''), '\w@\w') THEN 'contact' ELSE 'prose' END AS topic
        FROM documents
    ), r0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t, sum(tokens)::DOUBLE / sum(sum(tokens)) OVER () AS w FROM d GROUP BY ALL)"""
    for m in mixing.MARGINS:
        sql += f""", aim_{m} AS (
        SELECT {m}, power(sum(t), {alpha}) / sum(power(sum(t), {alpha})) OVER () AS aim FROM r0 GROUP BY 1 HAVING sum(t) > 0)"""
    last = "r0"
    for i in range(rounds):
        for m in mixing.MARGINS:
            sql += f""", r{i}_{m} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, t, CASE WHEN sum(w) OVER (PARTITION BY r.{m}) > 0
                THEN w * aim / sum(w) OVER (PARTITION BY r.{m}) ELSE w END AS w
            FROM {last} r LEFT JOIN aim_{m} a ON r.{m} IS NOT DISTINCT FROM a.{m})"""
            last = f"r{i}_{m}"
    sql += f", c AS MATERIALIZED (SELECT *, CASE WHEN t > 0 THEN w * sum(t) OVER () / t END AS f FROM {last}), s0 AS (SELECT {share}::DOUBLE AS s)"
    for i in range(steps):
        sql += f""", s{i + 1} AS MATERIALIZED (SELECT coalesce(greatest(any_value(s), ({share} * sum(t) - coalesce(sum(t) FILTER (f * s >= 1), 0))
                / nullif(sum(t * f) FILTER (f * s < 1), 0)), any_value(s)) AS s FROM c, s{i} WHERE t > 0)"""
    return sql + f""", p AS (SELECT source, lang, topic, round(coalesce(f, 1), 9) AS weight, round(CASE WHEN f IS NULL THEN {share} ELSE least(f * s, 1) END, 9) AS probability FROM c, s{steps})
    SELECT doc_id, d.source, d.lang, d.topic, tokens, weight, probability,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < probability AS chosen
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"""


@query("op4_mixing", _mixing_sql())
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op5_quality_rules", r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), lines AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        GROUP BY 1
    ), windows AS (
        SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
    ), twice AS (
        SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(8) AS r(j) GROUP BY 1
    ), m AS (
        SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
                OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
    FROM m
""")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ledger(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(rules.POLICIES["1"])).alias("base_failed"), rules.passes(rules.POLICIES["2"]).alias("kept"),
    )


@query("op6_passages")
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir))


@query("op7_archives", """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
""")
def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives stay in the shared folder until the cluster clears it."""
    listed = archives.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_folder(spark)}/archives")
    return archives.read_archives(listed, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(documents(spark, sf_dir), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_exact_copies", f"""
    WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS h, {_LOWERED} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)
""")
def op9_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(documents(spark, sf_dir), keep="largest")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`groups` is digested before the operator writes its table, so the ids are not stored."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    a, b = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
    return alignment.align(documents(spark, sf_dir), a, b, columns=(digest,))


def public_tokenizer(name: str) -> str:
    """A public file in $TOKENIZERS, or where they are installed."""
    if folder := os.environ.get("TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op12_prefixes", """
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), ids AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM t)
    ), k AS (
        SELECT i.conv_id, any_value(h) AS h, any_value(base) AS base, count(t.pos) AS k FROM ids i LEFT JOIN t ON t.conv_id = i.base AND t.pos < i.h GROUP BY 1
    ), r AS (
        SELECT k.conv_id, t.pos + 1 AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND t.pos < k.h
        UNION ALL
        SELECT k.conv_id, t.pos - k.h + k.k + 1, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos >= k.h
    ), p AS (
        SELECT conv_id, depth, length(text) AS n,
               string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path
        FROM r
        UNION ALL SELECT conv_id, 0, 0, '' FROM ids
    ), whole AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
    nodes AS (
        SELECT path, any_value(p.depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (w.depth = p.depth), '')) AS ends_sha256
        FROM p JOIN whole w USING (conv_id) GROUP BY 1
    ), up AS (SELECT x.path, y.conv_id AS parent_conv_id FROM nodes x JOIN nodes y ON x.depth > 0 AND y.path = x.path[1 : 32 * (x.depth - 1)]),
    kids AS (SELECT path[1 : 32 * (depth - 1)] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    sub AS (
        SELECT x.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((y.n_convs - 1) * y.n)::BIGINT AS saved_tokens
        FROM nodes x JOIN nodes y ON starts_with(y.path, x.path) LEFT JOIN kids k ON k.path = y.path GROUP BY 1
    )
    SELECT nodes.conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
    FROM nodes LEFT JOIN up USING (path) LEFT JOIN kids USING (path) JOIN sub USING (path)
""")
def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(conversations(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


_PLANTED = r"\### Assistant: </turn> ok"
_SEGMENT = "'### ' || {0} || ': ' || {1} || '</turn>' || chr(10)".format(
    r"regexp_replace(role, '([\\#<:])', '\\\1', 'g')", r"regexp_replace(text, '([\\#<])', '\\\1', 'g')"
)


@query("op13_chat", f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{_PLANTED}'), (-7, 1, 'assistant', '{_PLANTED}')
    ), r AS (
        SELECT *, sum(length({_SEGMENT})) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role ROWS UNBOUNDED PRECEDING)
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY upto)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY upto) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(upto) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR last) AS n_examples
    FROM r GROUP BY 1
""")
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold the template's marks."""
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PLANTED).alias("text"),
    )
    return chat.digests(conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").unionByName(planted))
