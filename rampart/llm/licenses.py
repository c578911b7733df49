"""License scans by diagonal voting.

Texts lose everything but letters, digits and characters beyond ASCII, A-Z lower-cased; what
remains are words.  Every rolling k-gram of words is looked up among the templates' k-grams; the
hits are joined to the template positions that hold the gram.  Position in the text minus position
in the template is a hit's diagonal.  Hits vote for diagonals; each diagonal and its neighbours
(words put in or left out) up to half a notice away make a window, and a window counts if enough of
the template's grams are in it.  Of overlapping windows the one whose own diagonal has most votes
stays, so stray pieces of a notice near a whole one neither hide nor stretch it.

Phrases (k = 2) must be there word by word.  Notices (k = 4) may differ a little.

Null text has no words.  Rows without an id and repeated rows are scanned like any other; empty
tables give empty results; columns besides id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.llm.common import pieces, raw, texts, written

#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences of well-known notices -> label.  At most 60 words each.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
    "distributed with this file": "mpl",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
    "compile sell or distribute this software": "unlicense",
    "this work is licensed under a creative commons attribution": "cc",
}
#: The share of a notice's grams that a span must hold.
ENOUGH = 0.5
#: Diagonals at most so far apart belong to one span.
SHIFT = 6
PHRASE_K, NOTICE_K = 2, 4

_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split(b" ") if text else []


def _gram(words: list[bytes]) -> int:
    h = xxhash.xxh64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def template_grams(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[tuple]:
    """(words, gram, template, label, is_phrase, position, grams of the template)."""
    out = []
    for t, (line, label) in enumerate([*phrases.items(), *notices.items()]):
        words, phrase = line.encode().split(), t < len(phrases)
        k = PHRASE_K if phrase else NOTICE_K
        n = len(words) - k + 1
        if not 0 < n <= 62:
            raise ValueError(f"a template needs {k} to {61 + k} words: {line}")
        out += [(tuple(words[i : i + k]), _gram(words[i : i + k]), t, label, phrase, i, n) for i in range(n)]
    return out


def hits_of(words: list[bytes], starts: dict[bytes, tuple[int, ...]], grams: dict[tuple[bytes, ...], int]) -> list[tuple[int, int]]:
    """(position, gram) of the text's k-grams that are a template's."""
    found = []
    for i, w in enumerate(words):
        if w in starts:
            for k in starts[w]:
                g = grams.get(tuple(words[i : i + k]))
                if g is not None:
                    found.append((i, g))
    return found


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Two tables.  Rows: _row, doc_id, n_words, one per row of `docs`.  Spans: _row, template,
    label, is_phrase, first_word, last_word, coverage."""
    spark = docs.sparkSession
    known = template_grams(phrases, notices)
    grams = {words: g for words, g, *_ in known}
    starts: dict[bytes, tuple[int, ...]] = {}
    for words in grams:
        starts[words[0]] = tuple(sorted({*starts.get(words[0], ()), len(words)}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                n, hits = [], []
                for text in raw(part.column(1)):
                    words = [w for w in words_of(text) if w]
                    n.append(len(words))
                    hits.append([{"pos": p, "gram": g} for p, g in hits_of(words, starts, grams)])
                kind = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])

    scanned = texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_words long, hits array<struct<pos: long, gram: long>>")
    scanned = written(scanned.withColumn("_row", F.monotonically_increasing_id()))
    table = spark.createDataFrame([k[1:] for k in known], "gram long, template int, label string, is_phrase boolean, tpos int, grams int")
    hits = scanned.select("_row", F.explode("hits").alias("h")).select("_row", "h.pos", "h.gram")
    met = hits.join(F.broadcast(table), "gram").withColumn("diagonal", F.col("pos") - F.col("tpos"))  # the templates' few hundred grams
    key = ["_row", "template", "label", "is_phrase", "grams"]
    votes = met.groupBy(*key, "diagonal").agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    along = W.partitionBy("_row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT) | F.col("is_phrase")
    chains = votes.withColumn("chain", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(along))
    # diagonals of a chain up to half a notice away: a span is never longer than two notices
    near = W.partitionBy("_row", "template", "chain").orderBy(F.expr(f"diagonal * 1000 div (grams + {NOTICE_K})")).rangeBetween(-500, 500)
    windows = chains.withColumns({
        "all": F.bit_or("held").over(near), "first_word": F.min("first").over(near), "last_word": F.max("last").over(near),
    }).withColumn("coverage", F.bit_count("all") / F.col("grams"))
    windows = windows.filter(F.col("coverage") >= F.when(F.col("is_phrase"), 1.0).otherwise(ENOUGH))
    best = F.struct(F.bit_count("held"), "coverage", -F.col("diagonal"))  # of windows that overlap
    k = F.when(F.col("is_phrase"), PHRASE_K).otherwise(NOTICE_K)
    spans = windows.withColumn("_best", F.max(best).over(near) == best).filter("_best")
    spans = spans.withColumn("last_word", F.col("last_word") + k - 1)
    rows = scanned.select("_row", "doc_id", "n_words")
    return rows, spans.select("_row", "template", "label", "is_phrase", "first_word", "last_word", "coverage")


def licenses(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row
    of `docs`.  The base columns are those of the phrases; the score is the best coverage."""
    rows, spans = scan_licenses(docs, **options)
    base = F.col("is_phrase")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("_row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"), F.max("coverage").alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(found, "_row", "left").na.fill(none).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
