"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger holds the measurements and one bit per
failed rule.  Policies are versioned masks over those bits, and ablations (what a policy would
keep without one of its rules) are sums over the few distinct masks, so neither reads a text again.

Null text has no words.  Rows without an id and repeated rows are measured like any other; empty
tables give empty results; columns besides id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import pieces, raw, texts

WINDOW = 8
#: Name -> SQL condition under which the rule fails; the position is the bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
}
#: Version -> names of its rules.
POLICIES = {
    "1": ("few_words", "repeated_words"),
    "2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
}

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _SYMBOL, _INNER = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[list(b"#*$%&|<>")] = _SYMBOL
_KIND[0x80:0xC0] = _INNER  # a byte within a code point


def repeated_words(words: list[bytes]) -> int:
    """Words within a window of eight words that occurs at least twice, by exact comparison."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + ids[j : n - WINDOW + 1 + j].astype(np.uint64) + np.uint64(1)
    h *= _MIX
    order = np.argsort(h, kind="stable")
    meet = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(meet):
        return 0
    view = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    a, b = order[meet], order[meet + 1]
    if (view[a] == view[b]).all():
        found = np.union1d(a, b)
    else:  # unequal windows share a hash: compare the words of all that met
        at: dict[bytes, list[int]] = {}
        for p in np.union1d(a, b).tolist():
            at.setdefault(view[p].tobytes(), []).append(p)
        found = np.array([p for ps in at.values() if len(ps) > 1 for p in ps], np.int64)
    step = np.zeros(n + 1, np.int64)
    step[found] += 1
    step[found + WINDOW] -= 1
    return int((np.cumsum(step) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    words = text.split() if text else []
    kinds = np.bincount(_KIND[np.frombuffer(text or b"", np.uint8)], minlength=4)
    if not words:  # white space alone has no symbols
        return 0, 0, 0, 0, 0, 0
    lines = [line for line in text.split(b"\n") if line.split(None, 1)] if b"\n" in text else [text]
    chars = len(text) - int(kinds[_INNER]) - int(kinds[_SPACE])
    return len(words), chars, int(kinds[_SYMBOL]), len(lines), len(lines) - len(set(lines)), repeated_words(words)


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, rules: dict[str, str] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and fail_bits, one row per row of `docs`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [measure(t) for t in raw(part.column(1))]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(NUMBERS))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *NUMBERS])

    measured = texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, " + ", ".join(f"{n} long" for n in NUMBERS))
    bits = " + ".join(f"if({sql}, {1 << bit}L, 0L)" for bit, sql in enumerate(rules.values())) or "0L"
    return measured.withColumn("fail_bits", F.expr(bits))


def mask(names: tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    return sum(1 << bit for bit, name in enumerate(rules) if name in names)


def passes(names: tuple[str, ...], rules: dict[str, str] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules)).cast("long")) == 0


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """policy, without (null: the whole policy), kept, total: from the counts of distinct masks, of
    which there are at most 2 ** len(rules)."""
    cases = [(v, None, mask(names, rules)) for v, names in policies.items()]
    cases += [(v, out, mask(tuple(n for n in names if n != out), rules)) for v, names in policies.items() for out in names]
    table = rows.sparkSession.createDataFrame(cases, "policy string, without string, _mask long")
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("_n"))
    ok = F.when(F.col("fail_bits").bitwiseAND(F.col("_mask")) == 0, F.col("_n")).otherwise(0)
    met = table.join(F.broadcast(counts))  # at most 2 ** len(rules) rows
    return met.groupBy("policy", "without").agg(F.sum(ok).alias("kept"), F.sum("_n").alias("total"))
