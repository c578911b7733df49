"""Alignment of two tokenizers over the same texts, with counts of the linked ids.

A byte-level BPE file of `tokenizers` (A) encodes space + text, a `sentencepiece` model (B), which puts
that space in itself, the text.  Character offsets of A and the spans of B's proto (return_type "proto", which
took the place of the immutable proto) are the coarse cuts: places where both say that a token ends.
A cut counts only where the decoded bytes of both end there too.  Between coarse cuts, wherever a token
is no whole number of characters (parts of a multibyte character, byte-fallback pieces) or a span
disagrees with the bytes, the ends of the decoded bytes refine the cuts.  What lies between two cuts is
a group; an A and a B token whose byte ranges overlap are linked.

Neither tokenizer merges across a single space between two other characters: A's pattern splits there,
and no piece of B has a space behind another character (looked up in the model; if one had, texts would
go through whole).  So texts are cut at such spaces, each distinct chunk is encoded and aligned once,
and a text is its chunks one after the other.  A text with a chunk of which the bytes do not come
back (U+2581, for one) is encoded whole, and has no tokens if its bytes do not come back either.

Special tokens' strings inside texts are plain text.  Null and empty texts and texts that are no UTF-8 have no
tokens: zeros and no groups.  Repeated rows and rows without an id are rows like any other, and their links
count.  Empty tables give empty results; columns besides id and text are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import pieces, raw, texts, written

#: Distinct chunks that a Python worker remembers; it forgets them all beyond that.
REMEMBERED = 600_000
#: Characters encoded in one call: few, since a call's cost grows faster than they do.
BLOB = 1 << 11
#: The most frequent pairs, at most so many rows, are broadcast; all others are joined.
FREQUENT = 1 << 16

_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s|\A\s|\s\Z")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others for 256, 257 and so on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def cut(text: str) -> list[str]:
    """The chunks between single spaces that stand between other characters than white space."""
    return _CUT.split(text) if _WIDE.search(text) else text.split(" ")


def _in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; y is sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The union of two sorted arrays without repeats."""
    return np.sort(np.concatenate((x, y[~_in(y, x)])), kind="stable")


class Side:
    """The decoded bytes of a vocabulary, and what its ids are written as: inside a group, at its end."""

    def __init__(self, tokens: list[bytes], end: str):
        self.tokens = tokens
        self.written = [f"{i}{c}" for i in range(len(tokens)) for c in (",", end)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.whole = np.array([_whole(t) for t in tokens], bool)


class Aligner:
    """Both tokenizers, and what was found for the chunks seen last."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        table, tokens = byte_of(), [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            tokens[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        found = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        decoded = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(found)]
        self.sides = Side(tokens, "|"), Side(decoded, ";")
        self.names = self.sides[0].written + self.sides[1].written
        self.chunked = not any(re.search("[^▁]▁", p) for p in found)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.links = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []  # of the chunks learned last

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends in bytes of space + text as the libraries tell them; A's ends are characters' ends."""
        found = self.a.encode(" " + text, add_special_tokens=False)
        pieces_ = self.b.encode(text, return_type="proto").pieces
        data = (" " + text).encode()
        ends = np.fromiter(map(itemgetter(1), found.offsets), np.int64, len(found))
        if len(data) > len(text) + 1:
            ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))[ends]
        b, ends_b = (np.fromiter(x, np.int64, len(pieces_)) for x in ((p.id for p in pieces_), (p.end for p in pieces_)))
        return np.array(found.ids, np.int64), ends, b, ends_b + 1

    def align(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids and byte ends of both sides, and the cuts; nothing if the bytes do not come back."""
        a, said_a, b, said_b = self.spans(text)
        data, (left, right) = (" " + text).encode(), self.sides
        if b"".join(map(left.tokens.__getitem__, a.tolist())) != data or b"".join(map(right.tokens.__getitem__, b.tolist())) != data:
            return None
        ends_a, ends_b = np.cumsum(left.size[a]), np.cumsum(right.size[b])
        agrees_a, agrees_b = said_a == ends_a, said_b == ends_b
        cuts = said_a[agrees_a]
        cuts = cuts[_in(cuts, said_b[agrees_b])]
        part_a, part_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        open_ = np.union1d(part_a[~(agrees_a & left.whole[a])], part_b[~(agrees_b & right.whole[b])])
        if len(open_):
            fine = ends_a[_in(part_a, open_)]
            cuts = _merged(cuts, fine[_in(fine, ends_b[_in(part_b, open_)])])
        return a, ends_a, b, ends_b, cuts

    def _add(self, found: tuple[np.ndarray, ...], stops: np.ndarray) -> None:
        """Chunks that end at the bytes `stops`; their groups are written with a `;` behind each."""
        a, ends_a, b, ends_b, cuts = found
        points = _merged(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, points)] * len(self.sides[1].tokens) + b[np.searchsorted(ends_b, points)]
        upto = [np.searchsorted(e, stops) + 1 for e in (ends_a, ends_b, cuts, points)]
        self.new.append((np.diff(np.stack(upto, 1), axis=0, prepend=0), links))
        # in a group A's ids stand before B's: each id moves behind those of the other side that come first
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + _in(ends_a, cuts)
        line[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (b + len(self.sides[0].tokens)) + _in(ends_b, cuts)
        names = list(map(self.names.__getitem__, line.tolist()))
        at = [0, *(upto[0] + upto[1]).tolist()]
        self.text += ["".join(names[s:e]) for s, e in zip(at, at[1:])]

    def _learn_one(self, chunk: str) -> int:
        """The number of a chunk aligned by itself; -1 if its bytes do not come back."""
        found = self.align(chunk)
        if found is None:
            return -1
        self._add(found, found[1][-1:])
        return len(self.text) - 1

    def _learn(self, chunks: list[str]) -> None:
        inner = [c for c in chunks if not (c[0].isspace() or c[-1].isspace())]
        for c in set(chunks).difference(inner):
            self.number[c] = self._learn_one(c)
        at = 0
        while at < len(inner):
            size, first = 0, at
            while at < len(inner) and size < BLOB:
                size += len(inner[at])
                at += 1
            some = inner[first:at]
            stops = np.cumsum([len(c.encode()) + 1 for c in some])
            found = self.align(" ".join(some))
            if found is None or not _in(stops, found[4]).all():
                for c in some:
                    self.number[c] = self._learn_one(c)
                continue
            self.number |= dict(zip(some, range(len(self.text), len(self.text) + len(some))))
            self._add(found, stops)

    def chunks(self, found: list[str | None]) -> list[list[int]]:
        """The chunk numbers of each text; none for a text without tokens."""
        if len(self.number) > REMEMBERED:
            self.forget()
        chunks = [cut(t) if t and self.chunked else [t] if t else [] for t in found]
        out = [list(map(self.number.get, cs)) for cs in chunks]
        open_ = [n for n, numbers in enumerate(out) if None in numbers]
        if open_:
            self._learn(list({c for n in open_ for c, k in zip(chunks[n], out[n]) if k is None}))
            for n in open_:
                out[n] = list(map(self.number.__getitem__, chunks[n]))
        for n, numbers in enumerate(out):
            if -1 in numbers:
                whole = -1 if len(numbers) == 1 else self._learn_one(found[n])
                out[n] = [] if whole < 0 else [whole]
        if self.new:
            sizes, links = zip(*self.new)
            self.sizes, self.links, self.new = np.concatenate((self.sizes, *sizes)), np.concatenate((self.links, *links)), []
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    key = (a_path, b_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _text(data: bytes | None) -> str | None:
    try:
        return data.decode() if data else None
    except UnicodeDecodeError:
        return None


_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: the ids in
    order), and of each linked pair in the text its code (A id times the size of B's vocabulary plus
    B id) and its number of links."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = aligner(a_path, b_path)
        span = len(with_.sides[0].tokens) * len(with_.sides[1].tokens)
        for batch in batches:
            for part in pieces(batch, 256):
                lists = with_.chunks([_text(t) for t in raw(part.column(1))])
                rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                numbers = np.fromiter(chain.from_iterable(lists), np.int64, len(rows))
                sizes = with_.sizes[numbers]
                totals = np.zeros((len(lists), 4), np.int64)
                np.add.at(totals, rows, sizes)
                stops = np.cumsum(with_.sizes[:, 3])
                n_links = sizes[:, 3]
                at = np.arange(n_links.sum()) + np.repeat(stops[numbers] - np.cumsum(n_links), n_links)
                pairs, times = np.unique(np.repeat(rows, n_links) * span + with_.links[at], return_counts=True)
                edges = pa.array(np.searchsorted(pairs, np.arange(len(lists) + 1) * span), pa.int32())
                groups = ["".join(map(with_.text.__getitem__, x))[:-1] for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c) for c in totals.T), pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(edges, pa.array(pairs % span)), pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int64)))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    return texts(docs, id_col, text_col).mapInArrow(scan, _FOUND)


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """pair, count, best: over all texts, the links of each pair, and whether its B id has no pair with more."""
    counts = found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counts = written(counts)
    b = (F.col("pair") % F.lit(b_size)).alias("_b")
    most = counts.groupBy(b).agg(F.max("count").alias("_most"))
    return written(counts.withColumn("_b", b).join(most, "_b").select("pair", "count", (F.col("count") == F.col("_most")).alias("best")))


def align(
    docs: DataFrame, a_path: str, b_path: str, columns: tuple[Column | str, ...] = ("groups",), frequent: int = FREQUENT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count over all texts is the
    highest of their B id, ties included), count_sum (over links), and `columns` over the groups.

    Texts are encoded once.  Pairs counted more often than the `frequent`-th are a broadcast table of
    fewer rows than that; the rest, none of them frequent, meets its counts in a shuffled join."""
    b_size = _vocabulary(b_path)
    totals = ["n_a", "n_b", "n_groups", "n_links"]
    rows = aligned(docs, a_path, b_path, id_col, text_col)
    rows = written(rows.select("doc_id", *totals, *columns, F.monotonically_increasing_id().alias("_row"), "pairs", "times"))
    counts = pair_counts(rows, b_size)
    top = counts.orderBy(F.desc("count")).limit(frequent + 1).agg(F.count("*"), F.min("count")).first()
    least = top[1] if top[0] > frequent else 0
    often = F.broadcast(counts.filter(F.col("count") > least))  # at most `frequent` rows
    each = rows.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    score = [F.when(F.col("best"), F.col("times")).otherwise(0).alias("_best"), (F.col("times") * F.col("count")).alias("_sum")]
    met = each.join(often, "pair").select("_row", *score)
    if least:
        seldom = each.join(often.select("pair"), "pair", "left_anti").join(counts.filter(F.col("count") <= least), "pair")
        met = met.unionByName(seldom.select("_row", *score))
    sums = met.groupBy("_row").agg(F.sum("_best").alias("_best"), F.sum("_sum").alias("_sum"))
    kept = [c for c in rows.columns if c not in ("doc_id", *totals, "_row", "pairs", "times")]
    return rows.drop("pairs", "times").join(sums, "_row", "left").select(
        "doc_id", *totals, F.coalesce("_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("_sum", F.lit(0)).cast("long").alias("count_sum"), *kept,
    )


def _vocabulary(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
