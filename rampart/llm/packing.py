"""Packing by power-of-two decomposition.

The tokens of a document, its end token included, are cut from the left into pieces of the
largest power of two that still fits, `longest` at most.  Every piece is a sequence of its own
and pieces of one length share a bucket: no sequence crosses documents and nothing is padded.

Null text counts as empty (one piece with the end token alone).  Repeated rows and rows without
an id are packed like any other.  Empty tables give empty results.  Texts of any length are
tokenized chunk by chunk between white space; columns besides id and text are not read."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.llm.common import FEW, texts, written
from rampart.llm.common import pieces as slices

#: Distinct chunks whose ids a Python worker remembers; it forgets them all beyond that.
REMEMBERED = 200_000

_SPACE = re.compile(r"[ \t\n\r]+")
#: Chunks of these characters are the same after NFC, and one-to-one in lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer file's own split, over those characters in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_END = "\0"


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others for 256, 257 and so on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in printable):
        table[chr(256 + i)] = b
    return table


class WordTokenizer:
    """Ids of a word-level BPE file of `tokenizers`, as little-endian unsigned 32-bit integers.

    Merges never cross white space, so a text's ids are those of its chunks.  Chunks of plain
    characters go through `tiktoken` with the file's merges as ranks and the word end as a
    byte; any other chunk goes through `tokenizers` itself."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of, suffix = _byte_of(), file["model"]["end_of_word_suffix"]
        special = {t["content"] for t in file["added_tokens"]}
        ranks, ends = {}, set()
        for token, i in file["model"]["vocab"].items():
            if token in special:
                continue
            body = token.removesuffix(suffix)
            if body != token:
                ends.add(i)
            ranks[bytes(byte_of[c] for c in body) + (_END.encode() if body != token else b"")] = i
        self.fast = tiktoken.Encoding("word", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.is_end = np.zeros(max(ranks.values()) + 1, bool)
        self.is_end[list(ends)] = True
        self.known: dict[str, bytes] = {}

    @property
    def slow(self):
        """Loaded by the first chunk that needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks that are not known yet, all plain ones in one call."""
        plain = [c for c in chunks if _PLAIN.fullmatch(c) and "<|" not in c]
        for c in chunks.difference(plain):
            self.known[c] = np.array(self.slow.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        if not plain:
            return
        parts = [_PARTS.findall(c.lower()) for c in plain]
        ids = self.fast.encode_to_numpy(_END.join(p for ps in parts for p in ps) + _END).astype("<u4")
        stops = np.flatnonzero(self.is_end[ids]) + 1  # a part ends where a token ends a word
        at, part = 0, 0
        for c, ps in zip(plain, parts):
            part += len(ps)
            stop = int(stops[part - 1])
            self.known[c] = ids[at:stop].tobytes()
            at = stop

    def ids(self, text: str) -> bytes:
        chunks = [c for c in _SPACE.split(text) if c]
        new = {c for c in chunks if c not in self.known}
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(chunks)
            self._learn(new)
        return b"".join(map(self.known.__getitem__, chunks))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as full pieces and then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cutter(path: str, end_id: int, longest: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = tokenizer(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch):
                doc, start, length, crc, total, rank, ids = [], [], [], [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    row = (tok.ids(text) if text else b"") + end
                    n, at = len(row) // 4, 0
                    for size in binary_lengths(n, longest):
                        piece = row[4 * at : 4 * (at + size)]
                        doc.append(i), start.append(at), length.append(size)
                        crc.append(zlib.crc32(piece)), total.append(n), rank.append(seen[size])
                        seen[size] += 1
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype("i4"))
                        at += size
                columns = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, total, np.full(len(doc), task), rank)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_task", "_rank"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    `with_ids`, the ids.  `longest` is a power of two.

    Equal lengths are a bucket: sequence ids run through the lengths, longest first, without gaps, and through the
    input's partitions.  A task numbers its pieces of each length while it cuts them and writes them; how
    many there are before a task's (a row for each task and length) is added when they are read, so no piece is shuffled."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _task long, _rank long" + (", ids array<int>" if with_ids else "")
    cut = written(texts(docs, id_col, text_col).mapInArrow(_cutter(tokenizer_path, end_id, longest, with_ids), schema))
    counts = cut.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    longer = counts.groupBy("length").agg(F.sum("_n").alias("_m"))
    longer = longer.select("length", F.coalesce(F.sum("_m").over(W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_m"))  # a row per length
    bases = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(longer, "length").select("length", "_task", (F.col("_m") + F.col("_before")).alias("_base")))
    if bases.count() <= FEW:
        bases = F.broadcast(bases)  # else the optimizer decides
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return cut.join(bases, ["length", "_task"]).select(
        *columns, (F.col("_base") + F.col("_rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []),
    )
