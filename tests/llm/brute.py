"""Plain Python versions of the operators, and rows with awkward values."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame, SparkSession

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "the QUICK brown fox jumps over the lazy dog", None, "a", 43),
    (3, "The quick brown fox jumps over the lazy dog", "en", None, None),
    (3, "The quick brown fox jumps over the lazy dog", "en", None, None),
    (4, None, "en", "b", None),
    (5, "", None, None, 0),
    (6, " \t\n ", "fr", "b", 4),
    (None, "ÉCOLE École école <|endoftext|> á Σς 東京 it's 12 <| \x00 x", "fr", "b", 30),
    (None, None, None, None, None),
    (7, "one two", "en", "a", 7),
    (8, "word " * 30_000, "en", "a", 150_000),
    (9, "12345 --- !!!", "en", "a", 13),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark: SparkSession) -> DataFrame:
    """With columns whose names operators also use."""
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    return docs.selectExpr("*", "1 as kept", "'x' as size", "2 as fp", "3 as _h", "4 as `shard`", "5 as `a.b`", "6 as tokens")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text: str | None, words: int = 3) -> int:
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids: list, linked) -> dict:
    """Position -> set of positions it is connected to."""
    seen, out = set(), {}
    for i in range(len(ids)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(len(ids)):
                if y not in group and linked(x, y):
                    group.add(y)
                    todo.append(y)
        seen |= group
        for x in group:
            out[x] = group
    return out


def near_copies(rows: list[tuple], bits: int = 2) -> list[tuple]:
    fps = [fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    of = classes(ids, lambda x, y: (fps[x] ^ fps[y]).bit_count() <= bits)
    return [(ids[k], f"{fps[k]:016x}", min((ids[x] for x in of[k] if ids[x] is not None), default=None)) for k in range(len(rows))]


def shingle_set(text: str | None, words: int = 5) -> set:
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))} if found else set()


def resembling(rows: list[tuple], similarity: float = 0.8, bits: int = 2) -> dict:
    """Position -> positions it is connected to by fingerprints or shingle sets."""
    fps, sets = [fingerprint(t) for _, t in rows], [shingle_set(t) for _, t in rows]

    def linked(x: int, y: int) -> bool:
        return (fps[x] ^ fps[y]).bit_count() <= bits or len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y]) > 0

    return classes(rows, linked)


def exact_copies(rows: list[tuple]) -> list[tuple]:
    low = [(i, (t or "").encode().lower()) for i, t in rows]
    groups = defaultdict(list)
    for i, t in low:
        groups[t].append(i)
    out = []
    for i, t in low:
        ids = groups[t]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t).hexdigest()))
    return out


def pieces(rows: list[tuple], path: str, longest: int = 2048) -> list[tuple]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out = []
    for i, t in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        while at < len(ids):
            n = min(longest, 1 << ((len(ids) - at).bit_length() - 1))
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n]))
            out.append((i, at, n, crc, len(ids)))
            at += n
    return out
