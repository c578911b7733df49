"""Near-duplicates by SimHash, candidates by pigeonring chains.

A text's fingerprint has a bit where more than half of its shingles' XXH64 hashes have it; fewer
words than a shingle are one shingle, and a text without words (or null) has the fingerprint zero.
Fingerprints that differ in at most `bits` bits are linked; classes are the connected components.

Pigeonring: cut the 64 bits into m segments in a ring.  If two fingerprints differ in at most t
bits, some segment starts a chain of which every prefix of l segments differs in at most l * t / m
bits.  The longest prefix with a budget below one bit must be equal: it is the join key.  The rest
of the chain is checked segment by segment before the Hamming distance.

A key that a great many fingerprints share (near copies agree in most segments) is not paired up.
There each fingerprint is tied to the numbers at most bits/2 flips away, and two fingerprints at
most `bits` apart meet in one of those: exact, and linear in the bucket.

Repeated rows and rows without an id take part; a class without any id has a null id."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm import resemblance
from rampart.llm.common import ascii_lower, bitmap, discard, marked, pieces, raw, small_batches, texts, written
from rampart.llm.components import components

SEED = 42
#: Shingles hashed at a time, whatever the length of a text.
CHUNK = 1 << 16
_BITS_OF = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes | None, words: int) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    found = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    n = max(len(found) - words + 1, 1)
    ones = np.zeros((8, 256), np.int64)
    for at in range(0, n, CHUNK):
        some = found[at : at + CHUNK + words - 1]
        line = b" ".join(some)
        stops = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate(([0], stops[:-1] + 1))
        last = min(words, len(some)) - 1
        k = len(some) - last
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:k].tolist(), stops[last:].tolist())), "<u8", k)
        ones += np.bincount((hashes.view("u1").reshape(-1, 8) + (np.arange(8) << 8)).ravel(), minlength=2048).reshape(8, 256)
    bits = (ones @ _BITS_OF).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fps = pa.array([fingerprint(t, words) for t in raw(part.column(1))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, fp long")


def segments(m: int) -> list[int]:
    """Masks of m nearly equal segments of 64 bits, as signed numbers."""
    edges = [64 * i // m for i in range(m + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def chain_budgets(m: int, bits: int) -> list[int]:
    """Of l consecutive segments, l = 1 .. m: the most bits that may differ."""
    return [length * bits // m for length in range(1, m + 1)]


def _chain(i: int, m: int, length: int, masks: list[int]) -> int:
    return reduce(lambda x, y: x | y, (masks[(i + j) % m] for j in range(length)))


def links(fps: DataFrame, bits: int = 2, m: int = 7, paired: int = 64) -> DataFrame:
    """a, b: ties between distinct fingerprints such that the connected components are those of all
    pairs at most `bits` apart.  `paired`: keys with more fingerprints are tied through numbers
    near them instead of in pairs; what is linked stays the same."""
    if bits % 2:  # balls of (bits + 1) / 2 flips also meet one bit further apart
        raise ValueError("an odd number of bits would need a second kind of centre")
    masks, budgets = segments(m), chain_budgets(m, bits)
    equal = sum(b == 0 for b in budgets)  # this many segments must agree
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_chain(i, m, equal, masks))).alias("v")) for i in range(m)
    ])).alias("_k")).select("fp", "_k.i", "_k.v")
    sizes = keyed.groupBy("i", "v").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = written(keyed.join(sizes, ["i", "v"]))
    few, many = shared.filter(F.col("_n") <= paired).drop("_n"), shared.filter(F.col("_n") > paired)
    x = F.col("fp").bitwiseXOR(F.col("_o"))
    within: Column = F.bit_count(x) <= bits
    chain = F.lit(False)
    for i in range(m):
        ok = F.col("i") == i
        for length in range(equal + 1, m + 1):
            ok = ok & (F.bit_count(x.bitwiseAND(F.lit(_chain(i, m, length, masks)))) <= budgets[length - 1])
        chain = chain | ok
    pairs = few.join(few.select("i", "v", F.col("fp").alias("_o")), ["i", "v"]).filter("fp < _o").filter(chain).filter(within)
    pairs = pairs.select(F.col("fp").alias("a"), F.col("_o").alias("b"))
    flips = [sum(1 << b for b in c) for r in range(bits // 2 + 1) for c in combinations(range(64), r)]
    near = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f - (1 << 64) if f >> 63 else f)) for f in flips]))
    balls = many.select("fp").distinct().select("fp", near.alias("_c"))
    centres = balls.groupBy("_c").agg(F.min("fp").alias("a"), F.count("*").alias("_n")).filter("_n > 1")
    ties = balls.join(centres, "_c").filter("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(ties).distinct()


def near_copies(docs: DataFrame, words: int = 3, bits: int = 2, m: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per row of `docs`."""
    rows = written(fingerprints(docs, words, id_col, text_col))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("_id")))
    roots = components(links(distinct.select("fp"), bits, m))
    classes = distinct.join(roots, distinct["fp"] == roots["id"], "left").select("fp", "_id", F.coalesce("root", "fp").alias("_root"))
    classes = written(classes)
    named = classes.join(classes.groupBy("_root").agg(F.min("_id").alias("component_id")), "_root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, words: int = 3, bits: int = 2, m: int = 7, shingle: int = 5, similarity: float = 0.8, paired: int = 32,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, all columns, of which one of each class stays: the smallest id, a missing
    one last, ties broken by the other columns.  Classes are the connected components of linked
    fingerprints together with texts whose sets of `shingle` words reach `similarity`, which 64 bits
    miss mostly; that part is not the dealt method (`resemblance`).

    Texts are known by 128 bits of hash; no text is stored or moved but those of rows that have, or share a slot of a
    bounded bitmap with rows that have, company in their class."""

    @F.arrow_udf("fp long, n long, bands array<long>")
    def sketch_of(text: pa.Array) -> pa.Array:
        found = [t.as_py() for t in text.cast(pa.binary())]
        sketches = [resemblance.sketch(t, shingle) for t in found]
        fps = pa.array([fingerprint(t, words) for t in found], pa.int64())
        n = pa.array([k for k, _ in sketches], pa.int64())
        return pa.StructArray.from_arrays([fps, n, pa.array([b for _, b in sketches], pa.list_(pa.int64()))], ["fp", "n", "bands"])

    sketch_of = sketch_of.asNondeterministic()  # evaluated once a row
    text = F.col(text_col).cast("string")
    norm = ascii_lower(F.coalesce(text, F.lit("")))
    key = [F.xxhash64(F.lit(i), norm).alias(f"_k{i}") for i in (1, 2)]  # 128 bits of the text
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    number = F.col(id_col).cast("long").alias("_id")
    order = F.struct(F.col("_id").isNull(), "_id", "_tie")  # which row of a class stays

    # a row per text, without the text; of it, the row that would stay
    rows = small_batches(docs).select(*key, number, F.xxhash64(whole).alias("_tie"), sketch_of(text).alias("_s"))
    rows = rows.groupBy("_k1", "_k2").agg(F.min(order).alias("_best"), F.count("*").alias("_rows"), F.first("_s").alias("_s"))
    rows = written(rows.select("_k1", "_k2", "_best", "_rows", "_s.*", F.monotonically_increasing_id().alias("_row")))
    fps = written(rows.groupBy("fp").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    same = rows.select("fp", "_row").join(fps.filter("_n > 1"), "fp").filter("_row != _first").select(F.col("_row").alias("a"), F.col("_first").alias("b"))
    first = fps.select("fp", "_first")
    ties = links(fps.select("fp"), bits, m).join(first.toDF("a", "_a"), "a").join(first.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    ties = written(ties.unionByName(same))

    def sets_of(asked: DataFrame) -> DataFrame:
        """Only sets of texts that are asked for, or share a bitmap's slot with one, are made and moved."""

        @F.arrow_udf("binary")
        def set_of(text: pa.Array) -> pa.Array:
            return pa.array([resemblance.short_set(t.as_py(), shingle) for t in text.cast(pa.binary())], pa.binary())

        asked = written(rows.select("_k1", "_k2", "_row").join(asked, "_row"))
        found = marked(small_batches(docs).select(*key, text.alias("_text")), "_k1", bitmap(asked, "_k1")).filter("_in")
        found = found.select("_k1", "_k2", set_of("_text").alias("_set")).groupBy("_k1", "_k2").agg(F.first("_set").alias("_set"))
        sets = written(found.join(asked, ["_k1", "_k2"]).select("_row", "_set"))
        discard(asked)
        return sets

    roots = resemblance.classes(rows.select("_row", "n", "bands"), sets_of, ties, similarity, paired)
    members = rows.select("_k1", "_k2", "_row", "_best").join(roots, F.col("_row") == F.col("id"))
    stays = members.groupBy("root").agg(F.min_by("_row", F.struct("_best", "_row")).alias("_row")).select("_row", F.lit(True).alias("_stays"))
    classed = members.select("_k1", "_k2", "_row").join(stays, "_row", "left").select("_k1", "_k2", F.coalesce("_stays", F.lit(False)).alias("_stays"))
    repeated = rows.filter("_rows > 1").select("_k1", "_k2", F.lit(True).alias("_stays"))
    special = written(classed.unionByName(repeated).groupBy("_k1", "_k2").agg(F.min("_stays").alias("_stays")))
    discard(rows, fps, ties)
    bits_ = written(bitmap(special, "_k1"))
    docs = marked(docs.select(whole, *key, number, F.xxhash64(whole).alias("_tie")), "_k1", bits_)
    met = docs.filter("_in").groupBy("_k1", "_k2").agg(F.min_by("_doc", order).alias("_doc"))  # of equal texts one row
    met = met.join(special, ["_k1", "_k2"], "left").filter(F.coalesce("_stays", F.lit(True))).select("_doc")
    return docs.filter("not _in").select("_doc").unionByName(met).select("_doc.*")
