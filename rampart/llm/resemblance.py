"""Texts of which the sets of word shingles resemble each other: at least `similarity` of the union
is shared.

Such texts often differ in five to fifteen of the 64 bits of a SimHash, further than 64 bits can
be searched without comparing a large share of all pairs.  So texts meet on bands of min-hashes: of
24 bands of 5, two texts at 0.8 miss all with a chance of 7 in 100,000.  Texts that share a band are
compared exactly, shingle set by shingle set.

Only what is connected matters, so texts that are connected already are not compared.  A band that
many texts share is not paired up: a few of its texts are compared with all the others and leave
the band; what is then still apart goes on with sixteen times as many, until every band is in one
piece or used up.  Nothing is capped, and one large group of near copies takes one round.

A text of fewer words is one shingle; a text without words, or null, resembles nothing here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.llm.common import bitmap, discard, gathered, marked, written
from rampart.llm.components import components

BANDS, ROWS = 24, 5
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_SALTS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles hashed at a time.
BLOCK = 256


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    found = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    number = {w: xxhash.xxh64_intdigest(w) for w in set(found)}
    h = np.fromiter(map(number.__getitem__, found), np.uint64, len(found))
    n = max(len(h) - words + 1, 1)
    total = h[:n].copy()
    for j in range(1, min(words, len(h))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    total ^= total >> np.uint64(31)
    return np.unique(total * np.uint64(0xD6E8FEB86659FD93))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number per band; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        mixed = (hashes[at : at + BLOCK, None] ^ _SALTS) * _MULTIPLIERS
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def sketch(text: bytes | None, words: int) -> tuple[int, np.ndarray]:
    """The number of distinct shingles, and the bands."""
    found = shingles(text, words)
    return len(found), bands(found)


def short_set(text: bytes | None, words: int) -> bytes:
    """The shingles as sorted numbers of four bytes."""
    return np.unique((shingles(text, words) >> np.uint64(32)).astype("<u4")).tobytes()


def _alike(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""

    @F.arrow_udf("double")
    def resemblance(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(x, y):
            p, q = (np.frombuffer(v.as_py(), "<u4") for v in (s, t))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / max(len(p) + len(q) - both, 1))
        return pa.array(out, pa.float64())

    x, y = (sets.select(F.col("_row").alias(k), F.col("_set").alias(f"_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").filter(resemblance("_a", "_b") >= similarity).select("a", "b")


def _shared(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """_row and alone: of the rows (_row, distinct), how many shingles no other of them has, if any."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(s.as_py(), "<u4") for s in batch.column(1)]
            if found:
                owner = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found).astype(np.int64))], ["_row", "h"])

    each = sets.join(rows, "_row", "left_semi").select("_row", "_set").mapInArrow(numbers, "_row long, h long")
    once = each.groupBy("h").agg(F.count("*").alias("_c"), F.min("_row").alias("_row")).filter("_c = 1")
    return once.groupBy("_row").agg(F.count("*").alias("alone"))


def classes(sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], known: DataFrame, similarity: float = 0.8, paired: int = 32) -> DataFrame:
    """id, root: the connected components of `known` (a, b) together with all pairs that resemble
    each other.  `sketches` has _row, n and bands; `sets_of` gives _row and _set of the rows (_row) it is asked for:
    those that share a band, once.  First a text of each band is compared with the others; bands still apart
    are paired up, but for those that more than `paired` texts share; what is connected stays the same.

    Before that, the shingles that no other text still apart has are counted: two texts cannot share them, so a text with
    too many resembles none, and pairs whose other shingles cannot suffice are not compared."""
    keyed = sketches.select("_row", "n", F.explode("bands").alias("key"))
    several = written(keyed.groupBy("key").agg(F.count("*").alias("_c")).filter("_c > 1").select("key"))
    left = written(marked(keyed, "key", bitmap(several, "key")).filter("_in").drop("_in").join(several, "key").withColumn("s", F.col("n")))
    sets = sets_of(left.select("_row").distinct())
    ties, roots, pivots, used = known.select("a", "b"), None, 1, [several, sets]
    while True:
        if roots is None:
            now = left.withColumn("root", F.col("_row"))
        else:
            now = left.join(roots, left["_row"] == roots["id"], "left").select("key", "_row", "n", "s", F.coalesce("root", "_row").alias("root"))
        apart = now.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi")
        now = written(now.join(apart.select("key", "c"), "key"))
        used += [left, now]
        most = now.agg(F.max("c")).first()[0]
        if most is None:
            roots = roots or components(ties)
            break
        for _ in range(0 if roots is None else 2):  # texts that go leave more shingles to one text alone
            alone = _shared(sets, now.select("_row").distinct())
            now = now.join(alone, "_row", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
            now = written(now.filter(F.col("s") >= similarity * F.col("n") - 1e-6))
            used.append(now)
        now = gathered(now)
        few, many = now.filter(F.col("c") <= paired), now.filter(F.col("c") > paired)
        if roots is None:
            few, many = None, now
        # at first the texts whose bands most others share, which near copies of one text resemble; later small pieces
        sizes = many.groupBy("root").agg(F.sum("c").alias("_size"))
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("_size") if few is None else F.col("_size"), "_row"))
        chosen = written(many.join(sizes, "root").withColumn("_rank", rank).filter(F.col("_rank") <= pivots).select("key", "_row", "n", "s", "root"))
        used.append(chosen)
        met = None
        for some, others in ((few, few), (chosen, many)):
            if some is None:
                continue
            some = some.join(some.groupBy("_row").agg(F.collect_set("key").alias("_keys")), "_row")  # at most BANDS of each
            others = others.join(others.groupBy("_row").agg(F.collect_set("key").alias("_others")), "_row")
            others = others.select("key", "_others", F.col("_row").alias("_o"), F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("root").alias("_r"))
            near = (F.least("n", "_n") >= similarity * F.greatest("n", "_n")) & ((1 + similarity) * F.least("s", "_s") >= similarity * (F.col("n") + F.col("_n")) - 1e-6)
            once = F.col("key") == F.array_min(F.array_intersect("_keys", "_others"))  # a pair meets in one of its bands only
            pairs = some.join(others, "key").filter((F.col("root") != F.col("_r")) & near & once)
            pairs = pairs.select(F.least("_row", "_o").alias("a"), F.greatest("_row", "_o").alias("b"))
            met = pairs if met is None else met.unionByName(pairs)
        pairs = written(met.distinct())  # chosen texts meet one another twice
        roots = components(ties.unionByName(_alike(sets, pairs, similarity)))
        used.append(pairs)
        if pivots > 1 and most <= paired:
            break
        ties = roots.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        left = written(many.select("key", "_row", "n", "s").join(chosen.select("key", "_row"), ["key", "_row"], "left_anti"))
        pivots *= 16
    discard(*used)
    return roots
