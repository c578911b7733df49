"""Longest substrings that enough texts of a group share.

Texts are written once, a group's together, and a task reads those of its groups through pyarrow.  It
takes the places whose first `size` characters fall into its buckets, brings what stands there into the
order of a trie and walks the trie from its root: a node is a run of places that begin alike.  Places are
never shuffled; a task holds its groups' texts, one or two bytes a character, and the places of a bucket.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rampart.session import checkpoint_dir

#: Groups are dealt over so many folders at most; characters of a folder's file, of a folder with few groups, of a bucket.
BINS, SLICE_CHARS, BIN_CHARS, BUCKET_CHARS = 1024, 8 << 20, 1 << 20, 1 << 20
#: Most buckets of a task, which reads its folder once; characters looked at together; rows returned together and texts a task
#: remembers before they are dealt out.
TASK_BUCKETS, CHUNK = 8, 1 << 20
ROWS, REMEMBERED = 50_000, 500_000


class Texts:
    """Texts of a folder as one array of codes, each behind a zero; codes number the characters met."""

    def __init__(self) -> None:
        self.code = np.zeros(0x110000, np.uint32)
        self.chars = [0]
        self.parts, self.lengths = [np.zeros(1, np.uint8)], []

    def add(self, texts: list[str]) -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        seen = np.unique(points[self.code[points] == 0])
        self.code[seen] = np.arange(len(self.chars), len(self.chars) + len(seen))
        self.chars.extend(seen.tolist())
        width = ">u1" if len(self.chars) <= 1 << 8 else ">u2" if len(self.chars) <= 1 << 16 else ">u4"
        part = np.zeros(len(points) + len(texts), width)
        part[np.arange(len(points)) + np.repeat(np.arange(len(texts)), lengths)] = self.code[points]
        self.parts.append(part)
        self.lengths.append(lengths)

    def done(self) -> None:
        width = max(p.dtype.itemsize for p in self.parts)
        self.a = np.zeros(sum(map(len, self.parts)) + 8, f">u{width}")
        at = 0
        self.parts.reverse()
        while self.parts:  # each is let go as it is copied
            part = self.parts.pop()
            self.a[at : at + len(part)] = part
            at += len(part)
        self.lengths = np.concatenate([np.zeros(0, np.int64), *self.lengths])
        self.ends = np.cumsum(self.lengths + 1)
        self.starts = self.ends - self.lengths
        self.space = self.code[32] or -1
        self.per = 8 // width
        # so many characters from any place on, as a number
        self.key = np.ndarray((len(self.a) - self.per + 1,), ">u8", self.a, strides=(width,))
        self.points = np.array(self.chars, np.uint32)

    def places(self, size: int, buckets: int, first: int, last: int, chunk: int = CHUNK) -> list[np.ndarray]:
        """Where a character other than a space has `size` or more before the text's end, by bucket."""
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(first, last)]
        for lo in range(0, len(self.a), chunk):
            part = self.a[lo : lo + chunk + size - 1]
            n = len(part) - size + 1
            if n <= 0:
                break
            part = part.astype(np.uint64)
            h = np.zeros(n, np.uint64)
            gap = np.zeros(n, bool)
            for i in range(size):
                piece = part[i : i + n]
                h = h * np.uint64(0x9E3779B97F4A7C15) + piece
                gap |= piece == 0
            h ^= h >> np.uint64(29)
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            good = ~gap & (part[:n] != self.space) & (bucket >= first) & (bucket < last)
            at = np.flatnonzero(good)
            own = bucket[at]
            for b in range(first, last):
                found[b - first].append(at[own == b] + lo)
        return [np.concatenate(x) for x in found]


def _ordered(t: Texts, q: np.ndarray, rem: np.ndarray, group: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of a trie of their groups, and how many characters each has in common with the one
    before.  Runs of too few texts are not told apart further than they have to be."""
    n = len(q)
    lcp = np.zeros(n, np.int64)
    key = t.key[q].astype(np.uint64)
    order = np.lexsort((key, group)) if n and group.min() != group.max() else np.argsort(key)
    slot, run, k, depth = np.arange(n), group[order], key[order], 0
    while len(slot):
        tied = np.r_[False, run[1:] == run[:-1]]
        differ = np.r_[np.uint64(0), k[1:] ^ k[:-1]]
        apart = tied & (differ != 0)
        common = np.zeros(int(apart.sum()), np.int64)
        for i in range(1, t.per):
            common += differ[apart] >> np.uint64(64 - 64 // t.per * i) == 0
        lcp[slot[apart]] = depth + common
        same = tied & (differ == 0)
        depth += t.per
        lcp[slot[same]] = depth
        run = np.cumsum(~same) - 1
        among = order[slot]
        enough = (np.bincount(run, weight[among]) >= least) & (np.bincount(run) > 1)
        go = enough[run] & (rem[among] >= depth)  # one that ends here still has to come before those that go on
        slot, run, among = slot[go], run[go], among[go]
        k = t.key[q[among] + depth].astype(np.uint64)
        sub = np.lexsort((k, run))
        order[slot], k = among[sub], k[sub]
    left = rem[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
    return order, lcp


def _before(*keys: np.ndarray) -> np.ndarray:
    """For each entry the last one before it with the same keys, or -1."""
    o = np.lexsort(keys)
    same = np.r_[False, np.logical_and.reduce([k[o][1:] == k[o][:-1] for k in keys])] if len(o) else np.zeros(0, bool)
    out = np.full(len(o), -1)
    out[o[1:]] = np.where(same[1:], o[:-1], -1)
    return out


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _walk(lcp: np.ndarray, rem: np.ndarray, last: np.ndarray, weight: np.ndarray, least: int, size: int) -> tuple[np.ndarray, list[tuple]]:
    """The longest shared beginning of every entry, and all nodes that enough texts share, level by level:
    (first entry, entries, depth of the node above, own depth, support)."""
    longest = np.zeros(len(lcp), np.int64)
    lo = np.flatnonzero(np.r_[True, lcp[1:] < size]) if len(lcp) else np.zeros(0, np.int64)
    n = np.diff(np.r_[lo, len(lcp)])
    above = np.full(len(lo), size - 1)
    levels = []
    big = np.iinfo(np.int64).max
    while len(lo):
        at, start = _ranges(lo, n), np.cumsum(n) - n
        support = np.add.reduceat(np.where(last[at] < np.repeat(lo, n), weight[at], 0), start)
        kept = support >= least
        at = at[np.repeat(kept, n)]
        lo, n, above, support = lo[kept], n[kept], above[kept], support[kept]
        if not len(lo):
            break
        start = np.cumsum(n) - n
        own = lcp[at]
        own[start] = big
        depth = np.minimum.reduceat(own, start)
        depth = np.where(n == 1, rem[lo], depth)
        longest[at] = np.repeat(depth, n)
        levels.append((lo, n, above, depth, support))
        inner = np.repeat(n > 1, n)
        cut = own <= np.repeat(depth, n)
        cut[start] = True
        cut = np.flatnonzero(cut & inner)
        above = np.repeat(depth, n)[cut]
        stop = np.repeat(start + n, n)[cut]
        n = np.minimum(np.r_[cut[1:], len(at)], stop) - cut
        lo = at[cut]
    return longest, levels


def shared(t: Texts, q: np.ndarray, group: np.ndarray, copies: np.ndarray, least: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, length, support) of the longest shared substrings that begin at places `q`, each once a group.
    `group` and `copies` are those of the texts."""
    text = np.searchsorted(t.starts, q, "right") - 1
    rem = t.ends[text] - q
    order, lcp = _ordered(t, q, rem, group[text], copies[text], least)
    run = np.cumsum(lcp < size) - 1
    some = np.bincount(run, copies[text[order]])[run] >= least if len(run) else np.zeros(0, bool)
    order, lcp = order[some], lcp[some]
    q, text, rem = q[order], text[order], rem[order]
    weight = copies[text]
    longest, levels = _walk(lcp, rem, _before(text), weight, least, size)
    # without the spaces at the end
    loose = np.flatnonzero(longest)
    while len(loose := loose[t.a[q[loose] + longest[loose] - 1] == t.space]):
        longest[loose] -= 1
    # what stands before: the spaces and the character before them; nothing at a text's beginning
    prior = q - 1
    loose = np.arange(len(q))
    while len(loose := loose[t.a[prior[loose]] == t.space]):
        prior[loose] -= 1
    context = ((q - prior) << 32) + t.a[prior].astype(np.int64)
    context = np.where(t.a[prior] == 0, -1, context)
    kinds, context = np.unique(context, return_inverse=True)
    none = len(kinds) > 0 and kinds[0] == -1
    again = _before(context, text)
    out = [(np.zeros(0, np.int64),) * 4]
    for lo, n, above, depth, support in levels:
        at, node = _ranges(lo, n), np.repeat(np.arange(len(lo)), n)
        asked = (longest[at] >= size) & (longest[at] > above[node]) & (longest[at] <= depth[node])
        any_asked = np.bincount(node, asked, len(lo)) > 0
        some = any_asked[node]
        at, node, asked = at[some], node[some], asked[some]
        if not len(at):
            continue
        pair, of = np.unique(node * len(kinds) + context[at], return_inverse=True)
        held = np.bincount(of, np.where(again[at] < lo[node], weight[at], 0))
        inside = held[of] >= least
        if none:
            inside &= context[at] > 0
        hit = np.flatnonzero(asked & ~inside)
        _, once = np.unique(node[hit] * (len(t.a) + 1) + longest[at[hit]], return_index=True)
        hit = hit[once]
        e = at[hit]
        out.append((text[e], q[e], longest[e], support[node[hit]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def strings(t: Texts, at: np.ndarray, n: np.ndarray) -> pa.StringArray:
    points = t.points[t.a[_ranges(at, n)]]
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.r_[0, np.cumsum(wide)][np.r_[0, np.cumsum(n)]].astype(np.int32)
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text goes on where it is first met; how often it came again follows without it."""
    seen: dict[tuple, int] = {}

    def again() -> pa.RecordBatch:
        rows = [(*key, n) for key, n in seen.items() if n]
        seen.clear()
        number = [pa.array([r[i] for r in rows], kind) for i, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.binary()), (3, pa.int64()))]
        none = [pa.nulls(len(rows), schema.field(n).type) for n in ("group", "low")]
        return pa.RecordBatch.from_arrays([*number, *none], ["bin", "slice", "digest", "copies", "group", "low"])

    for batch in batches:
        schema = batch.schema
        new = []
        for key in zip(*(batch.column(n).to_pylist() for n in ("bin", "slice", "digest"))):
            new.append(key not in seen)
            seen[key] = seen.get(key, -1) + 1
        kept = batch.filter(pa.array(new, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*[kept.column(n) for n in ("bin", "slice", "digest")], pa.array(np.ones(len(kept), np.int64)), kept.column("group"), kept.column("low")], ["bin", "slice", "digest", "copies", "group", "low"])
        if len(seen) > REMEMBERED:
            yield again()
    if seen:
        yield again()


def _read(files: list[str]) -> tuple[Texts, pa.Array, np.ndarray, np.ndarray]:
    """Different texts, the distinct groups, and of each text its group's number and its copies."""
    texts, groups, count = Texts(), [], {}
    order: list[bytes] = []
    held: set[bytes] = set()
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(4096, columns=["group", "low", "digest", "copies"]):
                there, new = batch.column("low").is_valid().to_pylist(), []
                for i, (digest, n) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("copies").to_pylist())):
                    count[digest] = count.get(digest, 0) + n
                    if there[i] and digest not in held:
                        held.add(digest)
                        order.append(digest)
                        new.append(i)
                rows = batch.take(pa.array(new, pa.int64()))
                texts.add(rows.column("low").to_pylist())
                groups.append(rows.column("group"))
    texts.done()
    named = pa.chunked_array(groups).combine_chunks().dictionary_encode()
    if isinstance(named, pa.ChunkedArray):
        named = named.combine_chunks()
    return texts, named.dictionary, named.indices.to_numpy().astype(np.int64), np.array([count[d] for d in order], np.int64)


def shared_substrings(texts: DataFrame, group: str, text: str, least: int = 3, size: int = 10) -> DataFrame:
    """(group, s, support): substrings of at least `size` lower-case characters, no space at either end, that `least` rows of
    a group share and that, where they stand, lie in no longer one; support counts the rows that hold it.

    A row without a group or text holds nothing.  Equal texts of a group are looked at once and
    count by their number."""
    spark = texts.sparkSession
    rows = texts.select(F.col(group).alias("group"), F.lower(text).alias("low")).filter(f"group is not null and length(low) >= {int(size)}")
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(BINS)).cast("int"))
    fine = {r[0]: r[1] for r in rows.groupBy("bin").agg(F.sum(F.length("low"))).collect()}  # at most BINS rows
    bins = min(BINS, math.ceil(sum(fine.values()) / BIN_CHARS)) or 1
    chars: dict[int, int] = {}
    for b, n in fine.items():
        chars[b % bins] = chars.get(b % bins, 0) + n
    schema = StructType([StructField("group", rows.schema["group"].dataType), StructField("s", StringType()), StructField("support", LongType())])
    if not chars:
        return spark.createDataFrame([], schema)
    slices = F.create_map(*[F.lit(x) for b, n in chars.items() for x in (b, math.ceil(n / SLICE_CHARS))])
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("\x01", F.col("group").cast("string"), "low").cast("binary"), 256)), 1, 16)
    named = rows.withColumn("bin", F.pmod("bin", F.lit(bins))).withColumn("digest", digest)
    dealt = named.select("bin", F.pmod(F.xxhash64("digest"), slices[F.col("bin")]).alias("slice"), "digest", "group", "low")
    kind = StructType([*dealt.schema.fields[:3], StructField("copies", LongType()), *[StructField(f.name, f.dataType) for f in dealt.schema.fields[3:]]])
    path = f"{checkpoint_dir(spark).rstrip('/')}/substrings-{uuid.uuid4().hex}"
    once = dealt.mapInArrow(_once, kind).repartition("bin", "slice")
    once.drop("slice").write.option("compression", "zstd").partitionBy("bin").parquet(path)
    files: dict[int, list[str]] = {}
    for uri in sorted(spark.read.parquet(path).inputFiles()):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        files.setdefault(int(uri.rsplit("/bin=", 1)[1].split("/")[0]), []).append(uri)
    cores = spark.sparkContext.defaultParallelism
    bucket = min(BUCKET_CHARS, max(sum(chars.values()) // (2 * cores), 1))
    step = min(TASK_BUCKETS, max(1, sum(chars.values()) // bucket // (4 * cores)))
    tasks = []
    for b, n in chars.items():
        buckets = math.ceil(n / bucket)
        tasks += [(files[b], i, min(i + step, buckets), buckets) for i in range(0, buckets, step)]
    kind = "files array<string>, first int, last int, buckets int"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                t, names, of, copies = _read(task["files"])
                for q in t.places(size, task["buckets"], task["first"], task["last"]):
                    held, at, n, support = shared(t, q, of, copies, least, size)
                    for i in range(0, len(at), ROWS):
                        part = slice(i, i + ROWS)
                        columns = [names.take(pa.array(of[held[part]])), strings(t, at[part], n[part]), pa.array(support[part].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["group", "s", "support"])

    dealt_out = spark.createDataFrame(spark.sparkContext.parallelize(tasks, len(tasks)), kind)
    return dealt_out.mapInArrow(found, schema)
