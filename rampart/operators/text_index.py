"""A positional inverted index over texts, kept as tables, and tables of searches answered by joins.

Words are runs of letters, digits and underscores, in lower case; places are counted from 0.  Postings stay where
they are made, run by run of documents, and are never sorted as a whole; a part is a piece of the table.  A directory
says which parts hold a term and what they hold of it, so that a frequent term is met in many pieces and a rare one
in one.  A posting holds at most PLACES places.  Searches that mean several words are counted by tasks that open a
part's files through pyarrow, so the work folder must be of a kind pyarrow knows.

A search is (search_id, kind, query, slack):
  * term: one word;
  * wildcard: a word with `*` (any characters) and `?` (one); candidates share the pattern's rarest gram;
  * fuzzy: a word within `slack` (at most 2) edits; candidates share what is left after that many deletions;
  * phrase: words in their order with at most `slack` others between them, found from the rarest word outwards.
    A run's postings are followed together, as hashes of the ways that some phrase takes; whole ways are then joined.
Equal searches are answered once.  A null or empty text holds no word; a null query, one of another kind and a term
or fuzzy query that is not one word find nothing.  Rows may share an id or have none: each is a document of its own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.session import checkpoint_dir

WORD = r"[\p{L}\p{N}_]+"
#: Words inverted at once (or one text), and the most places in one posting.
WORDS_AT_ONCE, PLACES = 500_000, 1024
#: Bits of the filters that are broadcast.
FILTER_BITS = 1 << 26
#: Flags set at once, a document and a search each, and documents of terms looked at for them.
CELLS, HITS_AT_ONCE = 1 << 23, 1 << 21
#: Grams of a word for wildcards; leading characters whose deletions stand for a word in fuzzy searches.
GRAM, LEADING, MOST_EDITS = 4, 8, 2


@dataclass(frozen=True)
class TextIndex:
    """postings: term, part, base, at (documents since base in the upper 32 bits, the place in the lower), n_docs (that
    begin in it), first_id, last_id; directory: term, part and the sums of these; docs: doc, id."""

    postings: DataFrame
    directory: DataFrame
    docs: DataFrame


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/text_index-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(df: DataFrame) -> dict[int, list[str]]:
    """The files of a table by `part`, in order, as URIs."""
    found: dict[int, list[str]] = {}
    for part, uri in sorted(df.select("part", F.input_file_name()).distinct().collect()):  # a few a part
        found.setdefault(part, []).append("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return found


def _batches(files: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            yield from pq.ParquetFile(file).iter_batches(columns=columns)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of runs of rows, and for each run a row without a term that holds its ids."""
    names = ["term", "base", "at", "n_docs", "first_id", "last_id", "ids"]
    top = np.iinfo("int64").max
    for batch in batches:
        sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype="int64") // WORDS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            rows, lengths = batch.slice(a, b - a), sizes[a:b].astype("int64")
            base, ids = rows.column("doc")[0].as_py(), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), rows.column("id"))
            none = [pa.nulls(1, pa.list_(pa.int64())), *[pa.nulls(1, pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([base]), *none, ids], names)
            coded = rows.column("words").flatten().dictionary_encode()
            if not len(coded):
                continue
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code, at = code[order], (row << 32 | place)[order]
            begin = np.r_[True, np.diff(code) != 0]
            since = np.arange(len(code)) - np.maximum.accumulate(np.where(begin, np.arange(len(code)), 0))
            first = np.flatnonzero(since % PLACES == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)], pa.int32()), pa.array(at))
            terms = coded.dictionary.take(pa.array(code[first]))
            doc = at >> 32
            n_docs = np.add.reduceat((begin | np.r_[True, np.diff(doc) != 0]).astype("int64"), first)
            known = rows.column("id").is_valid().to_numpy(zero_copy_only=False)
            number = rows.column("id").fill_null(0).to_numpy()
            some = ~np.logical_or.reduceat(known[doc], first)
            low = pa.array(np.minimum.reduceat(np.where(known, number, top)[doc], first), mask=some)
            high = pa.array(np.maximum.reduceat(np.where(known, number, -top - 1)[doc], first), mask=some)
            none = pa.nulls(len(first), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(first), base)), lists, pa.array(n_docs), low, high, none], names)


def build_index(df: DataFrame, id_col: str, text: str) -> TextIndex:
    """An index of every word of every row."""
    rows = df.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("id"), words(text).alias("words"))
    raw = _written(rows.mapInArrow(_invert, "term string, base long, at array<long>, n_docs long, first_id long, last_id long, ids array<long>"))
    docs = raw.filter("term IS NULL").select("base", F.posexplode("ids").alias("n", "id")).select((F.col("base") + F.col("n")).alias("doc"), "id")
    postings = raw.filter("term IS NOT NULL").drop("ids").withColumn("part", F.shiftright("base", 33))  # the piece that numbered the documents
    sums = [F.sum(F.size("at")).alias("n_places"), F.sum("n_docs").alias("n_docs"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")]
    directory = postings.groupBy("term", "part").agg(*sums)
    return TextIndex(postings, _written(directory), _written(docs))


def _met(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """skey, base, at: the postings of the terms of `wanted`, part by part.  Its size is known to the planner, as it is written first."""
    parts = _written(wanted.join(index.directory.select("term", "part"), "term"))
    return parts.join(index.postings, ["term", "part"]).select("skey", "base", "at")


def _grams(word: Column) -> Column:
    """The word's grams of 1 to GRAM characters, and the empty one."""
    def cut(n):
        starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[cut(n) for n in range(1, GRAM + 1)]))


def _less_one(word: Column) -> Column:
    starts = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _remains(word: Column, edits: int) -> Column:
    """What up to `edits` deletions leave of the leading characters.  Words within that distance have one in common."""
    levels = [F.array(F.substring(word, 1, LEADING))]
    for _ in range(edits):
        levels.append(F.flatten(F.transform(levels[-1], _less_one)))
    return F.array_distinct(F.concat(*levels))


def _wildcards(terms: DataFrame, asked: DataFrame) -> DataFrame:
    pieces = F.split(F.concat(F.lit("^"), F.lower("query"), F.lit("$")), r"[*?]")
    whole = lambda p: F.filter(_grams(p), lambda g: F.length(g) == F.least(F.length(p), F.lit(GRAM)))
    options = asked.select("skey", F.lower("query").alias("query"), F.explode(F.array_distinct(F.flatten(F.transform(pieces, whole)))).alias("gram"))
    word = F.concat(F.lit("^"), F.col("term"), F.lit("$"))
    options = _written(options)
    posted = _written(terms.select("term", F.explode(_grams(word)).alias("gram")).join(_written(options.select("gram").distinct()), "gram", "left_semi"))
    seen = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = options.join(seen, "gram", "left").groupBy("skey", "query").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram")
    )
    escaped = F.regexp_replace("query", r"([\\_%])", r"\\$1")
    like = F.translate(escaped, "*?", "%_")
    ends = [F.regexp_extract("query", r"^[^*?]*", 0).alias("begin"), F.regexp_extract("query", r"[^*?]*$", 0).alias("end")]
    tests = _written(rarest.select("skey", "gram", like.alias("like"), *ends, F.rlike("query", F.lit(r"^[^*?]*\*[^*?]*$")).alias("plain")))
    # most candidates are settled by both ends; LIKE compiles its pattern for every row
    size = F.when(F.rlike("like", F.lit("[%_]")), F.length("begin") + F.length("end")).otherwise(0)
    outer = F.startswith("term", "begin") & F.endswith("term", "end") & (F.length("term") >= size)
    fits = F.when(~outer, False).when(F.col("plain"), True).otherwise(F.expr("term LIKE like"))
    return posted.join(tests, "gram").filter(fits).select("skey", "term")


def _close(terms: DataFrame, asked: DataFrame) -> DataFrame:
    slack = F.when(F.col("slack") <= MOST_EDITS, F.col("slack")).otherwise(
        F.raise_error(F.lit(f"fuzzy searches allow at most {MOST_EDITS} edits")).cast("int")
    )
    one = asked.withColumn("w", words("query")).filter(F.size("w") == 1).select("skey", slack.alias("slack"), F.col("w")[0].alias("query"))
    by_slack = reduce(lambda a, d: F.when(F.col("slack") == d, _remains(F.col("query"), d)).otherwise(a), range(1, MOST_EDITS + 1), _remains(F.col("query"), 0))
    options = _written(one.select("skey", "slack", "query", F.explode(by_slack).alias("left")))
    near = F.levenshtein("term", "query") <= F.col("slack")
    posted = terms.select("term", F.explode(_remains(F.col("term"), MOST_EDITS)).alias("left"))
    return posted.join(options, "left").filter(near).select("skey", "term").distinct()


def _word_terms(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """skey, term: the words that each search for words means, of all that there are."""
    plain = asked.filter("kind = 'term'").withColumn("w", words("query")).filter(F.size("w") == 1).select("skey", F.col("w")[0].alias("term"))
    return plain.unionByName(_wildcards(terms, asked.filter("kind = 'wildcard'"))).unionByName(_close(terms, asked.filter("kind = 'fuzzy'")))


def _word_hits(index: TextIndex, asked: DataFrame) -> DataFrame:
    terms = _written(index.directory.select("term").distinct())
    each = _met(index, _word_terms(terms, asked)).select("skey", "base", F.explode("at").alias("at"))
    return each.groupBy("skey", (F.col("base") + F.shiftright("at", 32)).alias("doc")).agg(F.count("*").alias("n_places"))


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _documents_with_any(run: list[pa.RecordBatch], terms: pa.Array, first: np.ndarray, n: np.ndarray, search: np.ndarray, out: np.ndarray) -> None:
    """Adds to `out`, for every search, the documents of a run that hold any of its terms: those of term i are
    search[first[i] : first[i] + n[i]]."""
    table = pa.Table.from_batches(run).combine_chunks()
    code = pc.index_in(table.column("term").combine_chunks(), value_set=terms)
    table, code = table.filter(code.is_valid()), code.drop_null().to_numpy().astype(np.int64)
    if not len(code):
        return
    lists = table.column("at").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    doc = lists.flatten().to_numpy() >> 32
    posting = np.repeat(np.arange(len(size)), size)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (posting[1:] != posting[:-1])]
    doc, size = doc[new], np.bincount(posting[new], minlength=len(size))
    start, docs = np.cumsum(size) - size, int(doc.max()) + 1
    of, asking = np.repeat(np.arange(len(code)), n[code]), search[_ranges(first[code], n[code])]
    order = np.argsort(asking, kind="stable")
    of, asking = of[order], asking[order]
    rows = max(1, CELLS // docs)
    for lo in range(int(asking[0]), int(asking[-1]) + 1, rows):
        a, b = np.searchsorted(asking, [lo, lo + rows])
        if a == b:
            continue
        flags = np.zeros((int(asking[b - 1]) - lo + 1) * docs, np.bool_)
        piece = np.cumsum(size[of[a:b]]) // HITS_AT_ONCE
        for x, y in zip(cuts := [a, *(a + np.flatnonzero(np.diff(piece)) + 1), b], cuts[1:]):
            flags[np.repeat((asking[x:y] - lo) * docs, size[of[x:y]]) + doc[_ranges(start[of[x:y]], size[of[x:y]])]] = True
        held = np.add.reduce(flags.reshape(-1, docs), axis=1, dtype=np.int64)
        out[lo : lo + len(held)] += held


def _any_counts(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """skey, n: per part, how many of its documents hold any term of the search.  A task reads a part's postings, run by
    run, and what is wanted of that part; no posting is shuffled."""
    spark = wanted.sparkSession
    asked = wanted.join(index.directory.select("term", "part"), "term").select("part", "term", "skey")
    path = f"{checkpoint_dir(spark).rstrip('/')}/text_index-{uuid.uuid4().hex}"
    asked.repartition("part").withColumn("of", F.col("part")).write.option("compression", "zstd").partitionBy("of").parquet(path)
    schema = "skey long, n long"
    found = _files(spark.read.schema("part long, term string, skey long, of long").parquet(path))
    if not found:
        return spark.createDataFrame([], schema)
    postings = _files(index.postings)
    tasks = [(wants, postings[part]) for part, wants in found.items()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wants, files in (tuple(t.values()) for batch in batches for t in batch.to_pylist()):
            pairs = pa.Table.from_batches(_batches(wants, ["term", "skey"])).combine_chunks()
            coded = pairs.column("term").combine_chunks().dictionary_encode()
            keys, search = np.unique(pairs.column("skey").to_numpy(), return_inverse=True)
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            n = np.bincount(code, minlength=len(coded.dictionary))
            out, held, base = np.zeros(len(keys), np.int64), [], None
            add = lambda run: _documents_with_any(run, coded.dictionary, np.cumsum(n) - n, n, search[order], out)
            for batch in _batches(files, ["term", "base", "at"]):
                batch = batch.filter(batch.column("term").is_valid())
                bases = batch.column("base").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(bases)) + 1), len(bases)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if held and base != bases[a]:
                        add(held)
                        held = []
                    base = bases[a]
                    held.append(batch.slice(a, b - a))
            if held:
                add(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out)], ["skey", "n"])

    dealt = spark.createDataFrame(spark.sparkContext.parallelize(tasks, len(tasks)), "wants array<string>, files array<string>")
    return dealt.mapInArrow(count, schema)


def _word_counts(index: TextIndex, asked: DataFrame) -> DataFrame:
    """skey, n_docs, n_places, first_id, last_id.  All but n_docs are sums over terms, and for a search that means one term so is
    n_docs: the directory has them.  Only documents with any of several terms are counted from postings, a part at a time."""
    of_term = _written(index.directory.groupBy("term").agg(
        F.sum("n_places").alias("n_places"), F.sum("n_docs").alias("n_docs"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
    ))
    wanted = _written(_word_terms(of_term.select("term"), asked))
    summed = _written(wanted.join(of_term, "term").groupBy("skey").agg(
        F.count("*").alias("n_terms"), F.sum("n_docs").alias("n_docs"), F.sum("n_places").alias("n_places"),
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"),
    ))
    several = wanted.join(summed.filter("n_terms > 1").select("skey"), "skey")
    counted = _any_counts(index, several).groupBy("skey").agg(F.sum("n").alias("n_any"))
    joined = summed.join(counted, "skey", "left")
    return joined.select("skey", F.coalesce("n_any", "n_docs").alias("n_docs"), "n_places", "first_id", "last_id")


def _ways(index: TextIndex, asked: DataFrame) -> DataFrame:
    """skey, slack, at, w: the phrases whose words all stand somewhere, and which word is the rarest."""
    phrases = asked.filter("kind = 'phrase'").select("skey", F.greatest("slack", F.lit(0)).alias("slack"), words("query").alias("w"))
    asked_terms = _written(phrases.select(F.explode("w").alias("term")).distinct())
    counted = index.directory.join(asked_terms, "term", "left_semi").groupBy("term").agg(F.sum("n_places").alias("n"))
    known = phrases.select("skey", F.posexplode("w").alias("at", "term")).join(counted, "term")
    anchor = known.groupBy("skey").agg(F.min_by("at", F.struct("n", "at")).alias("at"), F.count("*").alias("found"))
    return phrases.join(anchor, "skey").filter(F.size("w") == F.col("found")).select("skey", "slack", "at", "w")


def _step(before: np.ndarray, way: int, term: np.ndarray) -> np.ndarray:
    """Hashes of ways that go on to a term, ahead (1) or back (2), or end (3)."""
    h = (before ^ term) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(way)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slot of every step of a way, from the rarest word to the end, then to the start, and of its end."""
    for batch in batches:
        out = [np.zeros(0, np.int64)]
        for slack, at, term in zip(*(batch.column(n).to_pylist() for n in ("slack", "at", "h"))):
            h = np.array(term, np.int64).view(np.uint64)
            steps = [_step(np.array([slack], np.uint64), 0, h[at : at + 1])]
            for way, i in [(1, i) for i in range(at + 1, len(h))] + [(2, i) for i in range(at - 1, -1, -1)]:
                steps.append(_step(steps[-1], way, h[i : i + 1]))
            steps.append(_step(steps[-1], 3, np.zeros(1, np.uint64)))
            out.append((np.concatenate(steps) % np.uint64(FILTER_BITS)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["slot"])


def _bitmap(slots: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, whatever is asked: small enough to send to every task."""
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    rows = slots.groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h % np.uint64(FILTER_BITS)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _follow(bits: np.ndarray, slacks: list[int], at: np.ndarray, code: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slack, way, document) of all that may be phrases in a run: a way is how many of its words lie ahead of the first, and
    their codes."""
    for slack in slacks:
        h = _step(np.full(len(at), slack, np.uint64), 0, term[code])
        on = np.flatnonzero(_in(bits, h))
        lo, hi, h, way = at[on], at[on], h[on], np.c_[np.zeros(len(on), np.int64), code[on]]
        while len(lo):
            end = _in(bits, _step(h, 3, np.zeros(1, np.uint64)))
            if end.any():
                yield slack, way[end], lo[end] >> 32
            found = []
            used = (hi - lo) - (way.shape[1] - 2)
            ahead = way[:, 0] == way.shape[1] - 2  # it has not turned back yet
            for skip in range(int((slack - used).max()) + 1):
                for sign, start, free in ((1, hi + 1 + skip, ahead), (2, lo - 1 - skip, True)):
                    ok = np.flatnonzero(free & (used + skip <= slack) & (start >> 32 == lo >> 32))
                    seat = np.minimum(np.searchsorted(at, start[ok]), len(at) - 1)
                    stands = at[seat] == start[ok]
                    ok, seat = ok[stands], seat[stands]
                    to = _step(h[ok], sign, term[code[seat]])
                    hit = _in(bits, to)
                    ok, seat, to = ok[hit], seat[hit], to[hit]
                    there = np.c_[way[ok, 0] + (sign == 1), way[ok, 1:], code[seat]]
                    found.append((np.minimum(lo[ok], at[seat]), np.maximum(hi[ok], at[seat]), to, there))
            lo, hi, h, way = (np.concatenate(x) for x in zip(*found))
            if slack and len(lo):  # one span may be reached through different gaps
                once = np.unique(np.c_[lo, hi, way], axis=0, return_index=True)[1]
                lo, hi, h, way = lo[once], hi[once], h[once], way[once]


def _phrase_hits(index: TextIndex, asked: DataFrame) -> DataFrame:
    spark = asked.sparkSession
    ways = _written(_ways(index, asked))
    slacks = sorted(r[0] for r in ways.select("slack").distinct().collect())
    steps = ways.select("slack", "at", F.transform("w", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(_hashed, "slot long")
    bits = spark.sparkContext.broadcast(_bitmap(steps))
    asked_terms = spark.sparkContext.broadcast(_bitmap(ways.select(F.explode("w").alias("w")).select(F.pmod(F.xxhash64("w"), F.lit(FILTER_BITS)).alias("slot"))))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(asked_terms.value, batch.column("h").to_numpy().view(np.uint64))))

    def run(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        lists = table.column("at").combine_chunks()
        at = lists.flatten().to_numpy()
        names = table.column("term").combine_chunks().dictionary_encode()
        code = np.repeat(names.indices.to_numpy(), lists.value_lengths().to_numpy())
        term = np.zeros(len(names.dictionary), np.uint64)
        term[names.indices.to_numpy()] = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(at)
        base = table.column("base")[0].as_py()
        for slack, way, doc in _follow(bits.value, slacks, at[order], code[order].astype(np.int64), term):
            each, n = np.unique(np.c_[doc, way], axis=0, return_counts=True)
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, len(each) * (way.shape[1] - 1) + 1, way.shape[1] - 1), pa.int32()), names.dictionary.take(pa.array(each[:, 2:].ravel())))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), slack)), pa.array(each[:, 1]), w, pa.array(each[:, 0] + base), pa.array(n)], ["slack", "ahead", "way", "doc", "n_places"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings come run by run; a run may go on in the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            base = batch.column("base").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(base)) + 1), len(base)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column("base")[0].as_py() != base[a]:
                    yield from run(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(held)

    hashed = index.postings.select("base", "term", "at", F.xxhash64("term").alias("h")).mapInArrow(wanted, "base long, term string, at array<long>, h long")
    runs = hashed.repartition("base").sortWithinPartitions("base")
    met = runs.mapInArrow(follow, "slack long, ahead long, way array<string>, doc long, n_places long")
    way = F.concat(F.slice("w", F.col("at") + 1, F.size("w")), F.reverse(F.slice("w", F.lit(1), F.col("at"))))
    whole = _written(ways.select("skey", F.col("slack").cast("long").alias("slack"), (F.size("w") - 1 - F.col("at")).cast("long").alias("ahead"), way.alias("way")))
    return met.join(whole, ["slack", "ahead", "way"]).select("skey", "doc", "n_places")


def _asked(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = searches.select("search_id", "kind", F.coalesce("query", F.lit("")).alias("query"), F.coalesce(F.col("slack").cast("int"), F.lit(0)).alias("slack"))
    return rows, _written(rows.drop("search_id").distinct().withColumn("skey", F.monotonically_increasing_id()))


def search(index: TextIndex, searches: DataFrame) -> DataFrame:
    """search_id, kind, query, slack, id, n_places: a row for every search and document that meets it."""
    rows, asked = _asked(searches)
    hits = _word_hits(index, asked).unionByName(_phrase_hits(index, asked)).join(index.docs, "doc")
    return rows.join(asked, ["kind", "query", "slack"]).join(hits, "skey").drop("skey", "doc")


def search_counts(index: TextIndex, searches: DataFrame) -> DataFrame:
    """search_id, kind, query, slack, n_docs, n_places, first_id, last_id per search.  Hits of equal searches are not repeated."""
    rows, asked = _asked(searches)
    phrases = _phrase_hits(index, asked).join(index.docs, "doc").groupBy("skey").agg(
        F.count("*").alias("n_docs"), F.sum("n_places").alias("n_places"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    counted = _word_counts(index, asked).unionByName(phrases)
    out = rows.join(asked.join(counted, "skey", "left").drop("skey"), ["kind", "query", "slack"])
    return out.fillna(0, ["n_docs", "n_places"])
