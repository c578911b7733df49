"""The prefix trie of conversations, from whole sequences.

A node is a distinct sequence of first turns (role, text); the root has none.  Identical
conversations collapse into one weighted sequence with the list of those that end there.  Sequences that are
proper prefixes of others are dropped by an anti-join, what is left are the leaves.  All else is
sums over the sequences' prefixes: members are weights, leaves are counted, and what a subtree saves
is what its sequences have from that depth on, weighted, less what each owns.  (A sequence owns the nodes of which its
conversation is the smallest member: from some depth on, and every node is owned once.)

Prefixes are told apart by 128 bits: the exclusive or of two hashes of each turn with its depth, so a
prefix's key is a running total.  Running totals and ranks are taken in slices of a conversation, tied together
by a row per slice; a node's members are summed before the shuffle.  Lists of ends go in blocks of neighbouring
ids past a digest and are never held whole.

The turns of a conversation are ordered by turn number, missing ones first, equal ones by role and a hash of
the text; repeated rows are turns like any other.  Null roles and texts are empty.  Rows without a
conversation id take no part.  An empty table gives no node; other columns than the four are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.llm.common import written

#: Turns in a slice of a conversation, and conversation ids in a block of an end list.
SLICE, BLOCK = 1024, 4096
#: The root's key, and the digest of no ends.
ROOT = 0
NO_ENDS = hashlib.sha256().hexdigest()

NODE = ["depth", "x", "y"]


def running(df: DataFrame, key: str, slice_: Column, order: tuple[str, ...], totals: dict[str, tuple]) -> DataFrame:
    """Adds running totals {name: (aggregate, how two totals add up, input column, total of nothing)} over `key` in
    `order`, along which `slice_` must not decrease: inside slices, plus what the slices before came to."""
    df = df.withColumn("_slice", slice_)
    sums = df.groupBy(key, "_slice").agg(*[agg(c).alias(n) for n, (agg, _, c, _) in totals.items()])
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(key, "_slice", *[F.coalesce(agg(n).over(earlier), F.lit(zero)).alias(f"_{n}0") for n, (agg, _, _, zero) in totals.items()])
    upto = W.partitionBy(key, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = df.withColumns({n: agg(c).over(upto) for n, (agg, _, c, _) in totals.items()}).join(before, [key, "_slice"])
    return run.withColumns({n: plus(F.col(n), F.col(f"_{n}0")) for n, (_, plus, _, _) in totals.items()}).drop("_slice", *[f"_{n}0" for n in totals])


_SUM = (F.sum, lambda a, b: a + b)
_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), a and b (hashes of role and text), n (characters of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("_turn"), role.alias("_role"), F.xxhash64(text).alias("_tie"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.char_length(text).cast("long").alias("n"), F.lit(1).cast("long").alias("_one"),
    )
    slice_ = F.coalesce(F.floor(F.col("_turn") / SLICE), F.lit(-(1 << 60))).cast("long")
    rows = running(rows, "conv_id", slice_, ("_turn", "_role", "_tie"), {"pos": (*_SUM, "_one", 0)})
    return rows.select("conv_id", (F.col("pos") - 1).alias("pos"), "a", "b", "n")


def rebuilt(turns: DataFrame, among: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike, from the rows of `numbered`: each takes its first h turns (the CRC-32 of its
    id modulo `heads`) from the first one of its `among` (ids c - c % `among`), and goes on with its own after the
    first h.  Returns the ids, and conv_id, depth (from 1), a, b, n."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(heads)
    base = F.col("conv_id") - F.col("conv_id") % F.lit(among)
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("_n")).select("conv_id", h.alias("_h"), base.alias("_base"))
    first = turns.filter((F.col("conv_id") % among == 0) & (F.col("pos") < heads - 1))  # at most so many rows of each
    first = first.groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n"))).alias("_head"))
    ids = ids.join(first, "_base", "left").select("conv_id", "_h", F.slice(F.coalesce("_head", F.array()), F.lit(1), F.col("_h").cast("int")).alias("_head"))
    ids = written(ids)
    borrowed = ids.select("conv_id", F.posexplode("_head").alias("depth", "_t")).select("conv_id", (F.col("depth") + 1).cast("long").alias("depth"), "_t.a", "_t.b", "_t.n")
    shift = ids.select("conv_id", "_h", F.size("_head").alias("_k"))
    own = turns.join(shift, "conv_id").filter("pos >= _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_k") + 1).alias("depth"), "a", "b", "n")
    return ids.select("conv_id"), borrowed.unionByName(own)


def end_digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """The key and ends_sha256: the digest of conv_id of each key, ascending, comma-joined.  Ids are
    gathered in blocks of at most BLOCK, and a key's blocks stream past its digest."""
    block = F.floor(F.col("conv_id") / BLOCK).alias("_block")
    blocks = ends.groupBy(*key, block).agg(F.array_sort(F.collect_list("conv_id")).alias("_ids"))
    blocks = blocks.select(*key, "_block", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("_ids"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(out)
            out.clear()
        yield rows([(*now, state.hexdigest())] if state else [])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * (len(key) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())], [*key, "ends_sha256"])

    schema = ", ".join(f"{k} long" for k in key) + ", ends_sha256 string"
    return blocks.repartition(*key).sortWithinPartitions(*key, "_block").mapInArrow(scan, schema)


def sequences(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, x, y, chars: each conversation as a whole."""
    x, y = (F.xxhash64(F.lit(s), "depth", "a", "b").alias(c) for s, c in ((3, "x"), (4, "y")))
    whole = rows.select("conv_id", "depth", "n", x, y).groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("chars"))
    return ids.join(whole, "conv_id", "left").fillna(ROOT)


def trie(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node of the conversations `ids` (turnless ones too) with the turns `rows` (conv_id, depth from 1, a,
    b, n): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(rows)
    whole = written(sequences(ids, rows))
    # identical conversations are one sequence, with a weight; its turns are those of its smallest conversation
    seqs = written(whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("w"), F.first("chars").alias("chars")))
    chosen = rows.join(seqs.select("conv_id", "w", "chars"), "conv_id")
    chosen = chosen.withColumns({"_x": F.xxhash64(F.lit(3), "depth", "a", "b"), "_y": F.xxhash64(F.lit(4), "depth", "a", "b")})
    run = running(chosen, "conv_id", F.floor(F.col("depth") / SLICE), ("depth",), {"x": (*_XOR, "_x", 0), "y": (*_XOR, "_y", 0), "_upto": (*_SUM, "n", 0)})
    run = run.select(
        "conv_id", "w", "chars", *NODE, F.col("x").bitwiseXOR(F.col("_x")).alias("px"), F.col("y").bitwiseXOR(F.col("_y")).alias("py"), "n", (F.col("_upto") - F.col("n")).alias("before"),
    )
    zero = [F.lit(ROOT).cast("long").alias(c) for c in (*NODE, "px", "py", "n", "before")]
    prefixes = written(run.unionByName(seqs.select("conv_id", "w", "chars", *zero)))
    nodes = written(prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("before").alias("before"),
    ))
    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    children = written(nodes.filter("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children")))
    leaves = seqs.join(children, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    # each sequence owns its nodes from some depth on, or none
    owned = written(nodes.groupBy("conv_id").agg(F.min("depth").alias("_from"), F.min_by("before", "depth").alias("_own")))
    of = seqs.select("conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    rest, alone = F.col("chars") - F.col("before"), F.col("chars") - F.greatest("before", "_own")
    sums = prefixes.join(of, "conv_id").groupBy(*NODE).agg(
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.sum(F.col("w") * rest - F.when(F.col("_from").isNotNull(), alone).otherwise(0)).alias("saved_tokens"),
    )
    # a node's parent has the same smallest member but where its owner's nodes begin
    begins = nodes.filter("depth > 0").join(owned, "conv_id").filter(F.col("depth") == F.col("_from"))
    begins = begins.select(*up, F.col("x").alias("_x"), F.col("y").alias("_y"))
    above = written(begins.join(nodes.select(*NODE, F.col("conv_id").alias("_above")), NODE))
    above = above.select((F.col("depth") + 1).alias("depth"), F.col("_x").alias("x"), F.col("_y").alias("y"), "_above")
    ends = end_digests(whole, NODE)
    found = nodes.join(sums, NODE).join(children, NODE, "left").join(above, NODE, "left").join(ends, NODE, "left")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("_above", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, among: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the `rebuilt` conversations."""
    return trie(*rebuilt(written(numbered(conversations)), among, heads))
