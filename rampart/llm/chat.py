"""Chat formatting by prefix-target expansion.

Every turn is written as

    ### role: text</turn>⏎

In texts `\\`, `#` and `<` are written `\\\\`, `\\h` and `\\l`, in roles `:` is `\\c` besides: no mark of the template stands in what was
a text, and the way back is exact.

Every assistant turn is an example of its own: all turns before it are the context, and only its
text is trainable.  Examples of one conversation are prefixes of one another, so the turns are
written once (`turns`), and an example (`examples`) says how far its context goes and where in it the
trainable text begins and ends.  `expanded` writes every example out whole, context and target, past the
sorted turns; their sum grows with the square of a conversation's turns, so an example is handed on in parts.
`rendered` puts an example into one row.  Turns behind the last reply (all turns, if there is none) are an
example without target, so a conversation is always written whole.

The turns of a conversation are ordered by turn number, missing ones first, equal ones by role and by a
hash of the text; repeated rows are turns like any other.  Null roles and texts are empty.  Rows
without a conversation id make up one conversation without id.  Empty tables give empty results;
other columns than the four are not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rampart.llm.common import pieces, small_batches

START, MIDDLE, END = "### ", ": ", "</turn>\n"
#: Turn numbers that lie in one slice of a conversation; a longer conversation is several tasks' work.
SLICE = 1024

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_LETTER = {"\\": "\\", "#": "h", "<": "l", ":": "c"}
_MARK = {letter: mark for mark, letter in _LETTER.items()}


def _escaped(c: Column, marks: str) -> Column:
    for mark in marks:  # the backslash comes first
        c = F.replace(c, F.lit(mark), F.lit("\\" + _LETTER[mark]))
    return c


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MARK[m[1]], text) if "\\" in text else text


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, segment (the turn as it is written), loss_start, loss_stop (the trainable characters of
    the segment; null but for the assistant), tie: one row per row of `conversations`, in no order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), _escaped(role, "\\#<:"), F.lit(MIDDLE))
    segment = F.concat(head, _escaped(text, "\\#<"), F.lit(END))
    reply = role == "assistant"
    return small_batches(conversations).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), segment.alias("segment"),
        F.when(reply, F.char_length(head)).cast("long").alias("loss_start"), F.when(reply, F.char_length(segment) - len(END)).cast("long").alias("loss_stop"),
        F.xxhash64(text).alias("tie"),
    )


ORDER = ("turn", "role", "tie")


def examples(written: DataFrame) -> DataFrame:
    """One row per example of the rows of `turns`: conv_id, example (from 0), n_turns (context and target), chars (of
    both), loss_start and loss_stop (characters of the conversation; null without target).

    Only lengths are moved.  A conversation's turns are summed up slice by slice, and slices
    are tied together by a row for each."""
    key = ["_conv", "_slice"]
    rows = written.select(
        F.struct("conv_id").alias("_conv"), F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 60))).cast("long").alias("_slice"), *ORDER,
        F.char_length("segment").cast("long").alias("_n"), "loss_start", "loss_stop", F.col("loss_start").isNotNull().cast("long").alias("_reply"),
    )
    sums = rows.groupBy(*key).agg(F.count("*").alias("_c"), F.sum("_n").alias("_s"), F.sum("_reply").alias("_r"))
    earlier = W.partitionBy("_conv").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_conv")
    offsets = sums.select(
        *key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_c", "_s", "_r")], F.sum("_c").over(whole).alias("_all"),
    )
    upto = W.partitionBy(*key).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumns({"_c": F.count("*").over(upto), "_s": F.sum("_n").over(upto), "_r": F.sum("_reply").over(upto)}).join(offsets, key)
    reply, last = F.col("_reply") == 1, F.col("_c") + F.col("_c0") == F.col("_all")
    until = F.col("_s") + F.col("_s0")
    return run.filter(reply | last).select(
        F.col("_conv.conv_id").alias("conv_id"), (F.col("_r") + F.col("_r0") - F.col("_reply")).alias("example"), (F.col("_c") + F.col("_c0")).alias("n_turns"), until.alias("chars"),
        (until - F.col("_n") + F.col("loss_start")).alias("loss_start"), (until - F.col("_n") + F.col("loss_stop")).alias("loss_stop"),
    )


def rendered(written: DataFrame, found: DataFrame) -> DataFrame:
    """The examples with their `text`, context and target.  For conversations of a size that a row may have."""
    text = written.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "segment"))).alias("_t"))
    text = text.select(F.struct("conv_id").alias("_conv"), F.array_join(F.transform("_t", lambda t: t["segment"]), "").alias("_text"))
    found = found.withColumn("_conv", F.struct("conv_id")).join(text, "_conv")
    return found.select(*[c for c in found.columns if c not in ("_conv", "_text")], F.expr("substring(_text, 1, cast(chars as int))").alias("text"))


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    found = _TURN.fullmatch(segment)
    if not found:
        raise ValueError(f"not a turn: {segment[:100]!r}")
    return unescaped(found[1]), unescaped(found[2])


#: Characters of an example in one row, and in one batch.
PART = 1 << 20


def expanded(written: DataFrame) -> DataFrame:
    """All examples of the rows of `turns`, written out: conv_id, example (from 0), chars, loss_start, loss_stop (characters
    of the example; null without target), text.

    An example longer than PART characters is several rows, one behind the other.  A conversation is one
    task's, which holds what it has said so far; the rows of a conversation leave in order."""
    schema = "conv_id long, example long, chars long, loss_start long, loss_stop long, text string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said, n, pending, seen = None, "", 0, False, False

        def example(start: int | None, stop: int | None) -> Iterator[tuple]:
            for i in range(0, len(said), PART):
                yield now, n, len(said), start, stop, said[i : i + PART]

        def made() -> Iterator[tuple]:
            nonlocal now, said, n, pending, seen
            for batch in batches:
                for part in pieces(batch):
                    for conv, segment, start, stop in zip(*(c.to_pylist() for c in part.columns)):
                        if not seen or conv != now:
                            if pending:
                                yield from example(None, None)
                            now, said, n, seen = conv, "", 0, True
                        before = len(said)
                        said += segment
                        pending = start is None
                        if not pending:
                            yield from example(before + start, before + stop)
                            n += 1
            if pending:
                yield from example(None, None)

        out, held = [], 0
        for row in made():
            out.append(row)
            held += len(row[-1])
            if held >= PART:
                yield _rows(out, schema)
                out, held = [], 0
        yield _rows(out, schema)

    ordered = written.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return ordered.select("conv_id", "segment", "loss_start", "loss_stop").mapInArrow(write, schema)


def read_back(output: DataFrame) -> DataFrame:
    """From the rows of `expanded`, in their order, per conversation: conv_id, n_turns, turns_sha256 (role, line feed,
    text, line feed per turn), loss_chars and loss_sha256 (of what lies under the loss masks), formatted_chars (of all
    examples) and n_examples.

    Every example is read whole: its context has to be what the one before it said, its own turns are parsed."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, out = None, False, []
        known, parsed_to, at, totals, turns_sha, loss_sha = "", 0, 0, [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            if seen:
                out.append((now, totals[0], turns_sha.hexdigest(), totals[1], loss_sha.hexdigest(), totals[2], totals[3]))

        for batch in batches:
            for part in pieces(batch):
                for conv, _, chars, start, stop, text in zip(*(c.to_pylist() for c in part.columns)):
                    if not seen or conv != now:
                        close()
                        now, seen = conv, True
                        known, parsed_to, at, totals, turns_sha, loss_sha = "", 0, 0, [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                    common = min(len(text), max(0, len(known) - at))
                    if known[at : at + common] != text[:common]:
                        raise ValueError(f"conversation {conv}: an example does not begin with the one before it")
                    known += text[common:]
                    at += len(text)
                    totals[2] += len(text)
                    if at < chars:
                        continue
                    while parsed_to < at:
                        found = _TURN.match(known, parsed_to)
                        if not found:
                            raise ValueError(f"not a turn: {known[parsed_to:parsed_to + 100]!r}")
                        totals[0] += 1
                        turns_sha.update(f"{unescaped(found[1])}\n{unescaped(found[2])}\n".encode())
                        parsed_to = found.end()
                    if start is not None:
                        target = unescaped(known[start:stop])
                        totals[1] += len(target)
                        loss_sha.update(target.encode())
                    totals[3] += 1
                    at = 0
            yield _rows(out, schema)
            out.clear()
        close()
        yield _rows(out, schema)

    return output.mapInArrow(scan, schema)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(schema.split(", "))
    named = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], [n for n, _ in named])


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation what `read_back` reads from all its examples, each written out with its context."""
    return read_back(expanded(turns(conversations)))
