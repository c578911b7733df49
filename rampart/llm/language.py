"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader and elastic-net penalties, then calibrated by one
temperature.

A text's features are the 1- to 3-grams of its letters in lower case, any run of other characters
being one space, hashed into `FEATURES` slots, weighed 1 + log(count) times the slot's idf, to
length one.  Document frequencies cover all training rows; the weights are fitted on a sample of
them, bounded by `sample` rows, dealt evenly over the languages.

Without letters, or for null, the prediction is `und` with score 0; so it is for every text if no
training row has a language.  Ties go to the language first by name.  Rows without an id are
never held out.  Repeated rows count as often as they occur.  Empty tables give empty results.
Texts are read in slices, so their length is not bounded.  The languages are taken to be few: the
model has FEATURES x languages weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import pieces, small_batches, texts, written

FEATURES = 1 << 15
#: Characters read at a time.
SLICE = 1 << 20
NONE = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def counts(text: str) -> np.ndarray:
    """How often each feature slot occurs; all zero if the text has no letter."""
    letter = _letters()
    total = np.zeros(FEATURES, np.int64)
    tail = np.array([32], np.uint64)
    any_letter = False

    def add(new: np.ndarray) -> np.ndarray:
        line, k = np.concatenate((tail, new)), len(tail)
        grams = [new]
        for n in (2, 3):
            if len(line) >= n:
                g = line[: len(line) - n + 1].copy()
                for j in range(1, n):
                    g = g * np.uint64(1_000_003) + line[j : len(line) - n + 1 + j]
                grams.append(g[max(k - n + 1, 0) :] + np.uint64(n << 50))
        slots = (np.concatenate(grams) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        total[:] += np.bincount(slots.astype(np.int64), minlength=FEATURES)
        return line[-2:]

    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        is_letter = letter[code.astype(np.int64)]
        any_letter = any_letter or bool(is_letter.any())
        code[~is_letter] = 32
        before = np.concatenate((tail[-1:], code[:-1]))
        code = code[(code != 32) | (before != 32)]
        if len(code):
            tail = add(code)
    if not any_letter:
        return np.zeros(FEATURES, np.int64)
    if tail[-1] != 32:
        add(np.array([32], np.uint64))
    return total


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of length one; empty without letters."""
    if not text:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    n = counts(text)
    slots = np.flatnonzero(n)
    value = (1 + np.log(n[slots])) * idf[slots] if len(slots) else np.zeros(0)
    norm = np.sqrt((value * value).sum())
    return slots.astype(np.int32), (value / (norm or 1)).astype(np.float32)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Per slot, in how many of the texts it occurs; and their number.  Every task adds up its
    own; FEATURES + 1 sums reach the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for part in pieces(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        df += counts(text) > 0
                        n += 1
        slots = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(df[slots], n))], ["slot", "n"])

    sums = rows.select("text").mapInArrow(scan, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(FEATURES, np.int64), 0
    for r in sums:
        if r.slot < 0:
            total = r.n
        else:
            df[r.slot] = r.n
    return df, total


def weights(z: np.ndarray, n: np.ndarray, rate: float, l1: float, l2: float) -> np.ndarray:
    """The leader's weights: zero where |z| stays within the l1 penalty."""
    w = (np.sign(z) * l1 - z) / ((1 + np.sqrt(n)) / rate + l2)
    return np.where(np.abs(z) <= l1, 0, w)


def follow(examples: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, rate: float, l1: float, l2: float) -> None:
    """One pass over (slots, values, class), updating the sums z and n in place."""
    for slots, values, label in examples:
        zs, ns = z[slots], n[slots]
        w = weights(zs, ns, rate, l1, l2)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        grown = ns + g * g
        z[slots] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / rate * w
        n[slots] = grown


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm within 0.02 .. 50.
    Labels are smoothed by one row in their number plus two, or rows that the model separates
    without error would push the temperature to zero."""
    if not len(labels):
        return 1.0
    doubt = 1 / (len(labels) + 2)
    aim = np.full(logits.shape, doubt / logits.shape[1])
    aim[np.arange(len(labels)), labels] += 1 - doubt

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - (aim * x).sum(axis=1)).mean())

    a, b, r = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, w: np.ndarray, t: float):
        self.languages, self.idf, self.w, self.t = languages, idf, w, t

    def logits(self, text: str | None) -> np.ndarray | None:
        slots, values = features(text, self.idf)
        return values @ self.w[slots] if len(slots) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        x = self.logits(text) if self.languages else None
        if x is None:
            return NONE, 0.0
        p = softmax(x / self.t)
        return self.languages[int(p.argmax())], float(p.max())


def fit(
    rows: DataFrame, sample: int = 8000, shards: int = 6, rounds: int = 4, rate: float = 0.5, l1: float = 0.02, l2: float = 1e-4,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Fits on the rows that have a language.  `sample` bounds the rows that weights are fitted on:
    each language gets an equal share of it, taken by a hash of the id.  A fifth of the sample sets
    the temperature; the rest is dealt into `shards` that follow the leader side by side, and their
    sums are averaged after each round."""
    spark = small_batches(rows).sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), 1.0)
    df, total = document_frequencies(rows)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    known = spark.sparkContext.broadcast(idf)

    share = sample / len(languages)
    chances = spark.createDataFrame([(k, i, min(1.0, share / per[k])) for i, k in enumerate(languages)], "lang string, label int, chance double")
    hashed = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    chosen = rows.join(F.broadcast(chances), "lang").filter(hashed < F.col("chance") * (1 << 30))  # one row per language

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [features(t, known.value) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s for s, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
                    ["doc_id", "label", "slots", "vals"],
                )

    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5 * shards)).cast("int")
    ready = chosen.select("doc_id", "label", "text").mapInArrow(scan, "doc_id long, label int, slots array<int>, vals array<float>")
    ready = written(ready.withColumn("part", part).filter("size(slots) > 0"))  # parts under `shards` calibrate
    size = (FEATURES, len(languages))
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def train(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["doc_id", "label"], kind="stable")
            order = np.random.default_rng(0).permutation(len(group))
            zs, ns = (x.copy() for x in state.value)
            s, v, y = group["slots"].to_numpy(), group["vals"].to_numpy(), group["label"].to_numpy()
            follow([(s[i], v[i].astype(np.float64), int(y[i])) for i in order], zs, ns, rate, l1, l2)
            return pd.DataFrame({"z": [zs.astype(np.float32).tobytes()], "n": [ns.astype(np.float32).tobytes()]})

        dealt = ready.filter(F.col("part") >= shards).groupBy((F.col("part") % shards).alias("shard"))
        sums = dealt.applyInPandas(train, "z binary, n binary").collect()  # `shards` rows
        if sums:
            z, n = (np.mean([np.frombuffer(r[k], np.float32) for r in sums], axis=0, dtype=np.float64).reshape(size) for k in ("z", "n"))
    w = weights(z, n, rate, l1, l2).astype(np.float32)
    held = ready.filter(F.col("part") < shards).select("label", "slots", "vals").collect()  # a fifth of the sample
    logits = np.array([np.asarray(r.vals) @ w[np.asarray(r.slots)] for r in held]).reshape(len(held), len(languages))
    return Model(languages, idf, w, temperature(logits, np.array([r.label for r in held], np.int64)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [shared.value.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """One row in four by the checksum of its id; never a row without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows that are not held out."""
    model = fit(docs.filter(~held_out()), **options)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.0, **options) -> DataFrame:
    """The rows of `docs`, all columns, whose text is not `und` and has its language at a score of
    `least` or more; a missing lang is filled in.  If no row is labelled, all rows with a letter
    stay.  By default no text is turned away for being short or mixed."""
    model = fit(docs.filter(~held_out()), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def guess(text: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in text]
        return pa.StructArray.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"])

    guess = guess.asNondeterministic()  # or the filter would evaluate it a second time
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), guess(F.col("text").cast("string")).alias("_guess"))
    good = (F.col("_guess.lang") != NONE) & (F.col("_guess.score") >= least) if model.languages else F.col("_doc.text").rlike(r"\p{L}")
    lang = F.coalesce("_doc.lang", "_guess.lang") if model.languages else F.col("_doc.lang")
    return rows.filter(good).select(*[lang.alias(c) if c == "lang" else F.col(f"_doc.`{c}`") for c in docs.columns])
