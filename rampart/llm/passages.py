"""Repeated passages by collinear chaining.

Seeds: of every `window` consecutive k-grams of words (lower-cased A-Z) the one with the smallest
hash, so any run of k + window - 1 equal words shares a seed.  A seed that occurs in more than one
document ties each of its documents to the first one (the smallest id), never document to document
at large: the ties grow with the text, whatever a passage's number of copies.

Ties to first holders miss a passage whose parts first stand in different documents, each part too
short to report.  So a second round takes the runs of `least` words whose seeds are all shared and
that no exact passage of the first round covers, ties every such run as one gram to its first
holder, and goes through the same chains and alignment: documents that share a run of `least` equal
words are always linked by passages that hold this run.

Chains: the ties of a document to one other, ordered in both, are chained by a Fenwick tree over
the positions in the other: each seed counts one, less a cost per word of gap.  Chains are cut at
gaps above `max_gap` words.

Alignment: the words of both sides around a chain are fetched and compared: equal words in the
gaps are matched, the ends are extended, pieces with enough words and identity are passages.  Of a
piece with less identity the longest stretches that have enough are.

Texts are hashed, ties chained and chains compared a batch at a time, not one by one: only ties out
of order go through the tree singly, and only chains that shift or fall short as a whole through `align`.

Documents without an id take no part; rows repeated under one id are one document, equal passages
of which are reported once.  Null and short texts have no seeds.  Empty tables give empty
results; columns besides id and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import pieces, texts, written

#: Bits of the two filters that are broadcast: eight megabytes, whatever the input.
FILTER_BITS = 1 << 26
#: Bytes hashed at a time, and what is left of the last word.
BLOCK = 1 << 16

_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i up to n at least."""
    size = 1 << max(n, 1).bit_length()
    if size not in _POWERS:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size + 1, b, np.uint64)
            p[0] = 1
            _POWERS[size] = (*_POWERS.get(size, ()), np.cumprod(p, dtype=np.uint64))
    return _POWERS[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def _bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All values of a string or binary column as one, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return data[int(at[0]) : int(at[-1])].to_pybytes() if data else b"", at - at[0]


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a column of texts, and how many words stand before each text
    and in all."""
    text, rows = _bytes(column)
    code = np.frombuffer(text.lower(), np.uint8)
    space, border = _SPACES[code], np.zeros(len(code) + 1, bool)
    border[rows] = True
    before, behind = border[:-1].copy(), border[1:].copy()
    before[1:] |= space[:-1]
    behind[:-1] |= space[1:]
    starts, stops = np.flatnonzero(before & ~space), np.flatnonzero(behind & ~space) + 1
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + BLOCK))
        base, end = int(starts[lo]), int(stops[hi - 1])
        up, down = _powers(end - base + 1)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((code[base:end].astype(np.uint64) + np.uint64(1)) * up[: end - base], out=sums[1:])
        s, e = starts[lo:hi] - base, stops[lo:hi] - base
        out[lo:hi] = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out, np.searchsorted(starts, rows)


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of every word."""
    return hashed(pa.array([text or b""], pa.binary()))[0]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-gram of words."""
    n = max(len(words) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + words[j : j + n]
    return _mixed(h)


def lowest(h: np.ndarray, window: int) -> np.ndarray:
    """Of every `window` consecutive hashes the position of the smallest; of fewer, of all."""
    if len(h) <= window:
        return np.array([int(h.argmin())] if len(h) else [], np.int64)
    at, width = np.arange(len(h)), 1
    while width < window:
        step = min(width, window - width)
        later = h[step:] < h[:-step]  # of equal ones the first stays
        h, at, width = np.where(later, h[step:], h[:-step]), np.where(later, at[step:], at[:-step]), width + step
    return at


def seeds(words: np.ndarray, edges: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (signed) of the seeds of all texts, their positions among all words, the starts of the
    windows of `window` grams, and the number of each one's seed.  A text's edges are those of `hashed`."""
    h, size = grams(words, k), np.diff(edges)
    starts = np.flatnonzero(np.arange(len(words)) + (k + window - 1) <= np.repeat(edges[1:], size))
    at = lowest(h, window)[starts] if len(starts) else starts
    new = np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]
    few = np.flatnonzero((size >= k) & (size < k + window - 1))  # one seed each
    cells = edges[few][:, None] + np.arange(window - 1)
    inside = cells <= (edges[few + 1] - k)[:, None]
    low = np.where(inside, h[np.minimum(cells, len(h) - 1)], ~np.uint64(0)).argmin(axis=1) if len(few) else few
    found = np.concatenate((at[new], edges[few] + low))
    return h[found].view(np.int64), found, starts, np.cumsum(new) - 1


def runs(good: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n windows that are all good."""
    bad = np.concatenate(([0], np.cumsum(~good)))
    return np.flatnonzero(bad[n:] == bad[: max(len(bad) - n, 0)])


def _spans(at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers of one row, as indices."""
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0))
    return np.concatenate(([0], cut + 1)), np.append(cut, len(at) - 1)


def uncovered(runs: list[tuple[int, int]], exact: list[tuple[int, int]], long: int) -> bool:
    """Whether a gram of `long` words that starts in one of the runs (first start, last start) lies
    in none of the exact passages (start, stop)."""
    exact = sorted(exact)
    for first, last in runs:
        for start, stop in exact:
            if start <= first <= stop - long:
                first = stop - long + 1
        if first <= last:
            return True
    return False


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


def thinned(a: np.ndarray, b: np.ndarray, edges: np.ndarray, k: int) -> np.ndarray:
    """Of chains of k-grams that overlap, which suffice: the edges of every stretch of consecutive
    grams, and some between, not more than k apart."""
    new = (np.diff(a, prepend=0) != 1) | (np.diff(b, prepend=0) != 1)
    new[edges[:-1]] = True
    return new | np.append(new[1:], True) | (a % k == 0)


def _tree(a: np.ndarray, b: np.ndarray, cost: float) -> tuple[list[int], list[int]]:
    """Indices of the ties (a[i], b[i]) chain by chain, and the size of each chain."""
    n, rank = len(a), np.unique(b, return_inverse=True)[1] + 1
    size, places, ranks, sums = int(rank.max()) + 1, a.tolist(), rank.tolist(), (cost * (a + b)).tolist()
    best, who = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, before = [1.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and places[j] == places[i]:  # ties of one position cannot follow one another
            top, at, x = -np.inf, -1, ranks[j] - 1
            while x > 0:
                if best[x] > top:
                    top, at = best[x], who[x]
                x &= x - 1
            if top > sums[j]:
                score[j], before[j] = 1 + (top - sums[j]), at
            j += 1
        for t in range(i, j):
            value, x = score[t] + sums[t], ranks[t]
            while x <= size:
                if value > best[x]:
                    best[x], who[x] = value, t
                x += x & -x
        i = j
    used, order, sizes = [False] * n, [], []
    for x in np.argsort(-np.array(score), kind="stable").tolist():
        line = []
        while x >= 0 and not used[x]:
            used[x] = True
            line.append(x)
            x = before[x]
        if line:
            order += line[::-1]
            sizes.append(len(line))
    return order, sizes


def _cut(a: np.ndarray, b: np.ndarray, order: np.ndarray, edges: np.ndarray, max_gap: int, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains, each a slice of `order`, cut at gaps above `max_gap`; what has at least `fewest` ties."""
    new = (np.diff(a[order], prepend=0) > max_gap) | (np.diff(b[order], prepend=0) > max_gap)
    new[edges[:-1]] = True
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    return order[np.repeat(sizes >= fewest, sizes)], _edges(sizes[sizes >= fewest])


def chains(a: np.ndarray, b: np.ndarray, max_gap: int, cost: float = 0.01) -> list[np.ndarray]:
    """Index arrays of the chains over ties (a[i], b[i]), ordered by a and then b.  A seed counts
    one; a link costs `cost` per word of gap on either side."""
    order, edges = lined_up(np.zeros_like(a), np.zeros_like(a), a, b, max_gap, 1, cost)
    return np.split(order, edges[1:-1])


def lined_up(
    doc: np.ndarray, ref: np.ndarray, a: np.ndarray, b: np.ndarray, max_gap: int, fewest: int, cost: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """The chains of at least `fewest` ties of many pairs of documents, ordered by pair, a and b:
    the indices of all their ties, and where among these each chain begins and the last ends."""
    new = (np.diff(doc) != 0) | (np.diff(ref) != 0)
    pairs = np.append(np.flatnonzero(np.append(True, new))[: len(doc)], len(doc))
    wrong = np.flatnonzero(~new & ((np.diff(a) <= 0) | (np.diff(b) <= 0)))
    tangled = np.zeros(len(pairs) - 1, bool)
    tangled[np.searchsorted(pairs, wrong, "right") - 1] = True
    sizes = np.diff(pairs)  # all ties in order: with links dearer than a seed cut below, all chain
    order, edges = [np.flatnonzero(np.repeat(~tangled, sizes))], [sizes[~tangled]]
    for i in np.flatnonzero(tangled & (sizes >= fewest)).tolist():
        s, e = pairs[i], pairs[i + 1]
        found, lengths = _tree(a[s:e], b[s:e], cost)
        order.append(np.array(found) + s), edges.append(np.array(lengths))
    return _cut(a, b, np.concatenate(order), _edges(np.concatenate(edges)), max_gap, fewest)


def _common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two short arrays."""
    equal = x[:, None] == y[None, :]
    if not equal.any():
        return []
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], (best[i + 1, 1:] + 1) * equal[i])
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if equal[i, j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _grow(equal: np.ndarray) -> int:
    """How far an end may be extended over these comparisons: to the highest sum of +1 and -2."""
    if not len(equal):
        return 0
    sums = np.cumsum(np.where(equal, 1, -2))
    return int(sums.argmax()) + 1 if sums.max() > 0 else 0


def parts(s: np.ndarray, t: np.ndarray, least: int, identity: float) -> list[tuple[int, int]]:
    """First and last match of the passages along the matches (s[i], t[i]): the longest stretch of at
    least `least` words on both sides, `identity` of them matched, then the same on either side of it.
    A longest stretch begins and ends where runs of equal words do."""
    jump = np.flatnonzero((np.diff(s) != 1) | (np.diff(t) != 1))
    heads, tails = np.concatenate(([0], jump + 1)), np.append(jump, len(s) - 1)
    out, todo = [], [(0, len(heads))]
    while todo:
        lo, hi = todo.pop()
        best, at = 0, None
        for i in range(lo, hi):
            head, ends = int(heads[i]), tails[i:hi]
            n, m = s[ends] - s[head] + 1, t[ends] - t[head] + 1
            if min(n[-1], m[-1]) < max(least, best + 1):
                break  # later heads leave fewer words
            good = np.flatnonzero((np.minimum(n, m) >= least) & (ends - head + 1 >= identity * np.maximum(n, m)))
            if len(good) and min(n[good[-1]], m[good[-1]]) > best:
                best, at = int(min(n[good[-1]], m[good[-1]])), (i, i + int(good[-1]))
        if at:
            out.append((int(heads[at[0]]), int(tails[at[1]])))
            todo += [(lo, at[0]), (at[1] + 1, hi)]
    return sorted(out)


def align(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, least: int, identity: float, loose: int = 8) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, stop, other start, other stop, matched) along the anchors (a[i], b[i]) in
    the words x and y."""
    px, py = [], []

    def same(i: int, j: int, n: int) -> None:
        at = np.flatnonzero(x[i : i + n] == y[j : j + n])
        px.append(at + i), py.append(at + j)

    left = _grow(x[: a[0]][::-1][: b[0]] == y[: b[0]][::-1][: a[0]])
    i, j = int(a[0]) - left, int(b[0]) - left
    turns = np.append(np.flatnonzero(np.diff(a - b)), len(a) - 1)  # the last anchors before a shift
    last, t = turns[np.searchsorted(turns, np.arange(len(a)))].tolist(), 0
    places, others = a.tolist(), b.tolist()
    while t < len(a):
        p, q = places[t], others[t]
        if p - i != q - j and p >= i and q >= j:
            n = min(p - i, q - j)
            head = int(np.argmin(np.append(x[i : i + n] == y[j : j + n], False)))
            same(i, j, head)
            i, j = i + head, j + head
            if max(p - i, q - j) <= 96 and min(p - i, q - j) > 0:
                pairs = np.array(_common(x[i:p], y[j:q]), np.int64).reshape(-1, 2)
                px.append(pairs[:, 0] + i), py.append(pairs[:, 1] + j)
            i, j = p, q
        elif p - i != q - j:  # the grams overlap on one side only: go on behind what is matched
            skip = max(i - p, j - q)
            if skip >= k:
                t += 1
                continue
            i, j = p + skip, q + skip
        t = last[t]  # up to the next shift only words at the same distance meet
        n = places[t] + k - i
        same(i, j, n)
        i, j, t = i + n, j + n, t + 1
    n = min(len(x) - i, len(y) - j)
    same(i, j, _grow(x[i : i + n] == y[j : j + n]))
    u, v = np.concatenate(px), np.concatenate(py)
    if not len(u):
        return []
    cut = np.flatnonzero((np.diff(u) > loose + 1) | (np.diff(v) > loose + 1)) + 1
    out = []
    for s, t in zip(np.split(u, cut), np.split(v, cut)):
        for i, j in parts(s, t, least, identity):
            out.append((int(s[i]), int(s[j]) + 1, int(t[i]), int(t[j]) + 1, j - i + 1))
    return out


def _grown(equal: np.ndarray, room: np.ndarray) -> np.ndarray:
    """`_grow` of many rows, of each only the first `room` comparisons."""
    if not equal.size:
        return np.zeros(len(equal), np.int64)
    step = np.where(equal, 1, -2)
    step[np.arange(equal.shape[1]) >= room[:, None]] = -3 * equal.shape[1]
    sums = np.cumsum(step, axis=1)
    return np.where(sums.max(axis=1) > 0, sums.argmax(axis=1) + 1, 0)


def straight(
    x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, least: int, identity: float, loose: int = 8,
) -> tuple[np.ndarray, np.ndarray]:
    """`align` of many chains without a shift, whose anchors reach over n[i] words from a[i] and b[i]: the
    passages, a column each (start, stop, other start, other stop, matched), and a number for each chain: 1 if its
    column is the answer, 0 if there is none, -1 if only `align` can tell.  The words of chain i stand in
    x[xs[0, i] : xs[1, i]] and y[ys[0, i] : ys[1, i]]."""
    room = np.minimum(a, b)
    back = np.arange(1, int(room.max(initial=0)) + 1)
    at = lambda words, start, step: words[np.clip(start[:, None] + step, 0, max(len(words) - 1, 0))]
    left = _grown(at(x, xs[0] + a, -back) == at(y, ys[0] + b, -back), room)
    room = np.minimum(xs[1] - xs[0] - a, ys[1] - ys[0] - b) - n
    on = np.arange(int(room.max(initial=0)))
    right = _grown(at(x, xs[0] + a + n, on) == at(y, ys[0] + b + n, on), room)
    start, other, size = a - left, b - left, left + n + right
    edges = _edges(size)
    row, word = np.repeat(np.arange(len(a)), size), np.arange(edges[-1]) - np.repeat(edges[:-1], size)
    same = x[(xs[0] + start)[row] + word] == y[(ys[0] + other)[row] + word]
    matched = np.bincount(row[same], minlength=len(a))
    row, word = row[same], word[same]
    whole = same[edges[:-1]] & same[edges[1:] - 1]  # not if the hashes of unequal grams are equal
    whole[row[1:][(row[1:] == row[:-1]) & (np.diff(word) > loose + 1)]] = False
    good = whole & (matched >= identity * size)
    return np.array((start, start + size, other, other + size, matched)), np.where(size < least, 0, np.where(good, 1, -1))


def _filter(numbers: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS of the column `n`: of fixed size, so it may be broadcast."""
    slot = F.pmod("n", F.lit(FILTER_BITS))
    words = numbers.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    found = words.toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _in(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = numbers & (FILTER_BITS - 1)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def passages(
    docs: DataFrame, k: int = 5, window: int = 6, least: int = 40, identity: float = 0.8, max_gap: int = 32, margin: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start_word, end_word, ref_doc_id, ref_start, ref_end, matched_words, identity: one row
    per passage of at least `least` words that a document shares with an earlier one (smaller id).
    Words count from 0, ends are exclusive."""
    spark = docs.sparkSession
    long = max(least, k + window - 1)  # shorter runs need not share a seed
    docs = texts(docs, id_col, text_col).filter("doc_id is not null and text is not null")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words, edges = hashed(part.column(1))
                h, at, _, _ = seeds(words, edges, k, window)
                yield _batch([pa.array(h), part.column(0).take(pa.array(np.searchsorted(edges, at, "right") - 1))], ["h", "doc"])

    held = docs.mapInArrow(plant, "h long, doc long").groupBy("h").agg(F.min("doc").alias("ref"), F.max("doc").alias("_last"))
    shared = written(held.filter("ref < _last").select("h", "ref"))
    wanted = spark.sparkContext.broadcast(_filter(shared.select(F.col("h").alias("n"))))

    def open_runs(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """The words of texts and their edges, hashes and positions of the seeds that may be shared, and the starts of
        grams of `long` words all of whose seeds may be."""
        words, edges = hashed(part.column(1))
        h, at, starts, seed = seeds(words, edges, k, window)
        hit = _in(wanted.value, h)
        good = np.zeros(len(words), bool)
        good[starts] = hit[seed]
        long_ = runs(good, long - k - window + 2)
        return words, edges, h[hit], at[hit], long_[long_ + long <= edges[np.searchsorted(edges, long_, "right")]]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seeds that may be shared; with `upto`, the first and last starts of grams of `long` words all of
        whose seeds may be."""
        for batch in batches:
            for part in pieces(batch):
                _, edges, h, at, starts = open_runs(part)
                upto = np.full(len(at), -1)
                row = np.searchsorted(edges, np.concatenate((at, starts)), "right") - 1
                if len(starts):
                    first, last = _spans(starts, row[len(at) :])
                    h, upto = np.append(h, np.zeros(len(first), np.int64)), np.append(upto, starts[last] - edges[row[len(at) + last]])
                    at, row = np.append(at, starts[first]), np.append(row[: len(at)], row[len(at) + first])
                yield _batch([pa.array(h), part.column(0).take(pa.array(row)), pa.array(at - edges[row]), pa.array(upto)], ["h", "doc", "pos", "upto"])

    picked = written(docs.mapInArrow(pick, "h long, doc long, pos long, upto long"))

    def tied(places: DataFrame, shared: DataFrame) -> DataFrame:
        found = written(places.join(shared, "h"))
        first = written(found.filter("doc = ref").groupBy("h").agg(F.min("pos").alias("rpos")))  # a plain side: hot seeds can be split
        return found.filter("doc > ref").join(first, "h").select("doc", "ref", "pos", "rpos")

    def link(batches: Iterator[pa.RecordBatch], k: int, fewest: int) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by document and reference; a group may go on in the next batch."""
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            if not len(rows[0]):
                continue
            if rest and (len(new) or rest[0][0][0] != rows[0][0] or rest[0][1][0] != rows[1][0]):
                last = int(new[-1]) if len(new) else 0
                yield chained([np.concatenate(c) for c in zip(*rest, [r[:last] for r in rows])], k, fewest)
                rest, rows = [], [r[last:] for r in rows]
            elif len(new):
                yield chained([r[: new[-1]] for r in rows], k, fewest)
                rows = [r[new[-1] :] for r in rows]
            rest.append(rows)
        if rest:
            yield chained([np.concatenate(c) for c in zip(*rest)], k, fewest)

    def chained(rows: list[np.ndarray], k: int, fewest: int) -> pa.RecordBatch:
        order, edges = lined_up(*rows, max_gap, fewest)
        doc, ref, a, b = (r[order] for r in rows)
        heads = edges[:-1]
        doc, ref = doc[heads], ref[heads]
        if fewest == 1:
            kept = thinned(a, b, edges, k)
            a, b, edges = a[kept], b[kept], _edges(kept)[edges]
        at = pa.array(edges, pa.int32())
        return _batch([pa.array(doc), pa.array(ref), pa.ListArray.from_arrays(at, pa.array(a)), pa.ListArray.from_arrays(at, pa.array(b))], ["doc", "ref", "pos", "rpos"])

    def lined(ties: DataFrame, k: int, fewest: int) -> DataFrame:
        ordered = ties.repartition("doc", "ref").sortWithinPartitions("doc", "ref", "pos", "rpos")
        return written(ordered.mapInArrow(lambda batches: link(batches, k, fewest), "doc long, ref long, pos array<long>, rpos array<long>"))

    def sign(batches: Iterator[pa.RecordBatch], needed: Broadcast) -> Iterator[pa.RecordBatch]:
        """Every word of the documents that chains need, as the upper half of its hash."""
        for batch in batches:
            good = _in(needed.value, batch.column(0).to_numpy())
            for part in pieces(batch.filter(pa.array(good))):
                words, edges = hashed(part.column(1))
                words = (words >> np.uint64(32)).astype("<u4")
                column = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(words)])
                yield _batch([part.column(0), column], ["id", "words"])

    def compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start_word", "end_word", "ref_doc_id", "ref_start", "ref_end", "matched_words", "identity"]
        for batch in batches:
            for part in pieces(batch, 2048):
                doc, ref, x0, y0 = (part.column(n).to_numpy() for n in ("doc", "ref", "x0", "y0"))
                (x, xs), (y, ys) = ((np.frombuffer(t, "<u4"), np.array((at[:-1], at[1:])) // 4) for t, at in (_bytes(part.column(n)) for n in "xy"))
                edges = _edges(pc.list_value_length(part.column("pos")).to_numpy())
                a, b = (part.column(n).flatten().to_numpy() - np.repeat(o, np.diff(edges)) for n, o in (("pos", x0), ("rpos", y0)))
                heads, tails = edges[:-1], edges[1:] - 1
                shifts = np.flatnonzero(np.diff(a - b) != 0) + 1
                even = ~np.isin(np.arange(len(doc)), np.searchsorted(edges, np.setdiff1d(shifts, heads), "right") - 1)
                spans, sure = straight(x, y, xs[:, even], ys[:, even], a[heads][even], b[heads][even], (a[tails] + k - a[heads])[even], least, identity)
                row, found = [np.flatnonzero(even)[sure > 0]], [spans[:, sure > 0]]
                for i in np.sort(np.concatenate((np.flatnonzero(~even), np.flatnonzero(even)[sure < 0]))).tolist():
                    s, e = edges[i], edges[i + 1]
                    more = align(x[xs[0, i] : xs[1, i]], y[ys[0, i] : ys[1, i]], a[s:e], b[s:e], k, least, identity)
                    if more:
                        row.append(np.full(len(more), i)), found.append(np.array(more).T)
                at, (s, e, s2, e2, n) = np.concatenate(row), np.concatenate(found, axis=1)
                out = (doc[at], s + x0[at], e + x0[at], ref[at], s2 + y0[at], e2 + y0[at], n, n / np.maximum(e - s, e2 - s2))
                yield _batch([pa.array(c) for c in out], names)

    def aligned(lines: DataFrame, k: int) -> DataFrame:
        involved = lines.select(F.explode(F.array("doc", "ref")).alias("n"))
        needed = spark.sparkContext.broadcast(_filter(involved))
        signed = docs.mapInArrow(lambda batches: sign(batches, needed), "id long, words binary")
        from_ = lambda c: F.greatest(F.col(c)[0] - margin, F.lit(0))
        until = lambda c: F.element_at(c, -1) + k + margin
        cut = lambda start, stop: F.expr(f"substring(words, cast(4 * {start} + 1 as int), cast(4 * ({stop} - {start}) as int))")
        lines = lines.select("*", from_("pos").alias("x0"), until("pos").alias("x1"), from_("rpos").alias("y0"), until("rpos").alias("y1"))
        sided = lines.join(signed, lines["doc"] == signed["id"]).select("doc", "ref", "pos", "rpos", "x0", "y0", "y1", cut("x0", "x1").alias("x"))
        sided = sided.join(signed, sided["ref"] == signed["id"]).select("doc", "ref", "pos", "rpos", "x0", "y0", "x", cut("y0", "y1").alias("y"))
        # of several texts under one id only those that reach as far as the chain
        sided = sided.filter(F.octet_length("x") >= 4 * (F.element_at("pos", -1) + k - F.col("x0"))).filter(F.octet_length("y") >= 4 * (F.element_at("rpos", -1) + k - F.col("y0")))
        return sided.mapInArrow(lambda batches: compare(batches, k), "doc_id long, start_word long, end_word long, ref_doc_id long, ref_start long, ref_end long, matched_words long, identity double")

    found = written(aligned(lined(tied(picked.filter("upto < 0").select("h", "doc", "pos"), shared), k, 2), k).distinct())

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), *([[(x["s"], x["e"]) for x in c or ()] for c in batch.column(n).to_pylist()] for n in (1, 2)))
            yield _batch([pa.array([i for i, r, exact in rows if uncovered(r, exact, long)], pa.int64())], ["n"])

    of = lambda df, doc, s, e, name: df.groupBy(F.col(doc).alias("doc")).agg(F.collect_list(F.struct(F.col(s).alias("s"), F.col(e).alias("e"))).alias(name))
    whole = of(found.filter("matched_words = end_word - start_word and matched_words = ref_end - ref_start"), "doc_id", "start_word", "end_word", "exact")
    rest = of(picked.filter("upto >= 0"), "doc", "pos", "upto", "runs").join(whole, "doc", "left").select("doc", "runs", "exact")
    left = _filter(rest.mapInArrow(open_, "n long"))
    if not left.any():
        return found
    going = spark.sparkContext.broadcast(left)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The grams of `long` words of runs, of documents with such grams outside exact passages."""
        for batch in batches:
            for part in pieces(batch.filter(pa.array(_in(going.value, batch.column(0).to_numpy())))):
                words, edges, _, _, starts = open_runs(part)
                h = grams(words, long)[starts] if len(starts) else np.zeros(0, np.uint64)
                row = np.searchsorted(edges, starts, "right") - 1
                yield _batch([pa.array(h.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(starts - edges[row])], ["h", "doc", "pos"])

    places = written(docs.mapInArrow(take, "h long, doc long, pos long"))
    held = places.groupBy("h").agg(F.min("doc").alias("ref"), F.max("doc").alias("_last"))
    ties = tied(places, written(held.filter("ref < _last").select("h", "ref")))
    # a run in an exact passage is linked to an earlier holder already, at last to the first
    block = lambda at: f"({at}) div 1024"
    known = found.select(
        "doc_id", "start_word", "end_word", F.when(F.expr("matched_words < end_word - start_word or matched_words < ref_end - ref_start"), F.col("ref_doc_id")).alias("only"),
    ).filter(F.col("end_word") - F.col("start_word") >= long)
    known = known.withColumn("_b", F.explode(F.expr(f"sequence({block('start_word')}, {block(f'end_word - {long}')})")))
    inside = (F.col("doc") == F.col("doc_id")) & (F.expr(block("pos")) == F.col("_b")) & (F.col("pos") >= F.col("start_word")) & (F.col("pos") + long <= F.col("end_word")) & (F.col("only").isNull() | (F.col("only") == F.col("ref")))
    again = aligned(lined(ties.join(known, inside, "left_anti"), long, 1), long)
    return found.union(again).distinct()
