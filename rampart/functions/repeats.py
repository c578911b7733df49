"""Blocks that stand several times in a row, in time close to linear in the text.

A back-reference expression finds them too, but needs time quadratic in the line.  Here
grams of doubling length are numbered; where the distance to the next equal gram stays the
same over a stretch, the stretch is periodic with that distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BLOCK = 10
COPIES = 4


def _numbered(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _has_repeats(text: str) -> bool:
    n = len(text)
    if n < MIN_BLOCK * COPIES:
        return False
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    breaks = chars == 10
    # a line end equals nothing, so no stretch runs over it
    chars[breaks] = 0x110000 + np.arange(int(breaks.sum()))
    ids = _numbered(chars)
    grams = ids[: n - MIN_BLOCK + 1].copy()
    for i in range(1, MIN_BLOCK):
        grams = grams * np.int64(ids.max() + 1) + ids[i : n - MIN_BLOCK + 1 + i]
        if i % 2 == 0 or i == MIN_BLOCK - 1:
            grams = _numbered(grams)
    size = MIN_BLOCK
    while len(grams):
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            return False
        ahead = np.zeros(len(grams), dtype=np.int64)
        ahead[order[:-1][same]] = order[1:][same] - order[:-1][same]
        ahead[ahead > size] = 0
        edges = np.flatnonzero(np.diff(ahead)) + 1
        starts = np.concatenate(([0], edges))
        lengths = np.diff(np.concatenate((starts, [len(ahead)])))
        period = ahead[starts]
        real = period > 0
        period, lengths = period[real], lengths[real]
        block = period * -(-MIN_BLOCK // np.maximum(period, 1))
        if (lengths + size - 1 + period >= COPIES * block).any():
            return True
        if len(grams) <= size:
            return False
        grams = _numbered(grams[:-size] * np.int64(grams.max() + 1) + grams[size:])
        size *= 2
    return False


def _flags(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t is not None and _has_repeats(t)).astype(bool)


def repeats_a_block(text: Column) -> Column:
    """Some block of at least ten characters stands four times in a row, within a line."""
    return F.pandas_udf(_flags, "boolean")(F.when(F.length(text) >= MIN_BLOCK * COPIES, text))
