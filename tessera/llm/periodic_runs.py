"""Runs of repeated words: stretches with a period of a few words or many.

Names after Karp, Miller and Rosenberg: level k numbers the 2**k words from
each place, so that equal numbers mean equal words, made from pairs of numbers
of the level below. How far two places agree, forwards or backwards, is read off
by going down the levels. A run of period p has to cover a multiple of
`grid_step(p)`, so only pairs (x, x + p) on that grid are candidates, and each is
extended both ways as far as it agrees. Names are exact: there are no hashes to
verify and no suffixes to sort.

All this is NumPy over the words of some thousand documents at once, laid end
to end between symbols that occur nowhere else. There is no shuffle; a document
is worked on where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import batch_of, mapped, text_slices

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Candidates that are held at once.
CHUNK = 1 << 20
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def names(symbols: np.ndarray) -> list[np.ndarray]:
    """The levels of names, from single symbols up to the longest that occur
    twice: names[k][i] == names[k][j] exactly if the 2**k symbols from i equal
    those from j. Whatever occurs once is named n + i."""
    n = len(symbols)
    dtype = np.int32 if n < 1 << 30 else np.int64
    alone = np.arange(n, 2 * n, dtype=dtype)
    counts = np.bincount(symbols, minlength=1)
    shared, dense = counts[symbols] > 1, np.cumsum(counts > 0) - 1
    levels, level, width = [], np.where(shared, dense[symbols], alone).astype(dtype), 1
    while shared.any():
        levels.append(level)
        # Both halves have to occur twice for the whole to.
        places = np.flatnonzero(shared[: max(n - width, 0)] & shared[width:])
        pairs = level[places].astype(np.int64) * n + level[places + width]
        _, named, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        twice = counts[named] > 1
        level, shared = alone.copy(), np.zeros(n, bool)
        level[places[twice]] = named[twice]
        shared[places[twice]] = True
        width *= 2
    return levels


def agreement(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, backwards: bool = False) -> np.ndarray:
    """How many symbols agree from x and y on, or before them. x < y, and the
    first and last symbols occur once."""
    length = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, level = 1 << k, levels[k]
        if backwards:
            a, b = x - length - width, y - length - width
            same = (a >= 0) & (level[np.maximum(a, 0)] == level[np.maximum(b, 0)])
        else:
            same = level[x + length] == level[y + length]
        length += np.where(same, width, 0)
    return length


def grid_step(period: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """Consecutive places that agree with the one a period on, at the least, in
    a run of that period."""
    return np.maximum(least_words, least_periods * period) - period


def _candidates(reach: np.ndarray, step: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid in chunks, by period: for period p the
    multiples of step[p - 1] below reach[p - 1]."""
    counts = -(-reach // step)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, CHUNK):
        at = np.arange(lo, min(lo + CHUNK, total))
        row = np.searchsorted(ends, at, side="right")
        yield (at - (ends[row] - counts[row])) * step[row], row + 1


def runs(documents: list[list[int]], n_symbols: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document, by start and period.

    Documents are lists of numbers below n_symbols.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    order = [d for d in order if len(documents[d]) >= least_words]
    if not order:
        return found
    sizes = np.array([len(documents[d]) for d in order])
    offsets = 1 + np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    symbols = np.empty(int(offsets[-1] + sizes[-1] + 1), np.int64)
    symbols[np.concatenate([[0], offsets + sizes])] = n_symbols + np.arange(len(order) + 1)
    for d, at in zip(order, offsets.tolist(), strict=True):
        symbols[at : at + len(documents[d])] = documents[d]

    levels = names(symbols)
    periods = np.arange(1, sizes[0] // least_periods + 1)
    step = grid_step(periods, least_words, least_periods)
    # Long documents come first, so those long enough for a period are a prefix.
    fitting = np.searchsorted(-sizes, -(step + periods), side="right")
    reach = (offsets + sizes)[fitting - 1] - periods
    parts = []
    for x, p in _candidates(reach, step):
        same = symbols[x] == symbols[x + p]
        x, p = x[same], p[same]
        before, after = agreement(levels, x, x + p, backwards=True), agreement(levels, x, x + p)
        long = before + after >= step[p - 1]
        start, end = (x - before)[long], (x + p + after)[long]
        # A stretch is found under each multiple of its period; the least stays.
        _, first = np.unique(start * len(symbols) + end, return_index=True)
        parts.append((start[first], end[first], p[long][first]))
    if not parts:
        return found
    start, end, period = (np.concatenate(c) for c in zip(*parts, strict=True))
    _, first = np.unique(start * len(symbols) + end, return_index=True)
    start, end, period = start[first], end[first], period[first]
    by_start = np.lexsort((period, start))
    start, end, period = start[by_start], end[by_start], period[by_start]
    owner = np.searchsorted(offsets, start, side="right") - 1
    for d, s, length, p in zip(owner.tolist(), (start - offsets[owner]).tolist(), (end - start).tolist(), period.tolist(), strict=True):
        found[order[d]].append((s, length, p))
    return found


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row.

    A run is a stretch of words, as long as it can be, in which words a period
    apart are equal; it has at least `least_words` words and `least_periods` of
    its smallest period, which may not be below 2 (below that a stretch has
    no one period). `runs` lists (start, length, period) by start, then period,
    in words from 0; `collapsed` is the text's words, joined by one space,
    without those that a run holds after its first period.

    A null or empty text has no words, no runs and an empty `collapsed`. Null
    keys, repeated rows and empty tables pass through; other columns aren't
    read. Whole texts are read, however long: names take four bytes a word
    for each level, up to the binary logarithm of the longest repeat.
    """
    if least_periods < 2 or least_words < 1:
        raise ValueError("runs need two periods and a word at the least")
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field("key").type), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])
            for start, texts in text_slices(batch, "text"):
                words = [WORD.findall(t) for t in texts]
                numbers: dict[str, int] = {}
                coded = [[numbers.setdefault(w, len(numbers)) for w in one] for one in words]
                found = runs(coded, len(numbers), least_words, least_periods)
                shown = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
                short = [" ".join(collapsed(w, own)) for w, own in zip(words, found, strict=True)]
                yield batch_of(schema, batch.column("key").slice(start, len(texts)), [len(w) for w in words], shown, short)

    kinds = f"key {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return mapped(source, run, kinds).withColumnRenamed("key", key)
