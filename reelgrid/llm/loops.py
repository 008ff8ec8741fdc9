"""Periodic runs: stretches of a clip text in which the metadata model repeats itself word for word.

Works on clip texts: one row per clip with ``clip_id`` and ``description``. A dictionary of basic factors names
all factors of a power-of-two length, twice as long at each level. Occurrences of a factor that follow each other
within twice its length form arithmetic progressions; each proposes its difference as a period, the proposal is
extended as far as the period holds, and proposals of the same stretch become one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices

#: Fewest words of a run, and fewest periods that it spans.
MIN_WORDS, MIN_PERIODS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Words that one comparison of an extension covers.
_STRIDE = 256


def find_loops(texts: DataFrame, key: str = "clip_id", text: str = "description") -> DataFrame:
    """Runs of every whole text, and the text without what its runs repeat.

    Output: ``key``, ``n_words``, ``runs`` (``start`` as word number, ``length`` in words, smallest ``period``; by
    start, then period) and ``collapsed`` (words that lie in no run after the run's first period, joined by one
    space). A run is a stretch of words with smallest period q and max(6, 4 q) words at least, which no neighbouring
    word extends with that period. Words are runs of characters without ASCII spaces.

    A null or empty text has no words, no runs and an empty ``collapsed``. A null key stays null; repeated rows give
    a result each; an empty table gives none; other columns are ignored whatever their names. Rows are independent:
    nothing is shuffled, memory is bounded by a slice of text and the longest text, and a text of n words takes
    O(n log n) steps at most, also when it is one single run.
    """
    names = [key, "n_words", "runs", "collapsed"]

    def run(batches):
        for batch in slices(batches, 1):
            columns = _loops(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    source = texts.select(key, text)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_words bigint, runs {RUNS}, collapsed string")


def _loops(column: pa.Array) -> list[pa.Array]:
    words = [(x or b"").split() for x in column.cast(pa.binary()).to_pylist()]  # bytes split on ASCII spaces only
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(sizes)])
    number: dict[bytes, int] = {}
    tokens = np.fromiter((number.setdefault(w, len(number)) for x in words for w in x), np.int64, int(first[-1]))
    start, length, period = runs_of(tokens, first)
    of = np.searchsorted(first, start, "right") - 1
    dropped = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    with_runs = set(of.tolist())
    collapsed = [
        b" ".join(w for w, k in zip(x, kept[lo : lo + len(x)].tolist(), strict=True) if k) if i in with_runs else b" ".join(x)
        for i, (x, lo) in enumerate(zip(words, first.tolist(), strict=False))
    ]
    values = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], fields=list(_RUN))
    offsets = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
    return [
        pa.array(sizes),
        pa.ListArray.from_arrays(pa.array(offsets), values),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]


def runs_of(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start, then period.

    ``tokens`` holds the word numbers of several texts one after the other; text i has those from ``first[i]`` to
    ``first[i + 1]``. No run crosses from one text to the next.
    """
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = [_extended(tokens, owner, *p) for p in _proposals(tokens + owner * (int(tokens.max(initial=0)) + 1))]
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, stop, period = np.concatenate(found, axis=1)
    long_enough = stop - start >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    start, stop, period = (x[long_enough] for x in (start, stop, period))
    order = np.lexsort((period, stop, start))
    start, stop, period = (x[order] for x in (start, stop, period))
    # A stretch of several periods has its smallest one; greater ones are its multiples.
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(stop) != 0)
    start, stop, period = (x[new] for x in (start, stop, period))
    order = np.lexsort((period, start))
    return start[order], (stop - start)[order], period[order]


def _proposals(names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Periods and stretches of starts (first, stop) in which a word equals the one a period later, level by level.

    ``names`` differ between texts. A factor that crosses into the next text occurs once, so it is never followed
    by another occurrence. Of each level only factors that occur twice live on: a longer factor that occurs twice
    consists of two of them.
    """
    total = len(names)
    name_at = np.full(total, -1, np.int64)
    at, name, size = np.arange(total), names, 1
    while len(at):
        order = np.argsort(name, kind="stable")
        at, name = at[order], name[order]
        gap = np.diff(at)
        same = np.diff(name) == 0
        step = np.where(same, gap, 0)
        # Occurrences at one distance from each to the next: where a progression begins, and how far it leads.
        follows = np.zeros(len(step), bool)
        follows[1:] = (step[1:] == step[:-1]) & (step[1:] > 0)
        begins = np.flatnonzero(~follows & (step > 0) & (step <= 2 * size))
        if len(begins):
            ends = np.append(np.flatnonzero(~follows), len(step))
            terms = ends[np.searchsorted(ends, begins, "right")] - begins
            yield _stretches(at[begins], step[begins], terms, size)
        alive = np.zeros(len(at), bool)
        alive[1:] |= same
        alive[:-1] |= same
        dense = np.cumsum(np.concatenate([[True], ~same])) - 1
        name_at[at] = np.where(alive, dense, -1)
        left = at[alive]
        left = np.sort(left[left + size < total])
        right = name_at[left + size]
        left, right = left[right >= 0], right[right >= 0]
        name = name_at[left] * len(at) + right
        name_at[at] = -1
        at, size = left, 2 * size


def _stretches(
    begin: np.ndarray, step: np.ndarray, terms: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Progressions of one difference that begin at neighbouring words, as one stretch each.

    Terms that overlap or touch (difference <= size) say of all words up to the last one that they equal the word a
    period later; others are sure of their first term only and left to the extension.
    """
    order = np.lexsort((begin, step))
    begin, step, terms = begin[order], step[order], terms[order]
    new = np.ones(len(begin), bool)
    new[1:] = (np.diff(step) != 0) | (np.diff(begin) != 1)
    sure = begin + np.where(step <= size, (terms - 1) * step, 0) + size
    heads = np.flatnonzero(new)
    return begin[heads], np.maximum.reduceat(sure, heads), step[heads]


def _extended(tokens: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Start, end and period of the longest stretches around the proposals in which the period holds."""
    lo, hi = start.copy(), stop.copy()
    total = len(tokens)

    def holds(at: np.ndarray, later: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (later < total)
        a, b = np.where(inside, at, 0), np.where(inside, later, 0)
        return inside & (tokens[a] == tokens[b]) & (owner[a] == owner[b])

    for edge, way in ((lo, -1), (hi, 1)):
        moving = np.arange(len(lo))
        for _ in range(16):  # most proposals end within a few words
            nxt = edge[moving] - (way < 0)
            moving = moving[holds(nxt, nxt + period[moving])]
            if not len(moving):
                break
            edge[moving] += way
        for k in moving.tolist():
            p = int(period[k])
            while True:
                e = int(edge[k])
                span = np.arange(e - 1, max(e - 1 - _STRIDE, -1), -1) if way < 0 else np.arange(e, min(e + _STRIDE, total))
                good = holds(span, span + p)
                n = len(span) if good.all() else int(np.argmin(good))
                edge[k] += way * n
                if n < _STRIDE:
                    break
    found = np.unique(np.stack([lo, hi + period, period]), axis=1)
    return found
