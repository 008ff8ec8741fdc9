"""Greedy thinning of long sequences in pieces: what is kept depends on what was kept last.

Rows are sorted into pieces of bounded size, so one track or entity is the work of many tasks. A piece tells, for
every state in which it may be entered, in which state it is left: pointers from each row to the next one that would
be kept are doubled until they reach its end. Chaining these maps over the pieces of a key gives the state at each
entry, and a last pass over the pieces picks the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_once
from . import scale

_RECORD = "_piece bigint, head boolean, thresholds array<double>, falls array<boolean>, exits array<double>, state double"
_NAMES = ["_piece", "head", "thresholds", "falls", "exits", "state"]


class _Plain:
    """Rules whose state is the last kept value."""

    def value(self, v: np.ndarray) -> np.ndarray:
        return v

    def after(self, v: np.ndarray) -> np.ndarray:
        return v


@dataclass(frozen=True)
class Advance(_Plain):
    """Keep a value that lies ``step`` or more above the last kept one; values of a key rise."""

    step: float
    start = -np.inf

    def following(self, v: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each row the next row of its key that is kept after it, or the end of the key."""
        low, high = np.arange(1, len(v) + 1), ends.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            far = v[mid] - v >= self.step
            high = np.where(open_ & far, mid, high)
            low = np.where(open_ & ~far, mid + 1, low)
        return high

    def first(self, v: np.ndarray, state: float) -> int:
        hit = v - state >= self.step
        return int(hit.argmax()) if hit.any() else len(v)

    def entries(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that an entry can hit first, and whether they are hit by falling below the state.

        A state lies at or below the first value, so the first row a step above that is hit by every state left.
        """
        rows = np.arange(min(len(v), self.first(v, v[0]) + 1))
        return rows, np.zeros(len(rows), bool)

    def hits(self, threshold: float, fall: bool, state: float) -> bool:
        return threshold - state >= self.step


@dataclass(frozen=True)
class Move(_Plain):
    """Keep a value that differs by ``step`` or more from the last kept one, and always ``full``, the greatest."""

    step: float
    full: float = 1.0
    start = -1.0

    def following(self, v: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = [np.where(np.isnan(v), -np.inf, v)]
        low = [np.where(np.isnan(v), np.inf, v)]
        while (1 << len(high)) <= len(v):
            half = 1 << (len(high) - 1)
            high.append(np.maximum(high[-1][:-half], high[-1][half:]))
            low.append(np.minimum(low[-1][:-half], low[-1][half:]))
        at = np.arange(1, len(v) + 1)
        for k in range(len(high) - 1, -1, -1):
            fits = at + (1 << k) <= ends
            place = np.where(fits, at, 0)
            top, bottom = high[k][place], low[k][place]
            free = ~((top - v >= self.step) | (v - bottom >= self.step) | (top >= self.full))
            at = np.where(fits & free, at + (1 << k), at)
        return at

    def first(self, v: np.ndarray, state: float) -> int:
        hit = (np.abs(v - state) >= self.step) | (v == self.full)
        return int(hit.argmax()) if hit.any() else len(v)

    def entries(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Only new greatest and least values can be the first that differ enough from a state.

        A state that the first value does not hit lies within a step of it, so nothing comes after a row that is two
        steps away from the first value.
        """
        known = np.flatnonzero(~np.isnan(v))
        far = np.abs(v - v[known[0]]) >= 2.000001 * self.step if len(known) else np.zeros(0, bool)
        v = v[: int(far.argmax()) + 1] if far.any() else v
        high = np.maximum.accumulate(np.where(np.isnan(v), -np.inf, v))
        low = np.minimum.accumulate(np.where(np.isnan(v), np.inf, v))
        rises = np.flatnonzero(np.diff(high, prepend=-np.inf) > 0)
        falls = np.flatnonzero(np.diff(low, prepend=np.inf) < 0)
        full = np.flatnonzero(v == self.full)[:1]
        last = full[0] if len(full) else len(v)
        rows = np.concatenate([rises[rises <= last], falls[falls <= last]])
        fall = np.repeat([False, True], [np.count_nonzero(rises <= last), np.count_nonzero(falls <= last)])
        order = np.lexsort((fall, rows))
        return rows[order], fall[order]

    def hits(self, threshold: float, fall: bool, state: float) -> bool:
        return (state - threshold if fall else threshold - state) >= self.step or (threshold == self.full and not fall)


@dataclass(frozen=True)
class Reach:
    """Keep a value at or above what the last kept row reached; values of a key rise. Rows are (value, reach)."""

    start = -np.inf

    def value(self, v: np.ndarray) -> np.ndarray:
        return v[:, 0]

    def after(self, v: np.ndarray) -> np.ndarray:
        return v[:, 1]

    def following(self, v: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = np.arange(1, len(v) + 1), ends.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            free = v[mid, 0] >= v[:, 1]
            high = np.where(open_ & free, mid, high)
            low = np.where(open_ & ~free, mid + 1, low)
        return high

    def first(self, v: np.ndarray, state: float) -> int:
        hit = v[:, 0] >= state
        return int(hit.argmax()) if hit.any() else len(v)

    def entries(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(v)), np.zeros(len(v), bool)

    def hits(self, threshold: float, fall: bool, state: float) -> bool:
        return threshold >= state


def thinned(
    rows: DataFrame, key: str, order: list[str], value: str, rule: Advance | Move | Reach, piece: int = scale.SPAN,
    reach: str | None = None,
) -> DataFrame:
    """Rows that the rule keeps, each key's rows taken by ``order``. Rows without a value are never kept.

    Rows are sorted once into pieces of ``piece`` rows at most and written; a task holds one piece. Per key only the
    maps of its pieces meet in one task, which streams them.
    """
    laid = scale.in_pieces(rows, [key], order, piece)
    kind = laid.schema[key].dataType.simpleString()
    columns = [value, *([reach] if reach else [])]
    records = _by_piece(laid.select(key, *columns, "_piece", "_at")).mapInArrow(
        lambda b: _maps(b, rule, len(columns)), f"`{key}` {kind}, {_RECORD}"
    )
    chained = records.repartition(key).sortWithinPartitions(key, "_piece", "head")
    entries = written_once(chained.mapInArrow(lambda b: _chain(b, rule), "_piece bigint, _entry double"))
    joined = _by_piece(laid.join(entries, "_piece", "left"))
    at = [joined.columns.index(c) for c in (key, *columns)]
    return joined.mapInArrow(lambda b: _kept(b, rule, at), joined.schema).select(*rows.columns)


def _by_piece(df: DataFrame) -> DataFrame:
    return df.repartition("_piece").sortWithinPartitions("_piece", "_at")


def _pieces(batches) -> Iterator[pa.Table]:
    """Whole pieces of rows that arrive sorted by piece."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        piece = np.asarray(batch.column(batch.schema.get_field_index("_piece")))
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if waiting and waiting[-1].column("_piece")[-1].as_py() != int(piece[lo]):
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(lo, hi - lo))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """First rows of the keys of a piece (equal keys are neighbours; null is a key), and its length."""
    codes = pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1)
    codes = np.asarray(codes)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


def _values(table: pa.Table, columns: list[int]) -> np.ndarray:
    """One column as an array, two as an array of pairs."""
    found = [np.asarray(table.column(c).cast(pa.float64()).combine_chunks().fill_null(np.nan), np.float64) for c in columns]
    return found[0] if len(found) == 1 else np.stack(found, axis=1)


def _maps(batches, rule, n_columns: int) -> Iterator[pa.RecordBatch]:
    """Per piece: the map of its first key, and the state in which its last key is left if it began here."""
    for table in _pieces(batches):
        starts, v = _keys(table.column(0)), _values(table, list(range(1, n_columns + 1)))
        piece, names = table.column("_piece")[0].as_py(), table.column(0)
        head = v[: starts[1]]
        out = [(names[0], piece, True, *_map(head, rule), None)]
        if len(starts) > 2:
            tail = v[starts[-2] :]
            out.append((names[int(starts[-2])], piece, False, None, None, None, _left(tail, rule)))
        keys = pa.concat_arrays([pa.array([r[0].as_py()], table.column(0).type) for r in out])
        columns = list(zip(*(r[1:] for r in out), strict=True))
        kinds = [pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [table.column_names[0], *_NAMES]
        )


def _left(v: np.ndarray, rule) -> float | None:
    first = rule.first(v, rule.start)
    return float(_exits(v, rule)[first]) if first < len(v) else None


def _exits(v: np.ndarray, rule) -> np.ndarray:
    """Last kept value if a row is kept: pointers doubled until all have reached the end."""
    n = len(v)
    to = np.append(rule.following(v, np.full(n, n)), n)
    last = np.arange(n + 1)
    while (to[:n] < n).any():
        last = np.where(to < n, last[np.minimum(to, n - 1)], last)
        to = to[to]
    return rule.after(v)[last[:n]]


def _map(v: np.ndarray, rule) -> tuple[list, list, list]:
    """Thresholds in the order of rows: an entry is left with the value beside the first threshold that it hits."""
    if not len(v):
        return [], [], []
    rows, fall = rule.entries(v)
    exits = _exits(v, rule)[rows]
    value = rule.value(v)
    good = ~np.isnan(value[rows])
    rows, fall, exits = rows[good], fall[good], exits[good]
    # of neighbours of one kind and one outcome the last decides
    final = np.append((np.diff(exits) != 0) | (fall[1:] != fall[:-1]), True) if len(rows) else np.zeros(0, bool)
    return value[rows[final]].tolist(), fall[final].tolist(), exits[final].tolist()


def _chain(batches, rule) -> Iterator[pa.RecordBatch]:
    """State at the entry of every piece, along the pieces of each key."""
    unseen = object()
    current, state = unseen, rule.start
    for batch in batches:
        out = []
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for name, piece, head, thresholds, falls, exits, left in rows:
            if name != current:
                current, state = name, rule.start
            if head:
                out.append((piece, state))
                for threshold, fall, after in zip(thresholds, falls, exits, strict=True):
                    if rule.hits(threshold, fall, state):
                        state = after
                        break
            else:
                state = rule.start if left is None else left
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64())], ["_piece", "_entry"]
        )


def _kept(batches, rule, columns: list[int]) -> Iterator[pa.RecordBatch]:
    for table in _pieces(batches):
        starts, v = _keys(table.column(columns[0])), _values(table, columns[1:])
        to = rule.following(v, np.repeat(starts[1:], np.diff(starts)))
        entry = table.column("_entry")[0].as_py()
        at = [rule.first(v[lo:hi], rule.start if k or entry is None else entry) + lo for k, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False))]
        keep = np.zeros(len(v) + 1, bool)
        ends = starts[1:]
        at = np.array(at)
        while len(at):  # all keys of the piece go from kept row to kept row together
            open_ = at < ends
            at, ends = at[open_], ends[open_]
            keep[at] = True
            at = to[at]
        yield from table.filter(pa.array(keep[:-1])).to_batches()
