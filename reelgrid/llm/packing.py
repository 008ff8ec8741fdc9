"""Best-fit packing of model answers into training sequences.

Works on answer texts: one row per answer with ``clip_id`` and ``answer``. Texts become pieces of at most
``max_len`` tokens. Only the histogram of piece lengths (``max_len`` numbers) reaches the driver: patterns of
a few pieces are fitted to it by non-negative least squares, rounded down, and the residual goes best-fit
into the room that the patterns leave. Spark ranks the pieces of each length and looks up their places.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_once
from .batches import all_cores, slices, texts_of
from .pretokens import is_simple, load, special_tokens, word_level

END_ID = 1
#: Lengths are fitted in this many steps of a sequence; a pattern holds at most MAX_PARTS pieces.
STEPS, MAX_PARTS = 64, 4
#: Pieces up to this share of a sequence are not fitted; they close sequences and fill the room that is left.
FILLER_SHARE = 1 / 4
#: Words whose ids a worker remembers (twice as many at most).
REMEMBERED = 300_000
#: Words that are encoded as one text.
TOGETHER = 512
#: Pieces of one length that one task ranks.
RANKED = 200_000
_RANK_BITS = np.uint64(40)


def cut_pieces(
    answers: DataFrame, tokenizer: str, max_len: int, key: str = "clip_id", text: str = "answer"
) -> DataFrame:
    """Pieces of every text: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A text's ids are those of the word-end tokenizer file ``tokenizer`` without added tokens, then END_ID;
    longer texts are cut every ``max_len`` ids. Null and empty texts have one piece, END_ID.
    """
    source = all_cores(answers.select(key, text), text)
    kind = source.schema[0].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        ids = _Ids(tokenizer)
        for batch in slices(batches, 1, 2 << 20):
            row, columns = [], ([], [], [], [])
            for i, raw in enumerate(ids.encoded(texts_of(batch.column(1)))):
                raw += END_ID.to_bytes(4, "little")
                for n, at in enumerate(range(0, len(raw), 4 * max_len)):
                    part = raw[at : at + 4 * max_len]
                    row.append(i)
                    for values, value in zip(columns, (n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        values.append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *arrays], names)

    return source.mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, max_len: int, key: str = "clip_id") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: sequences of at most ``max_len`` tokens without gaps.

    Every row gets a place, also rows that repeat others or have a null key; lengths lie in 1..``max_len``.
    Empty input gives an empty table. The plan on the driver grows with ``max_len`` only.
    """
    names = pieces.columns
    pieces = written_once(pieces.withColumn("_nr", F.monotonically_increasing_id()))  # tells repeated rows apart
    histogram = np.zeros(max_len + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # max_len rows at most
        histogram[length] = n
    plan = pieces.sparkSession.sparkContext.broadcast(make_plan(histogram, max_len))
    salts = 1 + int(histogram.max()) // RANKED
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "_nr"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_row", F.row_number().over(inside) - 1)
        .join(bases, ["length", "_salt"])
        .withColumn("_rank", (F.col("_base") + F.col("_row")).cast("bigint"))
        .select(*names, "_rank")
    )

    def run(batches):
        for batch in batches:
            sequence, offset = plan.value.places(
                batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    fields = [f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack_answers(
    answers: DataFrame, tokenizer: str, max_len: int, key: str = "clip_id", text: str = "answer"
) -> DataFrame:
    """Pieces of all texts with their places, see cut_pieces and pack."""
    return pack(cut_pieces(answers, tokenizer, max_len, key, text), max_len, key)


class _Ids:
    """Ids of texts as little-endian 32-bit bytes, word by word; frequent words are remembered."""

    def __init__(self, path: str):
        self.encoder, self.specials = load(path), special_tokens(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        cut = [
            word_level(x.lower()) if is_simple(x) and not any(s in x for s in self.specials) else None
            for x in texts
        ]
        self._remember({w for words in cut if words for w in words})
        known = self.young.__getitem__
        out = [None if words is None else b"".join(map(known, words)) for words in cut]
        if whole := [x for x, words in zip(texts, cut, strict=True) if words is None]:
            encoded = iter(self._encode(whole))
            out = [next(encoded) if x is None else x for x in out]
        return out

    def _remember(self, words: set[str]) -> None:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        missing = []
        for w in words - self.young.keys():
            if (ids := self.old.get(w)) is None:
                missing.append(w)
            else:
                self.young[w] = ids
        for at in range(0, len(missing), TOGETHER):
            part = missing[at : at + TOGETHER]
            self.young.update(zip(part, self._joined(part) or self._encode(part), strict=True))

    def _joined(self, words: list[str]) -> list[bytes] | None:
        """Ids of words encoded as one text with blanks between; None if the encoder cuts that text otherwise."""
        found = self.encoder.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        word, start = np.array(found.word_ids), np.array([a for a, _ in found.offsets])
        cuts = np.flatnonzero(np.diff(word, prepend=-1))
        if len(cuts) != len(words) or (start[cuts] != ends - [len(w) + 1 for w in words]).any():
            return None
        raw, places = np.array(found.ids, "<u4").tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip(places, [*places[1:], len(raw)], strict=True)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        encoded = self.encoder.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]


class Plan(NamedTuple):
    """Places: pieces of a length with ranks from ``first`` on lie one each in sequences from ``sequence`` on."""

    code: np.ndarray  # length and first rank
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = (length.astype(np.uint64) << _RANK_BITS) | rank.astype(np.uint64)
        at = np.searchsorted(self.code, code, "right") - 1
        return self.sequence[at] + (code - self.code[at]).astype(np.int64), self.offset[at]


def make_plan(histogram: np.ndarray, max_len: int) -> Plan:
    """Places for ``histogram[length]`` pieces of every length."""
    packer = _Packer(histogram, max_len)
    for lengths, times in _patterns(histogram, max_len):
        packer.sequences(lengths, times)
    packer.best_fit()
    order = sorted(range(len(packer.places)), key=lambda i: packer.places[i][:2])
    table = np.array([packer.places[i] for i in order], np.int64).reshape(-1, 4).T
    code = (table[0].astype(np.uint64) << _RANK_BITS) | table[1].astype(np.uint64)
    return Plan(code, table[2], table[3], packer.n_sequences)


class _Packer:
    """Sequences in groups of equal content; each group is a range of sequence ids."""

    def __init__(self, histogram: np.ndarray, max_len: int):
        self.max_len, self.left = max_len, histogram.tolist()
        self.used = [0] * len(self.left)
        self.places: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # room: groups of (first sequence, number)
        self.rooms = 0  # bit r: there are groups with room r
        self.n_sequences = 0

    def put(self, length: int, times: int, sequence: int, room: int) -> None:
        self.places.append((length, self.used[length], sequence, self.max_len - room))
        self.used[length] += times
        self.left[length] -= times

    def keep(self, room: int, sequence: int, times: int) -> None:
        if room and times:
            self.open.setdefault(room, []).append((sequence, times))
            self.rooms |= 1 << room

    def sequences(self, lengths: list[int], times: int) -> None:
        """``times`` new sequences that hold one piece of each of the lengths."""
        room = self.max_len
        for length in lengths:
            self.put(length, times, self.n_sequences, room)
            room -= length
        self.keep(room, self.n_sequences, times)
        self.n_sequences += times

    def best_fit(self) -> None:
        """All pieces that are left, longest first, each into the least room that holds it."""
        for length in range(self.max_len, 0, -1):
            while (n := self.left[length]) > 0:
                fitting = self.rooms >> length
                if not fitting:
                    whole, rest = divmod(n, self.max_len // length)
                    if whole:
                        self.sequences([length] * (self.max_len // length), whole)
                    if rest:
                        self.sequences([length] * rest, 1)
                    continue
                room = length + (fitting & -fitting).bit_length() - 1
                groups = self.open[room]
                sequence, times = groups.pop()
                if not groups:
                    self.rooms &= ~(1 << room)
                taken = min(n, times)
                self.put(length, taken, sequence, room)
                self.keep(room - length, sequence, taken)
                self.keep(room, sequence + taken, times - taken)


def _patterns(histogram: np.ndarray, max_len: int):
    """Concrete patterns (lengths, repeats) from the fitted step patterns."""
    step = -(-max_len // STEPS)
    room = max_len // step  # steps that a sequence holds for sure
    lengths = np.flatnonzero(histogram)
    lengths = lengths[(lengths > max_len * FILLER_SHARE) & (lengths <= room * step)]
    steps = -(-lengths // step)
    target = np.bincount(steps, histogram[lengths], room + 1)[1:]
    if not target.any():
        return
    present = {int(s) for s in steps}
    shapes = [p for p in _partitions(room, MAX_PARTS, room) if present.issuperset(p)]
    if not shapes:
        return
    matrix = np.zeros((room, len(shapes)))
    for column, shape in enumerate(shapes):
        for s in shape:
            matrix[s - 1, column] += 1
    repeats = np.floor(non_negative_least_squares(matrix, target / target.sum()) * target.sum() + 1e-9)
    stock = _Stock(histogram)
    for column in np.argsort(-repeats, kind="stable"):
        *fixed, _ = shapes[column]
        left = int(repeats[column])
        while left > 0:
            taken: list[int] = []
            for s in fixed:
                taken.append(stock.longest((s - 1) * step + 1, s * step, taken))
            # The last part is not bound to its step: the longest piece that fits closes the sequence.
            taken.append(stock.longest(1, max_len - sum(taken), taken) if all(taken) else 0)
            if not all(taken):
                break
            times = min(left, *(stock.left[n] // taken.count(n) for n in taken))
            stock.take(taken, times)
            yield sorted(taken, reverse=True), times
            left -= times


class _Stock:
    """Pieces left of every length."""

    def __init__(self, histogram: np.ndarray):
        self.left = histogram.tolist()
        self.present = sum(1 << int(n) for n in np.flatnonzero(histogram))  # bit n: there are pieces of length n

    def longest(self, low: int, high: int, taken: list[int]) -> int:
        """The longest length in low..high that has a piece besides those taken; 0 if there is none."""
        while high >= low:
            high = (self.present & ((1 << (high + 1)) - 1)).bit_length() - 1
            if high < low:
                break
            if self.left[high] > taken.count(high):
                return high
            high -= 1
        return 0

    def take(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if not self.left[n]:
                self.present &= ~(1 << n)


def _partitions(total: int, parts: int, largest: int):
    """Non-increasing tuples of at most ``parts`` positive numbers that add up to ``total``."""
    if total == 0:
        yield ()
    elif parts:
        for first in range(min(total, largest), 0, -1):
            for rest in _partitions(total - first, parts - 1, first):
                yield (first, *rest)


def non_negative_least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|, by adding and dropping active columns."""
    x = np.zeros(matrix.shape[1])
    active = np.zeros(matrix.shape[1], bool)
    for _ in range(rounds):
        gradient = matrix.T @ (target - matrix @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-12:
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            fitted = np.linalg.lstsq(matrix[:, columns], target, rcond=None)[0]
            if (fitted > 0).all():
                x[:] = 0
                x[columns] = fitted
                break
            low = fitted <= 0
            share = np.min(x[columns][low] / np.maximum(x[columns][low] - fitted[low], 1e-300))
            x[columns] += share * (fitted - x[columns])
            active[columns[low & (x[columns] <= 1e-15)]] = False
            x[~active] = 0
            if not active[columns].all():
                continue
            active[columns[low][np.argmin(fitted[low])]] = False
            x[~active] = 0
    return x
