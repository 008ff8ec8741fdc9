"""Benchmark decontamination: evaluation items that occur, exactly or edited, in clip texts.

Works on clip texts (``clip_id``, ``description``) and on the evaluation items of the metadata model
(``item_id``, ``text``). A CGK random walk embeds the window at a word start: at each step it emits the
current character and moves on or stays, by a random bit of (step, character), so that texts at a small
edit distance emit sequences at a small Hamming distance. Keys sample a few steps of the walk; windows of
texts and items that agree on a key are candidates, and a candidate is verified by its edit distance.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .batches import all_cores, mixed, slices, texts_of

#: Most edits, as a share of the item's characters.
EDIT_SHARE = 0.2
#: Steps of a walk (half as many bytes on average).
STEPS = 64
#: Classes of items: fewest bytes, leading steps of the walk that count, steps that a key samples.
CLASSES = ((0, 16, 8), (64, 32, 12), (130, 64, 12))
#: Items with fewer characters are found by exact search for whole words only.
SHORT = 24
#: Least share of equal steps of two walks that agree on a key.
NEAR = 0.7
#: Share of items of each class that must be found when their characters are edited at the rate of the most edits.
RECALL = 0.95
#: Edited copies tried per class, keys tried; a class that needs more keys is compared with every text in full.
TRIALS, TRIED_KEYS = 200, 256
#: Bytes by which exact copies are found, at any place of a text. Words longer than RUN bytes have more windows.
PREFIX, RUN = 24, 16
#: Characters of items that one pass looks for.
ITEM_BLOCK = 1 << 20
#: Windows of a slice that are walked and looked up at a time, so that their arrays stay in a core's cache.
WINDOWS = 16_384
#: Words of a walk by which the first filter of a key goes.
LEAD = 3
#: Candidates whose edits are counted together.
TOGETHER = 2048
_FILTER_BITS = 17  # a filter and the keys that are looked up in it stay in a core's cache
_MOVES = (mixed(np.arange(STEPS * 256)) & np.uint64(1)).astype(np.uint8).reshape(STEPS, 256)
_FACTORS = mixed(np.arange(1, STEPS // 8 + 1)) | np.uint64(1)
_SPACE = ord(" ")
#: Thai and Lao, Myanmar, Khmer, CJK and kana, compatibility and half-width forms, further planes of CJK.
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def find_leaks(
    texts: DataFrame, items: DataFrame, key: str = "clip_id", text: str = "description", edit_share: float = EDIT_SHARE
) -> DataFrame:
    """Items found in texts: ``key``, ``item_id``, ``start``, ``end``, ``edits``, one row per text row and item.

    Texts are compared lower-cased with runs of space as one blank; ``start`` and ``end`` are code points of
    that form. An item is found where its edit distance to a passage is at most ``edit_share`` of its length.
    The number of keys is chosen by trial, per class of length, so that RECALL of the items with so many edits
    are found; a class for which keys don't reach that is compared with all of every text. Exact copies are
    always found, wherever they begin. Items under SHORT characters are found by exact search for whole words
    (scripts without spaces have no word bounds).

    Null and empty texts and items match nothing, null keys and item ids are kept, repeated rows give a
    result each, other columns are ignored. Items go to the workers in blocks of ITEM_BLOCK characters, each
    of which passes over all texts; nothing else is collected.
    """
    found = None
    source = all_cores(texts.select(key, text), text)
    for block in _blocks(items):
        part = _pass(source, block, key, items.schema["item_id"].dataType, edit_share)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(
    texts: DataFrame, items: DataFrame, key: str = "clip_id", text: str = "description", edit_share: float = EDIT_SHARE
) -> DataFrame:
    """The rows, with all their columns, in which find_leaks finds no item."""
    at = texts.columns.index(text)
    for block in _blocks(items):
        index = texts.sparkSession.sparkContext.broadcast(_Index.of(block, edit_share))

        def run(batches, index=index):
            for batch in slices(batches, at):
                hits = {row for row, *_ in index.value.found(texts_of(batch.column(at)))}
                yield batch.filter(pa.array([i not in hits for i in range(batch.num_rows)], pa.bool_()))

        texts = texts.mapInArrow(run, texts.schema)
    return texts


def _blocks(items: DataFrame):
    """Lists of (item_id, normalised text) of bounded size; one empty list if there are no items."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + total // ITEM_BLOCK
    for n in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n)
        yield [(r.item_id, normalised(r.text)) for r in part.collect()]


def _pass(source: DataFrame, block, key: str, item_kind: DataType, edit_share: float) -> DataFrame:
    index = source.sparkSession.sparkContext.broadcast(_Index.of(block, edit_share))
    kind = source.schema[0].dataType.simpleString()
    names = [key, "item_id", "start", "end", "edits"]
    ids = to_arrow_type(item_kind)

    def run(batches):
        for batch in slices(batches, 1):
            rows = index.value.found(texts_of(batch.column(1)))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            places = [pa.array(c, pa.int64()) for c in columns[2:]]
            found = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([found, pa.array(columns[1], ids), *places], names)

    return source.mapInArrow(run, f"`{key}` {kind}, item_id {item_kind.simpleString()}, start bigint, end bigint, edits bigint")


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


@dataclass
class _Keys:
    """Keys of the item windows of one class."""

    steps: int
    samples: np.ndarray  # (repeats, sampled) steps
    masks: list[list[tuple[int, np.uint64]]]  # the same for words of eight steps
    walks: np.ndarray  # per item window
    keys: list[np.ndarray]  # per repeat: sorted keys
    windows: list[np.ndarray]  # per repeat: item windows in that order
    leads: list[np.ndarray]  # per repeat: filter of the sums of the first LEAD words
    filters: list[np.ndarray]
    item: np.ndarray  # per item window
    offset: np.ndarray

    @classmethod
    def of(cls, items, chosen: list[int], steps: int, samples: np.ndarray) -> _Keys:
        walks, offset, of = _item_windows([items[i][1] for i in chosen], steps)
        words, keys, windows, leads, filters = _words(walks), [], [], [], []
        for sample in samples:
            masks = _masks(sample)
            lead = _sampled(words, masks[:LEAD])
            key = _key(words, masks, lead, np.arange(len(lead)))
            order = np.argsort(key, kind="stable")
            for sums, present in ((lead, leads), (key, filters)):
                present.append(np.zeros(1 << _FILTER_BITS, bool))
                present[-1][_slot(sums)] = True
            keys.append(key[order])
            windows.append(order)
        return cls(steps, samples, [_masks(x) for x in samples], walks, keys, windows, leads, filters, np.array(chosen, np.int64)[of], offset)


    def near(self, n: int, walks: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Windows and item windows (two rows) that agree on key ``n`` and on NEAR of all steps.

        A filter of LEAD words of the walk lets few windows through to the rest of their key.
        """
        masks, known = self.masks[n], self.keys[n]
        lead = _sampled(words, masks[:LEAD])
        hits = np.flatnonzero(self.leads[n].take(_slot(lead)))
        key = _key(words, masks, lead, hits)
        there = np.flatnonzero(self.filters[n].take(_slot(key)))
        hits, key = hits[there], key[there]
        lo, hi = (np.searchsorted(known, key, side) for side in ("left", "right"))
        window = np.repeat(hits, hi - lo)
        if not len(window):
            return np.zeros((2, 0), np.int64)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        other = self.windows[n][np.repeat(lo, hi - lo) + inside]
        near = [
            (walks[: self.steps, window[i : i + 4096]] == self.walks[:, other[i : i + 4096]]).mean(0) >= NEAR
            for i in range(0, len(window), 4096)
        ]
        near = np.concatenate(near)
        return np.stack([window[near], other[near]])


@dataclass
class _Index:
    """Keys of item windows, and what is needed to verify a candidate."""

    items: list[tuple[object, str]]
    short: list[int]
    scanned: list[int]  # items that keys don't find often enough
    classes: list[_Keys]
    prefixes: np.ndarray  # sorted hashes of the first bytes of the items that are not short
    prefixed: np.ndarray  # these items in that order
    heads: np.ndarray  # filter of their first eight bytes
    edit_share: float

    @classmethod
    def of(cls, items, edit_share: float) -> _Index:
        items = [x for x in items if x[1]]
        short = [i for i, (_, x) in enumerate(items) if len(x) < SHORT]
        long = [i for i, (_, x) in enumerate(items) if len(x) >= SHORT]
        sizes = {i: len(items[i][1].encode()) for i in long}
        scanned, classes = [], []
        for (least, steps, sampled), (most, *_) in zip(CLASSES, [*CLASSES[1:], (np.inf,)], strict=True):
            chosen = [i for i in long if least <= sizes[i] < most]
            if chosen:
                samples = _samples([items[i][1] for i in chosen], steps, sampled, edit_share)
                if samples is None:
                    scanned += chosen
                else:
                    classes.append(_Keys.of(items, chosen, steps, samples))
        buffer, starts, _ = _buffer([items[i][1] for i in long])
        words = _words_from(buffer)
        prefixes = _prefixes(words, starts) if long else np.zeros(0, np.uint64)
        order = np.argsort(prefixes, kind="stable")
        heads = np.zeros(1 << _FILTER_BITS, bool)
        heads[_head(words[starts])] = True
        return cls(items, short, scanned, classes, prefixes[order], np.array(long, np.int64)[order], heads, edit_share)

    def found(self, texts: list[str]) -> list[tuple[int, object, int, int, int]]:
        """(row, item_id, start, end, edits) of the best passage of each row and item."""
        texts = [normalised(x) for x in texts]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        buffer, starts, owner = _buffer(texts)
        self._copies(texts, best, buffer, starts)
        at, of = _word_starts(buffer, starts, owner)
        near: list[list[list[np.ndarray]]] = [[[] for _ in keys.samples] for keys in self.classes]
        for lo in range(0, len(at) if self.classes else 0, WINDOWS):
            walks, _ = _walk(buffer, at[lo : lo + WINDOWS])
            words = _words(walks)
            for keys, of_class in zip(self.classes, near, strict=True):
                for n, out in enumerate(of_class):
                    out.append(keys.near(n, walks, words) + np.array([[lo], [0]]))
        seen: set[tuple[int, int, int]] = set()
        for keys, of_class in zip(self.classes, near, strict=True):
            window, other = np.concatenate([x for out in of_class for x in out] or [np.zeros((2, 0), np.int64)], axis=1)
            row = of[window]
            start = at[window] - starts[row] - keys.offset[other]
            self._verify(texts, best, seen, zip(row.tolist(), keys.item[other].tolist(), start.tolist(), strict=True))
        for item in self.scanned:
            self._scan(texts, best, item)
        for item in self.short:
            self._search(texts, best, item)
        return [(row, self.items[item][0], *found) for (row, item), found in sorted(best.items())]

    def _copies(self, texts, best, buffer, starts) -> None:
        """Exact copies of the items that are not short, at any place."""
        if not len(self.prefixes):
            return
        words = _words_from(buffer)
        at = np.flatnonzero(self.heads.take(_head(words[: len(buffer)])))
        key = _prefixes(words, at)
        lo, hi = (np.searchsorted(self.prefixes, key, side) for side in ("left", "right"))
        rows = np.searchsorted(starts, at, "right") - 1
        pairs = {(r, i) for r, a, b in zip(rows.tolist(), lo.tolist(), hi.tolist(), strict=True) if a < b for i in range(a, b)}
        for row, i in pairs:
            item = int(self.prefixed[i])
            place = texts[row].find(self.items[item][1])
            if place >= 0:
                best[row, item] = (place, place + len(self.items[item][1]), 0)

    def _scan(self, texts, best, item: int) -> None:
        wanted = self.items[item][1]
        for row, text in enumerate(texts):
            edits, end = nearest_passage(wanted, text)
            if edits <= int(self.edit_share * len(wanted)) and (row, item) not in best:
                _, length = nearest_passage(wanted[::-1], text[:end][::-1], anchored=True)
                best[row, item] = (end - length, end, edits)

    def _verify(self, texts, best, seen, places: Iterable[tuple[int, int, int]]) -> None:
        """Look for items around places (row, item, byte), with room for that and for the edits."""
        regions: list[tuple[int, int, int, str]] = []
        for row, item, start in places:
            if (row, item) in best and best[row, item][2] == 0:
                continue
            wanted, text = self.items[item][1], texts[row]
            allowed = int(self.edit_share * len(wanted))
            place = (row, item, start // (allowed + 8))
            if place in seen:
                continue
            seen.add(place)
            first = len(text.encode()[: max(0, start)].decode("utf-8", "ignore")) if not text.isascii() else max(0, start)
            lo = max(0, first - 2 * allowed - 8)
            regions.append((row, item, lo, text[lo : first + len(wanted) + 2 * allowed + 8]))
        found = nearest_passages([(self.items[item][1], region) for _, item, _, region in regions])
        for (row, item, lo, region), (edits, end) in zip(regions, found, strict=True):
            wanted = self.items[item][1]
            if edits <= int(self.edit_share * len(wanted)) and ((row, item) not in best or edits < best[row, item][2]):
                _, length = nearest_passage(wanted[::-1], region[:end][::-1], anchored=True)
                best[row, item] = (lo + end - length, lo + end, edits)

    def _search(self, texts, best, item: int) -> None:
        wanted = self.items[item][1]
        for row, text in enumerate(texts):
            at = text.find(wanted)
            while at >= 0:
                end = at + len(wanted)
                first = at == 0 or text[at - 1] == " " or _unspaced(wanted[0])
                if first and (end == len(text) or text[end] == " " or _unspaced(wanted[-1])):
                    best[row, item] = (at, end, 0)
                    break
                at = text.find(wanted, at + 1)


def _unspaced(c: str) -> bool:
    """Whether a character is of a script that sets no spaces between words."""
    n = ord(c)
    return any(lo <= n <= hi for lo, hi in _UNSPACED)


def nearest_passage(wanted: str, region: str, anchored: bool = False) -> tuple[int, int]:
    """Fewest edits between ``wanted`` and a passage of ``region``, and the passage's end.

    Bit-parallel columns of the edit distance table; ``anchored`` fixes the passage's start at 0.
    """
    m = len(wanted)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(wanted):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(region, 1):
        equal = at.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        rise = down | (full & ~(across | up))
        fall = up & across
        score += bool(rise & top) - bool(fall & top)
        rise = (rise << 1) | anchored
        fall <<= 1
        steady = equal | down
        up = full & (fall | ~(steady | rise))
        down = rise & steady & full
        if score < best:
            best, end = score, j
    return best, end


def nearest_passages(pairs: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """``nearest_passage`` of many (wanted, region) pairs.

    Pairs whose items have equally many words of 64 bits go through their columns together, as arrays with an entry
    per pair. Where a group is too small for that to pay, its pairs are compared one by one, with the same results.
    """
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (wanted, region) in enumerate(pairs):
        groups.setdefault((-(-len(wanted) // 64), len(region).bit_length()), []).append(k)
    for (words, _), members in groups.items():
        for i in range(0, len(members), TOGETHER):
            part = members[i : i + TOGETHER]
            if len(part) < 24 * words:
                for k in part:
                    out[k] = nearest_passage(*pairs[k])
            else:
                edits, ends = _columns([pairs[k] for k in part], words)
                for k, *found in zip(part, edits.tolist(), ends.tolist(), strict=True):
                    out[k] = tuple(found)
    return out


def _columns(pairs: list[tuple[str, str]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits and ends of passages: the columns of all pairs' tables at once, in words of 64 rows."""
    items = {wanted: k for k, wanted in enumerate(dict.fromkeys(w for w, _ in pairs))}
    letters = np.unique(_points("".join(items)))
    number = np.zeros(int(letters[-1]) + 2, np.int32)  # 0: a character of no item
    number[letters] = np.arange(1, len(letters) + 1)
    rows = np.zeros((len(letters) + 1, len(items), words), np.uint64)
    for wanted, k in items.items():
        at = np.arange(len(wanted))
        np.bitwise_or.at(rows, (number[_points(wanted)], k, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    item = np.array([items[w] for w, _ in pairs])
    length = max(len(r) for _, r in pairs)
    text = np.zeros((length, len(pairs)), np.int32)
    for k, (_, region) in enumerate(pairs):
        text[: len(region), k] = number[np.minimum(_points(region), len(number) - 1)]
    sizes = np.array([len(w) for w, _ in pairs])
    score = sizes.copy()
    best, end = score.copy(), np.zeros(len(pairs), np.int64)
    one, high = np.uint64(1), np.uint64(63)
    last = ((sizes - 1) & 63).astype(np.uint64)
    up = np.full((words, len(pairs)), ~np.uint64(0))
    down = np.zeros((words, len(pairs)), np.uint64)
    for j in range(length):
        of_column = rows[text[j], item]
        more = less = np.zeros(len(pairs), np.uint64)  # whether the row above rises or falls into this column
        for w in range(words):
            p, m, equal = up[w], down[w], of_column[:, w]
            steady = equal | m
            equal = equal | less
            across = (((equal & p) + p) ^ p) | equal
            rise, fall = m | ~(across | p), p & across
            top = last if w == words - 1 else high
            rising, falling = (rise >> top) & one, (fall >> top) & one
            rise, fall = (rise << one) | more, (fall << one) | less
            up[w], down[w] = fall | ~(steady | rise), rise & steady
            more, less = rising, falling
        score += more.astype(np.int64) - less.astype(np.int64)
        better = score < best
        best[better], end[better] = score[better], j + 1
    return best, end


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte buffer with room for a walk after each, their starts, and their sizes."""
    raw = [x.encode() for x in texts]
    gap = b"\0" * (STEPS + 1)
    buffer = np.frombuffer(gap.join([*raw, b""]), np.uint8) if raw else np.zeros(0, np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return buffer, np.cumsum(sizes + len(gap)) - sizes - len(gap), sizes


def _word_starts(buffer, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows of each text start, and their texts.

    These are its start, every place after a blank or mark, every character of three bytes or more, and in long
    words the places that a hash of two bytes chooses.
    """
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.zeros(len(buffer), bool)
    start[1:] = ~_IN_WORD[buffer[:-1]]
    start |= buffer >= 0xE0
    start[starts] = True
    start &= (buffer != _SPACE) & (buffer != 0)
    places = np.arange(len(buffer))
    since = places - np.maximum.accumulate(np.where(start | ~_IN_WORD[buffer], places, 0))
    long = np.flatnonzero((since >= RUN) & ((buffer & 0xC0) != 0x80))
    two = buffer[long].astype(np.uint64) << np.uint64(8) | buffer[long - 1]
    start[long[mixed(two + np.uint64(1)) & np.uint64(3) == 0]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(starts, at, "right") - 1


def _words_from(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, and from PREFIX places more."""
    padded = np.concatenate([buffer, np.zeros(PREFIX + 8, np.uint8)])
    words = np.empty(len(buffer) + PREFIX, np.uint64)
    for i in range(8):
        words[i::8] = padded[i : i + (len(words) - i + 7) // 8 * 8].view(np.uint64)
    return words


def _head(words: np.ndarray) -> np.ndarray:
    """Places in the filter of eight bytes."""
    return _slot(words * np.uint64(0x9E3779B97F4A7C15))


def _slot(sums: np.ndarray) -> np.ndarray:
    """Places in a filter: the highest bits."""
    return (sums >> np.uint64(64 - _FILTER_BITS)).view(np.int64)


def _prefixes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the PREFIX bytes from each of the places."""
    key = words[at]
    for i in range(8, PREFIX, 8):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[at + i]
    return mixed(key)


def _item_windows(texts: list[str], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks of so many steps that end inside their text, their offsets, and their texts."""
    buffer, starts, sizes = _buffer(texts)
    at, of = _word_starts(buffer, starts, sizes)
    walks, ends = _walk(buffer, at, steps)
    whole = ends <= (starts + sizes)[of]
    return walks[:, whole], (at - starts[of])[whole], of[whole]


def _walk(buffer: np.ndarray, at: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Characters emitted at each step by the walks from ``at``, and where the walks end."""
    walks, at = np.empty((steps, len(at)), np.uint8), at.copy()
    for step in range(steps):
        emitted = buffer.take(at)
        walks[step] = emitted
        at += _MOVES[step].take(emitted)
    return walks, at


def _words(walks: np.ndarray) -> np.ndarray:
    """Walks (columns) as words of eight steps each."""
    words = np.zeros((len(walks) // 8, walks.shape[1]), np.uint64)
    for step, emitted in enumerate(walks):
        words[step // 8] |= emitted.astype(np.uint64) << np.uint64(8 * (step % 8))
    return words


def _masks(steps: np.ndarray) -> list[tuple[int, np.uint64]]:
    """Words with sampled steps, and the bytes of these steps in them; words with the most steps first."""
    taken: dict[int, int] = {}
    for s in steps.tolist():
        taken[s // 8] = taken.get(s // 8, 0) | 0xFF << (8 * (s % 8))
    return [(word, np.uint64(mask)) for word, mask in sorted(taken.items(), key=lambda x: -x[1].bit_count())]


def _sampled(words: np.ndarray, masks: list[tuple[int, np.uint64]]) -> np.ndarray:
    """Hash of the sampled steps of each walk that lie in the words of ``masks``."""
    (word, mask), *rest = masks
    sums = words[word] & mask
    sums *= _FACTORS[word]
    part = np.empty_like(sums)
    for word, mask in rest:
        np.bitwise_and(words[word], mask, out=part)
        np.multiply(part, _FACTORS[word], out=part)
        sums += part
    return sums


def _key(words: np.ndarray, masks: list[tuple[int, np.uint64]], lead: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the sampled steps of the walks ``at``; ``lead`` is that of the first LEAD words, of all walks."""
    key = lead.take(at)
    for word, mask in masks[LEAD:]:
        key += (words[word].take(at) & mask) * _FACTORS[word]
    return key ^ (key >> np.uint64(31))


def _samples(items: list[str], steps: int, sampled: int, edit_share: float) -> np.ndarray | None:
    """Sampled steps of as many keys as RECALL asks for; None if TRIED_KEYS are too few.

    Copies of the items, edited at the rate ``edit_share``, stand between other items and are searched as
    texts are. The share found must exceed RECALL by two standard errors of the trial.
    """
    rng = np.random.default_rng(7)
    keys = np.array([np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(TRIED_KEYS)])
    trial = (items * -(-TRIALS // len(items)))[:: max(1, len(items) // TRIALS)]
    needed = []
    for x in trial:
        x = x[:2000]  # longer items have more windows and are found more often
        copy = edited(x, edit_share, rng)
        others = [items[rng.integers(len(items))][::-1] for _ in range(2)]
        joint = " " if " " in x else "x"
        wanted, *_ = _item_windows([x], steps)
        buffer, starts, sizes = _buffer([joint.join([others[0], copy, others[1]])])
        found, _ = _walk(buffer, _word_starts(buffer, starts, sizes)[0], steps)
        one, other = np.nonzero((wanted[:, :, None] == found[:, None, :]).mean(0) >= NEAR)
        equal = wanted[:, one] == found[:, other]
        agree = equal[keys].all(1).any(1)
        needed.append(int(agree.argmax()) + 1 if agree.any() else TRIED_KEYS + 1)
    goal = min(1.0, RECALL + 2 * (RECALL * (1 - RECALL) / len(needed)) ** 0.5)
    most = int(np.sort(needed)[int(np.ceil(goal * len(needed))) - 1])
    return keys[:most] if most <= TRIED_KEYS else None


def edited(text: str, rate: float, rng: np.random.Generator) -> str:
    """The text with characters left out, inserted or replaced at a rate."""
    letters = list(text)
    for i in np.flatnonzero(rng.random(len(letters)) < rate):
        other = letters[rng.integers(len(letters))]
        letters[i] = ("", letters[i] + other, other)[rng.integers(3)]
    return "".join(letters)
