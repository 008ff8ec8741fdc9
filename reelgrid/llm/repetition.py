"""Quality rules by repetition: how much of a text lies in n-grams and lines that it repeats.

Works on clip texts: one row per clip with ``clip_id`` and ``description``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import mixed, slices

#: Most characters (as a share of word characters) inside duplicated word n-grams, by n. First occurrences
#: count, so a short text that repeats one notice line has a quarter; the limits leave such texts alone.
NGRAM_LIMITS = {5: 0.45, 6: 0.42, 7: 0.39, 8: 0.36, 9: 0.33, 10: 0.30}
#: Most characters inside n-grams that repeat an earlier n-gram, for every n: what a text says again, without
#: first occurrences. Texts with one repeated notice line have 0.16 at most.
REDUNDANT_LIMIT = 0.17
#: Most lines, and most characters, in lines that repeat an earlier line (first occurrences don't count).
LINE_LIMITS = {"lines": 0.50, "chars": 0.30}
#: Fewest words, and most words in repeated three-word windows (percent).
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 3
MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_line_chars bigint, dup_ngram_share array<double>, base_failed boolean, kept boolean"
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def measure_repetition(texts: DataFrame, key: str = "clip_id", text: str = "description") -> DataFrame:
    """Repetition measures and verdict of every text.

    Output: ``key``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``dup_line_chars``, ``dup_ngram_share`` (share of word characters inside duplicated n-grams, one
    value per n of NGRAM_LIMITS), ``base_failed`` and ``kept``. The verdict also holds the share of characters
    in n-grams that repeat an earlier one against REDUNDANT_LIMIT.

    A null or empty text has no words, all measures 0, and fails the base rule. A null key stays null;
    repeated rows give one result each; other columns are ignored. Rows are independent, so memory is
    bounded by a slice of text and the longest text.
    """

    def run(batches):
        for batch in slices(batches, 1):
            m = _measures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *m.values()], [key, *m])

    source = texts.select(key, text)
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, {MEASURES}")


def drop_repetitive(texts: DataFrame, text: str = "description") -> DataFrame:
    """The rows, with all their columns, whose verdict by measure_repetition is ``kept``."""
    at = texts.columns.index(text)

    def run(batches):
        for batch in slices(batches, at):
            yield batch.filter(_measures(batch.column(at))["kept"])

    return texts.mapInArrow(run, texts.schema)


def _measures(column: pa.Array) -> dict[str, pa.Array]:
    raw = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    words = [x.split() for x in raw]  # bytes split on exactly the six ASCII spaces
    n_words = np.fromiter(map(len, words), np.int64, len(raw))
    n_chars = np.fromiter((_code_points(x) for x in raw), np.int64, len(raw))
    word_chars = n_chars - np.fromiter((_count(x, SPACES) for x in raw), np.int64, len(raw))
    symbols = np.fromiter((_count(x, SYMBOLS) for x in raw), np.int64, len(raw))
    lines = np.array([_line_counts(x) for x in raw], np.int64).reshape(len(raw), 4)
    repeat_words, shares, redundant = _ngrams(words, n_words, word_chars)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
    total = np.maximum(word_chars, 1)
    n_lines, dup_lines, line_chars, dup_chars = lines.T
    bad = (dup_lines > LINE_LIMITS["lines"] * n_lines) | (dup_chars > LINE_LIMITS["chars"] * line_chars)
    for share, limit in zip(shares, NGRAM_LIMITS.values(), strict=True):
        bad |= share / total > limit
    for share in redundant:
        bad |= share / total > REDUNDANT_LIMIT
    per_text = (np.array(shares) / total).T.ravel()
    ends = np.arange(len(raw) + 1, dtype=np.int32) * len(NGRAM_LIMITS)
    return {
        "n_words": pa.array(n_words),
        "word_chars": pa.array(word_chars),
        "n_symbols": pa.array(symbols),
        "n_dup_lines": pa.array(dup_lines),
        "n_repeat_words": pa.array(repeat_words),
        "dup_line_chars": pa.array(dup_chars),
        "dup_ngram_share": pa.ListArray.from_arrays(pa.array(ends), pa.array(per_text, pa.float64())),
        "base_failed": pa.array(base_failed),
        "kept": pa.array(~base_failed & ~bad),
    }


def _code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def _count(raw: bytes, members: bytes) -> int:
    return sum(raw.count(c) for c in members)


def _line_counts(raw: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier line, and the characters of both."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = set(lines)
    total = sum(map(_code_points, lines))
    if len(distinct) == len(lines):
        return len(lines), 0, total, 0
    return len(lines), len(lines) - len(distinct), total, total - sum(map(_code_points, distinct))


def _ngrams(words: list[list[bytes]], n_words: np.ndarray, word_chars: np.ndarray):
    """Words in repeated windows per text, and per n and text characters in duplicated n-grams and in later ones."""
    flat = [w for x in words for w in x]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    lengths = np.fromiter(map(_code_points, number), np.int64, len(number))[ids]
    owner = np.repeat(np.arange(len(words)), n_words)
    hashed = mixed(ids + 1)
    salt = mixed(owner + (1 << 40))
    per_text = lambda covered, weight: np.bincount(owner[covered], weight[covered], len(words)).astype(np.int64)
    ones = np.ones(len(ids), np.int64)
    starts, _ = _duplicated(hashed, salt, owner, np.arange(max(0, len(ids) - WINDOW + 1)), WINDOW)
    repeat_words = per_text(_covered(starts, WINDOW, len(ids)), ones)
    shares, redundant, n = [], [], WINDOW
    for wider in NGRAM_LIMITS:
        # A duplicated n-gram consists of duplicated shorter ones: only such starts are hashed.
        known = np.zeros(len(ids) + wider, bool)
        known[starts] = True
        candidates = starts[np.logical_and.reduce([known[starts + i] for i in range(wider - n + 1)])] if len(starts) else starts
        (starts, later), n = _duplicated(hashed, salt, owner, candidates, wider), wider
        shares.append(per_text(_covered(starts, wider, len(ids)), lengths))
        redundant.append(per_text(_covered(later, wider, len(ids)), lengths))
    return repeat_words, shares, redundant


def _duplicated(hashed, salt, owner, starts, n):
    """Those starts whose n-gram begins at two starts or more of the same text, and all but the first of each."""
    starts = starts[starts + n <= len(hashed)]
    starts = starts[owner[starts] == owner[starts + n - 1]] if len(starts) else starts
    rolled = np.zeros(len(starts), np.uint64)
    for i in range(n):
        rolled = rolled * _BASE + hashed[starts + i]
    rolled ^= salt[starts]
    order = np.argsort(rolled, kind="stable")
    equal = rolled[order][1:] == rolled[order][:-1]
    double = np.zeros(len(starts), bool)
    double[order[1:][equal]] = True
    double[order[:-1][equal]] = True
    return starts[double], starts[np.sort(order[1:][equal])]


def _covered(starts, n, size):
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges)[:size] > 0
