"""Scores of clip texts by an interpolated modified Kneser-Ney bigram model.

Works on clip texts: one row per clip with ``clip_id``, ``description`` and ``held_out`` (not learned from).
Spark counts n-grams by ranges of their hashes; each range becomes sorted arrays in the shared folder, which
workers memory-map and search. Nothing but a handful of totals reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from . import shared_files
from .batches import all_cores, mixed, slices

#: Tokens that a counting task gathers before it hands its counts on, and that scoring looks up at a time.
CHUNK_TOKENS = 1_000_000
#: Bytes of text per hash range.
RANGE_BYTES = 8 << 20
#: A first word with more tokens is dealt over ranges by its second words; one text in SAMPLED tells which do.
HOT_TOKENS, SAMPLED = 4 << 20, 16
_BEGIN, _END = (int(x) for x in mixed(np.array([101, 102])))
_COUNTS = "kind string, range int, key binary, other binary, n binary, m binary"
_COUNT_NAMES = ["kind", "range", "key", "other", "n", "m"]


@dataclass(frozen=True)
class Model:
    """Totals of a counted model; its arrays lie in ``folder``, cut into 2 ** ``bits`` hash ranges."""

    folder: str
    bits: int
    tokens: int  # of the training texts, ends included
    types: int  # distinct tokens
    bigrams: int  # distinct bigrams
    bigram_discounts: tuple[float, ...]  # for counts 1, 2, 3 and more
    word_discounts: tuple[float, ...]  # for continuation counts 1, 2, 3 and more
    word_backoff: float  # probability that the word level leaves to the uniform one
    hot: tuple[np.ndarray, np.ndarray]  # sorted hashes of hot first words, bits of the parts of each

    @property
    def uniform(self) -> float:
        return 1 / (self.types + 1)


def count_model(texts: DataFrame, text: str = "description") -> Model:
    """Count the model of all whole texts and write its arrays.

    Tokens are words (runs without ASCII spaces, A-Z lower-cased), then one end per text; null and empty
    texts are an end only. The first shuffle carries, per task and hash range of the first word, sorted
    distinct bigrams with their counts; the second, per range of words, how many words precede each word and
    how often it occurs. A hot first word has its successors dealt over several ranges, about HOT_TOKENS tokens
    each, and its totals added up in the second shuffle; hot words there are partial sums. The sample that finds
    them decides the size of ranges only, never a count. Memory is bounded by a chunk or one range.
    """
    spark = texts.sparkSession
    source = all_cores(texts.select(text), text)
    size = source.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(0, int(size // RANGE_BYTES)).bit_length()
    folder = shared_path(spark, "model")
    hot = _hot_words(source, size, bits)
    parts = source.mapInArrow(lambda b: _count(b, bits, hot), _COUNTS)
    words = parts.groupBy("range").applyInArrow(lambda t: _merge_bigrams(t, folder, bits, hot), _COUNTS)
    stats = words.groupBy("kind", "range").applyInArrow(lambda t: _merge_words(t, folder, bits), "kind string, totals array<bigint>")
    totals = {"bigram": np.zeros(6, np.int64), "word": np.zeros(6, np.int64)}
    for row in stats.groupBy("kind").agg(*(F.sum(F.col("totals")[i]).alias(f"t{i}") for i in range(6))).where("kind <> 'hot'").collect():
        totals[row["kind"]] += np.array(row[1:], np.int64)
    *of_bigrams, bigrams, _ = totals["bigram"].tolist()
    *of_words, types, tokens = totals["word"].tolist()
    word_discounts = discounts(of_words)
    left = sum(d * n for d, n in zip(word_discounts, (*of_words[:2], types - sum(of_words[:2])), strict=True))
    return Model(
        folder, bits, tokens, types, bigrams, discounts(of_bigrams), word_discounts, left / bigrams if bigrams else 1.0, hot
    )


def score_texts(texts: DataFrame, model: Model, key: str = "clip_id", text: str = "description") -> DataFrame:
    """Scores of all whole texts: ``key``, ``n_tokens``, ``n_known``, ``base_score``, ``score``.

    ``n_known`` counts tokens seen in training; ``base_score`` is the add-one unigram log10 probability,
    ``score`` the model's. Null and empty texts are one end token; null keys stay; repeated rows give a result
    each; other columns are ignored.
    """
    source = all_cores(texts.select(key, text), text)
    kind = source.schema[0].dataType.simpleString()
    names = [key, "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        for batch in slices(batches, 1, 8 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in _score(batch.column(1), model))], names
            )

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def discounts(counts: list[int]) -> tuple[float, ...]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of entries that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2):
        return (0.5, 0.5, 0.5)
    share = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3 if n3 else 2.5)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, of the token before each, and tokens per text."""
    import xxhash

    words = [(x or b"").lower().split() for x in column.cast(pa.binary()).to_pylist()]
    counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
    number: dict[bytes, int] = dict.fromkeys((w for x in words for w in x), 0)
    number = dict(zip(number, range(len(number)), strict=True))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    ends = np.cumsum(counts) - 1
    tokens = np.empty(int(counts.sum()), np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    ids = np.fromiter((number[w] for x in words for w in x), np.int64, len(tokens) - len(ends))
    tokens[inner] = hashed[ids] if len(ids) else 0
    tokens[ends] = _END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends - counts + 1] = _BEGIN
    return tokens, before, counts


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before) * np.uint64(0x9E3779B97F4A7C15) + token


def _range_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _hot_words(source: DataFrame, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of first words with more than HOT_TOKENS tokens by the sample, and bits of their parts."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not bits or size < HOT_TOKENS:
        return none

    def run(batches):
        for batch in slices(batches, 0):
            word, n = np.unique(_tokens(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    text = source.columns[0]
    sample = source.where(F.pmod(F.xxhash64(text), F.lit(SAMPLED)) == 0)
    found = sample.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") * SAMPLED > HOT_TOKENS).collect()
    rows = sorted((r.word % (1 << 64), min(bits, (r.n * SAMPLED // HOT_TOKENS).bit_length())) for r in rows)
    return (np.array([w for w, _ in rows], np.uint64), np.array([b for _, b in rows], np.int64)) if rows else none


def _bigram_ranges(before: np.ndarray, token: np.ndarray, bits: int, hot) -> np.ndarray:
    """Ranges of bigrams: by the first word, for hot ones by the second word too."""
    ranges, (words, parts) = _range_of(before, bits), hot
    if len(words) and len(before):
        at = np.minimum(np.searchsorted(words, before), len(words) - 1)
        place = np.flatnonzero(words[at] == before)
        part = mixed(_pair(before[place], token[place])) >> (np.uint64(64) - parts[at[place]].astype(np.uint64))
        ranges[place] = (ranges[place] + part.astype(np.int64)) % (1 << bits)
    return ranges


def _summed(before, token, n):
    """Distinct (before, token) in order, with their summed n."""
    order = np.lexsort((token, before))
    before, token, n = before[order], token[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(new)
    return before[first], token[first], np.add.reduceat(n, first) if len(first) else n


def _groups(x: np.ndarray):
    """First place and length of each run of equal values."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _row(kind, number, key, other, n, m) -> pa.RecordBatch:
    values = [x if x is None else np.ascontiguousarray(x).tobytes() for x in (key, other, n, m)]
    arrays = [pa.array([kind], pa.string()), pa.array([number], pa.int32()), *(pa.array([v], pa.binary()) for v in values)]
    return pa.RecordBatch.from_arrays(arrays, _COUNT_NAMES)


def _count(batches, bits: int, hot):
    """Distinct bigrams of chunks of texts: per range, first words, their numbers of successors, those, counts."""
    held, size = [], 0

    def out():
        before, token, n = _summed(
            np.concatenate([b for b, _ in held]), np.concatenate([t for _, t in held]), np.ones(size, np.int64)
        )
        ranges = _bigram_ranges(before, token, bits, hot)
        order = np.argsort(ranges, kind="stable")
        before, token, n = before[order], token[order], n[order]
        bounds = np.searchsorted(ranges[order], np.arange((1 << bits) + 1))
        for number, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if hi > lo:
                first, runs = _groups(before[lo:hi])
                yield _row("bigram", number, before[lo:hi][first], token[lo:hi], n[lo:hi].astype(np.uint32), runs.astype(np.uint32))

    for batch in slices(batches, 0):
        tokens, before, _ = _tokens(batch.column(0))
        held.append((before, tokens))
        size += len(tokens)
        if size >= CHUNK_TOKENS:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _parts(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), dtype)


def _merge_bigrams(table: pa.Table, folder: str, bits: int, hot) -> pa.Table:
    """Write the arrays of one range of bigrams; hand on what they say about second words and hot first words."""
    number = table["range"][0].as_py()
    before = np.repeat(_parts(table, "key", np.uint64), _parts(table, "m", np.uint32))
    before, token, n = _summed(before, _parts(table, "other", np.uint64), _parts(table, "n", np.uint32).astype(np.int64))
    first, _ = _groups(before)
    total = np.add.reduceat(n, first)
    by_count = [np.add.reduceat((n == k).astype(np.int64), first) for k in (1, 2)]
    by_count.append(np.add.reduceat((n >= 3).astype(np.int64), first))
    contexts, of_contexts = before[first], np.stack([total, *by_count], 1)
    parted = np.isin(contexts, hot[0])
    shared_files.put(folder, f"context-{number}", contexts[~parted])
    shared_files.put(folder, f"context-n-{number}", of_contexts[~parted])
    pair = _pair(before, token)
    order = np.argsort(pair, kind="stable")
    large = np.flatnonzero(n[order] > 255)
    shared_files.put(folder, f"pair-{number}", pair[order])
    shared_files.put(folder, f"pair-n-{number}", np.minimum(n[order], 255).astype(np.uint8))
    shared_files.put(folder, f"pair-large-{number}", np.stack([large, n[order][large]], 1))
    order = np.argsort(token, kind="stable")
    first, preceding = _groups(token[order])
    token, seen = token[order][first], np.add.reduceat(n[order], first)
    totals = np.array([*((n == k).sum() for k in (1, 2, 3, 4)), len(n), n.sum()], np.int64)
    rows = [_row("bigram", number, None, None, totals, None)]
    if parted.any():
        rows.append(_row("hot", 0, contexts[parted], None, of_contexts[parted], None))
    bounds = np.searchsorted(_range_of(token, bits), np.arange((1 << bits) + 1))
    for to, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if hi > lo:
            rows.append(_row("word", to, token[lo:hi], None, seen[lo:hi], preceding[lo:hi].astype(np.uint32)))
    return pa.Table.from_batches(rows)


def _merge_words(table: pa.Table, folder: str, bits: int) -> pa.Table:
    """Write the arrays of one range of words, or of hot first words; counts of continuation counts, types and tokens."""
    kind, number = table["kind"][0].as_py(), table["range"][0].as_py()
    if kind == "bigram":
        totals = np.frombuffer(table["n"][0].as_py(), np.int64)
    elif kind == "hot":
        word, n = _parts(table, "key", np.uint64), _parts(table, "n", np.int64).reshape(-1, 4)
        order = np.argsort(word, kind="stable")
        first, _ = _groups(word[order])
        shared_files.put(folder, "hot", word[order][first])
        shared_files.put(folder, "hot-n", np.add.reduceat(n[order], first))
        totals = np.zeros(6, np.int64)
    else:
        word = _parts(table, "key", np.uint64)
        order = np.argsort(word, kind="stable")
        first, _ = _groups(word[order])
        preceding = np.add.reduceat(_parts(table, "m", np.uint32).astype(np.int64)[order], first)
        seen = np.add.reduceat(_parts(table, "n", np.int64)[order], first)
        shared_files.put(folder, f"word-{number}", word[order][first])
        shared_files.put(folder, f"word-n-{number}", np.stack([preceding, seen], 1))
        totals = np.array([*((preceding == k).sum() for k in (1, 2, 3, 4)), len(first), seen.sum()], np.int64)
    return pa.table({"kind": [kind], "totals": [totals.tolist()]})


def _looked_up(folder: str, bits: int, ranges: np.ndarray, query: np.ndarray, name: str, read) -> None:
    """Search sorted queries, range by range: read(number, slice, place in the range, found)."""
    bounds = np.searchsorted(ranges, np.arange((1 << bits) + 1))
    for number, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if hi > lo:
            keys = _file(folder, f"{name}-{number}", "u8")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, query[lo:hi]), len(keys) - 1)
                found = keys[at] == query[lo:hi]
                read(number, np.arange(lo, hi)[found], at[found])


def _file(folder: str, name: str, dtype: str) -> np.ndarray:
    try:
        return shared_files.mapped(folder, name, dtype)
    except FileNotFoundError:  # no entry fell into this range
        return np.empty(0, dtype)


def _score(column: pa.Array, model: Model):
    tokens, before, counts = _tokens(column)
    word, of_word = np.unique(tokens, return_inverse=True)
    seen, preceding = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)

    def read_words(number, at, place):
        n = _file(model.folder, f"word-n-{number}", "i8").reshape(-1, 2)[place]
        preceding[at], seen[at] = n[:, 0], n[:, 1]

    _looked_up(model.folder, model.bits, _range_of(word, model.bits), word, "word", read_words)
    context, of_context = np.unique(before, return_inverse=True)
    totals = np.zeros((len(context), 4), np.int64)

    def read_contexts(number, at, place):
        totals[at] = _file(model.folder, f"context-n-{number}", "i8").reshape(-1, 4)[place]

    _looked_up(model.folder, model.bits, _range_of(context, model.bits), context, "context", read_contexts)
    if len(model.hot[0]):
        hot = _file(model.folder, "hot", "u8")
        if len(hot):
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            found = hot[at] == context
            totals[found] = _file(model.folder, "hot-n", "i8").reshape(-1, 4)[at[found]]
    pair, ranges = _pair(before, tokens), _bigram_ranges(before, tokens, model.bits, model.hot)
    order = np.lexsort((pair, ranges))
    together = np.zeros(len(pair), np.int64)  # in that order

    def read_pairs(number, at, place):
        n = _file(model.folder, f"pair-n-{number}", "u1")[place].astype(np.int64)
        large = _file(model.folder, f"pair-large-{number}", "i8").reshape(-1, 2)
        if len(large):
            big = n == 255
            spot = np.minimum(np.searchsorted(large[:, 0], place[big]), len(large) - 1)
            n[big] = np.where(large[spot, 0] == place[big], large[spot, 1], 255)
        together[at] = n

    _looked_up(model.folder, model.bits, ranges[order], pair[order], "pair", read_pairs)
    n_pair = np.empty_like(together)
    n_pair[order] = together
    single = _discounted(preceding, model.word_discounts) / max(model.bigrams, 1) + model.word_backoff * model.uniform
    known = totals[:, 0] > 0
    left = totals[:, 1:] @ np.array(model.bigram_discounts)
    backoff = np.where(known, left / np.maximum(totals[:, 0], 1), 1.0)
    seen_before = np.maximum(totals[of_context, 0], 1)
    chance = _discounted(n_pair, model.bigram_discounts) / seen_before + backoff[of_context] * single[of_word]
    base = np.log10((seen[of_word] + 1) / (model.tokens + model.types + 1))
    starts = np.cumsum(counts) - counts
    total = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
    return counts, total((seen[of_word] > 0).astype(np.int64)), total(base), total(np.log10(chance))


def _discounted(n: np.ndarray, by: tuple[float, ...]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *by])[np.minimum(n, 3)], 0.0)
