"""Token counts of model prompts, from the distinct pre-tokens.

Works on prompt texts: one row per prompt with ``clip_id`` and ``prompt``. Byte-pair merges never cross a
pre-token, so a text's count is the sum of its pre-tokens' counts; each distinct pre-token is encoded once.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_once
from .batches import all_cores, slices, texts_of
from .pretokens import byte_level, load, special_tokens

#: Distinct pre-tokens that a counting task holds before it hands its counts on.
FLUSH = 300_000
#: Most pre-tokens, the most frequent ones, whose counts every worker holds; others meet theirs in a join.
HOT = 1 << 18
#: Longest of them in bytes, which bounds what is broadcast, and rows that one list of repeated texts holds.
HOT_BYTES, COPIES = 64, 4096


def count_tokens(
    prompts: DataFrame, tokenizer: str, limit: int, key: str = "clip_id", text: str = "prompt"
) -> DataFrame:
    """Tokens of every whole text by the byte-level tokenizer file ``tokenizer``.

    Output: ``key``, ``n_bytes`` (UTF-8), ``n_tokens`` (no begin, end or added tokens; a special string in
    a text is one token, as the library has it) and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 tokens, a null key stays null, repeated rows give one result each, other
    columns are ignored. Spark counts each distinct pre-token over the corpus; its pieces are counted once;
    the counts of the most frequent ones (HOT at most) go to the workers and the rest are joined by pre-token.
    """
    spark = prompts.sparkSession
    source = all_cores(prompts.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")

    def distinct(batches):
        counts: Counter[str] = Counter()
        for batch in slices(batches, 1):
            for x in texts_of(batch.column(1)):
                counts.update(_cut(x, tokenizer)[0])
            if len(counts) > FLUSH:
                yield _table(counts)
                counts = Counter()
        yield _table(counts)

    def pieces(batches):
        encoder = load(tokenizer)
        for batch in slices(batches, 0):
            encoded = encoder.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            n = pa.array([len(e) for e in encoded], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], ["piece", "seen", "n"])

    seen = source.mapInArrow(distinct, "piece string, seen bigint").groupBy("piece").agg(F.sum("seen").alias("seen"))
    counted = written_once(seen.mapInArrow(pieces, "piece string, seen bigint, n bigint"))
    frequent = counted.where(F.octet_length("piece") <= HOT_BYTES)
    hot_rows = frequent.where(F.col("seen") >= _hot_from(frequent)).select("piece", "n")
    hot = spark.sparkContext.broadcast(dict(zip(*hot_rows.toArrow().to_pydict().values(), strict=True)))

    def per_text(batches):
        known = hot.value
        for batch in slices(batches, 1):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            keys = batch.column(0).to_pylist()
            for row, (k, x) in enumerate(zip(keys, texts_of(batch.column(1)), strict=True)):
                cut, special = _cut(x, tokenizer)
                total, raw = special, x.encode()
                rare: list[tuple[str, int]] = []
                for piece, times in Counter(cut).items():
                    n = known.get(piece)
                    if n is None:
                        rare.append((piece, times))
                    else:
                        total += n * times
                content = _fingerprint(raw)
                for values, value in zip(rows, (row, content, len(raw), total, None, 1), strict=True):
                    values.append(value)
                for piece, times in rare:
                    for values, value in zip(rows, (row, content, None, times, piece, 0), strict=True):
                        values.append(value)
            row, content, n_bytes, n, piece, copies = rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(content, pa.int64()),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(piece, pa.string()),
                    pa.array(copies, pa.int64()),
                ],
                ["_key", "content", "n_bytes", "n", "piece", "copies"],
            )

    kind = source.schema[0].dataType.simpleString()
    parts = written_once(
        source.mapInArrow(
            per_text, f"_key {kind}, content bigint, n_bytes bigint, n bigint, piece string, copies bigint"
        )
    )
    rare = parts.where("piece IS NOT NULL").join(counted.select("piece", F.col("n").alias("each")), "piece")
    rare = rare.select("_key", "content", "n_bytes", (F.col("n") * F.col("each")).alias("n"), "copies")
    # Rows that repeat key and text are added up and dealt out again.
    totals = (
        parts.where("piece IS NULL")
        .drop("piece")
        .unionByName(rare)
        .groupBy("_key", "content")
        .agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    )
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES)))
    totals = totals.withColumn("_block", blocks)  # no long list, however many copies
    left = F.least(F.lit(COPIES), F.col("copies") - F.col("_block") * COPIES).cast("int")
    each = F.explode(F.array_repeat(F.struct("n_bytes", (F.col("n") / F.col("copies")).cast("bigint").alias("n")), left))
    return totals.select("_key", each.alias("t")).select(
        F.col("_key").alias(key),
        F.col("t.n_bytes").alias("n_bytes"),
        F.col("t.n").alias("n_tokens"),
        (F.col("t.n") > limit).alias("over_limit"),
    )


def _hot_from(counted: DataFrame) -> int:
    """Least count from which on at most HOT pre-tokens are as frequent, from counts by eighths of an octave."""
    step = F.floor(8 * F.log2("seen")).cast("int").alias("step")
    sizes = dict(counted.groupBy(step).count().collect())  # a few hundred rows
    total, lowest = 0, max(sizes, default=0) + 1
    for step in sorted(sizes, reverse=True):
        total += sizes[step]
        if total > HOT:
            break
        lowest = step
    return math.ceil(2 ** (lowest / 8))


def _cut(text: str, tokenizer: str) -> tuple[list[str], int]:
    """Pre-tokens outside special strings, and the number of special strings."""
    specials = special_tokens(tokenizer)
    if not any(s in text for s in specials):
        return byte_level(text), 0
    parts = re.split("|".join(map(re.escape, sorted(specials, key=len, reverse=True))), text)
    return [p for part in parts for p in byte_level(part)], len(parts) - 1


def _fingerprint(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _table(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "seen"]
    )
