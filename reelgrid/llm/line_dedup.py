"""Lines that many clip texts share are kept in one of them.

Works on clip texts: one row per clip with ``clip_id`` and ``description``. All steps are DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_once
from .batches import all_cores, lower_ascii

MIN_CHARS, MIN_TEXTS = 40, 5
_SPACES = " \t\n\x0b\x0c\r"


def drop_shared_lines(
    texts: DataFrame, key: str = "clip_id", text: str = "description",
    min_chars: int = MIN_CHARS, min_texts: int = MIN_TEXTS,
) -> DataFrame:
    """The input rows with ``text`` freed of shared lines, plus ``n_lines`` and ``n_dropped``.

    A line counts by its normalised form (ASCII spaces stripped at both ends, A-Z lower-cased). A form of
    ``min_chars`` code points or more that occurs in ``min_texts`` texts or more loses all its lines, except
    in the text with the largest key. Other lines keep their order, joined by line feeds.

    Null and empty texts are one empty line (a null text becomes empty). Rows with the same key count as
    one text for ``min_texts``; a null key is a key of its own, smaller than all others. Other columns stay, but
    for an input column named ``n_lines`` or ``n_dropped``, whose place the measure takes.
    Lines are compared by two independent 64-bit hashes, counted first per key and then per line, so a line
    that a third of all texts share stays a partial sum. A text moves once, to meet its dropped positions.
    """
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    # The input row stays one value, so that its columns can't clash with those of the work.
    source = all_cores(texts, text).select(F.struct(*texts.columns).alias("row"))
    source = source.select("row", F.col("row")[key].alias("key"), whole.alias("whole"), F.xxhash64(whole).alias("hash"))
    lines = written_once(
        source.select("key", "hash", F.posexplode(F.split("whole", "\n")).alias("position", "line"))
        .select("key", "hash", "position", F.btrim(lower_ascii(F.col("line")), F.lit(_SPACES)).alias("form"))
        .where(F.length("form") >= min_chars)
        .select("key", "hash", "position", F.xxhash64("form").alias("h"), F.xxhash64(F.lit(1), "form").alias("g"))
    )
    # Written, so that the join below reads plain exchanges and Spark can split a line that very many texts share.
    shared = written_once(
        lines.select("h", "g", "key")
        .distinct()
        .groupBy("h", "g")
        .agg(F.count("*").alias("texts"), F.max("key").alias("keeper"))
        .where(F.col("texts") >= min_texts)
    )
    dropped = (
        lines.join(shared, ["h", "g"])
        .where(~F.col("key").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("key").alias("_key"), F.col("hash").alias("_hash"))
        .agg(F.collect_set("position").alias("dropped"))
    )
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash"))
    parts = F.split("whole", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    # The one-element transform binds the split text, so it is cut once per text and not once per line.
    rest = F.transform(F.array(parts), lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n"))[0]
    freed = F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(rest)
    return source.join(dropped, same, "left").select(
        *(freed.alias(c) if c == text else F.col("row")[c].alias(c) for c in texts.columns if c not in ("n_lines", "n_dropped")),
        F.size(parts).cast("bigint").alias("n_lines"),
        F.coalesce(F.array_size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
