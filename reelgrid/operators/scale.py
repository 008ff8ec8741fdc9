"""Building blocks that keep order-dependent work distributed when one key is very large.

A video, job or user may hold a third of all rows, so no window below is partitioned by such a key
alone. Ordered data is cut into fixed position spans (``chunk``); frames that reach over a span edge
get copies of the neighbouring rows (halo), and running values cross spans through a table that
holds one row per span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written_once

#: Rows of one key handled by one window partition.
SPAN = 16384
#: Largest table (rows) that is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Largest group (rows) whose exact quantile is taken by one aggregate buffer.
QUANTILE_GROUP_ROWS = 2_000_000


def with_halo(df: DataFrame, pos: str, before: int, after: int, span: int = SPAN) -> DataFrame:
    """Assign rows to spans and copy rows near an edge into the neighbour that needs them.

    Adds ``chunk`` and ``own``. A span sees ``before`` rows ahead of its first position and
    ``after`` rows past its last one; callers keep ``own`` rows once the frames are evaluated.
    """
    if before > span or after > span:
        raise ValueError("halo wider than the span")
    home = F.floor(F.col(pos) / F.lit(span))
    offset = F.col(pos) - home * F.lit(span)
    chunks = F.array_compact(
        F.array(
            home,
            F.when(offset >= span - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    out = df.withColumn("chunk", F.explode(chunks))
    return out.withColumn("own", F.col("chunk") == F.floor(F.col(pos) / F.lit(span)))


def running_last(
    df: DataFrame,
    key: Sequence[str],
    pos: str,
    values: dict[str, Column],
    span: float = SPAN,
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Add, per output name, the last non-null value at or before each row.

    Rows are ordered by ``pos`` (or by ``order``, which must refine it) and cut into spans of ``pos``.
    """
    key = list(key)
    order = list(order or [pos])
    work = df if "chunk" in df.columns else df.withColumn("chunk", F.floor(F.col(pos) / F.lit(span)))
    local = W.partitionBy(*key, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # The local running value at the end of a span is what the following spans inherit.
    place = F.row_number().over(W.partitionBy(*key, "chunk").orderBy(*order))
    work = work.withColumns(
        {**{n: F.last(v, ignorenulls=True).over(local) for n, v in values.items()}, "_place": place}
    )
    tails = work.groupBy(*key, "chunk").agg(
        *[F.max_by(F.col(n), F.col("_place")).alias(f"_tail_{n}") for n in values]
    )
    work = work.drop("_place")
    across = W.partitionBy(*key).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = tails.select(
        *key,
        "chunk",
        *[F.last(f"_tail_{n}", ignorenulls=True).over(across).alias(f"_carry_{n}") for n in values],
    )
    joined = work.join(carry, [*key, "chunk"], "left")
    for name in values:
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.col(f"_carry_{name}"))).drop(f"_carry_{name}")
    return joined


def dense_rank_in_order(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str], bucket: Column, out: str = "i"
) -> DataFrame:
    """Zero-based position of each row inside its key, counted bucket by bucket.

    ``bucket`` must grow with the order. Only (key, bucket) groups are sorted; earlier buckets enter
    through their row counts.
    """
    key = list(key)
    work = df.withColumn("_bucket", bucket)
    sizes = work.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    across = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*key, "_bucket", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    within = W.partitionBy(*key, "_bucket").orderBy(*order)
    ranked = work.withColumn("_rn", F.row_number().over(within))
    return (
        ranked.join(offsets, [*key, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
        .drop("_bucket", "_offset", "_rn")
    )


def in_pieces(df: DataFrame, key: Sequence[str], order: Sequence[str], rows: int = SPAN) -> DataFrame:
    """The rows sorted by key and order and cut into pieces of at most ``rows``: adds ``_piece`` and ``_at``.

    A sample sort: ranges of the full order, so a key of any size is spread over many tasks; piece numbers and the
    places in them rise with the order. The result is written, as later passes must see the same cuts.
    """
    laid = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    place = laid.withColumn("_id", F.monotonically_increasing_id())
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    piece = F.shiftleft(F.shiftright("_id", 33), 33) + F.floor(inside / rows)
    return written_once(place.withColumns({"_piece": piece, "_at": inside}).drop("_id"))


def ranks_in_pieces(
    df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "i", rows: int = SPAN
) -> DataFrame:
    """Zero-based position of each row inside its key, whatever the size of the key or of any bucket of it.

    ``order`` should leave no large group of ties: rows of equal order lie in one range.
    """
    laid = in_pieces(df, key, order, rows)
    ranked = dense_rank_in_order(laid, key, ["_at"], F.col("_piece"), out)
    return ranked.drop("_piece", "_at")


def group_profile(df: DataFrame, key: Sequence[str]) -> tuple[int, int]:
    """(number of groups, rows of the largest group): one aggregated row to the driver."""
    row = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
        .first()
    )
    return int(row["groups"]), int(row["largest"])


def exact_medians(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], largest: int | None = None
) -> DataFrame:
    """One row per key with the exact median of each column (mean of the middle two).

    Small groups use one aggregate buffer each. When a group exceeds ``QUANTILE_GROUP_ROWS`` the
    medians come from ``ranked_medians``, which never holds a group in one place.
    """
    key = list(key)
    if largest is None:
        _, largest = group_profile(df, key)
    if largest <= QUANTILE_GROUP_ROWS:
        return df.groupBy(*key).agg(*[F.percentile(F.col(c), F.lit(0.5)).alias(c) for c in columns])
    out = None
    for c in columns:
        one = ranked_medians(df.select(*key, c), key, c)
        out = one if out is None else out.join(one, key, "full")
    return out


def ranked_medians(df: DataFrame, key: Sequence[str], column: str, slices: int = 256) -> DataFrame:
    """Exact median by rank selection: values are counted per slice of the key's range, then only
    the slice that holds the middle ranks is ordered."""
    key = list(key)
    steps = [k / slices for k in range(1, slices)]
    values = df.where(F.col(column).isNotNull())
    # Distinct values with their counts: ties collapse before anything is shuffled by rank.
    counted = values.groupBy(*key, column).agg(F.count(F.lit(1)).alias("_c"))
    splits = values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(column, steps, 10000).alias("_splits")
    )
    if group_profile(splits, key)[0] <= BROADCAST_ROWS // slices:
        placed = counted.join(F.broadcast(splits), key)
    else:
        # Keys are too many to broadcast: spread each key over salts so a hot key is not one task.
        salts = 64
        salted = splits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = counted.withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")).join(
            salted, [*key, "_salt"]
        )
    slot = F.size(F.filter("_splits", lambda s: s < F.col(column)))
    placed = placed.withColumn("_slot", slot).select(*key, column, "_c", "_n", "_slot")
    per_slot = placed.groupBy(*key, "_slot").agg(F.sum("_c").alias("_m"), F.first("_n").alias("_n"))
    up_to = W.partitionBy(*key).orderBy("_slot")
    slots = per_slot.withColumn(
        "_base", F.coalesce(F.sum("_m").over(up_to.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    hit = slots.where((F.col("_base") <= hi) & (F.col("_base") + F.col("_m") > lo)).select(
        *key, "_slot", "_base"
    )
    inside = placed.join(hit, [*key, "_slot"])
    order = W.partitionBy(*key, "_slot").orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = inside.withColumn("_end", F.col("_base") + F.sum("_c").over(order))
    start = F.col("_end") - F.col("_c")
    middle = F.when((start <= lo) & (F.col("_end") > lo), F.col(column))
    upper = F.when((start <= hi) & (F.col("_end") > hi), F.col(column))
    return ranked.groupBy(*key).agg(((F.max(middle) + F.max(upper)) / 2).alias(column))


def interval_chunks(start: Column, end: Column, span: float) -> Column:
    """Buckets touched by the half-open interval [start, end), for an equi-join on bucket."""
    first = F.floor(start / F.lit(float(span)))
    last = F.greatest(first, F.ceil(end / F.lit(float(span))) - 1)
    return F.sequence(first, last)


def with_neighbours(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, values: Sequence[str]
) -> DataFrame:
    """Add ``prev`` and ``next``: structs of ``values`` of the rows around each row in key order.

    Windows cover (key, bucket) only; the rows at bucket edges find their neighbour in a table of
    bucket ends. ``bucket`` must grow with the order.
    """
    key = list(key)
    work = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*key, "_bucket").orderBy(*order)
    item, rank = F.struct(*values), F.struct(*order)
    # Both branches read the same exchange on (key, bucket).
    ends = work.repartition(*key, "_bucket").groupBy(*key, "_bucket").agg(
        F.min_by(item, rank).alias("_first"), F.max_by(item, rank).alias("_last")
    )
    work = work.repartition(*key, "_bucket").withColumns(
        {"prev": F.lag(item).over(inner), "next": F.lead(item).over(inner)}
    )
    across = W.partitionBy(*key).orderBy("_bucket")
    ends = ends.select(
        *key, "_bucket", F.lag("_last").over(across).alias("_p"), F.lead("_first").over(across).alias("_n")
    )
    return (
        work.join(ends, [*key, "_bucket"])
        .withColumns({"prev": F.coalesce("prev", "_p"), "next": F.coalesce("next", "_n")})
        .drop("_bucket", "_p", "_n")
    )


def ordered_fold(df: DataFrame, key: Sequence[str], order: Sequence[str], fold, schema: str) -> DataFrame:
    """Run ``fold(batches)`` over rows sorted by key and order, each key whole inside one partition.

    For steps that depend on the previous result. Rows stream through in Arrow batches and nothing
    is grouped in memory; the fold keeps its own small state and resets it when the key changes.
    """
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(fold, schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input with fewer splits than cores; larger inputs are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add expensive columns so that they are computed once per row.

    The optimizer copies a plain projection into every filter and expression that uses it; a
    one-element explode is a boundary it does not cross.
    """
    for name, value in columns.items():
        df = df.withColumn(name, F.explode_outer(F.array(value)))
    return df


def explode_present(df: DataFrame, name: str, items: Column) -> DataFrame:
    """One row per list member; ``items`` is evaluated once."""
    return df.withColumn(name, F.explode_outer(items)).where(F.col(name).isNotNull())
