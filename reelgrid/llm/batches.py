"""Arrow helpers shared by the operators: bounded slices of text and word splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a worker holds as Python objects at a time.
SLICE_BYTES = 4 << 20
_MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def slices(batches, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of column ``text`` (one row at least)."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def texts_of(column: pa.Array) -> list[str]:
    """Values of a text column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a fixed bijection)."""
    x = x.astype(np.uint64, copy=True)
    for shift, multiplier in zip((30, 27), _MULTIPLIERS, strict=True):
        x ^= x >> np.uint64(shift)
        x *= multiplier
    return x ^ (x >> np.uint64(31))


def all_cores(df: DataFrame, key: str) -> DataFrame:
    """Deal out an input that has fewer splits than the cluster has cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.xxhash64(key)) if df.rdd.getNumPartitions() < cores else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
