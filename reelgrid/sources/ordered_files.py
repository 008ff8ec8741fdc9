"""Text files of ordered lines: one file per unit, whatever its size, in place only once all of them are complete.

Tasks write numbered parts side by side, then one task per file joins its parts block by block; the driver sees
names and sizes only and moves the joined files in place. A write that fails leaves all former files as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import located

BLOCK = 8 << 20
_PART = "file string, number bigint, at string, bytes bigint"


def write_ordered_files(lines: DataFrame, path: str, order: list[str], emptied: list[str] | None = None) -> dict[str, int]:
    """Write ``lines`` (``file``, ``value`` and the columns of ``order``) below ``path``; bytes of every file written.

    ``file`` is a path below ``path``; its lines end in a line feed each. Files with lines are replaced, those in
    ``emptied`` without lines are removed, all others stay. Lines are dealt out by range of (file, order): give an
    order without large groups of ties. A file of any size is joined by one task that holds one block of it.
    """
    spark = lines.sparkSession
    stage = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    laid = lines.repartitionByRange("file", *order).sortWithinPartitions("file", *order).select("file", "value")
    try:
        parts = laid.mapInArrow(lambda b: _write_parts(b, stage), _PART)
        rows = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("number", "at"))).alias("parts"))
        joined = rows.select("file", "parts.at").mapInArrow(lambda b: _join(b, stage), "file string, at string, bytes bigint")
        done = joined.collect()  # a name and a size per file
        fs, _ = _hadoop(spark, path)
        for row in done:
            _move(spark, row["at"], f"{path.rstrip('/')}/{row['file']}")
        for name in set(emptied or ()) - {row["file"] for row in done}:
            fs.delete(_hadoop(spark, f"{path.rstrip('/')}/{name}")[1], False)
    finally:
        fs, at = _hadoop(spark, stage)
        fs.delete(at, True)
    return {row["file"]: row["bytes"] for row in done}


def _write_parts(batches, stage: str) -> Iterator[pa.RecordBatch]:
    """One part per file of this task, named by an attempt of its own; only a task that ends well reports its parts."""
    number = TaskContext.get().partitionId()
    out, name, rows = None, None, []
    # Few lines at a time as Python values: a line may hold a whole text.
    pieces = (batch.slice(start, 256) for batch in batches for start in range(0, batch.num_rows, 256))
    for piece in pieces:
        for file, value in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            if file != name:
                if out is not None:
                    rows[-1][3] = out.tell()
                    out.close()
                at = f"{stage}/parts/{uuid.uuid4().hex}"
                system, place = located(at)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                out, name = system.open_output_stream(place), file
                rows.append([file, number, at, 0])
            out.write((value or "").encode() + b"\n")
    if out is not None:
        rows[-1][3] = out.tell()
        out.close()
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "number", "at", "bytes"])


def _join(batches, stage: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, size = f"{stage}/whole/{uuid.uuid4().hex}", 0
            system, place = located(at)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as out:
                for part in parts:
                    with located(part)[0].open_input_stream(located(part)[1]) as source:
                        while block := source.read(BLOCK):
                            out.write(block)
                            size += len(block)
            rows.append((file, at, size))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "at", "bytes"])


def _hadoop(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def _move(spark, source: str, target: str) -> None:
    """Replace a file in one step."""
    fs, to = _hadoop(spark, target)
    fs.mkdirs(to.getParent())
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_hadoop(spark, source)[1], to, options)
