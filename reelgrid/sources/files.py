"""File listings and content fingerprints."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written_once

# Fixed value: bytes hashed from each end of a file.
CHUNK = 8 * 1024 * 1024
READ_BLOCK = 4 * 1024 * 1024


def read_file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), bytes and file_key of every file below ``root``, empty ones too; contents are not read.

    Workers list the directories, level by level; the driver sees none of them. ``file_key`` is device and inode of a
    local file, so a file with two names is one, and the path elsewhere. Links to directories are not followed.
    """
    frontier = spark.createDataFrame([("",)], "path string")
    found = None
    while frontier is not None:
        cores = spark.sparkContext.defaultParallelism
        listed = written_once(frontier.repartition(cores, "path").mapInArrow(lambda b: _listed(b, root), _LISTED))
        files = listed.where("NOT directory").select("path", "bytes", "file_key")
        found = files if found is None else found.unionByName(files)
        below = listed.where("directory").select("path")
        frontier = None if below.isEmpty() else below
    return found


_LISTED = "path string, directory boolean, bytes bigint, file_key string"


def _listed(batches, root: str) -> Iterator[pa.RecordBatch]:
    """Entries of each directory (paths relative to the root)."""
    system, base = located(root.rstrip("/"))
    for batch in batches:
        rows = []
        for directory in batch.column(0).to_pylist():
            inside = f"{directory}/" if directory else ""
            if isinstance(system, fs.LocalFileSystem):
                with os.scandir(f"{base}/{directory}") as entries:
                    for e in entries:
                        is_dir = e.is_dir(follow_symlinks=False)
                        if is_dir or e.is_file():
                            stat = e.stat()
                            rows.append((inside + e.name, is_dir, stat.st_size, f"{stat.st_dev}:{stat.st_ino}"))
            else:
                for info in system.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/"))):
                    rows.append((inside + info.base_name, info.type == fs.FileType.Directory, info.size or 0, info.path))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "directory", "bytes", "file_key"]
        )


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain place of a path as Spark names it."""
    uri = re.sub("^s3[an]:", "s3:", path)
    uri = re.sub("^file:/+", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    # Listed names are plain, not encoded: only the part before the key is parsed as a URI.
    scheme, rest = uri.split("://", 1)
    bucket, _, name = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{bucket}")
    return system, f"{base.rstrip('/')}/{name}"


def fingerprint(content: Column) -> Column:
    """sha256 over "size LF", the first 8 MiB and the last 8 MiB without overlap."""
    size = F.octet_length(content)
    tail_from = F.greatest(F.least(F.lit(CHUNK), size), size - CHUNK)
    head = F.substring(content, F.lit(1), F.lit(CHUNK))
    tail = F.substring(content, tail_from + 1, F.lit(CHUNK))
    prefix = F.encode(F.concat(size.cast("string"), F.lit("\n")), "UTF-8")
    return F.sha2(F.concat(prefix, head, tail), 256)


def fingerprint_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, fingerprint and content_hash of every non-empty file below ``root``.

    Spark lists the files; workers read them block by block through the file system of the path (local,
    HDFS or object store), whatever their size, so memory stays at one block per task.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", F.col("length").alias("size_bytes"))
    )
    return listed.repartition("path").mapInPandas(
        _hash_files, "path string, size_bytes bigint, fingerprint string, content_hash string"
    )


def _opened(path: str):
    """Input stream of a path as Spark lists it."""
    system, place = located(path)
    return system.open_input_stream(place)


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, size in zip(batch["path"], batch["size_bytes"], strict=True):
            with _opened(path) as stream:
                rows.append((path, size, *_digests(stream, size)))
        yield pd.DataFrame(rows, columns=["path", "size_bytes", "fingerprint", "content_hash"])


def _digests(stream, size: int) -> tuple[str, str]:
    """Fingerprint (size, first and last CHUNK) and SHA-256 of the whole stream."""
    quick, full = hashlib.sha256(f"{size}\n".encode()), hashlib.sha256()
    tail, at = max(min(CHUNK, size), size - CHUNK), 0
    while block := stream.read(READ_BLOCK):
        full.update(block)
        quick.update(block[: max(0, CHUNK - at)])
        quick.update(block[max(0, tail - at) :])
        at += len(block)
    return quick.hexdigest(), full.hexdigest()
