"""Array files in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as fs

#: Files that a worker keeps mapped, about half of what Linux allows a process by default.
MAPPED = 1 << 15


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(folder)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path or folder
    return fs.FileSystem.from_uri(folder)


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under a name of its own and move it in place, so that repeated tasks do no harm.

    A store that refuses to move onto an existing name has the array of an earlier attempt, which is the same.
    """
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    try:
        system.move(own, f"{path}/{name}")
    except OSError:
        if system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(own)


@lru_cache(maxsize=MAPPED)
def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """The array of a file, memory-mapped; from a remote store by way of a copy that ends with its mapping."""
    system, path = _place(folder)
    full = f"{path}/{name}"
    size = system.get_file_info(full).size
    if not size:
        return np.empty(0, dtype)
    if not isinstance(system, fs.LocalFileSystem):
        handle, copy = tempfile.mkstemp(prefix="reelgrid-")
        os.close(handle)
        try:
            fs.copy_files(full, copy, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            return np.memmap(copy, dtype, "r")
        finally:
            os.unlink(copy)  # the mapping keeps the bytes until it goes
    return np.memmap(full, dtype, "r")
