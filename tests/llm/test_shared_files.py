"""Array files: repeated writes, many files, copies of remote files."""

import os

import numpy as np
import pyarrow.fs as fs
import pytest

from reelgrid.llm import shared_files


class Remote(fs.FileSystemHandler):
    """A store that is not local and refuses to move onto an existing name."""

    def __init__(self, root):
        self.inner = fs.SubTreeFileSystem(str(root), fs.LocalFileSystem())

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def move(self, src, dest):
        if self.inner.get_file_info(dest).type == fs.FileType.File:
            raise FileExistsError(dest)
        self.inner.move(src, dest)

    def create_dir(self, path, recursive):
        self.inner.create_dir(path, recursive=recursive)

    def delete_file(self, path):
        self.inner.delete_file(path)

    def get_file_info(self, paths):
        return self.inner.get_file_info(paths)

    def normalize_path(self, path):
        return path

    def get_type_name(self):
        return "remote"

    def open_input_file(self, path):
        return self.inner.open_input_file(path)

    def open_input_stream(self, path):
        return self.inner.open_input_stream(path)

    def open_output_stream(self, path, metadata):
        return self.inner.open_output_stream(path)

    def open_append_stream(self, path, metadata):
        raise NotImplementedError

    def delete_dir_contents(self, path, missing_dir_ok=False):
        raise NotImplementedError

    def delete_root_dir_contents(self):
        raise NotImplementedError

    def get_file_info_selector(self, selector):
        return self.inner.get_file_info(selector)


Remote.__abstractmethods__ = frozenset()


@pytest.fixture
def remote(tmp_path, monkeypatch):
    (tmp_path / "store").mkdir()
    (tmp_path / "own").mkdir()
    system = fs.PyFileSystem(Remote(tmp_path / "store"))
    monkeypatch.setattr(shared_files, "_place", lambda folder: (system, folder))
    monkeypatch.setattr(shared_files.tempfile, "tempdir", str(tmp_path / "own"))
    shared_files.mapped.cache_clear()
    yield tmp_path
    shared_files.mapped.cache_clear()


def test_remote_files_leave_no_copies(remote):
    for k in range(40):
        shared_files.put("model", f"a{k}", np.arange(k * 10, dtype=np.uint64))
    for _ in range(2):
        assert all(shared_files.mapped("model", f"a{k}", "uint64").sum() == sum(range(k * 10)) for k in range(40))
    assert os.listdir(remote / "own") == []
    assert shared_files.mapped.cache_info().hits == 40


def test_a_repeated_task_finds_its_file_in_place(remote):
    for _ in range(2):
        shared_files.put("model", "a", np.arange(5))
    assert os.listdir(remote / "store" / "model") == ["a"]
    assert shared_files.mapped("model", "a", "int64").tolist() == [0, 1, 2, 3, 4]


def test_many_files_stay_mapped(tmp_path):
    shared_files.mapped.cache_clear()
    for k in range(6000):
        (tmp_path / f"f{k}").write_bytes(np.int64(k).tobytes())
    for _ in range(2):  # in the same order each time, as slices of text do
        assert sum(int(shared_files.mapped(str(tmp_path), f"f{k}", "int64")[0]) for k in range(6000)) == 17_997_000
    assert shared_files.mapped.cache_info().hits == 6000
    shared_files.mapped.cache_clear()
