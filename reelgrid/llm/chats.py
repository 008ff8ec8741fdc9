"""Chat formatting of answer logs: turns become one marked text with a loss mask.

Works on the turns of metadata conversations: ``clip_id``, ``turn``, ``role`` and ``content``. The
formatted bytes are assembled by column: numpy computes segment lengths, offsets and scatter positions,
and headers and contents are copied into one preallocated buffer per batch.

A turn is ``### `` role, line feed, content, ``</turn>`` and line feed. Inside roles and contents a
backslash precedes every backslash, ``<`` and ``#`` (in roles also line feeds), so no text can hold a
mark, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

HEAD, MIDDLE, TAIL = b"### ", b"\n", b"</turn>\n"
#: Characters of role and content by which turns of one number are dealt out.
PREFIX = 32
LEARNED_ROLE = "assistant"
_ESCAPED, _ESCAPED_IN_ROLES = b"\\<#", b"\\<#\n"
_TURN = re.compile(r"### ((?:[^\\\n]+|\\.)*)\n((?:[^\\<]+|\\.)*)</turn>\n", re.DOTALL)
_MARK = re.compile(r"\\(.)", re.DOTALL)
PAGES = "page bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, n_turns bigint"


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations in pages: ``clip_id``, ``page``, ``formatted``, ``loss``, ``n_turns``.

    Pages of a conversation, in order of ``page``, concatenate to its text. ``loss`` lists the code-point
    ranges of the page that hold assistant contents. Turns are ordered by turn (null first), role, content.

    Null roles and contents are empty texts, null clip ids form one conversation, repeated rows stay, other
    columns are ignored. Rows are dealt out by range of (clip, turn), so a very long conversation spreads
    over tasks; a page holds a slice of a batch at most.
    """
    order = ["clip_id", "turn", "role", "content"]
    source = turns.select("clip_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in order[2:]))
    kind = source.schema["clip_id"].dataType.simpleString()

    def run(batches):
        page = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 3):
            out = _assemble(batch.column(0), batch.column(2), batch.column(3), page)
            page += out.num_rows
            yield out

    # Ranges are sampled by short prefixes, so that no whole content reaches the driver.
    short = (F.substring(c, 1, PREFIX) for c in order[2:])
    laid = source.repartitionByRange("clip_id", "turn", *short).sortWithinPartitions(*order)
    return laid.mapInArrow(run, f"clip_id {kind}, {PAGES}")


def read_chats(pages: DataFrame) -> DataFrame:
    """Digests of conversations, read back from their formatted pages.

    Output: ``clip_id``, ``n_turns``, ``turns_sha256`` (of role, line feed, content, line feed per turn),
    ``loss_chars`` and ``loss_sha256`` (of the unescaped text under the mask), ``formatted_chars``.
    A digest needs its conversation in order: pages stream through one task per conversation with
    constant state; nothing is collected.
    """
    kind = pages.schema["clip_id"].dataType.simpleString()
    schema = (
        f"clip_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        clip, state = None, None
        for batch in slices(batches, 2):
            done = []
            for i, (text, loss) in enumerate(
                zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ):
                key = batch.column(0)[i]
                if state is None or key != clip:
                    if state is not None:
                        done.append((clip, *state.result()))
                    clip, state = key, _Digest()
                state.add(text, loss)
            if done:
                yield _rows(done, batch.schema.field(0).type, names)
        if state is not None:
            yield _rows([(clip, *state.result())], clip.type, names)

    laid = pages.repartition("clip_id").sortWithinPartitions("clip_id", "page")
    return laid.mapInArrow(run, schema)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, loss: list[dict]) -> None:
        at = 0
        for m in _TURN.finditer(text):
            if m.start() != at:
                raise ValueError("the page can't be read back")
            at = m.end()
            self.turns.update(f"{_plain(m[1])}\n{_plain(m[2])}\n".encode())
            self.n_turns += 1
        if at != len(text):
            raise ValueError("the page can't be read back")
        for span in loss:
            learned = _plain(text[span["start"] : span["end"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(text)

    def result(self):
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _rows(rows, key_type, names):
    columns = list(zip(*rows, strict=True))
    keys = pa.array([k.as_py() for k in columns[0]], key_type)
    return pa.RecordBatch.from_arrays([keys, *(pa.array(list(c)) for c in columns[1:])], names)


def _plain(text: str) -> str:
    return _MARK.sub(r"\1", text) if "\\" in text else text


def _assemble(clips: pa.Array, roles: pa.Array, contents: pa.Array, page: int) -> pa.RecordBatch:
    """Pages of a batch of ordered turns, one per run of equal clip ids."""
    n = len(clips)
    role, content = _Escaped(roles, _ESCAPED_IN_ROLES), _Escaped(contents, _ESCAPED)
    lengths = len(HEAD) + role.lengths + len(MIDDLE) + content.lengths + len(TAIL)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    role_at = starts + len(HEAD)
    content_at = role_at + role.lengths + len(MIDDLE)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for at, mark in ((starts, HEAD), (content_at - len(MIDDLE), MIDDLE), (ends - len(TAIL), TAIL)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    role.scatter(out, role_at)
    content.scatter(out, content_at)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    codes = clips.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    bounds = np.append(starts[first], len(out)).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    of_page = np.searchsorted(first, np.arange(n), "right") - 1
    base = points[bounds[of_page]]
    learned = np.array(roles.to_pylist(), object) == LEARNED_ROLE
    spans = pa.StructArray.from_arrays(
        [
            pa.array((points[content_at] - base)[learned], pa.int64()),
            pa.array((points[content_at + content.lengths] - base)[learned], pa.int64()),
        ],
        ["start", "end"],
    )
    per_page = np.bincount(of_page[learned], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_page)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays(
        [
            clips.take(pa.array(first)),
            pa.array(page + np.arange(len(first)), pa.int64()),
            texts,
            loss,
            pa.array(np.bincount(of_page, minlength=len(first)), pa.int64()),
        ],
        ["clip_id", "page", "formatted", "loss", "n_turns"],
    )


class _Escaped:
    """Bytes of a text column with the places where a backslash goes in."""

    def __init__(self, column: pa.Array, members: bytes):
        column = pa.concat_arrays([column])  # offsets from 0
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        lo, hi = (int(self.offsets[0]), int(self.offsets[-1])) if len(column) else (0, 0)
        self.data = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
        self.offsets -= lo
        marked = np.zeros(256, bool)
        marked[np.frombuffer(members, np.uint8)] = True
        self.marks = marked[self.data]
        self.before = np.concatenate([[0], np.cumsum(self.marks)])
        sizes = np.diff(self.offsets)
        self.lengths = sizes + self.before[self.offsets[1:]] - self.before[self.offsets[:-1]]

    def scatter(self, out: np.ndarray, at: np.ndarray) -> None:
        sizes = np.diff(self.offsets)
        shift = at - self.offsets[:-1] - self.before[self.offsets[:-1]]
        target = np.arange(len(self.data)) + np.repeat(shift, sizes) + self.before[1:]
        out[target] = self.data
        out[target[self.marks] - 1] = ord("\\")
