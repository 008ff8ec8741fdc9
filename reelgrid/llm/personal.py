"""Personal data in clip texts, plain or disguised, with offsets into the source.

Disguises are undone by small transducers that keep, for every normalised character, the source
characters it came from; identifiers are found in the normalised text and mapped back.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices, texts_of
from .spans import Span, digest, free, joined

KINDS = ["email", "ip", "card", "phone"]

# Shapes of the identifiers.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters that look like Latin ones, invisible characters, digits and marks spelled in the languages of
# the texts.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
}
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {
    "en": ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"],
    "fr": ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"],
    "de": ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"],
    "es": ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
}
PLUS = ["plus", "más", "mas"]
#: Words for @ and for the full stop of a domain, which belong together.
AT_DOT = [("at", "dot"), ("arobase", "point"), ("arroba", "punto"), ("at", "punkt"), ("ät", "punkt")]

_WIDE = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
_CHARS = LOOKALIKES | _WIDE | dict.fromkeys(INVISIBLE, "")
_ODD = re.compile("[" + "".join(map(re.escape, _CHARS)) + "]")
_DIGIT_OF = {word: str(k) for words in SPELLED.values() for k, word in enumerate(words)}
_NUMBER = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_DIGITS_IN_WORDS = re.compile(
    rf"(?:\b({'|'.join(PLUS)})[ ,.-]+)?\b(?:{_NUMBER})(?:[ ,.-]+(?:{_NUMBER})\b){{6,}}", re.IGNORECASE
)
_ONE_NUMBER = re.compile(rf"\b(?:{_NUMBER})\b", re.IGNORECASE)
_ATS, _DOTS = ("|".join(dict.fromkeys(words)) for words in zip(*AT_DOT, strict=True))
_BRACKETED = re.compile(rf" ?[\[({{<] ?(?:({_ATS}|@)|{_DOTS}|\.) ?[\])}}>] ?", re.IGNORECASE)
_BARE = re.compile(
    "|".join(
        rf"(?<=[A-Za-z0-9_%+-]){at}[A-Za-z0-9-]+(?: {dot} [A-Za-z0-9-]+)+\b"
        for at, dot in [*((f" {a} ", d) for a, d in AT_DOT), ("@", f"(?:{_DOTS})")]
    ),
    re.IGNORECASE,
)
_DOT = re.compile(rf" (?:({_ATS})|{_DOTS}) ", re.IGNORECASE)
_CLOSED = re.compile(rf"(?:{_ATS}|{_DOTS}|[@.]) ?[\])}}>]", re.IGNORECASE)


def find_personal_data(texts: DataFrame, key: str = "clip_id", text: str = "description") -> DataFrame:
    """Spans of e-mail addresses, IP addresses, card and phone numbers in every text.

    Output: ``key``, ``plain`` (spans as written plainly), ``plain_sha256``, ``spans`` (plain and disguised
    ones) as ``kind:start:end`` by start and kind, comma-joined, and the counts of plain spans ``n_email``,
    ``n_ip``, ``n_card``, ``n_phone``. Offsets are code points of the source, end exclusive.

    Null and empty texts have no spans; a null key stays null; repeated rows give one result each; other
    columns are ignored. A disguised span never lies within a plain one of its kind. Memory is bounded by a slice of text.
    """
    columns = ["plain", "plain_sha256", "spans"]

    def run(batches):
        for batch in slices(batches, 1):
            found = [_spans(x) for x in texts_of(batch.column(1))]
            values = [
                pa.array([joined(p, KINDS) for p, _ in found], pa.string()),
                pa.array([digest(p, KINDS) for p, _ in found], pa.string()),
                pa.array([joined(p + d, KINDS) for p, d in found], pa.string()),
            ] + [pa.array([sum(s[0] == k for s in p) for p, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *values], [key, *columns, *(f"n_{k}" for k in KINDS)]
            )

    source = texts.select(key, text)
    schema = [f"`{key}` {source.schema[0].dataType.simpleString()}", *(f"{c} string" for c in columns)]
    return source.mapInArrow(run, ", ".join([*schema, *(f"n_{k} bigint" for k in KINDS)]))


def _spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and spans that appear only when disguises are undone."""
    plain = plain_spans(text)
    undone = _undo(text)
    if undone is None:
        return plain, []
    return plain, free(undone.mapped(plain_spans(undone.text)), plain)


def plain_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and _is_card(_NO_DIGIT.sub("", m[0])):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from the at-signs so that long words without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield ("email", start, m.end())
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _is_card(digits: str) -> bool:
    if not 14 <= len(digits) <= 19:
        return False
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


class _Undone:
    """A normalised text with, per segment, its place in the source."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.out, self.src, self.ends, self.changed = [], [], [], []
        pieces, at, size = [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for lo, hi, piece, changed in ((at, start, text[at:start], False), (start, end, new, True)):
                if piece:
                    self.out.append(size)
                    self.src.append(lo)
                    self.ends.append(hi)
                    self.changed.append(changed)
                    pieces.append(piece)
                    size += len(piece)
            at = end
        self.text = "".join(pieces)

    def mapped(self, spans: list[Span]) -> list[Span]:
        """Spans of the source behind spans of the normalised text, if they contain a change."""
        out = []
        for kind, start, end in spans:
            first, last = (bisect.bisect_right(self.out, x) - 1 for x in (start, end - 1))
            lo = self.src[first] + (0 if self.changed[first] else start - self.out[first])
            hi = self.ends[last] if self.changed[last] else self.src[last] + end - self.out[last]
            if any(self.changed[first : last + 1]) or hi - lo != end - start:
                out.append((kind, lo, hi))
        return out


def _undo(text: str) -> _Undone | None:
    """The text without its disguises, or None if it has none."""
    edits: list[tuple[int, int, str]] = []
    if not text.isascii():
        edits += [(m.start(), m.end(), _CHARS[m[0]]) for m in _ODD.finditer(text)]
        if edits:  # the word rules below see the letters as Latin
            inner = _Undone(text, edits)
            more = _word_edits(inner.text)
            spans = inner_spans(inner, more)
            kept = [e for e in edits if not any(s <= e[0] < t for s, t, _ in spans)] if spans else edits
            return _Undone(text, sorted(kept + spans))
    edits = _word_edits(text)
    return _Undone(text, edits) if edits else None


def inner_spans(inner: _Undone, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits of a normalised text as edits of its source."""
    out = []
    for start, end, new in edits:
        first, last = (bisect.bisect_right(inner.out, x) - 1 for x in (start, end - 1))
        lo = inner.src[first] + (0 if inner.changed[first] else start - inner.out[first])
        hi = inner.ends[last] if inner.changed[last] else inner.src[last] + end - inner.out[last]
        out.append((lo, hi, new))
    return out


def _word_edits(text: str) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(c in low for c in ")]}>") and _CLOSED.search(text):
        edits += [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)]
    if any(f" {d} " in low for _, d in AT_DOT):
        for m in _BARE.finditer(text):
            for d in _DOT.finditer(text, *m.span()):
                edits.append((d.start(), d.end(), "@" if d[1] else "."))
    if sum(low.count(w) for w in _DIGIT_OF) >= 7:
        for m in _DIGITS_IN_WORDS.finditer(text):
            number = "".join(_DIGIT_OF[d.lower()] for d in _ONE_NUMBER.findall(m[0][m.end(1) - m.start() if m[1] else 0 :]))
            # Nobody spells out so many digits but to hide a phone number.
            edits.append((*m.span(), ("+" if m[1] or 10 <= len(number) <= 15 else "") + number))
    out: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out
