"""Text clean-up: whitespace, truncation, transliteration, slugs and keyword hygiene.

Lengths and cuts count code points. The platforms' own limits count UTF-16 units, which differ only
for characters outside the BMP.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .numeric import compact, let

# Fixed value: the whitespace class of the source data (more than Java's \s).
WS = r"[\s\x0B\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Letters without a decomposition, and Cyrillic to Latin.
SPECIAL_LETTERS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu",
    "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
}
# Typographic characters folded to ASCII.
FOLDED = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "…": "...",
}


def collapse(c: Column) -> Column:
    """Whitespace runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


# Whole texts and keyword lists are tidied in Arrow batches: a regular expression of the JVM costs several hundred
# nanoseconds a character there, and its array functions evaluate a word many times.
_SPACES = r"[ \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_RUNS = re.compile(f"{_SPACES}+")
_BLANKS = "".join(re.findall(_SPACES, "".join(map(chr, range(0x10000)))))
#: Words of at most ``_KNOWN_LENGTH`` characters whose tidied form one task remembers per rule.
_KNOWN_WORDS, _KNOWN_LENGTH = 1 << 14, 64
#: Bytes of text that ``tidied`` holds as Python values at a time (one row at least).
_PIECE_BYTES = 1 << 20


def _collapsed(s: str) -> str:
    """``collapse`` of one value."""
    for ch in _SPLIT_OTHERWISE:
        if ch in s:
            return _RUNS.sub(" ", s).strip(" ")
    return " ".join(s.split())


# Whitespace to str.split or to ``WS``, but not to both.
_SPLIT_OTHERWISE = "\x1c\x1d\x1e\x1f\x85\ufeff"


def _values(column: pa.Array, rows: int = 256) -> Iterator:
    """Python values of an Arrow column, a few rows at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def _mapped(step: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function as a column function; nulls stay."""

    @F.arrow_udf(StringType())
    def batch(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else step(v) for v in _values(values)], pa.string())

    return batch


def _listed(steps: Callable[[], Callable[[Iterable[str]], list[str]]]) -> Callable[[Column], Column]:
    """A function over a list of words as a column function; nulls stay. ``steps`` builds it once per task."""

    @F.arrow_udf(ArrayType(StringType()))
    def batch(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = steps()
        for lists in values:
            yield pa.array([None if v is None else step(v) for v in _values(lists)], pa.list_(pa.string()))

    return batch


def _remembered(tidy: Callable[[str], tuple]) -> Callable[[str], tuple]:
    """``tidy`` with a memory for words of usual length."""
    known = lru_cache(maxsize=_KNOWN_WORDS)(tidy)
    return lambda raw: known(raw) if len(raw) <= _KNOWN_LENGTH else tidy(raw)


@dataclass(frozen=True)
class Step:
    """A rule of ``tidied``: the columns or earlier steps it reads, the type of its value, and the builder of its function
    of one row, which is called once per task."""

    reads: tuple[str, ...]
    type: str
    build: Callable[[], Callable]


_ARROW_TYPES = {
    "string": pa.string(),
    "array<string>": pa.list_(pa.string()),
    "struct<value:string,n:int>": pa.struct([("value", pa.string()), ("n", pa.int32())]),
}


class _Words:
    """Words of one list in order, each the first time it comes, read from Arrow only as far as they are asked for."""

    def __init__(self, values: pa.Array, start: int, end: int):
        self.values, self.at, self.end, self.seen, self.known = values, start, end, {}, []

    def __iter__(self) -> Iterator[str]:
        done = 0
        while done < len(self.known) or self.at < self.end:
            if done == len(self.known):
                n = min(max(64, 2 * done), self.end - self.at)
                # A word keeps its first place in a dictionary.
                self.seen.update(dict.fromkeys(self.values.slice(self.at, n).to_numpy(zero_copy_only=False).tolist()))
                self.at, self.known = self.at + n, list(self.seen)
            yield from self.known[done:]
            done = len(self.known)


def _word_lists(values: pa.Array, at: np.ndarray, there: np.ndarray, lo: int, hi: int) -> Iterator[_Words | None]:
    for i in range(lo, hi):
        yield _Words(values, int(at[i]), int(at[i + 1])) if there[i] else None


def _pieces(arrays: Sequence[pa.Array]) -> Iterator[Iterator[tuple]]:
    """Rows of text and list columns, a piece at a time: texts as Python values, lists to be read as far as needed."""
    sizes = np.full(len(arrays[0]), 256, np.int64)
    lists = {}
    for k, a in enumerate(arrays):
        if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
            lists[k] = (a.offsets.to_numpy(), a.is_valid().to_numpy(zero_copy_only=False))
        else:
            sizes += pc.fill_null(pc.binary_length(a), 0).to_numpy()
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // _PIECE_BYTES, prepend=-1)).tolist()
    for lo, hi in zip(starts, [*starts[1:], len(sizes)], strict=True):
        columns = []
        for k, a in enumerate(arrays):
            if k in lists:
                columns.append(_word_lists(a.values, *lists[k], lo, hi))
            else:
                columns.append(a.slice(lo, hi - lo).to_pylist())
        yield zip(*columns, strict=True)


def tidied(columns: dict[str, Column], steps: dict[str, Step]) -> Column:
    """struct of the steps' values, from one pass over the columns: one Python worker per task for all rules.

    Every column function below costs a pass of its own, in which whole texts travel and wait again. Steps whose name
    begins with ``_`` are read by later steps only.
    """
    names, shown = [*columns, *steps], [n for n in steps if not n.startswith("_")]
    program = [(step.build, [names.index(r) for r in step.reads]) for step in steps.values()]
    kept = [names.index(n) for n in shown]
    types = [_ARROW_TYPES[steps[n].type] for n in shown]

    @F.arrow_udf(", ".join(f"{n} {steps[n].type}" for n in shown))
    def batch(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        built = [(build(), reads) for build, reads in program]
        for arrays in batches:
            done = [[pa.array([], t)] for t in types]
            for rows in _pieces(arrays if isinstance(arrays, tuple) else (arrays,)):
                outs = [[] for _ in kept]
                for row in rows:
                    have = list(row)
                    for step, reads in built:
                        have.append(step(*[have[r] for r in reads]))
                    for out, k in zip(outs, kept, strict=True):
                        out.append(have[k])
                for out, t, parts in zip(outs, types, done, strict=True):
                    parts.append(pa.array(out, t))
            yield pa.StructArray.from_arrays([pa.concat_arrays(parts) for parts in done], shown)

    return batch(*columns.values())


def _unless_null(f: Callable) -> Callable:
    return lambda v: None if v is None else f(v)


def collapse_step(text: str) -> Step:
    """``collapse_text`` as a step."""
    return Step((text,), "string", lambda: _unless_null(_collapsed))


def _first_distinct(
    words: Iterable[str], tidy: Callable[[str], Iterable[tuple[str, str]]], limit: int | None
) -> list[str]:
    """First word per key in order, until ``limit`` are found: later words can't change those.

    ``tidy`` gives the (key, word) pairs of a raw word; equal raw words are looked at once.
    """
    seen, out = set(), {}
    for raw in words:
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for key, word in tidy(raw):
            out.setdefault(key, word)
        if limit is not None and len(out) >= limit:
            break
    return list(out.values())[:limit]


def collapse_text(c: Column) -> Column:
    """``collapse`` for whole texts."""
    return _mapped(_collapsed)(c)


def unfenced(c: Column) -> Column:
    """Content of the first Markdown fence of a text if there is one, trimmed."""
    fence = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.ASCII)

    def step(s: str) -> str:
        found = fence.search(s) if "```" in s else None
        return (found.group(1) if found else s).strip(_BLANKS)

    return _mapped(step)(c)


def _cut_at_word(t: str, n: int) -> str:
    """Cut an already collapsed text."""
    if len(t) <= n:
        return t
    space = t.rfind(" ", 0, n + 1)
    return t[: space if space > n * 0.5 else n].rstrip(" ,;:-–—(")


def truncate_at_word(c: Column, n: int) -> Column:
    """Cut at a word boundary beyond half of the limit, without dangling punctuation."""
    return _mapped(lambda s: _cut_at_word(_collapsed(s), n))(c)


def _cut_at_sentence(t: str, n: int) -> str:
    if len(t) <= n:
        return t
    end = max(*(t.rfind(f"{mark} ", 0, n) for mark in ".!?"), n - 1 if t[n - 1] == "." else -1)
    return t[: end + 1] if end > n * 0.5 else _cut_at_word(t, n)


def truncate_text(c: Column, n: int) -> Column:
    """Prefer a sentence end beyond half of the limit, else a word boundary."""
    return _mapped(lambda s: _cut_at_sentence(_collapsed(s), n))(c)


@lru_cache(maxsize=1)
def _transliteration() -> tuple[dict[str, str], dict[str, str]]:
    """(one-to-one or deleted, one-to-many) replacements for the BMP.

    The bulk follows a rule: canonical decomposition without combining marks. Scripts that do not
    reduce to one character that way (Hangul, for one) stay composed.
    """
    fixed = dict(SPECIAL_LETTERS)
    fixed.update(CYRILLIC)
    for low, latin in CYRILLIC.items():
        fixed[low.upper()] = latin[:1].upper() + latin[1:]
    fixed.update(FOLDED)
    single, many = {}, {}
    for code in range(0x80, 0xFFFE):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        target = fixed.get(ch)
        if target is None:
            plain = "".join(x for x in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(x) <= 0x36F)
            if plain == ch or len(plain) > 1:
                continue
            target = FOLDED.get(plain, plain)
        (single if len(target) <= 1 else many)[ch] = target
    return single, many


def _translate(c: Column, table: dict[str, str]) -> Column:
    kept = [k for k, v in table.items() if v]
    dropped = [k for k, v in table.items() if not v]
    return F.translate(c, "".join(kept + dropped), "".join(table[k] for k in kept))


def transliterate(c: Column) -> Column:
    """ASCII form of Latin and Cyrillic text, as JVM string functions only."""
    single, many = _transliteration()
    plain = _translate(c, single)
    for ch, target in many.items():
        plain = F.replace(plain, F.lit(ch), F.lit(target))
    # Most texts are ASCII: they skip the replacements.
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


@lru_cache(maxsize=1)
def _latin() -> dict[str, str]:
    single, many = _transliteration()
    return many | {ch: many.get(target, target) for ch, target in single.items()}


def _transliterated(s: str) -> str:
    """``transliterate`` of one value."""
    if not s.isascii():
        table = _latin()
        for ch in set(s):
            if ch in table:
                s = s.replace(ch, table[ch])
    return s


def slugify(c: Column) -> Column:
    flat = F.regexp_replace(F.lower(transliterate(c)), "[^a-z0-9]+", "_")
    return F.regexp_replace(flat, "^_+|_+$", "")


def _word_pattern(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def remove_words(c: Column, words: list[str]) -> Column:
    """Drop whole words, ignoring case; word edges are ASCII."""
    if not words:
        return c
    pattern = re.compile(rf"\b(?:{_word_pattern(words)})(?![A-Za-z0-9_]){_SPACES}*", re.IGNORECASE | re.ASCII)
    edge = re.compile(r"(?<![A-Za-z0-9_])" + pattern.pattern[2:], re.IGNORECASE | re.ASCII)
    plain = all(w[:1].isascii() and (w[:1].isalnum() or w[:1] == "_") for w in words)
    return _mapped(lambda s: _collapsed((pattern if plain else edge).sub("", s)))(c)


def singular(word: str) -> str:
    """Fold a simple English plural."""
    if len(word) <= 3:
        return word
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith(("ches", "shes", "sses", "xes", "zes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def norm_key(keyword: str) -> str:
    """Keyword with its last word in the singular."""
    head, blank, last = keyword.rpartition(" ")
    return head + blank + singular(last)


def distinct_first(items: Column, key: Callable[[Column], Column]) -> Column:
    """First member per key, in order. Sort based, so long lists stay O(n log n)."""
    keyed = F.array_sort(
        F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    )

    def firsts(s: Column) -> Column:
        kept = F.filter(s, lambda e, j: (j == 0) | (e["k"] != F.get(s, j - 1)["k"]))
        return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])

    return let(keyed, firsts)


def distinct_ci(items: Column) -> Column:
    """Case-insensitive first-wins distinct."""
    return distinct_first(items, F.lower)


def top_n(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


@dataclass(frozen=True)
class KeywordRules:
    technical_terms: tuple[str, ...]
    brand_names: tuple[str, ...]
    filler_words: tuple[str, ...]


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def _nfkd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def nfc(c: Column) -> Column:
    """Compose; only values that hold combining marks are sent to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"\p{M}"), c)), c)


def nfkd(c: Column) -> Column:
    """Compatibility decomposition; only non-ASCII values are sent to Python."""
    return F.coalesce(_nfkd(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def norm_name(c: Column) -> Column:
    """Landmark name as a key: letters and digits separated by single blanks."""
    return F.trim(F.regexp_replace(nfkd(F.lower(c)), r"[^\p{L}\p{N}]+", " "))


def clean_keywords(items: Column, rules: KeywordRules, limit: int) -> Column:
    """Compose, lower-case, strip odd characters, drop technical terms, brands and numbers, dedupe plurals."""
    banned = {w.lower() for w in (*rules.technical_terms, *rules.brand_names)}
    brands, number = _word_pattern(list(rules.brand_names)), r"[0-9]+(?:(?:\.[0-9]+)?\s*(?:k|p|fps|mbps|bit))?"

    def steps():
        brand = re.compile(rf"(?<![A-Za-z0-9_])(?:{brands})(?![A-Za-z0-9_])", re.IGNORECASE | re.ASCII)
        unit, odd = re.compile(number, re.ASCII), re.compile(r"[^\w'\-]|_")

        @_remembered
        def tidy(raw: str) -> tuple[tuple[str, str], ...]:
            # Everything but letters, digits, ' and - is a blank by now, other whitespace too.
            clean = " ".join(odd.sub(" ", unicodedata.normalize("NFC", raw).lower()).strip(" '-").split())
            out = not clean or clean in banned or unit.fullmatch(clean) or (brands and brand.search(clean))
            return () if out else ((norm_key(clean), clean),)

        return lambda words: _first_distinct(words, tidy, limit)

    return _listed(steps)(items)


def _flat(k: str) -> str:
    """A keyword without separators of a CSV field."""
    return k if k.isascii() and k.isalnum() else _collapsed(re.sub('[,;"]+', " ", k))


def _csv_keywords(limit: int | None, step: Callable[[str], str]) -> Callable[[], Callable[[Iterable[str]], list[str]]]:
    def steps():
        @_remembered
        def tidy(raw: str) -> tuple[tuple[str, str], ...]:
            k = _flat(step(raw))
            return ((k.lower(), k),) if k else ()

        return lambda words: _first_distinct(words, tidy, limit)

    return steps


def csv_keywords(items: Column, limit: int | None = None, step: Callable[[str], str] = str) -> Column:
    """Separators inside a keyword become blanks; empty and repeated keywords go.

    With ``limit`` only the first so many are returned. ``step`` is applied to every keyword before.
    """
    return _listed(_csv_keywords(limit, step))(items)


def csv_keywords_step(items: str, limit: int | None = None) -> Step:
    """``csv_keywords`` as a step."""
    return Step((items,), "array<string>", lambda: _unless_null(_csv_keywords(limit, str)()))


def issue(level: str, message: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), message.alias("message"))


def limit_keywords(clean: Column, raw_count: Column, low: int, high: int) -> Column:
    """struct(out, issues) of a cleaned list: warns with the raw count when cut, errors below the minimum."""
    text = lambda n: n.cast("string")

    def checked(clean: Column) -> Column:
        kept = F.size(clean)
        used = F.least(kept, F.lit(high))
        issues = compact(
            [
                F.when(
                    kept > high,
                    issue("warning", F.concat(text(raw_count), F.lit(f" keywords, only the first {high} are used"))),
                ),
                F.when(
                    used < low,
                    issue("error", F.concat(text(used), F.lit(f" keywords, at least {low} are required"))),
                ),
            ]
        )
        return F.struct(F.slice(clean, 1, high).alias("out"), issues.alias("issues"))

    return let(clean, checked)


@dataclass(frozen=True)
class TagRules:
    """Budget of a comma separated tag field."""

    max: int
    max_length: int
    field_max: int
    split_multiword: bool = False


def _envato_keywords(rules: TagRules) -> Callable[[], Callable[[Iterable[str]], list[str]]]:
    def steps():
        odd, number = re.compile("[^A-Za-z0-9. ]+"), re.compile("[0-9.]+")

        @_remembered
        def tidy(raw: str) -> tuple[tuple[str, str], ...]:
            k = _transliterated(raw)
            if not (k.isascii() and k.isalnum()):
                k = " ".join(odd.sub(" ", k).split()).lstrip(".")
            parts = k.split(" ") if rules.split_multiword else [k]
            short = (p.strip(" ").lstrip(".")[: rules.max_length].strip(" ") for p in parts)
            return tuple((p.lower(), p) for p in short if p and not number.fullmatch(p))

        def within(words: Iterable[str]) -> list[str]:
            used, out = 0, []
            for k in _first_distinct(words, tidy, rules.max):
                used += len(k) + (1 if out else 0)
                if used > rules.field_max:
                    break
                out.append(k)
            return out

        return within

    return steps


def envato_keywords(items: Column, rules: TagRules) -> Column:
    """ASCII tags within a count and a total length budget; the list ends at the first overflow."""
    return _listed(_envato_keywords(rules))(items)


def envato_keywords_step(items: str, rules: TagRules) -> Step:
    """``envato_keywords`` as a step."""
    return Step((items,), "array<string>", lambda: _unless_null(_envato_keywords(rules)()))


# Readable replacements of forbidden characters.
READABLE = {"&": " and ", "%": " percent", "@": " at ", "/": " ", "\\": " "}


def _pond5_step(forbidden: str) -> Callable[[str], str]:
    readable = {ch: words for ch, words in READABLE.items() if ch in forbidden}
    unprintable = re.compile(r"[^\x20-\x7e]+")

    def step(s: str) -> str:
        if s.isascii() and s.isalnum() and not any(ch in s for ch in forbidden):
            return s
        for ch, words in readable.items():
            s = s.replace(ch, words)
        s = _transliterated(s)
        for ch in forbidden:
            s = s.replace(ch, "")
        if s.isascii() and s.isalnum():
            return s
        for ch in "\n\t":
            s = s.replace(ch, " ")
        if not (s.isascii() and s.isprintable()):
            s = unprintable.sub(" ", s)
        spaced = " ".join(s.split())
        for mark in ",.;:!":
            spaced = spaced.replace(f" {mark}", mark)
        return spaced

    return step


def pond5_sanitize(c: Column, forbidden: str) -> Column:
    """Transliterate, replace or strip forbidden characters, printable ASCII only."""
    return _mapped(_pond5_step(forbidden))(c)


def pond5_sanitized(s: str | None, forbidden: str) -> str:
    """``pond5_sanitize`` of one value; null is the empty text."""
    return _pond5_step(forbidden)(s or "")


def pond5_sanitize_step(text: str, forbidden: str) -> Step:
    """``pond5_sanitize`` as a step; null is the empty text."""

    def build():
        clean = _pond5_step(forbidden)
        return lambda s: clean(s or "")

    return Step((text,), "string", build)


def pond5_keywords(items: Column, forbidden: str, limit: int | None = None) -> Column:
    """``csv_keywords`` of the sanitized items."""
    return csv_keywords(items, limit, _pond5_step(forbidden))


def pond5_keywords_step(items: str, forbidden: str, limit: int | None = None) -> Step:
    """``pond5_keywords`` as a step."""
    return Step((items,), "array<string>", lambda: _unless_null(_csv_keywords(limit, _pond5_step(forbidden))()))


def _cut(mode: str) -> Callable[[str, int], str]:
    return _cut_at_sentence if mode == "sentence" else _cut_at_word


def fit(c: Column, limit: int, field: str, mode: str = "word", plain: bool = False) -> Column:
    """struct(value, issue): collapsed text within the limit, with a warning when it was cut.

    ``plain`` texts are collapsed already.
    """
    cut = _cut(mode)

    @F.arrow_udf("value string, n int")
    def batch(values: pa.Array) -> pa.Array:
        texts = [v if plain or v is None else _collapsed(v) for v in _values(values)]
        out = pa.array([None if t is None else cut(t, limit) for t in texts], pa.string())
        return pa.StructArray.from_arrays(
            [out, pa.array([None if t is None else len(t) for t in texts], pa.int32())], ["value", "n"]
        )

    return let(batch(c), lambda t: fitted(t, limit, field))


def fitted(t: Column, limit: int, field: str) -> Column:
    """struct(value, issue) of struct(value, n), the cut text and the length it had."""
    message = F.concat(F.lit(f"{field} shortened from "), t["n"].cast("string"), F.lit(f" to {limit} characters"))
    return F.struct(t["value"].alias("value"), F.when(t["n"] > limit, issue("warning", message)).alias("issue"))


def fit_step(reads: Sequence[str], limit: int, mode: str = "word", text: Callable[..., str | None] | None = None) -> Step:
    """struct(value, n) for ``fitted`` as a step: of the one text read, which is collapsed already, or of ``text`` of what
    is read, collapsed here."""
    cut = _cut(mode)

    def step(*values: str | None) -> dict:
        t = values[0] if text is None else _unless_null(_collapsed)(text(*values))
        return {"value": None, "n": None} if t is None else {"value": cut(t, limit), "n": len(t)}

    return Step(tuple(reads), "struct<value:string,n:int>", lambda: step)


def split_tags(typed: Column, existing: Column) -> Column:
    """New tags of a typed list: comma separated, lower-case, without known ones."""
    words = F.filter(F.transform(F.split(typed, ","), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.transform(existing, F.lower))
