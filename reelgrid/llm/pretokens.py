"""Pre-tokens of the public tokenizers, cut the way their files declare it."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import regex

# The pre-token patterns that the tokenizer files declare, and the same for texts whose
# characters all lie below U+0250, where the classes are short enough to spell out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_SIMPLE = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_WORD_SIMPLE = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"
_HIGH = re.compile("[^\x00-\u024f]")
_BYTE_FULL = regex.compile(BYTE_LEVEL.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_BYTE, _WORD = re.compile(_BYTE_SIMPLE), re.compile(_WORD_SIMPLE)


def is_simple(text: str) -> bool:
    """All characters lie below U+0250."""
    return text.isascii() or not _HIGH.search(text)


def byte_level(text: str) -> list[str]:
    """Pre-tokens of the byte-level tokenizer."""
    return (_BYTE if is_simple(text) else _BYTE_FULL).findall(text)


def word_level(text: str) -> list[str]:
    """Pre-tokens of the word-end tokenizer, for lower-cased simple texts."""
    return _WORD.findall(text)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per worker process, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())
