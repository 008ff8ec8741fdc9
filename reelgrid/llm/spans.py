"""Spans found in texts: order, digest and the text form kind:start:end."""

from __future__ import annotations

import bisect
import hashlib
import math

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(spans: list[Span], kinds: list[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that lie within no taken span of their kind and overlap no earlier one of their kind in the list."""
    ends: dict[str, list[tuple[int, int]]] = {}  # per kind: starts, and the furthest end so far
    for kind, start, end in sorted(taken, key=lambda x: x[1]):
        known = ends.setdefault(kind, [])
        known.append((start, max(end, known[-1][1] if known else 0)))
    out: list[Span] = []
    last: dict[str, int] = {}  # per kind: end of its last span
    for span in sorted(spans, key=lambda x: (x[1], -x[2])):
        known = ends.get(span[0], [])
        at = bisect.bisect_right(known, (span[1], math.inf)) - 1
        if not (at >= 0 and known[at][1] >= span[2]) and span[1] >= last.get(span[0], 0):
            out.append(span)
            last[span[0]] = span[2]
    return out
