"""Rounding, clamping and single-evaluation helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(v: Column | float | int) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def half_up(c: Column) -> Column:
    """Nearest integer with ties towards +inf, as bigint (Spark's round() goes away from zero)."""
    return F.floor(c + F.lit(0.5))


def round_half_up(c: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)) / scale


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive expression once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compact(items: list[Column]) -> Column:
    """Array of the non-null members, in order: the shape of every issue list."""
    return F.array_compact(F.array(*items))


def case(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    head, *rest = pairs
    out = F.when(*head)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def string_array(values: list[str]) -> Column:
    """Literal array<string>, also when empty."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
