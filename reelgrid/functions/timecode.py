"""Frame grid, time codes and human readable sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import case, half_up, let


def snap_to_frame(sec: Column, fps: Column) -> Column:
    return half_up(sec * fps) / fps


def sec_to_frame(sec: Column, fps: Column) -> Column:
    return half_up(sec * fps)


def _two(c: Column) -> Column:
    return F.when(c >= 100, c.cast("string")).otherwise(F.lpad(c.cast("string"), 2, "0"))


def format_short_time(sec: Column) -> Column:
    """mm:ss, rounded to the second."""
    return let(
        F.greatest(F.lit(0).cast("bigint"), half_up(sec)),
        lambda s: F.concat(_two(F.floor(s / 60)), F.lit(":"), _two(s % 60)),
    )


def format_timecode(sec: Column) -> Column:
    """mm:ss.cc, with hours in front when there are any."""

    def text(s: Column) -> Column:
        h = F.floor(s / 3600)
        base = F.concat(
            _two(F.floor((s % 3600) / 60)), F.lit(":"), _two(F.floor(s % 60)), F.lit("."), _two(F.floor((s * 100) % 100))
        )
        return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), base)).otherwise(base)

    return let(F.greatest(F.lit(0.0), sec), text)


def parse_timecode(text: Column) -> Column:
    """[[h:]mm:]ss[.fff] to seconds; null when malformed."""
    parts = F.split(F.trim(text), ":")
    valid = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.rlike(r"^[0-9]+(\.[0-9]+)?$"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + F.coalesce(p.try_cast("double"), F.lit(0.0)))
    return F.when(valid, total)


def format_bytes(size: Column, ties_to_even: bool = False) -> Column:
    """Size in the largest unit, with one digit below 100.

    Exact ties go up, or to the even digit as in C's printf.
    """
    units = ["B", "KB", "MB", "GB", "TB"]
    near = (lambda v, digits: F.bround(v, digits)) if ties_to_even else (lambda v, digits: v)

    def show(power: int) -> Column:
        v = size.cast("double") / float(1024**power)
        whole = F.format_string("%.0f", near(v, 0))
        text = whole if power == 0 else F.when(v >= 100, whole).otherwise(F.format_string("%.1f", near(v, 1)))
        return F.concat(text, F.lit(f" {units[power]}"))

    return case([(size < 1024 ** (p + 1), show(p)) for p in range(4)], show(4))


def format_duration(sec: Column) -> Column:
    """m:ss or h:mm:ss."""

    def text(s: Column) -> Column:
        h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
        return F.when(
            h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(r))
        ).otherwise(F.concat(m.cast("string"), F.lit(":"), _two(r)))

    return let(half_up(sec), text)
