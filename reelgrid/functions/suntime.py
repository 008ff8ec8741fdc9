"""Capture time, light condition and season."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up, let

FILENAME_TIME = r"(?:^|\D)(20\d{2})(\d{2})(\d{2})[_-]?(\d{2})(\d{2})(\d{2})(?!\d)"
WALL_CLOCK = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})"


def _wall(parts: list[Column]) -> Column:
    """Timestamp of clock parts; days and months beyond the calendar roll over."""
    y, mo, d, h, mi, s = parts
    first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1)
    days = F.unix_date(first) + (d - 1)
    return F.timestamp_seconds(days.cast("bigint") * 86400 + h * 3600 + mi * 60 + s)


def _parts(text: Column, pattern: str) -> Column:
    """array<int> of the six clock groups, null when the pattern does not occur."""
    groups = F.array(*[F.regexp_extract(text, pattern, k).try_cast("int") for k in range(1, 7)])
    return F.when(text.rlike(pattern), groups)


def _clock(parts: Column) -> Column:
    return _wall([parts[k] for k in range(6)])


def filename_wall_clock(filename: Column) -> Column:
    """Local clock time in a camera file name, as a zone-less instant."""

    def read(p: Column) -> Column:
        ok = p[1].between(1, 12) & p[2].between(1, 31) & (p[3] <= 23) & (p[4] <= 59) & (p[5] <= 59)
        return F.when(ok, _clock(p))

    return let(_parts(filename, FILENAME_TIME), read)


def resolve_capture_time(
    creation_time: Column, mode: str, make: Column, tz: Column, filename: Column
) -> Column:
    """struct(utc, local_date, local_month).

    auto: a clock time in the file name wins; then makes that label local time as UTC; then real UTC.
    ``tz`` is the zone at the position, null when unknown. Clocks before 2000 were never set.
    """
    nothing = F.lit(None)

    def result(utc: Column, local: Column, month: Column | None = None) -> Column:
        return F.struct(
            utc.cast("timestamp").alias("utc"),
            local.cast("date").alias("local_date"),
            (month if month is not None else F.month(local)).cast("int").alias("local_month"),
        )

    none = result(nothing, nothing, nothing)
    zoned = creation_time.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local_label = F.lit(mode == "local") | (
        F.lit(mode == "auto") & F.coalesce(make.rlike("(?i)dji"), F.lit(False))
    )

    def from_tag(f: Column) -> Column:
        parts, tagged, wall = f["parts"], f["tagged"], f["wall"]
        shifted = F.when(tz.isNotNull(), F.from_utc_timestamp(tagged, tz)).otherwise(tagged)
        return (
            F.when(~F.coalesce(parts[0] >= 2000, F.lit(False)), none)
            .when(local_label, result(F.when(tz.isNotNull(), F.to_utc_timestamp(wall, tz)), wall, parts[1]))
            .when(tagged.isNull(), none)
            .otherwise(result(tagged, shifted))
        )

    def resolved(f: Column) -> Column:
        if mode != "auto":
            return from_tag(f)
        named = f["named"]
        utc = F.when(tz.isNotNull(), F.to_utc_timestamp(named, tz)).when(zoned, f["tagged"])
        return F.when(named.isNotNull(), result(utc, named)).otherwise(from_tag(f))

    def facts(parts: Column) -> Column:
        return F.struct(
            parts.alias("parts"),
            F.try_to_timestamp(creation_time).alias("tagged"),
            _clock(parts).alias("wall"),
            filename_wall_clock(filename).alias("named"),
        )

    return let(let(_parts(creation_time, WALL_CLOCK), facts), resolved)


def _sun(days: Column) -> tuple[Column, Column, Column]:
    """(mean anomaly, ecliptic longitude, declination) for days since J2000; low-precision series."""
    m = F.radians(days * 0.98560028 + 357.5291)
    centre = F.radians(F.sin(m) * 1.9148 + F.sin(m * 2) * 0.02 + F.sin(m * 3) * 0.0003)
    longitude = m + centre + math.radians(102.9372) + math.pi
    declination = F.asin(F.sin(longitude) * math.sin(math.radians(23.4397)))
    return m, longitude, declination


def _days(instant: Column) -> Column:
    return F.unix_micros(instant) / 86_400e6 - 10957.5


def sun_altitude_deg(instant: Column, lat: Column, lon: Column) -> Column:
    """Apparent altitude of the sun: geometric altitude plus refraction."""
    d = _days(instant)
    _, longitude, declination = _sun(d)
    tilt = math.radians(23.4397)
    ascension = F.atan2(F.sin(longitude) * math.cos(tilt), F.cos(longitude))
    hour = F.radians(d * 360.9856235 + 280.16 + lon) - ascension
    phi = F.radians(lat)
    h = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    raised = F.greatest(F.lit(0.0), h)
    refraction = F.lit(0.0002967) / F.tan(raised + F.lit(0.00312536) / (raised + 0.08901179))
    return F.degrees(h + refraction)


def is_before_solar_noon(instant: Column, lon: Column) -> Column:
    d = _days(instant)
    west = -lon / 360
    cycle = half_up(d - 0.0009 - west)
    approx = cycle + west + 0.0009
    m, longitude, _ = _sun(approx)
    return d < approx + F.sin(m) * 0.0053 - F.sin(longitude * 2) * 0.0069


def time_of_day(instant: Column, lat: Column, lon: Column) -> Column:
    def bands(h: Column) -> Column:
        return (
            F.when(h < -6, "night")
            .when(h < -0.833, "blue_hour")
            .when(h < 2, F.when(is_before_solar_noon(instant, lon), "sunrise").otherwise("sunset"))
            .when(h < 6, "golden_hour")
            .otherwise("day")
        )

    known = instant.isNotNull() & lat.isNotNull() & lon.isNotNull()
    return F.when(known, let(sun_altitude_deg(instant, lat, lon), bands))


def season(month: Column, lat: Column) -> Column:
    """Meteorological season of a local month, flipped south of the equator."""
    quarter = F.pmod(F.floor(month % 12 / 3) + F.when(lat < 0, 2).otherwise(0), F.lit(4))
    names = F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")])
    return F.get(names, quarter.cast("int"))
