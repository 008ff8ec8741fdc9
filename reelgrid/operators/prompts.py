"""Prompt dataset: a factual context block per clip and the rendered system and user texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.motion import PROMPT_PHRASES
from ..functions.numeric import compact, half_up, literal_map
from ..sources.rules import PlatformRules

# Wording of the context lines.
SHOT_PHRASES = {
    "real_time": "real time",
    "slow_motion": "slow motion",
    "high_frame_rate": "real time (high frame rate source)",
    "timelapse": "timelapse",
    "hyperlapse": "hyperlapse",
}
LIGHT_PHRASES = {
    "sunrise": "sunrise",
    "golden_hour": "golden hour",
    "day": "daytime",
    "sunset": "sunset",
    "blue_hour": "blue hour (twilight)",
    "night": "night",
}
SOURCE_PHRASES = {
    "embedded": "GPS from the video file",
    "manual": "location entered by the user",
    "none": "none",
}

DEFAULT_SYSTEM = """You describe aerial stock clips for four stock sites.
Use only what the frames show and what the context confirms.
Title: at most {{titleMax}} characters. Description: at most {{descriptionMax}} characters.
Keywords: {{keywordsMin}} to {{keywordsMax}}, lower-case English, most important first.

Categories:
{{categories}}

Answer with one JSON document."""
DEFAULT_USER = """Clip context:
{{context}}
{{hint}}
Write the metadata for this clip."""


def _line(*parts: Column | str) -> Column:
    """A line that disappears when any part is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(c: Column) -> Column:
    return half_up(c).cast("string")


def describe_context(geo: Column, tech: Column) -> Column:
    """Lines about place, landmarks, movement, light and date. Unknown places forbid naming any."""
    full = lambda n: F.when(F.length(geo[n]) > 0, geo[n])
    place = F.concat_ws(", ", full("city"), full("region"), full("country"))
    located = geo.isNotNull() & (F.length(place) > 0)
    landmarks = geo["poi_candidates"]
    some = F.size(landmarks) > 0

    def landmark(p: Column) -> Column:
        view = F.when(p["in_camera_sector"].isNull(), "unknown").when(p["in_camera_sector"], "yes").otherwise("no")
        local = F.when(p["name"] != p["name_en"], F.concat(F.lit(" / "), p["name"])).otherwise("")
        return F.concat(
            F.lit("- "), p["name_en"], local, F.lit(" ("), p["type"], F.lit("), "), p["distance_m"].cast("string"),
            F.lit(" m away, bearing "), _text(p["bearing_deg"]), F.lit("°, in view: "), view,
        )

    known = F.concat(
        compact(
            [
                _line("Location: ", place, " (source: ", literal_map(SOURCE_PHRASES)[geo["source"]], ")."),
                _line("Local name: ", full("local_name"), "."),
                _line("Full address: ", full("display_name"), "."),
                F.when(
                    geo["lat"].isNotNull() & geo["lon"].isNotNull(),
                    F.format_string("Coordinates: %.5f, %.5f.", geo["lat"], geo["lon"]),
                ),
                _line("Estimated camera heading (from the flight direction): ", _text(geo["camera_heading_deg"]), "°."),
                F.when(
                    some,
                    'Nearby landmark candidates (closest first; "in view" = inside the camera field of view):',
                ).otherwise("Nearby landmark candidates: none found."),
            ]
        ),
        F.transform(F.coalesce(landmarks, F.array().cast("array<struct<name:string,name_en:string,type:string,distance_m:bigint,bearing_deg:double,in_camera_sector:boolean,wikidata_id:string>>")), landmark),
    )
    typed = F.array(
        _line(
            "Location (typed by the user, could not be verified): ",
            full("manual_text"),
            '. Use it only at region/country level and set placeConfidence to "low".',
        )
    )
    unknown = F.array(
        F.lit(
            "Location: UNKNOWN. Do not guess or name any place, city or country; use generic terms and set "
            'placeConfidence to "unknown".'
        )
    )
    where = F.when(located, known).when(full("manual_text").isNotNull(), typed).otherwise(unknown)
    altitude = F.coalesce(tech["altitude_m"], geo["altitude_m"])
    rest = compact(
        [
            _line("GPS altitude: ", _text(altitude), " m above sea level."),
            _line("Camera movement: ", literal_map(PROMPT_PHRASES)[tech["motion_type"]], " (", F.array_join(tech["movement"], ", "), ")."),
            _line("Shot type: ", literal_map(SHOT_PHRASES)[tech["shot_type"]], "."),
            _line("Time of day: ", literal_map(LIGHT_PHRASES)[tech["time_of_day"]], "."),
            _line("Season: ", tech["season"], "."),
            _line("Capture date: ", tech["capture_date"], "."),
            _line("Clip duration: ", _text(tech["duration_sec"]), " s."),
        ]
    )
    return F.array_join(F.concat(where, rest), "\n")


def describe_hint(hint: Column, poi_name: Column) -> Column:
    full = lambda c: F.when(F.length(c) > 0, c)
    lines = compact(
        [
            _line(
                "The user confirmed that the main subject is: ",
                full(poi_name),
                '. Name it in the title and keywords and set placeConfidence to "high".',
            ),
            _line("User hint (treat as reliable): ", full(hint)),
        ]
    )
    return F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def format_categories(rules: PlatformRules) -> str:
    return "\n".join(
        [
            "Adobe Stock (adobeCategory, number): "
            + "; ".join(f"{c['id']} = {c['label']}" for c in rules.adobe["categories"]),
            "Shutterstock (shutterstockCategories, 1–2 values): " + "; ".join(rules.shutterstock["categories"]),
            "Envato (envatoCategory, one value): " + "; ".join(rules.envato["categories"]),
        ]
    )


def _render(template: str, fixed: dict[str, str], columns: dict[str, Column]) -> Column:
    """Fill {{name}} placeholders; unknown ones stay."""
    parts = []
    for token in re.split(r"(\{\{\w+\}\})", template):
        name = token[2:-2] if token.startswith("{{") else None
        if name in columns:
            parts.append(columns[name])
        elif token:
            parts.append(F.lit(fixed.get(name, token) if name else token))
    return F.concat(*parts)


def render_prompts(
    clips: DataFrame, rules: PlatformRules, system: str = DEFAULT_SYSTEM, user: str = DEFAULT_USER
) -> DataFrame:
    """clip_id, system_text, user_text for any batch scorer. ``clips``: geo, tech, user_hint, poi_override."""
    fixed = {k: str(v) for k, v in rules.common["llm"].items()} | {"categories": format_categories(rules)}
    columns = {"context": F.col("_context"), "hint": F.col("_hint")}
    rows = clips.withColumns(
        {
            "_context": describe_context(F.col("geo"), F.col("tech")),
            "_hint": describe_hint(F.col("user_hint"), F.col("poi_override")),
        }
    )
    return rows.select(
        "clip_id",
        _render(system, fixed, columns).alias("system_text"),
        _render(user, fixed, columns).alias("user_text"),
    )
