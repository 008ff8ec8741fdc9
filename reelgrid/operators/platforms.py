"""One clip -> one row per stock platform, with typed issues.

The clip view (``csv_clip_view``) has the columns filename, title, description, keywords,
adobe_category, shutterstock_categories, envato_category, recognizable_buildings, editorial, city,
region, country, duration_sec, shot_type, movement, capture_date, drone_model, output_size_bytes.
Every builder adds ``row`` (array aligned with the header) and ``issues``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ExportSettings
from ..functions import text as T
from ..functions.numeric import compact, literal_map, string_array
from ..functions.text import issue
from ..sources.rules import PLATFORM_ORDER, PlatformRules, load_platform_rules


@dataclass(frozen=True)
class DeliveryContext:
    settings: ExportSettings = field(default_factory=ExportSettings)
    export_date: date = date(2024, 1, 1)
    rules: PlatformRules = field(default_factory=load_platform_rules)


def csv_clip_view(clips: DataFrame) -> DataFrame:
    """Delivered clips: resolved editorial flag; only clips with metadata and technical context."""
    return clips.where(F.col("title").isNotNull() & F.col("duration_sec").isNotNull()).withColumns(
        {
            "editorial": F.coalesce("editorial", "editorial_suggested"),
            "filename": F.coalesce("filename", F.lit("pending.mov")),
        }
    )


def plain_number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def _gb(n: Column) -> Column:
    return F.format_string("%.2f", n / float(1024**3))


def media_issues(limits: dict) -> Column:
    """Duration and file size against the platform limits."""
    d, size = F.col("duration_sec"), F.col("output_size_bytes")
    lo, hi, cap = limits["minDurationSec"], limits["maxDurationSec"], limits["maxFileSizeBytes"]
    long_text = lambda word, n: F.format_string(f"Clip is %.1f s, the {word} is {plain_number(n)} s", d)
    cap_text = f"{cap / 1024**3:.2f}"
    return compact(
        [
            F.when(d < lo, issue("error", long_text("minimum", lo))).when(
                d > hi, issue("error", long_text("maximum", hi))
            ),
            F.when(
                size > cap,
                issue("error", F.concat(F.lit("File is "), _gb(size), F.lit(f" GB, the limit is {cap_text} GB"))),
            ),
        ]
    )


def _finish(df: DataFrame, row: list[Column], issues: list[Column], header: list[str]) -> DataFrame:
    if len(row) != len(header):
        raise ValueError(f"row has {len(row)} columns, header has {len(header)}")
    cells = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in row])
    helpers = [c for c in df.columns if c.startswith("_")]
    return df.withColumns({"row": cells, "issues": F.concat(*issues)}).drop(*helpers)


def _one(c: Column) -> Column:
    """An optional issue as a list."""
    return F.array_compact(F.array(c))


#: What the rows say with whole texts and keyword lists: one struct for all platforms that are built together.
_TEXTS = "platform texts"


def _csv_list(ctx: DeliveryContext) -> dict[str, T.Step]:
    """Keywords safe for a comma separated field, for the platforms that share them.

    The list ends one keyword after the largest number a platform takes, which is enough to see that there are more.
    """
    most = max(rules["limits"]["keywordsMax"] for rules in (ctx.rules.adobe, ctx.rules.shutterstock))
    return {"csv_list": T.csv_keywords_step("keywords", most + 1)}


def _adobe_texts(ctx: DeliveryContext) -> dict[str, T.Step]:
    return {
        "_plain_title": T.collapse_step("title"),
        "adobe_title": T.fit_step(["_plain_title"], ctx.rules.adobe["limits"]["titleMax"]),
    } | _csv_list(ctx)


def _shutterstock_texts(ctx: DeliveryContext) -> dict[str, T.Step]:
    limit = ctx.rules.shutterstock["limits"]["descriptionMax"]
    both = lambda title, description: shutterstock_description(title, description, limit)
    return {
        "_plain_title": T.collapse_step("title"),
        "plain_description": T.collapse_step("description"),
        "_shutterstock_text": T.Step(("_plain_title", "plain_description"), "string", lambda: both),
        "shutterstock_desc": T.fit_step(["_shutterstock_text"], limit),
    } | _csv_list(ctx)


def _pond5_texts(ctx: DeliveryContext) -> dict[str, T.Step]:
    lim, forbidden = ctx.rules.pond5["limits"], ctx.rules.pond5["forbiddenCharacters"]
    joined = lambda prefix, text: prefix + text
    return {
        **{f"pond5_{c}": T.pond5_sanitize_step(c, forbidden) for c in ("city", "region", "country", "drone_model")},
        "_pond5_title": T.pond5_sanitize_step("title", forbidden),
        "_pond5_description": T.pond5_sanitize_step("description", forbidden),
        "_prefix": T.Step(("editorial_day", "city", "pond5_city", "country", "pond5_country"), "string", lambda: editorial_prefix),
        "pond5_title": T.fit_step(["_prefix", "_pond5_title"], lim["titleMax"], text=joined),
        "pond5_desc": T.fit_step(["_prefix", "_pond5_description"], lim["descriptionMax"], "sentence", joined),
        # One keyword beyond the limit is enough to see that there are more; the raw number feeds the warning.
        "pond5_list": T.pond5_keywords_step("keywords", forbidden, lim["keywordsMax"] + 1),
    }


def _envato_texts(ctx: DeliveryContext) -> dict[str, T.Step]:
    return {
        "_plain_title": T.collapse_step("title"),
        "plain_description": T.collapse_step("description"),
        "envato_title": T.fit_step(["_plain_title"], ctx.rules.envato["limits"]["titleMax"]),
        "envato_list": T.envato_keywords_step("keywords", ctx.rules.tag_rules),
    }


_PLATFORM_TEXTS = {
    "adobe": _adobe_texts, "shutterstock": _shutterstock_texts, "pond5": _pond5_texts, "envato": _envato_texts
}


def _with_texts(clips: DataFrame, ctx: DeliveryContext, *platforms: str) -> DataFrame:
    """The texts of the platforms as one struct, unless they are there; one pass in Python, whatever their number.

    Every Python function of its own takes a worker per task and lets whole clips travel and wait once more.
    """
    steps: dict[str, T.Step] = {}
    for p in platforms:
        steps |= _PLATFORM_TEXTS.get(p, lambda ctx: {})(ctx)
    there = clips.schema[_TEXTS].dataType.names if _TEXTS in clips.columns else []
    if {n for n in steps if not n.startswith("_")} <= set(there):
        return clips
    columns = {c: F.col(c) for c in dict.fromkeys(r for step in steps.values() for r in step.reads) if c in clips.columns}
    if any("editorial_day" in step.reads for step in steps.values()):
        columns["editorial_day"] = F.when(F.col("editorial"), _day(ctx, "y", "m", "d"))
    return clips.withColumn(_TEXTS, T.tidied(columns, steps))


def _text(name: str) -> Column:
    return F.col(f"`{_TEXTS}`.`{name}`")


def adobe_rows(clips: DataFrame, ctx: DeliveryContext) -> DataFrame:
    cfg = ctx.rules.adobe
    lim = cfg["limits"]
    df = _with_texts(clips, ctx, "adobe").withColumns(
        {
            "_title": T.fitted(_text("adobe_title"), lim["titleMax"], "Title"),
            "_kw": T.limit_keywords(_text("csv_list"), F.size("keywords"), lim["keywordsMin"], lim["keywordsMax"]),
        }
    )
    category = F.col("adobe_category")
    issues = [
        media_issues(lim),
        _one(F.col("_title.issue")),
        F.col("_kw.issues"),
        compact(
            [
                F.when(
                    ~category.isin(*[c["id"] for c in cfg["categories"]]),
                    issue("error", F.concat(F.lit("Unknown Adobe category "), category.cast("string"))),
                ),
                F.when(
                    F.col("editorial"),
                    issue(
                        "warning",
                        F.lit(
                            "Marked editorial: Adobe Stock video editorial content is limited, check the submission rules"
                        ),
                    ),
                ),
            ]
        ),
    ]
    row = [F.col("filename"), F.col("_title.value"), F.array_join("_kw.out", ", "), category, F.lit("")]
    return _finish(df, row, issues, cfg["header"])


def shutterstock_description(title: str | None, description: str | None, limit: int) -> str | None:
    """Title and description (collapsed) in one field when both fit, otherwise the title."""
    if title is None:
        return None
    head = title.rstrip(". ")
    both = None if description is None else f"{head}. {description}"
    return both if both is not None and len(both) <= limit else head


def shutterstock_rows(clips: DataFrame, ctx: DeliveryContext) -> DataFrame:
    cfg = ctx.rules.shutterstock
    lim = cfg["limits"]
    allowed = string_array(cfg["categories"])
    limit = lim["descriptionMax"]
    df = _with_texts(clips, ctx, "shutterstock").withColumns(
        {
            "_desc": T.fitted(_text("shutterstock_desc"), limit, "Description"),
            "_kw": T.limit_keywords(_text("csv_list"), F.size("keywords"), lim["keywordsMin"], lim["keywordsMax"]),
            "_cat": F.slice(F.filter("shutterstock_categories", lambda c: F.array_contains(allowed, c)), 1, 2),
        }
    )
    wrong = (F.size("_cat") != F.size("shutterstock_categories")) | (F.size("_cat") == 0)
    issues = [
        media_issues(lim),
        _one(F.col("_desc.issue")),
        F.col("_kw.issues"),
        _one(
            F.when(
                wrong,
                issue("error", F.lit("Shutterstock categories must be 1–2 values from the official list")),
            )
        ),
    ]
    row = [
        F.col("filename"),
        F.col("_desc.value"),
        F.array_join("_kw.out", ","),
        F.array_join("_cat", ","),
        F.when(F.col("editorial"), "Yes").otherwise("No"),
    ]
    return _finish(df, row, issues, cfg["header"])


def _capture_part(group: int, fallback: str) -> Column:
    pattern = r"^(\d{4})-(\d{2})-(\d{2})$"
    found = F.regexp_extract(F.col("capture_date"), pattern, group)
    return F.when(F.col("capture_date").rlike(pattern), found).otherwise(F.lit(fallback))


def _day(ctx: DeliveryContext, *parts: str) -> Column:
    """Year (y), month (m) and day (d) of the capture date, or of the export date when that is unknown."""
    d = ctx.export_date
    known = {"y": (1, f"{d:%Y}"), "m": (2, f"{d:%m}"), "d": (3, f"{d:%d}")}
    return F.concat_ws("/", *(_capture_part(*known[p]) for p in parts))


def editorial_prefix(day: str | None, city: str | None, clean_city: str, country: str | None, clean_country: str) -> str:
    """"City, Country yyyy/mm/dd: " with the cleaned names of a known place; nothing without a day, if not editorial."""
    place = ", ".join(clean for raw, clean in ((city, clean_city), (country, clean_country)) if raw)
    return "" if day is None else f"{place} {day}: " if place else f"{day}: "


def pond5_rows(clips: DataFrame, ctx: DeliveryContext) -> DataFrame:
    cfg = ctx.rules.pond5
    lim, forbidden, s = cfg["limits"], cfg["forbiddenCharacters"], ctx.settings
    known = F.coalesce(F.col("capture_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    df = _with_texts(clips, ctx, "pond5").withColumns(
        {
            "_title": T.fitted(_text("pond5_title"), lim["titleMax"], "Title"),
            "_desc": T.fitted(_text("pond5_desc"), lim["descriptionMax"], "Description"),
            "_kw": T.limit_keywords(_text("pond5_list"), F.size("keywords"), lim["keywordsMin"], lim["keywordsMax"]),
        }
    )
    issues = [
        media_issues(lim),
        _one(F.col("_title.issue")),
        _one(F.col("_desc.issue")),
        F.col("_kw.issues"),
        _one(
            F.when(
                ~known,
                issue("warning", F.lit("Capture date unknown: the export date is used for datecreated")),
            )
        ),
    ]
    row = [
        F.col("filename"),
        F.col("_title.value"),
        F.col("_desc.value"),
        F.array_join("_kw.out", ","),
        *[_text(f"pond5_{c}") for c in ("city", "region", "country", "drone_model")],
        F.lit("no"),
        F.lit(""),
        F.lit(T.pond5_sanitized(s.copyright, forbidden)),
        F.lit(plain_number(s.pond5_price)),
        F.lit(plain_number(s.pond5_price_large)),
        F.when(F.col("editorial"), "yes").otherwise("no"),
        _day(ctx, "m", "d", "y"),
    ]
    return _finish(df, row, issues, cfg["header"])


def _dollars(x: float) -> str:
    return f"${int(x)}" if float(x).is_integer() else f"${x:.2f}"


def envato_rows(clips: DataFrame, ctx: DeliveryContext) -> DataFrame:
    cfg, s = ctx.rules.envato, ctx.settings
    lim = cfg["limits"]
    df = _with_texts(clips, ctx, "envato").withColumns(
        {"_title": T.fitted(_text("envato_title"), lim["titleMax"], "Title"), "_kw": _text("envato_list")}
    )
    category = F.col("envato_category")
    issues = [
        media_issues(lim),
        _one(F.col("_title.issue")),
        compact(
            [
                F.when(
                    F.size("_kw") < F.least(F.size("keywords"), F.lit(lim["keywordsMax"])),
                    issue("warning", F.lit("Some keywords were dropped by the Envato keyword rules")),
                ),
                F.when(
                    ~category.isin(*cfg["categories"]),
                    issue("error", F.concat(F.lit('Unknown Envato category "'), category, F.lit('"'))),
                ),
            ]
        ),
    ]
    moves = string_array(cfg["movement"])
    row = [
        F.col("filename"),
        F.col("_title.value"),
        _text("plain_description"),
        F.array_join("_kw", ","),
        category,
        F.lit(_dollars(s.envato_price_single)),
        F.lit(_dollars(s.envato_price_multi)),
        F.lit("No"),
        F.when(F.col("recognizable_buildings"), "Yes").otherwise("No"),
        F.lit(""),
        F.lit(""),
        F.lit("Full Color"),
        F.coalesce(literal_map(cfg["pace"])[F.col("shot_type")], F.lit("Real Time")),
        F.array_join(F.filter("movement", lambda m: F.array_contains(moves, m)), ","),
        F.lit("Wide Shot"),
        F.lit("Outdoors"),
        *[F.lit("")] * 7,
    ]
    return _finish(df, row, issues, cfg["header"])


#: Pluggable targets: name -> builder. The order defines the output order.
REGISTRY: dict[str, Callable[[DataFrame, DeliveryContext], DataFrame]] = {
    "adobe": adobe_rows,
    "shutterstock": shutterstock_rows,
    "pond5": pond5_rows,
    "envato": envato_rows,
}


def platform_registry() -> dict[str, Callable[[DataFrame, DeliveryContext], DataFrame]]:
    return dict(REGISTRY)


def validation_level(issues: Column) -> Column:
    return (
        F.when(F.exists(issues, lambda i: i["level"] == "error"), "error")
        .when(F.size(issues) > 0, "warning")
        .otherwise("ok")
    )


def platform_results(clips: DataFrame, ctx: DeliveryContext) -> DataFrame:
    """Every clip with ``results``: one struct (platform, level, messages, row) per enabled platform.

    All platforms are computed in one pass over the clips.
    """
    enabled = [p for p in REGISTRY if p in ctx.settings.enabled_platforms]
    columns = clips.columns
    df = _with_texts(clips, ctx, *enabled)
    names = [f"`{c}`" for c in df.columns]
    for p in enabled:
        result = F.struct(
            F.lit(p).alias("platform"),
            validation_level(F.col("issues")).alias("level"),
            F.transform("issues", lambda i: i["message"]).alias("messages"),
            "row",
        )
        kept = [f"`result {q}`" for q in enabled if f"result {q}" in df.columns]
        df = REGISTRY[p](df, ctx).select(*names, *kept, result.alias(f"result {p}"))
    return df.select(*(f"`{c}`" for c in columns), F.array(*[F.col(f"`result {p}`") for p in enabled]).alias("results"))


def validations(clips: DataFrame, ctx: DeliveryContext, keep: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Long form of ``platform_results``: level, ordered messages and the row per clip and platform."""
    # The outer form keeps the optimizer from evaluating the results a second time for a size filter.
    return platform_results(clips, ctx).select(*keep, F.inline_outer("results"))


def clips_by_platform(clips: DataFrame, ctx: DeliveryContext) -> DataFrame:
    """One row per clip and enabled platform, without a join: the platform list is a literal."""
    enabled = [p for p in PLATFORM_ORDER if p in ctx.settings.enabled_platforms]
    return clips.withColumn("platform", F.explode(string_array(enabled)))


def category_check(clips: DataFrame, ctx: DeliveryContext) -> DataFrame:
    """Categories of each clip that are not in the platform lists."""
    r = ctx.rules
    adobe = string_array([str(c["id"]) for c in r.adobe["categories"]])
    named = lambda p, c: F.struct(F.lit(p).alias("platform"), c.alias("unknown"))
    bad = lambda given, allowed: F.array_except(given, allowed)
    rows = F.array(
        named("adobe", bad(F.array(F.col("adobe_category").cast("string")), adobe)),
        named("shutterstock", bad(F.col("shutterstock_categories"), string_array(r.shutterstock["categories"]))),
        named("envato", bad(F.array("envato_category"), string_array(r.envato["categories"]))),
    )
    return (
        clips.select("clip_id", F.inline(rows))
        .select("clip_id", "platform", F.explode("unknown").alias("category"))
    )


def report_counts(checked: DataFrame, key: str = "job_id") -> DataFrame:
    """ok / warning / error clips per platform."""
    return checked.groupBy(key, "platform").agg(
        *[F.count_if(F.col("level") == level).alias(level) for level in ("ok", "warning", "error")]
    )


def report_totals(clips: DataFrame, key: str = "job_id") -> DataFrame:
    """Clips, seconds and gigabytes per job, with low-confidence and editorial numbers."""
    return clips.groupBy(key).agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum("duration_sec").alias("seconds"),
        (F.coalesce(F.sum("output_size_bytes"), F.lit(0)) / float(1024**3)).alias("gigabytes"),
        F.count_if(F.coalesce("place_confidence", F.lit("unknown")).isin("low", "unknown")).alias("low_confidence"),
        F.count_if(F.coalesce("editorial_suggested", F.lit(False)) | F.coalesce("editorial", F.lit(False))).alias(
            "editorial"
        ),
    )
