"""Catalog, feature and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.numeric import round_half_up
from ..operators import scale
from . import units

# Stored digits of each feature column.
FEATURE_DIGITS = {
    "t": 4, "dx": 5, "dy": 5, "div": 5, "rot": 5, "px": 5, "py": 5, "fit": 4, "coherence": 4, "mag_var": 8,
    "sharpness": 2, "brightness": 2, "overexposed": 5,
}


def read_catalog(
    spark: SparkSession, path: str, names: list[str] | None = None, version: int | None = None
) -> dict[str, DataFrame]:
    """The seven catalog tables with their fixed schemas, all of one version (the newest by default).

    A table that was never stored is empty.
    """
    if version is None:
        version = (units.versions(spark, path) or [None])[-1]
    return {name: units.read(spark, path, name, schemas.CATALOG[name], version) for name in (names or list(schemas.CATALOG))}


def write_catalog(catalog: dict[str, DataFrame], path: str, removed_projects: DataFrame | None = None) -> int:
    """Store catalog tables in one step; the number of the new version.

    Projects, videos and jobs are replaced project by project, segments by video, clips by job, other tables as a
    whole. What is below ``removed_projects`` (``project_id``) is cleared unless it has rows again, so the result of
    ``cascade_delete`` is stored as it is.
    """
    spark = next(iter(catalog.values())).sparkSession
    gone = {} if removed_projects is None else _below(read_catalog(spark, path), removed_projects)
    return units.commit(
        spark, path, {n: units.Change(df, schemas.UNITS.get(n, ()), gone.get(n)) for n, df in catalog.items()}
    )


def delete_projects(spark: SparkSession, path: str, project_ids: DataFrame) -> int:
    """Remove stored projects (``project_id``) with everything below them in one step; the number of the new version.

    Nothing is rewritten but the projects that have a video whose ``duplicate_of_id`` names a removed one: there it
    becomes null.
    """
    stored, known = read_catalog(spark, path), set(units.tables(spark, path))
    gone = _below(stored, project_ids)
    removed = gone["segments"].select(F.col("video_id").alias("duplicate_of_id")).distinct()
    left = stored["videos"].join(gone["videos"], "project_id", "left_anti")
    touched = left.join(removed, "duplicate_of_id", "left_semi").select("project_id").distinct()
    affected = left.join(touched, "project_id", "left_semi").join(removed.withColumn("_lost", F.lit(True)), "duplicate_of_id", "left")
    pointer = F.when(F.col("_lost").isNull(), F.col("duplicate_of_id"))
    videos = affected.withColumn("duplicate_of_id", pointer).select(stored["videos"].columns)
    changes = {n: units.Change(None, schemas.UNITS[n], gone[n]) for n in schemas.UNITS if n != "videos"}
    changes["videos"] = units.Change(videos, schemas.UNITS["videos"], gone["videos"])
    return units.commit(spark, path, {n: c for n, c in changes.items() if n in known})


def _below(catalog: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Units of each table that belong to projects."""
    projects = project_ids.select("project_id").distinct()
    videos = catalog["videos"].join(projects, "project_id", "left_semi").select(F.col("id").alias("video_id"))
    jobs = catalog["export_jobs"].join(projects, "project_id", "left_semi").select(F.col("id").alias("job_id"))
    return {
        "projects": projects.select(F.col("project_id").alias("id")), "videos": projects, "segments": videos,
        "export_jobs": projects, "export_clips": jobs,
    }


def read_frame_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame pair from per-video documents (<video id>/features.json).

    A document that does not fit the schema counts as absent.
    """
    docs = (
        spark.read.schema(schemas.FEATURE_DOCUMENT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*features*.json")
        .json(path)
        .withColumn("_file", F.input_file_name())
    )
    complete = F.forall(
        "features", lambda f: F.array_contains(F.array(*[f[n].isNull() for n in schemas.FRAME_FIELDS]), False)
        & ~F.array_contains(F.array(*[f[n].isNull() for n in schemas.FRAME_FIELDS]), True)
    )
    good = docs.where(F.col("_corrupt_record").isNull() & F.col("analysisFps").isNotNull() & F.col("features").isNotNull() & complete)
    video = F.element_at(F.split("_file", "/"), -2)
    rows = good.select(
        F.url_decode(video).alias("video_id"), F.col("analysisFps").alias("analysis_fps"), F.posexplode("features").alias("i", "f")
    )
    fields = [F.col(f"f.{n}").alias("mag_var" if n == "magVar" else n) for n in schemas.FRAME_FIELDS]
    return rows.select("video_id", "analysis_fps", F.col("i").cast("bigint").alias("i"), *fields)


def rounded_features(df: DataFrame) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), d) for c, d in FEATURE_DIGITS.items()})


def write_frame_features(df: DataFrame, path: str, span: int = scale.SPAN, emptied: DataFrame | None = None) -> None:
    """Feature cache by fps and video, the unit of re-analysis; a second write keeps all other videos.

    Rows are clustered by video span and sorted, so re-analysis reads in order. ``emptied`` (``analysis_fps``,
    ``video_id``) lists videos that lose their rows.
    """
    laid = (
        rounded_features(df)
        .repartition("video_id", F.floor(F.col("i") / span))
        .sortWithinPartitions("analysis_fps", "video_id", "i")
    )
    units.commit(df.sparkSession, path, {"features": units.Change(laid, ("analysis_fps", "video_id"), emptied)})


def read_stored_features(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of the feature cache, of its newest version by default."""
    return units.read(spark, path, "features", version=version)


def metric_pages(series: DataFrame, fps: float, page: int = scale.SPAN) -> DataFrame:
    """Column-wise graph series: one row of parallel arrays per page of a video."""
    item = F.struct("i", "t", "speed", "smoothness", "motion")
    grouped = series.groupBy("video_id", F.floor(F.col("i") / page).alias("page")).agg(
        F.array_sort(F.collect_list(item)).alias("_s")
    )
    pull = lambda c: F.transform("_s", lambda s: s[c]).alias(c)
    return grouped.select("video_id", "page", F.lit(fps).alias("fps"), *map(pull, ("t", "speed", "smoothness", "motion")))


def write_metrics(
    series: DataFrame, fps: float, path: str, page: int = scale.SPAN, emptied: DataFrame | None = None
) -> None:
    """Replace the stored series of the videos in ``series`` and clear those of ``emptied``; other videos stay."""
    pages = metric_pages(series, fps, page)
    units.commit(series.sparkSession, path, {"metrics": units.Change(pages, ("video_id",), emptied)})


def read_metrics(spark: SparkSession, path: str, page: int = scale.SPAN) -> DataFrame:
    """Long form of stored metric pages."""
    pages = units.read(spark, path, "metrics")
    rows = pages.select("video_id", "page", F.posexplode(F.arrays_zip("t", "speed", "smoothness", "motion")).alias("k", "s"))
    return rows.select("video_id", (F.col("page") * page + F.col("k")).alias("i"), "s.*")


def read_answer_log(spark: SparkSession, path: str) -> DataFrame:
    """Attempt log documents named <clip>_<stamp>_a<attempt>.json."""
    docs = (
        spark.read.schema(schemas.ANSWER_LOG).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    )
    name = F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1))
    return docs.withColumn("_name", name).select(
        F.regexp_extract("_name", r"^(.*?)_.*_a\d+\.json$", 1).alias("clip_id"),
        "model",
        F.col("promptVersion").alias("prompt_version"),
        F.coalesce("attempt", F.regexp_extract("_name", r"_a(\d+)\.json$", 1).try_cast("int")).alias("attempt"),
        F.col("durationMs").alias("duration_ms"),
        F.col("response.message.content").alias("answer"),
        "errors",
    )


def violations(checks: list[tuple[str, Column, str]]) -> Column:
    """array<struct<path, message>> of the failing checks."""
    items = [
        F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message"))) for path, bad, message in checks
    ]
    return F.array_compact(F.array(*items))


def validate_settings(df: DataFrame) -> DataFrame:
    """Range and cross-field problems of analysis settings rows."""
    outside = lambda c, lo, hi: ~F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    lo, hi, target = F.col("min_duration"), F.col("max_duration"), F.col("target_duration")
    checks = [
        ("minDuration", outside("min_duration", 1, 600), "must be within 1..600"),
        ("maxDuration", outside("max_duration", 2, 1200), "must be within 2..1200"),
        ("targetDuration", outside("target_duration", 1, 1200), "must be within 1..1200"),
        ("analysisFps", outside("analysis_fps", 1, 30), "must be within 1..30"),
        ("sensitivity", outside("sensitivity", 0.25, 4), "must be within 0.25..4"),
        ("includeStatic", F.col("include_static").isNull(), "is required"),
        ("maxDuration", lo >= hi, "minDuration must be less than maxDuration"),
        ("targetDuration", (target < lo) | (target > hi), "targetDuration must be within [minDuration, maxDuration]"),
    ]
    return df.withColumn("violations", violations(checks))


# Contract of the export settings document (JSON kind, Spark type, default, check).
_TEXT, _NUMBER = ("STRING",), ("BIGINT", "DOUBLE", "DECIMAL")
EXPORT_FIELDS = {
    "model": (_TEXT, "string", "gemma4:31b", lambda c: F.length(c) >= 1),
    "think": (("BOOLEAN",), "boolean", False, None),
    "llmTimeoutSec": (("BIGINT",), "int", 600, lambda c: c.between(30, 3600)),
    "temperature": (_NUMBER, "double", 0.3, lambda c: c.between(0, 2)),
    "autoApprove": (("BOOLEAN",), "boolean", False, None),
    "concurrency": (("BIGINT",), "int", 2, lambda c: c.between(1, 8)),
    "slowMoConform": (_TEXT, "string", "off", lambda c: c.isin("off", "25", "30")),
    "embedGps": (("BOOLEAN",), "boolean", False, None),
    "creationTimeMode": (_TEXT, "string", "auto", lambda c: c.isin("auto", "utc", "local")),
    "filenameTemplate": (_TEXT, "string", "{subject}_{place}_{motion}_{date}_{n}", lambda c: F.length(c).between(1, 120)),
    "adobeAuthor": (_TEXT, "string", "author", lambda c: F.length(c) <= 100),
    "copyright": (_TEXT, "string", "", lambda c: F.length(c) <= 200),
    "pond5Price": (_NUMBER, "double", 50.0, lambda c: c >= 0),
    "pond5PriceLarge": (_NUMBER, "double", 100.0, lambda c: c >= 0),
    "envatoPriceSingle": (_NUMBER, "double", 15.0, lambda c: c >= 0),
    "envatoPriceMulti": (_NUMBER, "double", 30.0, lambda c: c >= 0),
    "poiRadiusM": (("BIGINT",), "int", 2000, lambda c: c.between(100, 10000)),
    "useOverpass": (("BOOLEAN",), "boolean", False, None),
}


def resolve_settings(df: DataFrame, document: str = "value") -> DataFrame:
    """Stored settings over defaults, field by field; one bad field discards the whole document."""
    doc = F.col("_doc")
    df = df.withColumn("_doc", F.try_parse_json(document))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    present = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    values, valid = {}, is_object
    for name, (kinds, kind, default, check) in EXPORT_FIELDS.items():
        raw = F.try_variant_get(doc, f"$.{name}", "variant")
        value = F.try_variant_get(doc, f"$.{name}", kind)
        # "DECIMAL(p,s)" and friends compare by their first word.
        ok = F.substring_index(F.schema_of_variant(raw), "(", 1).isin(*kinds)
        if check is not None:
            ok = ok & check(value)
        valid = valid & (~F.array_contains(present, name) | F.coalesce(ok, F.lit(False)))
        values[name] = (value, F.lit(default).cast(kind))
    df = df.withColumn("_valid", valid)
    settings = F.struct(
        *[F.when(F.col("_valid"), F.coalesce(v, d)).otherwise(d).alias(n) for n, (v, d) in values.items()]
    )
    return df.withColumn("settings", settings).drop("_doc", "_valid")
