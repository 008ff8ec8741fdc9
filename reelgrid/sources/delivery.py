"""Delivery sinks: manifest, platform CSV files, clip documents, report."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ExportSettings
from ..functions.text import slugify
from ..operators import platforms as P
from ..operators import scale
from ..operators.clips import job_progress, step_hash
from ..operators.naming import assign_filenames
from ..session import written_once
from . import units
from .ordered_files import write_ordered_files

#: Segments per manifest page; a very long video continues on further pages.
MANIFEST_PAGE = 1000


def manifest_documents(rows: DataFrame, page: int = MANIFEST_PAGE) -> DataFrame:
    """JSON documents of the manifest: version, project, video facts and segments, ``page`` segments at most each.

    Every document names its page and the number of pages of its video, so a reader sees what is missing.
    """
    placed = scale.dense_rank_in_order(
        rows, ["project_id", "video_id"], ["start_sec", "segment_id"], F.floor(F.col("start_sec") / 600), "_pos"
    )
    video = ["video_id", "original_filename", "duration_sec", "fps", "width", "height"]
    item = F.struct("_pos", "segment_id", "start_sec", "end_sec", "start_frame", "end_frame", "motion_type", "score", "origin")
    pages = placed.groupBy("project_id", *video, F.floor(F.col("_pos") / page).alias("page")).agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    )
    pages = pages.withColumn("pages", F.max("page").over(W.partitionBy("project_id", "video_id")) + 1)
    names = {
        "segment_id": "segmentId", "start_sec": "startSec", "end_sec": "endSec", "start_frame": "startFrame",
        "end_frame": "endFrame", "motion_type": "motionType", "score": "score", "origin": "origin",
    }
    segments = F.transform("_items", lambda s: F.struct(*[s[a].alias(b) for a, b in names.items()]))
    doc = F.struct(
        F.lit(1).alias("manifestVersion"),
        F.col("project_id").alias("projectId"),
        "page",
        "pages",
        F.struct(
            F.col("video_id").alias("videoId"), F.col("original_filename").alias("originalFilename"),
            F.col("duration_sec").alias("durationSec"), "fps", "width", "height", segments.alias("segments"),
        ).alias("video"),
    )
    return pages.select("project_id", "video_id", "page", F.to_json(doc).alias("value"))


def write_manifest(rows: DataFrame, path: str, page: int = MANIFEST_PAGE, emptied: DataFrame | None = None) -> None:
    """Replace the manifests of the projects in ``rows`` in one step; other projects stay as they are.

    A project in ``emptied`` (``project_id``) that has no rows any more loses its manifest.
    """
    pages = manifest_documents(rows, page).select("project_id", "value").repartition("project_id", F.xxhash64("value"))
    units.commit(rows.sparkSession, path, {"manifest": units.Change(pages, ("project_id",), emptied)})


_MANIFEST = (
    "struct<manifestVersion:int,projectId:string,page:bigint,pages:bigint,video:struct<videoId:string,originalFilename:string,"
    "durationSec:double,fps:double,width:int,height:int,segments:array<struct<segmentId:string,startSec:double,"
    "endSec:double,startFrame:bigint,endFrame:bigint,motionType:string,score:double,origin:string>>>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Long form of the manifests; documents of another version are left out, a missing page ends the query."""
    stored = units.read(spark, path, "manifest", "project_id string, value string")
    docs = stored.select(F.from_json("value", _MANIFEST).alias("d")).where("d.manifestVersion = 1")
    of_video = W.partitionBy("projectId", "videoId")
    rows = docs.select("d.projectId", "d.pages", "d.video.*")
    whole = F.coalesce(F.count(F.lit(1)).over(of_video) == F.col("pages"), F.lit(True))
    missing = F.concat(F.lit("manifest pages are missing: video "), "videoId")
    rows = rows.withColumn("_whole", whole).where(
        F.when(F.col("_whole"), True).otherwise(F.raise_error(missing).cast("boolean"))
    )
    return rows.select(
        F.col("projectId").alias("project_id"), F.col("videoId").alias("video_id"),
        F.col("originalFilename").alias("original_filename"), F.col("durationSec").alias("duration_sec"),
        "fps", "width", "height", F.inline("segments"),
    )


def platform_file_name(platform: str, settings: ExportSettings, export_date: date) -> Column:
    """File name of a platform's CSV; one of them carries the author and the date."""
    if platform != "adobe":
        return F.lit(f"{platform}.csv")
    author = slugify(F.lit(settings.adobe_author))
    author = F.when(author == "", "author").otherwise(author)
    return F.concat(F.lit("adobe_stock_"), author, F.lit(f"_{export_date:%Y_%m_%d}.csv"))


_CSV = {
    "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def platform_csv_lines(rows: DataFrame, platform: str, ctx: P.DeliveryContext) -> DataFrame:
    """CSV lines per job (job_id, ordinal, value): one header before all clips, quotes only where needed."""
    header = ctx.rules[platform]["header"]
    line = lambda cells: F.to_csv(F.struct(*cells), _CSV).alias("value")
    names = [F.lit(name).alias(f"c{k}") for k, name in enumerate(header)]
    cells = [F.col("row")[k].alias(f"c{k}") for k in range(len(header))]
    heads = rows.select("job_id").distinct().select("job_id", F.lit(-1).cast("bigint").alias("ordinal"), line(names))
    return heads.unionByName(rows.select("job_id", F.col("ordinal").cast("bigint").alias("ordinal"), line(cells)))


def write_platform_csv(
    rows: DataFrame, platform: str, ctx: P.DeliveryContext, path: str, export_date: date, emptied: Iterable[str] = ()
) -> None:
    """RFC 4180 CSV of a platform per job, in clip order: one file ``<job>/<platform's file name>``.

    ``rows``: job_id, ordinal, row. Other jobs and other file names stay as they are; a job of ``emptied`` without
    rows loses its file. All files are put in place together once they are complete.
    """
    name = platform_file_name(platform, ctx.settings, export_date)
    lines = platform_csv_lines(rows, platform, ctx).withColumn("file", F.concat_ws("/", _folder(F.col("job_id")), name))
    write_ordered_files(lines, path, ["ordinal"], _files_of(rows.sparkSession, emptied, name))


def _folder(job: Column) -> Column:
    """A job's folder; characters that mean something in a path are encoded."""
    return F.replace(F.url_encode(job.cast("string")), F.lit("+"), F.lit("%20"))


def _files_of(spark: SparkSession, jobs: Iterable[str], name: Column) -> list[str]:
    rows = spark.createDataFrame([(j,) for j in jobs], "job_id string")
    return [r.file for r in rows.select(F.concat_ws("/", _folder(F.col("job_id")), name).alias("file")).collect()]


def delivery_metadata(results: DataFrame) -> DataFrame:
    """One JSON document per clip: source, context, final values and the platform validations."""
    pick = lambda names: F.struct(*[c for c in names if c in results.columns])
    checks = F.transform("results", lambda r: F.struct(r["platform"].alias("platform"), r["level"].alias("level"), r["messages"].alias("messages")))
    doc = F.struct(
        "filename",
        F.col("clip_id").alias("clipId"),
        pick(["video_id", "segment_id", "start_sec", "end_sec", "start_frame", "end_frame", "job_id"]).alias("source"),
        pick(["geo", "tech", "frames", "city", "region", "country", "duration_sec", "capture_date", "shot_type"]).alias("context"),
        pick(
            ["title", "description", "keywords", "subject", "adobe_category", "shutterstock_categories",
             "envato_category", "recognizable_buildings", "editorial", "editorial_reason"]
        ).alias("final"),
        F.col("output_size_bytes").alias("outputSizeBytes"),
        checks.alias("validations"),
    )
    return results.select("job_id", "clip_id", F.to_json(doc).alias("value"))


def write_delivery_metadata(documents: DataFrame, path: str, emptied: DataFrame | None = None) -> None:
    """Replace the documents of the jobs in ``documents`` and clear those of ``emptied`` (``job_id``); others stay."""
    change = units.Change(documents.select("job_id", "value"), ("job_id",), emptied)
    units.commit(documents.sparkSession, path, {"documents": change})


def read_delivery_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``job_id`` and ``value`` of the stored documents."""
    return units.read(spark, path, "documents", "job_id string, value string")


REPORT = "report.md"
_REPORT_FACTS = ("place_confidence", "editorial_reason", "city", "country", "editorial_suggested")
LEVEL_NAMES = {"ok": "OK", "warning": "Warning", "error": "Error"}


def report_lines(jobs: DataFrame, results: DataFrame, ctx: P.DeliveryContext) -> DataFrame:
    """Markdown report of every job as ordered lines (job_id, section, ord, sub, line).

    ``jobs``: job_id, project_name, folder, built_at, excluded. ``results``: ``platform_results`` of
    the delivered clips with ordinal; it is read several times, so pass a written table. Lines are
    rows: a job of any size is assembled by sorting, never in one place.
    """
    from ..functions.numeric import literal_map

    lit, s = F.lit, lambda c: c.cast("string")
    totals = P.report_totals(results)
    j = jobs.join(totals, "job_id", "left").na.fill(0)
    head = F.array(
        F.concat(lit("# Export report: "), "project_name"),
        lit(""),
        F.concat(lit("- Folder: `"), "folder", lit("`")),
        F.concat(lit("- Built: "), "built_at"),
        F.concat(lit("- Clips: "), s(F.col("clips")), lit(" (excluded by the user: "), s(F.col("excluded")), lit(")")),
        F.concat(
            lit("- Total duration: "), F.format_string("%.1f", "seconds"), lit(" s, total size: "),
            F.format_string("%.2f", "gigabytes"), lit(" GB"),
        ),
        lit(""),
        lit("## Platforms"),
        lit(""),
        lit("| Platform | OK | Warnings | Errors | Template verified |"),
        lit("|---|---|---|---|---|"),
    )

    def lines(df: DataFrame, section: int, array: Column) -> DataFrame:
        return df.select("job_id", lit(section).alias("section"), lit(0).cast("bigint").alias("ord"), F.posexplode(array).alias("sub", "line"))

    def fixed(section: int, *texts: str) -> DataFrame:
        return lines(jobs, section, F.array(*[lit(t) for t in texts]))

    enabled = [p for p in P.REGISTRY if p in ctx.settings.enabled_platforms]
    counts = P.report_counts(results.select("job_id", F.inline("results")))
    facts = F.array(
        *[
            F.struct(
                lit(k).alias("ord"), lit(p).alias("platform"), lit(ctx.rules[p]["label"]).alias("label"),
                lit(ctx.rules[p]["lastVerified"]).alias("last_verified"), lit(ctx.rules[p]["verified"]).alias("verified"),
            )
            for k, p in enumerate(enabled)
        ]
    )
    table = jobs.select("job_id", F.inline(facts)).join(counts, ["job_id", "platform"], "left").na.fill(0)
    verified = F.when(F.col("verified"), "yes").otherwise("no")
    table = table.select(
        "job_id", lit(2).alias("section"), F.col("ord").cast("bigint").alias("ord"), lit(0).alias("sub"),
        F.concat(
            lit("| "), "label", lit(" | "), s(F.col("ok")), lit(" | "), s(F.col("warning")), lit(" | "),
            s(F.col("error")), lit(" | "), verified, lit(" (checked "), "last_verified", lit(") |"),
        ).alias("line"),
    )
    labels = literal_map({p: ctx.rules[p]["label"] for p in P.REGISTRY})

    def described(r: Column) -> Column:
        start = F.concat(lit("- **"), labels[r["platform"]], lit("** ("), literal_map(LEVEL_NAMES)[r["level"]], lit("): "))
        return F.transform(r["messages"], lambda m: F.concat(start, m))

    troubled = F.filter("results", lambda r: r["level"] != "ok")
    block = F.concat(
        F.array(F.concat(lit("### "), "filename"), lit("")),
        F.flatten(F.transform("_bad", described)),
        F.array(lit("")),
    )
    flagged = results.withColumn("_bad", troubled).where(F.size("_bad") > 0)
    details = flagged.select(
        "job_id", lit(4).alias("section"), F.col("ordinal").cast("bigint").alias("ord"), F.posexplode(block).alias("sub", "line")
    )
    worst = counts.groupBy("job_id").agg(F.sum(F.col("warning") + F.col("error")).alias("n")).where("n > 0")

    def listing(section: int, df: DataFrame, text: Column) -> DataFrame:
        rows = df.select("job_id", lit(section).alias("section"), F.col("ordinal").cast("bigint").alias("ord"), lit(0).alias("sub"), text.alias("line"))
        empty = jobs.select("job_id").join(df.select("job_id").distinct(), "job_id", "left_anti")
        return rows.unionByName(lines(empty, section, F.array(lit("None."))))

    confidence = F.coalesce("place_confidence", lit("unknown"))
    full = lambda c: F.when(F.length(c) > 0, F.col(c))
    place = F.concat_ws(", ", full("city"), full("country"))
    place = F.when(F.length(place) > 0, place).otherwise("no location")
    final = F.coalesce("editorial", "editorial_suggested", lit(False))
    uncertain = results.where(confidence.isin("low", "unknown"))
    editorial = results.where(F.coalesce("editorial_suggested", lit(False)) | F.coalesce("editorial", lit(False)))
    verdict = F.when(final, "editorial").otherwise("commercial (model suggested editorial)")
    reason = F.coalesce("editorial_reason", lit("set by the user"))
    no_issues = jobs.select("job_id").join(worst, "job_id", "left_anti")
    parts = [
        lines(j, 1, head),
        table,
        fixed(3, "", "## Platform warnings and errors", ""),
        lines(no_issues, 4, F.array(lit("None."), lit(""))),
        details,
        fixed(5, "## Place confidence low or unknown", ""),
        listing(6, uncertain, F.concat(lit("- "), "filename", lit(": "), confidence, lit(" ("), place, lit(")"))),
        fixed(7, "", "## Editorial", ""),
        listing(8, editorial, F.concat(lit("- "), "filename", lit(": "), verdict, lit(". "), reason)),
        fixed(9, "", ""),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report(lines: DataFrame, path: str, emptied: Iterable[str] = ()) -> None:
    """One file ``<job>/report.md`` per job of ``lines``; other jobs stay, those of ``emptied`` without lines lose theirs."""
    named = lines.withColumn("file", F.concat(_folder(F.col("job_id")), F.lit(f"/{REPORT}"))).withColumnRenamed("line", "value")
    write_ordered_files(named, path, ["section", "ord", "sub"], _files_of(lines.sparkSession, emptied, F.lit(REPORT)))


def delivery_hash(clips: DataFrame, ctx: P.DeliveryContext, inputs: list[str]) -> DataFrame:
    """Digest per job of everything that ends up in a delivery: clips, settings, headers and check dates.

    A clip's SHA-256 is added up in four 64-bit slices, so clips combine in any order and aggregate on the
    map side for a job of any size.
    """
    s = ctx.settings
    fixed = [
        F.lit(x)
        for x in (
            s.adobe_author, s.copyright, float(s.pond5_price), float(s.pond5_price_large),
            float(s.envato_price_single), float(s.envato_price_multi), ",".join(s.enabled_platforms),
            ",".join(ctx.rules[p]["lastVerified"] for p in s.enabled_platforms),
            ";".join(",".join(ctx.rules[p]["header"]) for p in s.enabled_platforms),
        )
    ]
    digest = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring("_d", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    per_job = (
        scale.pinned(clips.select("job_id", *[c for c in inputs if c != "job_id"]), {"_d": digest})
        .groupBy("job_id")
        .agg(*[F.sum(part(k)).alias(f"_{k}") for k in range(4)], F.count(F.lit(1)).alias("_n"))
    )
    sums = [F.col(f"_{k}").cast("string") for k in range(4)]
    return per_job.select("job_id", step_hash(F.lit("archive.v2"), *sums, F.col("_n"), *fixed).alias("delivery_hash"))


def build_delivery(clips: DataFrame, jobs: DataFrame, ctx: P.DeliveryContext, ext: str = "mov") -> dict[str, DataFrame]:
    """Build the deliveries of all jobs: the gate, names, rows and documents.

    A job is built when every clip that is not excluded is done and its hash, which covers the project name if
    ``jobs`` has it, differs from ``jobs.archive_hash``. Clips with a ``first_name`` get their names by it, unique per
    job in clip order. Returns ``jobs`` with their outcome and, for those to build, ``results`` (clips with platform
    results) and ``metadata`` (documents); ``delivery_lines`` has the lines of all files, ``write_delivery`` stores them.
    """
    if "first_name" in clips.columns:
        todo = clips.where(~F.col("excluded"))
        names = assign_filenames(todo.select("job_id", "clip_id", "ordinal", "first_name"), ext)
        named = names.select("job_id", "clip_id", F.col("filename").alias("_filename"))
        clips = clips.drop("filename").join(named, ["job_id", "clip_id"], "left").withColumnRenamed("_filename", "filename")
    gate = job_progress(clips).select("job_id", "can_build")
    done = clips.where(~F.col("excluded") & (F.col("status") == "done"))
    view = P.csv_clip_view(done)
    inputs = [c for c in view.columns if c not in ("job_id", "progress", "updated_at")]
    hashes = delivery_hash(view, ctx, inputs)
    if "project_name" in jobs.columns:
        named = step_hash(F.col("delivery_hash"), F.coalesce("project_name", F.lit("")))
        hashes = hashes.join(jobs.select("job_id", "project_name"), "job_id").select("job_id", named.alias("delivery_hash"))
    plan = (
        jobs.join(gate, "job_id", "left")
        .join(hashes, "job_id", "left")
        .withColumn(
            "outcome",
            F.when(~F.coalesce("can_build", F.lit(False)), "blocked")
            .when(F.col("delivery_hash") == F.col("archive_hash"), "reused")
            .otherwise("built"),
        )
    )
    # Hashed once; as a file of a row per job its size is known, so few jobs are sent to the clips and no clip moves.
    plan = written_once(plan)
    todo = view.join(plan.where("outcome = 'built'").select("job_id"), "job_id", "left_semi")
    results = P.platform_results(todo, ctx)
    return {"jobs": plan, "results": results, "metadata": delivery_metadata(results)}


def delivery_lines(delivery: dict[str, DataFrame], ctx: P.DeliveryContext) -> DataFrame:
    """Lines of all files of a delivery: ``job_id``, ``file``, ``section``, ``ord``, ``sub``, ``value``.

    One CSV per enabled platform and, if the jobs have what a report says (project_name, folder, built_at, excluded),
    the report. The results are read once per file, so pass a delivery whose results are a written table.
    """
    jobs, results, out = delivery["jobs"].where("outcome = 'built'"), delivery["results"], None
    for platform in (p for p in P.REGISTRY if p in ctx.settings.enabled_platforms):
        rows = results.select("job_id", "ordinal", F.inline("results")).where(F.col("platform") == platform)
        part = platform_csv_lines(rows, platform, ctx).select(
            "job_id", platform_file_name(platform, ctx.settings, ctx.export_date).alias("file"), F.lit(0).alias("section"),
            F.col("ordinal").alias("ord"), F.lit(0).alias("sub"), "value",
        )
        out = part if out is None else out.unionByName(part)
    if {"project_name", "folder", "built_at", "excluded"} <= set(jobs.columns):
        facts = {c: F.lit(None).cast("string") for c in _REPORT_FACTS if c not in results.columns}
        report = report_lines(jobs, results.withColumns(facts), ctx)
        report = report.select("job_id", F.lit(REPORT).alias("file"), "section", "ord", "sub", F.col("line").alias("value"))
        out = report if out is None else out.unionByName(report)
    return out


def write_delivery(delivery: dict[str, DataFrame], ctx: P.DeliveryContext, path: str) -> dict[str, int]:
    """Store a built delivery: files ``<job>/<name>`` all at once, then the documents; bytes of every file."""
    results = written_once(delivery["results"])
    lines = delivery_lines(delivery | {"results": results}, ctx)
    lines = lines.withColumn("file", F.concat_ws("/", _folder(F.col("job_id")), "file"))
    sizes = write_ordered_files(lines, f"{path.rstrip('/')}/files", ["section", "ord", "sub"])
    write_delivery_metadata(delivery_metadata(results), f"{path.rstrip('/')}/documents")
    return sizes
