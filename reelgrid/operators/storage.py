"""Storage accounting over a file listing: categories, owners, usage and the cleanup plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Storage categories in contract order and the scan order of the top folders.
CATEGORIES = [
    "sources", "proxies", "analysis", "encodedClips", "archives", "frames", "aiLogs", "uploads", "database", "other",
]
SCAN_ORDER = ["videos", "export-work", "exports", "llm-logs", "uploads"]


def _part(path: Column, k: int) -> Column:
    return F.get(F.split(path, "/"), F.lit(k))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_category(path: Column, database: str = "app.db") -> Column:
    """Category from the top folder and the file name of a root-relative path."""
    top, name = _part(path, 0), _name(path)
    depth = F.size(F.split(path, "/"))
    video = (
        F.when(depth < 3, "other")
        .when(name.startswith("source."), "sources")
        .when(name.isin("proxy.mp4", "sprite.jpg"), "proxies")
        .when(name.endswith(".json"), "analysis")
        .otherwise("other")
    )
    work = F.when(name.startswith("cut."), "encodedClips").when(name.startswith("frame_"), "frames").otherwise("other")
    return (
        F.when(path.isin(database, f"{database}-wal", f"{database}-shm"), "database")
        .when(top == "videos", video)
        .when(top == "export-work", work)
        .when(top == "exports", "archives")
        .when(top == "llm-logs", "aiLogs")
        .when(top == "uploads", "uploads")
        .otherwise("other")
    )


def reclaimable(path: Column, project_id: Column) -> Column:
    """Rebuildable or orphaned work files; leftovers of interrupted writes always qualify."""
    top, name = _part(path, 0), _name(path)
    work = (top == "export-work") & (name.startswith("cut.") | project_id.isNull())
    return work | (top == "exports") | path.endswith(".part") | name.startswith("cut.part.")


def distinct_files(listing: DataFrame) -> DataFrame:
    """One row per physical file: a file reachable by several names counts under the first scanned.

    ``listing`` has path, bytes and file_key (device and inode, or any identity).
    """
    known = F.array(*[F.lit(s) for s in SCAN_ORDER])
    position = F.array_position(known, _part(F.col("path"), 0))
    rank = F.struct(F.when(position == 0, len(SCAN_ORDER) + 1).otherwise(position), F.col("path"))
    rest = [c for c in listing.columns if c != "file_key"]
    return listing.groupBy("file_key").agg(F.min_by(F.struct(*rest), rank).alias("_f")).select("file_key", "_f.*")


def assign_owner(files: DataFrame, videos: DataFrame, jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """Owning project through the video, job, archive or clip named by the path; null = leftover."""
    top, second = _part(F.col("path"), 0), _part(F.col("path"), 1)
    clip_key = F.substring_index(_name(F.col("path")), "_", 1)
    keyed = files.withColumns(
        {
            "_kind": top,
            "_key": F.when(top.isin("videos", "export-work", "exports", "projects"), second).when(
                top == "llm-logs", clip_key
            ),
        }
    )
    archives = jobs.select(
        F.explode(F.array_compact(F.array("archive_dir", "archive_zip"))).alias("_path"), "project_id"
    ).select(F.lit("exports").alias("_kind"), _name(F.col("_path")).alias("_key"), "project_id")
    text = lambda c: F.col(c).cast("string").alias("_key")
    owners = (
        videos.select(F.lit("videos").alias("_kind"), text("id"), "project_id")
        .unionByName(jobs.select(F.lit("export-work").alias("_kind"), text("job_id"), "project_id"))
        .unionByName(archives)
        .unionByName(
            clips.join(jobs, "job_id").select(F.lit("llm-logs").alias("_kind"), text("clip_id"), "project_id")
        )
    )
    depth = F.size(F.split("path", "/"))
    direct = F.when((F.col("_kind") == "projects") & (depth > 2), F.col("_key"))
    # One owner per key (the smallest of archives that share a name); files without a key skip the join.
    owner = owners.groupBy("_kind", "_key").agg(F.min("project_id").cast("string").alias("_owner"))
    named = keyed.where(F.col("_key").isNotNull()).join(owner, ["_kind", "_key"], "left")
    unnamed = keyed.where(F.col("_key").isNull()).withColumn("_owner", F.lit(None).cast("string"))
    return (
        named.unionByName(unnamed).withColumn("project_id", F.coalesce("_owner", direct)).drop("_kind", "_key", "_owner")
    )


def classified(files: DataFrame) -> DataFrame:
    return files.withColumns(
        {
            "category": file_category(F.col("path")),
            "reclaimable": reclaimable(F.col("path"), F.col("project_id")),
        }
    )


def storage_usage(files: DataFrame) -> DataFrame:
    """Bytes per scope: the total, each project (largest first) and unassigned files.

    Output: scope (total / project / unassigned), project_id, total_bytes, reclaimable_bytes and one
    column per category.
    """
    rows = classified(files) if "category" not in files.columns else files
    sums = [
        F.sum("bytes").alias("total_bytes"),
        F.sum(F.when(F.col("reclaimable"), F.col("bytes")).otherwise(0)).alias("reclaimable_bytes"),
        *[F.sum(F.when(F.col("category") == c, F.col("bytes")).otherwise(0)).alias(c) for c in CATEGORIES],
    ]
    # One pass: per project first, then the small per-project table is rolled up.
    per_project = rows.groupBy("project_id").agg(*sums)
    names = ["total_bytes", "reclaimable_bytes", *CATEGORIES]
    total = per_project.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select(
        F.lit("total").alias("scope"), F.lit(None).cast(dict(files.dtypes)["project_id"]).alias("project_id"), *names
    )
    scoped = per_project.select(
        F.when(F.col("project_id").isNull(), "unassigned").otherwise("project").alias("scope"), "project_id", *names
    )
    return total.unionByName(scoped)


def largest_projects(usage: DataFrame) -> DataFrame:
    return usage.where("scope = 'project'").orderBy(F.desc("total_bytes"), "project_id")


def freed_files(before: DataFrame, after: DataFrame, building: DataFrame) -> DataFrame:
    """Files that disappeared, apart from those of projects whose archive is being built."""
    gone = before.join(after.select("path"), "path", "left_anti").dropDuplicates(["path"])
    return gone.join(building.select("project_id"), "project_id", "left_anti")


def cleanup_files(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files a cleanup would drop.

    Encoded files and archives of jobs that are not being built go; leftovers without an owner go
    too, except partial files while any build is running.
    """
    rows = classified(files) if "category" not in files.columns else files
    building = jobs.where(F.col("build_status") == "building").select("project_id").distinct()
    idle = jobs.where(F.col("build_status") != "building").select("project_id").distinct()
    any_build = not building.isEmpty()
    owned = rows.where(F.col("project_id").isNotNull() & F.col("category").isin("encodedClips", "archives")).join(
        idle, "project_id", "left_semi"
    )
    orphans = rows.where(F.col("project_id").isNull() & F.col("reclaimable"))
    if any_build:
        orphans = orphans.where(~F.col("path").endswith(".part"))
    return owned.unionByName(orphans)


def cleanup_plan(files: DataFrame, jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """What a cleanup would do, per project: bytes, jobs, clips sent back to review, skips."""
    dropped = cleanup_files(files, jobs).groupBy("project_id").agg(
        F.sum("bytes").alias("freed_bytes"), F.count(F.lit(1)).alias("files")
    )
    state = jobs.groupBy("project_id").agg(
        F.count_if(F.col("build_status") != "building").alias("jobs_cleaned"),
        F.bool_or(F.col("build_status") == "building").alias("skipped"),
    )
    back = F.col("status").isin("cut", "done")
    reset = (
        clips.groupBy("job_id")
        .agg(F.count_if(back).alias("n"))
        .join(jobs.where(F.col("build_status") != "building").select("job_id", "project_id"), "job_id")
        .groupBy("project_id")
        .agg(F.sum("n").alias("clips_reset"))
    )
    d, s = dropped.alias("d"), state.join(reset, "project_id", "left").alias("s")
    return d.join(s, F.col("d.project_id").eqNullSafe(F.col("s.project_id")), "full").select(
        F.coalesce("d.project_id", "s.project_id").alias("project_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("freed_bytes", "files", "jobs_cleaned", "clips_reset")],
        F.coalesce("skipped", F.lit(False)).alias("skipped"),
    )


def reset_cleaned_clips(clips: DataFrame, jobs: DataFrame) -> DataFrame:
    """Clips of cleaned jobs after the cleanup: encoded ones wait approved in review again."""
    idle = jobs.where(F.col("build_status") != "building").select("job_id")
    hit = clips.join(idle, "job_id", "left_semi")
    back = F.col("status").isin("cut", "done")
    touched = back | F.col("cut_path").isNotNull()
    return hit.where(touched).withColumns(
        {
            "approved": F.col("approved") | back,
            "progress": F.when(back, 0.0).otherwise(F.col("progress")),
            "status": F.when(back, "review").otherwise(F.col("status")),
            "cut_path": F.lit(None).cast("string"),
            "output_size_bytes": F.lit(None).cast("bigint"),
            "step_hashes": F.map_filter("step_hashes", lambda k, v: k != "cut"),
        }
    )
