"""Relational operators over the catalog: projects, videos, segments, duplicates, transitions."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import compact
from ..session import written_once
from . import scale

# Contract enums.
VIDEO_STATUSES = ["uploading", "queued", "probing", "proxy", "analyzing", "ready", "failed"]
CLIP_STATUSES = ["queued", "frames", "geo", "tech", "llm", "review", "cut", "done", "failed"]
CLIP_STEPS = ["frames", "geo", "tech", "llm", "cut"]
PREVIEW_LIMIT = 4
DURATION_TOLERANCE = 0.05
FPS_TOLERANCE = 0.01
#: Variants of one content that are paired; more are swept, in stretches of so many tolerances of duration.
PAIRED_VARIANTS, SWEPT_STEPS = 64, 200


def is_settled(status: Column) -> Column:
    return status.isin("ready", "failed")


def is_ready(status: Column) -> Column:
    return status == "ready"


def is_terminal(status: Column) -> Column:
    return status.isin("review", "done", "failed")


def is_unfinished(status: Column) -> Column:
    return ~is_terminal(status)


# Total orders of the listings: the id breaks ties.
def projects_newest_first(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("created_on"), "id")


def videos_by_created(videos: DataFrame) -> DataFrame:
    return videos.orderBy("project_id", "created_at", "id")


def segments_by_start(segments: DataFrame) -> DataFrame:
    return segments.orderBy("video_id", "start_sec", "id")


def clips_by_ordinal(clips: DataFrame) -> DataFrame:
    return clips.orderBy("job_id", "ordinal", "clip_id")


def segments_with_context(segments: DataFrame, videos: DataFrame, projects: DataFrame) -> DataFrame:
    """segments joined to their video and project; the optimizer picks the join by table size."""
    v = videos.select(
        F.col("id").alias("video_id"), "project_id", "duration_sec", F.col("fps"), F.col("status").alias("video_status"),
        "created_at", "original_filename",
    )
    p = projects.select(
        F.col("id").alias("project_id"), F.col("name").alias("project_name"),
        F.col("status").alias("project_status"), "min_duration", "max_duration",
    )
    return segments.join(v, "video_id").join(p, "project_id")


def status_map(rows: DataFrame, key: str, status: str) -> DataFrame:
    """Sparse counts per status: counted first, so at most one entry per status is collected."""
    counted = rows.groupBy(key, status).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("status_counts")
    )


def project_overview(
    projects: DataFrame, videos: DataFrame, segments: DataFrame, has_preview: Column | None = None
) -> DataFrame:
    """Counts per project with sparse status counts and the first previews; zeroes when empty."""
    has_preview = F.lit(True) if has_preview is None else has_preview
    per_video = videos.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("video_count"), F.count_if("reviewed").alias("reviewed_count")
    )
    # The rank limit is applied inside each task before the exchange, so a large project sends
    # only its first rows per task.
    rank = F.row_number().over(W.partitionBy("project_id").orderBy("created_at", "id"))
    previews = (
        videos.where(has_preview)
        .select("project_id", "created_at", "id")
        .withColumn("rank", rank)
        .where(F.col("rank") <= PREVIEW_LIMIT)
        .groupBy("project_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("previews"))
    )
    counted = segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("yes")
    )
    per_segment = (
        counted.join(videos.select(F.col("id").alias("video_id"), "project_id"), "video_id")
        .groupBy("project_id")
        .agg(F.sum("n").alias("segment_count"), F.sum("yes").alias("accepted_segments"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    out = projects.withColumnRenamed("id", "project_id")
    for part in (per_video, status_map(videos, "project_id", "status"), previews, per_segment):
        out = out.join(part, "project_id", "left")
    return out.select(
        "project_id", "name", "status", "created_on", zero("video_count"), zero("reviewed_count"),
        zero("segment_count"), zero("accepted_segments"),
        F.coalesce("status_counts", F.create_map().cast("map<string,bigint>")).alias("status_counts"),
        F.coalesce("previews", F.array().cast("array<bigint>")).alias("previews"),
    )


def project_summary(projects: DataFrame, videos: DataFrame, segments: DataFrame, issues: DataFrame) -> DataFrame:
    """Gate of the confirmation: counts, accepted seconds and ordered blockers.

    ``issues`` has one row per issue with ``segment_id`` and ``video_id``. Only ready videos contribute.
    """
    v = videos.select(F.col("id").alias("video_id"), "project_id", F.col("status").alias("video_status"))
    counts = v.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("video_count"),
        F.count_if(is_ready(F.col("video_status"))).alias("ready_count"),
        F.count_if(F.col("video_status") == "failed").alias("failed_count"),
    )
    length = F.col("end_sec") - F.col("start_sec")
    by_video = segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("proposed"),
        F.count_if("accepted").alias("accepted"),
        F.sum(F.when(F.col("accepted"), length).otherwise(0.0)).alias("seconds"),
    )
    bad = issues.select("video_id", "segment_id").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("bad"))
    contributions = (
        v.where(is_ready(F.col("video_status")))
        .join(by_video, "video_id")
        .join(bad, "video_id", "left")
        .groupBy("project_id")
        .agg(
            F.sum("proposed").alias("proposed_segments"),
            F.sum("accepted").alias("accepted_segments"),
            F.sum("seconds").alias("accepted_duration_sec"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("issue_count"),
        )
    )
    out = (
        projects.select(F.col("id").alias("project_id"), "status")
        .join(counts, "project_id", "left")
        .join(contributions, "project_id", "left")
        .na.fill(0)
    )
    processing = F.col("video_count") - F.col("ready_count") - F.col("failed_count")
    blockers = compact(
        [
            F.when(F.col("status") == "confirmed", F.lit("The project is already confirmed")),
            F.when(F.col("video_count") == 0, F.lit("No videos")),
            F.when(processing > 0, F.lit("Not all videos are processed")),
            F.when(F.col("accepted_segments") == 0, F.lit("No accepted segments")),
            F.when(
                F.col("issue_count") > 0, F.concat(F.lit("Invalid segments: "), F.col("issue_count").cast("string"))
            ),
        ]
    )
    out = out.withColumns({"processing_count": processing, "blockers": blockers})
    return out.withColumn("can_confirm", F.size("blockers") == 0)


# ---- duplicates -------------------------------------------------------------------------------


def find_upload_duplicates(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Stored videos matching files about to be uploaded: match count and earliest match per file.

    Copies collapse to (size, fingerprint, duration) variants before any pairing, so a group of a
    million copies pairs as one row. Files without a match are left out.
    """
    same = ["size_bytes", "fingerprint"]
    stored = (
        videos.where(F.col("status") != "uploading")
        .groupBy(*same, F.col("duration_sec").alias("stored_sec"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "video_id")).alias("first"))
    )
    asked = files.select(*same, F.col("duration_sec").alias("asked_sec")).distinct()
    close = (
        F.col("asked_sec").isNull()
        | F.col("stored_sec").isNull()
        | (F.abs(F.col("stored_sec") - F.col("asked_sec")) <= DURATION_TOLERANCE)
    )
    found = (
        asked.join(stored, same)
        .where(close)
        .groupBy(*same, "asked_sec")
        .agg(F.sum("n").alias("match_count"), F.min("first").alias("first"))
    )
    f, d = files.alias("f"), found.alias("d")
    on = [F.col(f"f.{c}") == F.col(f"d.{c}") for c in same] + [F.col("f.duration_sec").eqNullSafe(F.col("d.asked_sec"))]
    return f.join(d, on).select("f.key", "d.match_count", F.col("d.first.video_id").alias("first_video_id"))


def list_upload_matches(files: DataFrame, videos: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per (file, stored video) for an interactive request, ranked by upload time."""
    v = videos.where(F.col("status") != "uploading").join(
        projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id"
    )
    close = (
        files["duration_sec"].isNull()
        | v["duration_sec"].isNull()
        | (F.abs(v["duration_sec"] - files["duration_sec"]) <= DURATION_TOLERANCE)
    )
    pairs = files.join(
        v, (files["size_bytes"] == v["size_bytes"]) & (files["fingerprint"] == v["fingerprint"]) & close
    )
    return pairs.select("key", "video_id", "project_id", "project_name", "original_filename", "created_at").orderBy(
        "key", "created_at", "video_id"
    )


def find_earlier_duplicate(videos: DataFrame) -> DataFrame:
    """Earliest video with equal content and matching metadata, strictly earlier by (created_at, id).

    Works on distinct metadata variants: each keeps its earliest upload, and a video's answer is the earliest
    upload of its compatible variants. Few variants of one content are paired; of more than ``PAIRED_VARIANTS`` each
    finds its answer in a sweep of its neighbourhood, see ``_sweep``.
    """
    exact = ["content_hash", "size_bytes", "width", "height", "codec", "creation_time"]
    loose = ["duration_sec", "fps"]
    hashed = videos.where(F.col("content_hash").isNotNull())
    variants = hashed.groupBy(*exact, *loose).agg(F.min(F.struct("created_at", "id")).alias("first"))
    content = F.sha2(F.to_json(F.struct(*exact), {"ignoreNullFields": "false"}), 256)
    variants = written_once(variants.withColumn("_content", content))
    sizes = variants.groupBy("_content").agg(F.count(F.lit(1)).alias("_n"))
    many = sizes.where(F.col("_n") > PAIRED_VARIANTS).select("_content")
    few = variants.join(many, "_content", "left_anti")
    a, b = few.alias("a"), few.alias("b")

    def near(name: str, tolerance: float) -> Column:
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        return (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))

    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in exact]
    earliest = (
        a.join(b, on)
        .where(near("duration_sec", DURATION_TOLERANCE) & near("fps", FPS_TOLERANCE))
        .groupBy(*[F.col(f"a.{c}") for c in exact + loose])
        .agg(F.min("b.first").alias("first"))
    )
    swept = _sweep(variants.join(many, "_content", "left_semi"))
    earliest = earliest.unionByName(swept.select(*exact, *loose, "first"))
    v, e = hashed.alias("v"), earliest.alias("e")
    back = [F.col(f"v.{c}").eqNullSafe(F.col(f"e.{c}")) for c in exact + loose]
    return (
        v.join(e, back)
        .where(F.col("e.first") < F.struct("v.created_at", "v.id"))
        .select("v.id", F.col("e.first.id").alias("duplicate_of_id"))
    )


def _sweep(variants: DataFrame) -> DataFrame:
    """Variants with the earliest upload (``first``) of those of the same content within both tolerances.

    Variants are cut into stretches of duration, each with the candidates just outside; a task takes a stretch in the
    order of uploads, so that every variant is settled by the first candidate that reaches it.
    """
    width, cell = DURATION_TOLERANCE * SWEPT_STEPS, F.col("duration_sec") / (DURATION_TOLERANCE * SWEPT_STEPS)
    reach = F.lit(DURATION_TOLERANCE * 1.001 / width)
    home = F.floor(cell)
    around = F.array_distinct(F.array_compact(F.array(home, F.floor(cell - reach), F.floor(cell + reach))))
    placed = variants.withColumn("_home", home).withColumn("_cell", F.explode_outer(around))
    laid = placed.repartition("_content", "_cell").sortWithinPartitions("_content", "_cell", "first")
    at = [laid.columns.index(c) for c in ("_content", "_cell", "_home", "duration_sec", "fps", "first")]
    return laid.mapInArrow(lambda b: _settled(b, at), laid.schema).select(*variants.columns)


def _settled(batches, at: list[int]) -> Iterator[pa.RecordBatch]:
    content, cell, home, duration, fps, first = at
    waiting: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        own = pc.fill_null(pc.equal(table.column(cell), table.column(home)), True)
        values = [np.asarray(pc.cast(table.column(c), pa.float64()).combine_chunks().fill_null(np.nan)) for c in (duration, fps)]
        found = table.column(first).take(pa.array(earliest_within(*values, DURATION_TOLERANCE, FPS_TOLERANCE)))
        yield from table.set_column(first, table.schema.field(first), found).filter(own).to_batches()

    for batch in batches:
        names = list(zip(batch.column(content).to_pylist(), batch.column(cell).to_pylist(), strict=True))
        lo = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[lo]:
                if waiting and (waiting[-1].column(content)[-1].as_py(), waiting[-1].column(cell)[-1].as_py()) != names[lo]:
                    yield from flush()
                    waiting.clear()
                waiting.append(batch.slice(lo, k - lo))
                lo = k
    if waiting:
        yield from flush()


def earliest_within(d: np.ndarray, f: np.ndarray, d_tolerance: float, f_tolerance: float) -> np.ndarray:
    """For each entry the first one (in the given order, itself at the latest) within both tolerances; NaN equals NaN.

    Entries lie in cells of ``f`` and are sorted by ``d`` there. Each entry in turn settles what it reaches and is not
    settled yet; settled entries are skipped for good, so that an entry is settled once and rarely looked at again.
    """
    n = len(d)
    answer = np.full(n, -1, np.int64)
    cells: dict[int | None, tuple[list[int], list[float], list[int]]] = {}
    of = [None if np.isnan(x) else int(np.floor(x / f_tolerance)) for x in f]
    for k in np.argsort(d, kind="stable").tolist():  # NaN last
        ids, values, _ = cells.setdefault(of[k], ([], [], []))
        ids.append(k)
        values.append(d[k])
    for ids, _, following in cells.values():
        following.extend(range(len(ids) + 1))

    def open_from(following: list[int], i: int) -> int:
        root = i
        while following[root] != root:
            root = following[root]
        while following[i] != root:
            following[i], i = root, following[i]
        return root

    for k in range(n):
        x, y, c = d[k], f[k], of[k]
        for near in (None,) if c is None else (c - 2, c - 1, c, c + 1, c + 2):
            if near not in cells:
                continue
            ids, values, following = cells[near]
            if np.isnan(x):
                i = open_from(following, bisect.bisect_left(values, True, key=np.isnan))
            else:
                i = open_from(following, bisect.bisect_left(values, x - 1.001 * d_tolerance))
            while i < len(ids):
                other = ids[i]
                if not np.isnan(x) and not values[i] - x <= d_tolerance:  # NaN ends the search too
                    break
                same_f = c is None or abs(f[other] - y) <= f_tolerance
                if same_f and (np.isnan(x) or abs(values[i] - x) <= d_tolerance):
                    answer[other] = k
                    following[i] = i + 1
                i = open_from(following, i + 1)
    return answer


def duplicate_ref(videos: DataFrame, projects: DataFrame) -> DataFrame:
    """Resolve duplicate_of_id to the target's project and file name; null when it is gone."""
    target = videos.join(
        projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id"
    ).select(
        F.col("id").alias("duplicate_of_id"),
        F.struct(F.col("id").alias("video_id"), "project_id", "project_name", "original_filename").alias("duplicate_of"),
    )
    return videos.join(target, "duplicate_of_id", "left")


def missing_hashes(videos: DataFrame) -> DataFrame:
    return videos.where(
        is_settled(F.col("status"))
        & F.col("stored_path").isNotNull()
        & (F.col("fingerprint").isNull() | F.col("content_hash").isNull())
    )


# ---- review -----------------------------------------------------------------------------------


def review_queue(videos: DataFrame) -> DataFrame:
    return videos.where(is_ready(F.col("status")) & ~F.col("reviewed"))


def next_video(videos: DataFrame) -> DataFrame:
    """Where "next" leads from each video: the first other unreviewed one, else the next ready one.

    Neighbours are found in pieces of the sorted videos, so a project of any size is the work of many tasks.
    """
    rank = F.row_number().over(W.partitionBy("project_id").orderBy("created_at", "id"))
    heads = (
        review_queue(videos)
        .select("project_id", "created_at", "id")
        .withColumn("rank", rank)
        .where(F.col("rank") <= 2)
        .groupBy("project_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("first_id"),
            F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("second_id"),
        )
    )
    sorted_ready = scale.in_pieces(
        videos.where(is_ready(F.col("status"))).select("project_id", "created_at", "id"), ["project_id"], ["created_at", "id"]
    )
    ready = scale.with_neighbours(sorted_ready, ["project_id"], ["_at"], F.col("_piece"), ["id"])
    ready = ready.select("id", F.col("next.id").alias("following"))
    other = F.when(F.col("first_id") != F.col("id"), F.col("first_id")).otherwise(F.col("second_id"))
    return (
        videos.join(heads, "project_id", "left")
        .join(ready, "id", "left")
        .select("id", "project_id", F.coalesce(other, F.col("following")).alias("next_id"))
    )


def selection_totals(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Accepted count and duration of a selection, per video."""
    chosen = segments.join(ids.select("id"), "id", "left_semi")
    return chosen.groupBy("video_id").agg(
        F.count_if("accepted").alias("accepted"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("seconds")
    )


def processing_total(videos: DataFrame) -> DataFrame:
    return videos.groupBy("project_id").agg(F.count_if(~is_settled(F.col("status"))).alias("processing"))


def reanalysis_counts(videos: DataFrame, cache: DataFrame, fps: float) -> DataFrame:
    """Ready videos that can be re-segmented from cached features and those that need extraction."""
    known = cache.select("video_id", "analysis_fps")
    joined = videos.where(is_ready(F.col("status"))).join(known, F.col("id") == F.col("video_id"), "left")
    reusable = F.coalesce(F.col("analysis_fps") == fps, F.lit(False))
    return joined.groupBy("project_id").agg(
        F.count_if(reusable).alias("segmented"), F.count_if(~reusable).alias("queued")
    )


# ---- maintenance ------------------------------------------------------------------------------


def upsert_latest(table: DataFrame, updates: DataFrame, key: list[str], version: str) -> DataFrame:
    """Insert or replace by key; the newest version wins. max_by combines on the map side.

    A null version is older than any other; of equal versions an update replaces the stored row, and
    equal updates are ordered by their values.
    """
    rows = table.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)))
    rest = [c for c in rows.columns if c not in (*key, "_side")]
    order = F.struct(F.col(version).isNotNull(), F.col(version), "_side", F.to_json(F.struct(*rest)))
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return latest.select(*key, "_row.*").select(*table.columns)


def cascade_delete(catalog: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove projects with everything below them; dangling duplicate pointers become null.

    The ids of removed videos are hashed partition by partition, and what they are looked up for streams past: no task
    sorts its share of segments or videos.
    """
    gone = project_ids.select(F.col("id").alias("project_id"))
    out = dict(catalog)
    out["projects"] = catalog["projects"].join(gone, F.col("id") == F.col("project_id"), "left_anti")
    removed = catalog["videos"].join(gone, "project_id", "left_semi").select(F.col("id").alias("video_id"))
    kept = catalog["videos"].join(gone, "project_id", "left_anti")
    if "duplicate_of_id" in kept.columns:
        lost = removed.select(F.col("video_id").alias("duplicate_of_id"), F.lit(True).alias("_lost"))
        kept = (
            kept.join(lost.hint("shuffle_hash"), "duplicate_of_id", "left")
            .withColumn("duplicate_of_id", F.when(F.col("_lost").isNull(), F.col("duplicate_of_id")))
            .select(*catalog["videos"].columns)
        )
    out["videos"] = kept
    out["segments"] = catalog["segments"].join(removed.hint("shuffle_hash"), "video_id", "left_anti")
    if "export_jobs" in catalog:
        jobs = catalog["export_jobs"].join(gone, "project_id", "left_semi").select("job_id")
        out["export_jobs"] = catalog["export_jobs"].join(gone, "project_id", "left_anti")
        out["export_clips"] = catalog["export_clips"].join(jobs, "job_id", "left_anti")
    return out


def build_manifest_rows(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """Accepted segments of ready videos on the frame grid, one row per segment.

    Times are recomputed from the frames; videos without accepted segments do not appear.
    """
    v = videos.where(is_ready(F.col("status"))).select(
        F.col("id").alias("video_id"), "project_id", "original_filename", "duration_sec", "fps", "width", "height",
        "created_at",
    )
    start, end = (F.floor(F.col(c) * F.col("fps") + 0.5) for c in ("start_sec", "end_sec"))
    return (
        segments.where("accepted")
        .withColumnRenamed("id", "segment_id")
        .join(v, "video_id")
        .withColumns({"start_frame": start, "end_frame": end})
        .withColumns({"start_sec": F.col("start_frame") / F.col("fps"), "end_sec": F.col("end_frame") / F.col("fps")})
    )


def manifest_violations(rows: DataFrame) -> DataFrame:
    """Rows a manifest must not contain, with the field and the reason."""
    checks = compact(
        [
            F.when(F.col("start_sec") < 0, F.lit("startSec: must not be negative")),
            F.when(F.col("end_sec") <= 0, F.lit("endSec: must be positive")),
            F.when(~F.col("score").between(0, 1), F.lit("score: must be within 0..1")),
            F.when(~F.col("origin").isin("ai", "user"), F.lit("origin: unknown value")),
            F.when(F.col("fps") <= 0, F.lit("fps: must be positive")),
            F.when(F.col("duration_sec") <= 0, F.lit("durationSec: must be positive")),
        ]
    )
    return scale.explode_present(rows, "violation", checks).select("segment_id", "violation")


def videos_of_export(clips: DataFrame, videos: DataFrame) -> DataFrame:
    """Distinct videos used by the clips."""
    used = clips.select(F.col("video_id").alias("id")).distinct()
    return videos.join(used, "id", "left_semi")


def project_state_transition(projects: DataFrame, actions: DataFrame, summary: DataFrame) -> DataFrame:
    """Apply confirm / reopen / edit requests; refused ones carry the reason."""
    joined = (
        actions.join(projects.select(F.col("id").alias("project_id"), "status"), "project_id")
        .join(summary.select("project_id", "can_confirm", "blockers"), "project_id", "left")
    )
    confirmed = F.col("status") == "confirmed"
    action = F.col("action")
    error = (
        F.when((action == "confirm") & confirmed, "The project is confirmed and read-only")
        .when(
            (action == "confirm") & ~F.coalesce("can_confirm", F.lit(False)),
            F.concat(F.lit("Cannot confirm: "), F.array_join("blockers", "; ")),
        )
        .when((action == "reopen") & ~confirmed, "The project is not confirmed")
        .when((action == "edit") & confirmed, "The project is confirmed and read-only")
    )
    done = F.col("error").isNull()
    return joined.withColumn("error", error).select(
        "project_id",
        "action",
        F.when(done & (action == "confirm"), "confirmed")
        .when(done & (action == "reopen"), "draft")
        .otherwise(F.col("status"))
        .alias("status"),
        # Confirming and reopening both discard an earlier export; reopening drops the manifest too.
        (done & action.isin("confirm", "reopen")).alias("discard_export"),
        (done & (action == "reopen")).alias("remove_manifest"),
        "error",
    )
