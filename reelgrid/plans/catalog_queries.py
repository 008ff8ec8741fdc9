"""Registered queries over projects, videos, segments, clips and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import motion as M
from ..operators import catalog as C
from ..operators import clips as K
from ..operators import intervals as I
from ..operators import motion as OM
from ..operators import segments as OS
from ..operators import storage as S
from ..session import shared_path
from ..sources import tables as ST
from . import bindings as B
from .bindings import duck, duck_six, six
from .motion_queries import _SMOOTHED

_MOTION_SQL = "['" + "', '".join(M.MOTION_TYPES) + "']"


def _segments(spark, sf):
    names = F.array(*[F.lit(m) for m in M.MOTION_TYPES])
    named = F.element_at(names, F.col("motion_code").cast("int") + 1)
    return B.segments(spark, sf).withColumn("motion_type", named)


def _settings(spark, sf):
    return B.projects(spark, sf).select(F.col("id").alias("project_id"), "min_duration", "max_duration")


def _issues(spark, sf):
    return I.segment_issues(B.segments(spark, sf), B.videos(spark, sf), _settings(spark, sf))


def segments_joined(spark, sf):
    return C.segments_with_context(B.segments(spark, sf), B.videos(spark, sf), B.projects(spark, sf)).select(
        "id", "video_id", "project_id", "project_name", "video_status", six("start_sec").alias("start_sec")
    )


def project_overview(spark, sf):
    out = C.project_overview(B.projects(spark, sf), B.videos(spark, sf), B.segments(spark, sf))
    pairs = F.transform(
        F.array_sort(F.map_entries("status_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return out.select(
        "project_id", "name", "video_count", "reviewed_count", "segment_count", "accepted_segments",
        F.array_join(pairs, ",").alias("status_counts"),
        F.array_join(F.col("previews").cast("array<string>"), ",").alias("previews"),
    )


def project_summary(spark, sf):
    out = C.project_summary(B.projects(spark, sf), B.videos(spark, sf), B.segments(spark, sf), _issues(spark, sf))
    return out.select(
        "project_id", "video_count", "ready_count", "failed_count", "processing_count", "proposed_segments",
        "accepted_segments", six("accepted_duration_sec").alias("accepted_duration_sec"), "issue_count",
        "can_confirm", F.array_join("blockers", "; ").alias("blockers"),
    )


def segment_issues(spark, sf):
    return _issues(spark, sf).select("segment_id", "video_id", "kind")


def reconcile_segments(spark, sf):
    """Current segments against proposals shifted by 20 s with two thirds of the length."""
    segments = B.segments(spark, sf)
    length = F.col("end_sec") - F.col("start_sec")
    proposals = segments.withColumns(
        {
            "id": F.concat(F.lit("p-"), F.col("id")),
            "start_sec": F.col("start_sec") + 20,
            "end_sec": F.col("start_sec") + 20 + length * 2 / 3,
            "origin": F.lit("ai"),
            "edited": F.lit(False),
        }
    )
    return I.reconcile_segments(segments, proposals).select(
        "id", "video_id", six("start_sec").alias("start_sec"), six("end_sec").alias("end_sec"), "origin"
    )


def _metrics(spark, sf):
    layout = B.features_layout(spark, sf)
    signals = OM.motion_signals(B.frame_features(spark, sf), B.SETTINGS, layout)
    return OS.motion_series(signals, B.SETTINGS)


def _short_segments(spark, sf):
    """Segments moved onto the first seconds of their video, where the derived samples are."""
    return B.segments(spark, sf).withColumns(
        {"end_sec": F.pmod("start_sec", F.lit(9.0)) + 2 + F.pmod("end_sec", F.lit(5.0)), "start_sec": F.pmod("start_sec", F.lit(9.0))}
    )


def dominant_motion(spark, sf):
    metrics = _metrics(spark, sf)
    segs = I.segment_motion(_short_segments(spark, sf), metrics)
    return segs.select("id", "video_id", "motion_type", "smoothness")


def segment_at(spark, sf):
    points = B.frame_features(spark, sf).select("video_id", F.col("event_id").alias("point_id"), "t")
    return I.segment_at(points, _short_segments(spark, sf))


def merge_segments(spark, sf):
    segs = B.segments(spark, sf).withColumns(
        {
            "reasons": F.array(F.concat(F.lit("origin "), F.col("origin")), F.concat(F.lit("class "), F.col("motion_code").cast("string"))),
        }
    )
    segs = segs.withColumn("motion_type", F.col("motion_code"))
    # Rank of the id text stands in for the list position.
    segs = segs.withColumn("pos", F.xxhash64("id"))
    groups = segs.select(F.concat(F.col("video_id").cast("string"), F.lit("/"), (F.col("motion_code") % 2).cast("string")).alias("group_id"), "id")
    out = I.merge_segments(segs, groups)
    return out.select(
        "group_id", six("start_sec").alias("start_sec"), six("end_sec").alias("end_sec"), "origin", "accepted",
        F.array_join(F.array_sort("reasons"), ";").alias("reasons"),
    )


def segment_edits(spark, sf):
    segs = _segments(spark, sf)
    code = F.col("motion_code")
    edits = segs.select(
        "video_id",
        "id",
        F.when(code == 0, "remove").when(code == 1, "bounds").when(code == 2, "accept").when(code == 3, "split")
        .when(code == 4, "retype").alias("op"),
        (F.col("start_sec") + 1.01).alias("start_sec"),
        (F.col("end_sec") - 0.52).alias("end_sec"),
        ((F.col("start_sec") + F.col("end_sec")) / 2).alias("at_sec"),
        F.lit("static").alias("motion_type"),
    ).where("op IS NOT NULL")
    out = I.apply_segment_edits(segs, edits, B.videos(spark, sf))
    return out.select(
        "id", "video_id", six("start_sec").alias("start_sec"), six("end_sec").alias("end_sec"), "motion_type",
        "accepted", "edited",
    )


def record_violations(spark, sf):
    return I.record_violations(_segments(spark, sf), B.videos(spark, sf)).select("id", "violation")


def replace_segments(spark, sf):
    segs = _segments(spark, sf)
    incoming = segs.where("origin = 'ai'").withColumn("start_sec", F.col("start_sec") + 0.25)
    kept, _ = I.replace_segments(segs, incoming, B.videos(spark, sf))
    return kept.select("id", "video_id", six("start_sec").alias("start_sec"))


def manifest(spark, sf):
    rows = C.build_manifest_rows(B.videos(spark, sf), B.segments(spark, sf))
    return rows.select(
        "segment_id", "video_id", "project_id", "start_frame", "end_frame", six("start_sec").alias("start_sec"),
        six("end_sec").alias("end_sec"),
    )


def _prints(spark, sf):
    return B.fingerprints(spark, sf).select(
        F.col("id").alias("video_id"), "project_id", "size_bytes", F.col("content_hash").alias("fingerprint"),
        "duration_sec", F.col("created_ord").alias("created_at"), F.lit("ready").alias("status"),
    )


def upload_duplicates(spark, sf):
    stored = _prints(spark, sf)
    files = stored.select(F.col("video_id").alias("key"), "size_bytes", "fingerprint", "duration_sec")
    return C.find_upload_duplicates(files, stored)


def _hashed(spark, sf):
    return B.fingerprints(spark, sf).withColumns(
        {
            "created_at": F.col("created_ord"), "width": F.lit(3840), "height": F.lit(2160), "codec": F.lit("hevc"),
            "fps": F.lit(30.0), "creation_time": F.lit(None).cast("string"),
            "original_filename": F.concat(F.lit("DJI_"), F.col("id").cast("string")),
        }
    )


def earlier_duplicate(spark, sf):
    return C.find_earlier_duplicate(_hashed(spark, sf))


def duplicate_ref(spark, sf):
    videos = _hashed(spark, sf)
    linked = videos.join(C.find_earlier_duplicate(videos), "id", "left")
    projects = videos.select(F.col("project_id").alias("id"), F.upper("project_id").alias("name")).distinct()
    return C.duplicate_ref(linked, projects).select(
        "id", F.col("duplicate_of.video_id").alias("target_id"), F.col("duplicate_of.project_name").alias("target_project"),
        F.col("duplicate_of.original_filename").alias("target_file"),
    )


def _files(spark, sf):
    return B.file_inventory(spark, sf)


def storage_usage(spark, sf):
    return S.storage_usage(_files(spark, sf))


def cleanup_plan(spark, sf):
    return S.cleanup_plan(_files(spark, sf), B.shared(spark, sf, "jobs"), B.shared(spark, sf, "clips"))


def freed_files(spark, sf):
    files = _files(spark, sf).withColumn("path", F.concat("path", F.lit("#"), F.col("file_id").cast("string")))
    doomed = S.cleanup_files(_files(spark, sf), B.shared(spark, sf, "jobs")).select("file_id")
    after = files.join(doomed, "file_id", "left_anti")
    building = B.shared(spark, sf, "jobs").where("build_status = 'building'")
    return S.freed_files(files, after, building).select("file_id", "bytes")


def file_owners(spark, sf):
    """Files of every video, job and clip of the catalog, resolved back to their project."""
    videos, jobs = B.videos(spark, sf), B.shared(spark, sf, "jobs")
    clips = B.shared(spark, sf, "clips")
    jobs = jobs.withColumns(
        {"archive_dir": F.concat(F.lit("/data/exports/e"), F.col("job_id").cast("string")), "archive_zip": F.lit(None).cast("string")}
    )
    v, j, c = (F.col(n).cast("string") for n in ("id", "job_id", "clip_id"))
    files = (
        videos.select(F.concat(F.lit("videos/"), v, F.lit("/source.mp4")).alias("path"), F.col("size_bytes").alias("bytes"))
        .unionByName(jobs.select(F.concat(F.lit("exports/e"), j, F.lit("/csv/x.csv")).alias("path"), F.lit(10).cast("bigint").alias("bytes")))
        .unionByName(jobs.select(F.concat(F.lit("export-work/"), j, F.lit("/c/cut.mov")).alias("path"), F.lit(20).cast("bigint").alias("bytes")))
        .unionByName(clips.select(F.concat(F.lit("llm-logs/"), c, F.lit("_a1.json")).alias("path"), F.lit(5).cast("bigint").alias("bytes")))
    )
    owned = S.classified(S.assign_owner(files, videos.select("id", "project_id"), jobs, clips.select("clip_id", "job_id")))
    return owned.groupBy("project_id", "category", "reclaimable").agg(F.sum("bytes").alias("bytes"))


def distinct_files(spark, sf):
    """Each physical file seen under a work name and an archive name counts once, under the work name."""
    base = _files(spark, sf).select(F.col("file_id").alias("file_key"), "bytes")
    listing = base.withColumn("path", F.lit("exports/a/videos/x.mov")).unionByName(
        base.withColumn("path", F.lit("export-work/j/c/cut.mov"))
    )
    return S.distinct_files(listing).select("file_key", "path", "bytes")


def job_progress(spark, sf):
    out = K.job_progress(B.shared(spark, sf, "clips"))
    return out.select("job_id", "total", "excluded", *[f"n_{s}" for s in C.CLIP_STATUSES], six("progress").alias("progress"), "can_build")


def work_list(spark, sf):
    return K.work_list(B.shared(spark, sf, "clips")).select("clip_id", "queue")


def clip_labels(spark, sf):
    return B.shared(spark, sf, "clips").select("clip_id", K.clip_status_label().alias("label"))


def _with_hashes(spark, sf):
    clips = B.shared(spark, sf, "clips")
    return clips.withColumn(
        "step_hashes",
        F.when(F.col("motion_code") >= 3, F.create_map(F.lit("frames"), F.lit("f1"), F.lit("tech"), F.lit("t1"), F.lit("llm"), F.lit("m1")))
        .otherwise(F.create_map(F.lit("frames"), F.lit("f1"))),
    ).withColumns({"user_hint": F.lit(None).cast("string"), "poi_override": F.lit(None).cast("string")})


def state_transitions(spark, sf):
    clips = _with_hashes(spark, sf)
    pick = F.pmod(F.floor("start_sec"), F.lit(6))
    actions = clips.select(
        "clip_id",
        F.when(pick == 0, "approve").when(pick == 1, "exclude").when(pick == 2, "include").when(pick == 3, "retry")
        .when(pick == 4, "regenerate").otherwise("rerun").alias("action"),
        F.lit("geo").alias("step"), F.lit("  hint ").alias("hint"), F.lit(" ").alias("poi_name"),
    )
    return K.clip_state_transition(clips, actions).select(
        "clip_id", "action", "status", "failed_step", six("progress").alias("progress"), "excluded", "approved",
        "user_hint", F.array_join(F.array_sort(F.map_keys("step_hashes")), ",").alias("hashes"), "error",
    )


def stale_steps(spark, sf):
    clips = B.shared(spark, sf, "clips")
    now = clips.select("clip_id", F.lit("cut").alias("step"), K.step_hash(F.lit("cut.v1"), F.col("start_sec"), F.col("end_sec")).alias("input_hash"))
    # Stored hashes: a third was computed with another end, another third lost its output.
    turn = F.pmod(F.floor("start_sec"), F.lit(3))
    old_end = F.when(turn == 1, F.col("end_sec") + 1).otherwise(F.col("end_sec"))
    stored = clips.select(
        "clip_id", F.lit("cut").alias("step"),
        K.step_hash(F.lit("cut.v1"), F.col("start_sec"), old_end).alias("hash"), (turn != 2).alias("complete"),
    )
    return K.step_outcomes(now, stored).select("clip_id", F.coalesce("next_status", F.lit("stale")).alias("outcome"))


def new_clips(spark, sf):
    rows = C.build_manifest_rows(B.videos(spark, sf), B.segments(spark, sf)).withColumn("job_id", F.col("project_id"))
    existing = rows.where("motion_code < 4").select("job_id", "segment_id")
    fresh = K.new_clips(rows, existing, ["created_at", "video_id", "start_sec", "segment_id"])
    return fresh.select("job_id", "segment_id", "ordinal")


def videos_of_export(spark, sf):
    clips = B.shared(spark, sf, "clips").where("status = 'done'")
    return C.videos_of_export(clips, B.videos(spark, sf)).select("id", "original_filename")


def missing_hashes(spark, sf):
    v = B.videos(spark, sf).withColumns(
        {
            "stored_path": F.when(F.col("id") % 4 != 0, F.col("original_filename")),
            "fingerprint": F.when(F.col("id") % 3 != 0, F.lit("fp")),
            "content_hash": F.when(F.col("id") % 5 != 0, F.lit("h")),
        }
    )
    return C.missing_hashes(v).select("id")


def next_video(spark, sf):
    return C.next_video(B.videos(spark, sf))


def review_queue(spark, sf):
    return C.review_queue(B.videos(spark, sf)).select("id", "project_id")


def selection_totals(spark, sf):
    segs = B.segments(spark, sf)
    out = C.selection_totals(segs, segs.where("origin = 'ai'"))
    return out.select("video_id", "accepted", six("seconds").alias("seconds"))


def processing_total(spark, sf):
    return C.processing_total(B.videos(spark, sf))


def reanalysis_counts(spark, sf):
    cache = B.table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.when(F.col("user_id") % 3 == 0, 10.0).otherwise(5.0).alias("analysis_fps")
    ).distinct()
    return C.reanalysis_counts(B.videos(spark, sf), cache, 5.0)


def upsert_latest(spark, sf):
    events = B.table(spark, sf, "events").select("user_id", "event_id", "value")
    table, updates = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return C.upsert_latest(table, updates, ["user_id"], "event_id")


def cascade_delete(spark, sf):
    catalog = {
        "projects": B.projects(spark, sf),
        "videos": B.videos(spark, sf).withColumn("duplicate_of_id", F.when(F.col("id") % 7 == 0, F.col("id") - 1)),
        "segments": B.segments(spark, sf),
    }
    left = C.cascade_delete(catalog, catalog["projects"].where("status = 'confirmed'"))
    return (
        left["videos"].select(F.lit("video").alias("kind"), F.col("id").cast("string").alias("id"), F.col("duplicate_of_id").alias("link"))
        .unionByName(left["projects"].select(F.lit("project").alias("kind"), F.col("id").cast("string").alias("id"), F.lit(None).cast("bigint").alias("link")))
        .unionByName(left["segments"].select(F.lit("segment").alias("kind"), "id", F.lit(None).cast("bigint").alias("link")))
    )


def _as_stored(df, name):
    """A derived table with the stored columns and types."""
    fields = df.sparkSession.createDataFrame([], schemas.CATALOG[name]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def stored_catalog(spark, sf):
    """The catalog stored, confirmed projects deleted from the store, and what is left read back."""
    videos = B.videos(spark, sf).withColumn("duplicate_of_id", F.when(F.col("id") % 7 == 0, F.col("id") - 1))
    tables = {"projects": B.projects(spark, sf), "videos": videos, "segments": B.segments(spark, sf)}
    path = shared_path(spark, "catalog")
    ST.write_catalog({n: _as_stored(df, n) for n, df in tables.items()}, path)
    confirmed = tables["projects"].where("status = 'confirmed'").select(F.col("id").cast("string").alias("project_id"))
    ST.delete_projects(spark, path, confirmed)
    left = ST.read_catalog(spark, path, ["projects", "videos", "segments"])
    kind = lambda name, text, link: left[name].select(F.lit(text).alias("kind"), "id", link.cast("bigint").alias("link"))
    return (
        kind("videos", "video", F.col("duplicate_of_id"))
        .unionByName(kind("projects", "project", F.lit(None)))
        .unionByName(kind("segments", "segment", F.lit(None)))
    )


def largest_projects(spark, sf):
    """The ten projects that take the most room."""
    return S.largest_projects(S.storage_usage(_files(spark, sf))).select("project_id", "total_bytes").limit(10)


def project_transitions(spark, sf):
    projects = B.projects(spark, sf)
    summary = C.project_summary(projects, B.videos(spark, sf), B.segments(spark, sf), _issues(spark, sf))
    pick = F.col("id") % 3
    actions = projects.select(
        F.col("id").alias("project_id"), F.when(pick == 0, "confirm").when(pick == 1, "reopen").otherwise("edit").alias("action")
    )
    return C.project_state_transition(projects, actions, summary)


def listing_order(spark, sf):
    """Position of every project in the listing (newest first, id as tie break)."""
    from ..operators import scale

    day = -F.datediff("created_on", F.lit("2024-01-01").cast("date"))
    p = B.projects(spark, sf).withColumns({"all": F.lit(1), "age": day})
    ranked = scale.dense_rank_in_order(p, ["all"], ["age", "id"], F.col("age"), "position")
    return ranked.select("id", "position")


QUERIES = {
    f.__name__: f
    for f in (
        segments_joined, project_overview, project_summary, segment_issues, reconcile_segments, dominant_motion,
        segment_at, merge_segments, segment_edits, record_violations, replace_segments, manifest, upload_duplicates,
        earlier_duplicate, duplicate_ref, storage_usage, cleanup_plan, freed_files, file_owners, distinct_files,
        job_progress, work_list, clip_labels, state_transitions, stale_steps, new_clips, videos_of_export,
        missing_hashes, next_video, review_queue, selection_totals, processing_total, reanalysis_counts,
        upsert_latest, cascade_delete, stored_catalog, largest_projects, project_transitions, listing_order,
    )
}

_ISSUES = f"""{duck("projects", "videos", "segments")},
acc AS (SELECT s.*, v.duration_sec, v.project_id, p.min_duration, p.max_duration FROM segments s
  JOIN videos v ON s.video_id = v.id JOIN projects p ON v.project_id = p.id WHERE accepted),
nb AS (SELECT id, video_id, start_sec, end_sec, lag(end_sec) OVER w AS prev_end, lead(start_sec) OVER w AS next_start
  FROM segments WHERE accepted WINDOW w AS (PARTITION BY video_id ORDER BY start_sec, id)),
issues AS (
  SELECT id AS segment_id, video_id, 'too_short' AS kind FROM acc WHERE end_sec - start_sec < min_duration - 1e-3
  UNION ALL SELECT id, video_id, 'too_long' FROM acc WHERE end_sec - start_sec > max_duration + 1e-3
  UNION ALL SELECT id, video_id, 'out_of_bounds' FROM acc WHERE start_sec < -1e-3 OR end_sec > duration_sec + 1e-3
  UNION ALL SELECT id, video_id, 'overlap' FROM nb WHERE start_sec < prev_end - 1e-3
  UNION ALL SELECT id, video_id, 'overlap' FROM nb WHERE next_start < end_sec - 1e-3)"""

_SUMMARY = f"""{_ISSUES},
vc AS (SELECT project_id, count(*) AS video_count, count(*) FILTER (WHERE status = 'ready') AS ready_count,
  count(*) FILTER (WHERE status = 'failed') AS failed_count FROM videos GROUP BY 1),
sc AS (SELECT v.project_id, count(*) AS proposed, count(*) FILTER (WHERE accepted) AS accepted_n,
  coalesce(sum(end_sec - start_sec) FILTER (WHERE accepted), 0) AS secs
  FROM segments s JOIN videos v ON s.video_id = v.id WHERE v.status = 'ready' GROUP BY 1),
ic AS (SELECT v.project_id, count(DISTINCT segment_id) AS n FROM issues i JOIN videos v ON i.video_id = v.id
  WHERE v.status = 'ready' GROUP BY 1),
b AS (SELECT p.id AS project_id, p.status, coalesce(video_count, 0) AS video_count, coalesce(ready_count, 0) AS ready_count,
  coalesce(failed_count, 0) AS failed_count, coalesce(proposed, 0) AS proposed_segments,
  coalesce(accepted_n, 0) AS accepted_segments, coalesce(secs, 0e0) AS secs, coalesce(ic.n, 0) AS issue_count
  FROM projects p LEFT JOIN vc ON p.id = vc.project_id LEFT JOIN sc ON p.id = sc.project_id LEFT JOIN ic ON p.id = ic.project_id),
summary AS (SELECT *, video_count - ready_count - failed_count AS processing_count,
  concat_ws('; ', CASE WHEN status = 'confirmed' THEN 'The project is already confirmed' END,
    CASE WHEN video_count = 0 THEN 'No videos' END,
    CASE WHEN video_count > ready_count + failed_count THEN 'Not all videos are processed' END,
    CASE WHEN accepted_segments = 0 THEN 'No accepted segments' END,
    CASE WHEN issue_count > 0 THEN 'Invalid segments: ' || issue_count END) AS blockers FROM b)"""

_SHORT = """short AS (SELECT id, video_id, start_sec % 9 AS start_sec, start_sec % 9 + 2 + end_sec % 5 AS end_sec FROM segments)"""

_CATEGORY = """cat AS (SELECT *, CASE file_id % 8 WHEN 0 THEN 'sources' WHEN 1 THEN 'proxies' WHEN 2 THEN 'analysis'
    WHEN 3 THEN 'encodedClips' WHEN 4 THEN 'frames' WHEN 5 THEN 'archives' WHEN 6 THEN 'aiLogs' ELSE 'uploads' END AS category,
  CASE file_id % 8 WHEN 3 THEN true WHEN 4 THEN project_id IS NULL WHEN 5 THEN true WHEN 7 THEN true ELSE false END AS reclaim
  FROM file_inventory)"""

_DOOMED = f"""{duck("projects", "file_inventory", "jobs")}, {_CATEGORY},
doomed AS (
  SELECT c.* FROM cat c JOIN jobs j ON c.project_id = j.project_id
  WHERE category IN ('encodedClips', 'archives') AND build_status <> 'building'
  UNION ALL SELECT * FROM cat WHERE project_id IS NULL AND reclaim
    AND NOT (path LIKE '%.part' AND (SELECT count(*) FROM jobs WHERE build_status = 'building') > 0))"""

_sums = ", ".join(
    f"CAST(coalesce(sum(bytes) FILTER (WHERE category = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in S.CATEGORIES
)
_usage = f"""CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(coalesce(sum(bytes) FILTER (WHERE reclaim), 0) AS BIGINT) AS reclaimable_bytes, {_sums}"""
_statuses = ", ".join(f"count(*) FILTER (WHERE NOT excluded AND status = '{s}') AS n_{s}" for s in C.CLIP_STATUSES)

ORACLES = {
    "segments_joined": f"""WITH {duck("projects", "videos", "segments")}
SELECT s.id, video_id, project_id, p.name AS project_name, v.status AS video_status, {duck_six("start_sec")} AS start_sec
FROM segments s JOIN videos v ON s.video_id = v.id JOIN projects p ON v.project_id = p.id""",
    "project_overview": f"""WITH {duck("projects", "videos", "segments")},
v AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE reviewed) AS r FROM videos GROUP BY 1),
st AS (SELECT project_id, string_agg(status || '=' || n, ',' ORDER BY status) AS t FROM
  (SELECT project_id, status, count(*) AS n FROM videos GROUP BY 1, 2) GROUP BY 1),
pv AS (SELECT project_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS t FROM
  (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS rn FROM videos) WHERE rn <= 4 GROUP BY 1),
sg AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE accepted) AS a FROM segments s JOIN videos v ON s.video_id = v.id GROUP BY 1)
SELECT p.id AS project_id, name, coalesce(v.n, 0) AS video_count, coalesce(v.r, 0) AS reviewed_count,
  coalesce(sg.n, 0) AS segment_count, coalesce(sg.a, 0) AS accepted_segments, coalesce(st.t, '') AS status_counts, coalesce(pv.t, '') AS previews
FROM projects p LEFT JOIN v ON p.id = v.project_id LEFT JOIN st ON p.id = st.project_id
  LEFT JOIN pv ON p.id = pv.project_id LEFT JOIN sg ON p.id = sg.project_id""",
    "project_summary": f"""WITH {_SUMMARY}
SELECT project_id, video_count, ready_count, failed_count, processing_count, proposed_segments, accepted_segments,
  {duck_six("secs")} AS accepted_duration_sec, issue_count, blockers = '' AS can_confirm, blockers FROM summary""",
    "segment_issues": f"WITH {_ISSUES} SELECT segment_id, video_id, kind FROM issues",
    "reconcile_segments": f"""WITH {duck("segments")},
kept AS (SELECT * FROM segments WHERE origin = 'user' OR edited),
prop AS (SELECT 'p-' || id AS id, video_id, start_sec + 20 AS start_sec, start_sec + 20 + (end_sec - start_sec) * 2 / 3 AS end_sec, 'ai' AS origin FROM segments)
SELECT id, video_id, {duck_six("start_sec")} AS start_sec, {duck_six("end_sec")} AS end_sec, origin FROM kept
UNION ALL
SELECT id, video_id, {duck_six("start_sec")}, {duck_six("end_sec")}, origin FROM prop p
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.video_id = p.video_id AND k.start_sec < p.end_sec AND p.start_sec < k.end_sec)""",
    "dominant_motion": f"""WITH {_SMOOTHED}, {duck("segments")}, {_SHORT},
series AS (SELECT video_id, i, floor((t + 1e-1) * 1000 + 5e-1) / 1000 AS t, label, floor(least(1e0, greatest(0e0, smooth_fit)) * 1000 + 5e-1) / 1000 AS f FROM s),
inside AS (SELECT short.id, label, i, f FROM short JOIN series ON short.video_id = series.video_id AND series.t >= start_sec AND series.t < end_sec),
top AS (SELECT id, label, count(*) AS n, min(i) AS first_i FROM inside GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(i)) = 1),
calm AS (SELECT id, floor(sum(floor(f * 1000 + 5e-1)) / (count(*) * 1000) * 100 + 5e-1) / 100 AS smoothness FROM inside GROUP BY 1)
SELECT short.id, video_id, CASE WHEN label IS NULL OR label = 'erratic' THEN 'forward' ELSE label END AS motion_type, coalesce(smoothness, 0e0) AS smoothness
FROM short LEFT JOIN top ON short.id = top.id LEFT JOIN calm ON short.id = calm.id""",
    "segment_at": f"""WITH {duck("frame_features", "segments")}, {_SHORT}
SELECT point_id, segment_id FROM (
  SELECT f.event_id AS point_id, s.id AS segment_id,
    row_number() OVER (PARTITION BY f.event_id ORDER BY s.end_sec - s.start_sec, s.start_sec, s.id) AS rn
  FROM frame_features f JOIN short s ON f.video_id = s.video_id AND f.t >= s.start_sec AND f.t < s.end_sec) WHERE rn = 1""",
    "merge_segments": f"""WITH {duck("segments")},
g AS (SELECT *, video_id || '/' || motion_code % 2 AS group_id FROM segments),
r AS (SELECT group_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM (
  SELECT DISTINCT group_id, 'origin ' || origin AS reason FROM g UNION SELECT DISTINCT group_id, 'class ' || motion_code FROM g) GROUP BY 1)
SELECT group_id, {duck_six("min(start_sec)")} AS start_sec, {duck_six("max(end_sec)")} AS end_sec,
  CASE WHEN bool_and(origin = 'ai') THEN 'ai' ELSE 'user' END AS origin, bool_or(accepted) AS accepted, any_value(r.reasons) AS reasons
FROM g JOIN r USING (group_id) GROUP BY group_id HAVING count(*) >= 2""",
    "segment_edits": f"""WITH {duck("videos", "segments")},
s AS (SELECT s.*, {_MOTION_SQL}[motion_code + 1] AS motion_type, v.fps, v.duration_sec FROM segments s JOIN videos v ON s.video_id = v.id),
acc AS (SELECT video_id, bool_or(NOT accepted) AS target FROM s WHERE motion_code = 2 GROUP BY 1),
b AS (SELECT *, greatest(0e0, floor((start_sec + 101e-2) * fps + 5e-1) / fps) AS ns,
    least(duration_sec, floor((end_sec - 52e-2) * fps + 5e-1) / fps) AS ne,
    greatest(0e0, floor((end_sec - 52e-2) * fps + 5e-1) / fps) AS ns_rev,
    least(duration_sec, floor((start_sec + 101e-2) * fps + 5e-1) / fps) AS ne_rev,
    floor((start_sec + end_sec) / 2 * fps + 5e-1) / fps AS cut FROM s),
m AS (SELECT *, CASE WHEN start_sec + 101e-2 <= end_sec - 52e-2 THEN ns ELSE ns_rev END AS bs,
    CASE WHEN start_sec + 101e-2 <= end_sec - 52e-2 THEN ne ELSE ne_rev END AS be FROM b),
x AS (SELECT *, motion_code = 1 AND be - bs >= 1 / fps / 2 AND NOT (bs = start_sec AND be = end_sec) AS moved,
    motion_code = 3 AND cut > start_sec AND cut < end_sec AS cutting,
    motion_code = 4 AND motion_type <> 'static' AS retyped FROM m WHERE motion_code <> 0),
o AS (
  SELECT id, video_id, CASE WHEN moved THEN bs ELSE start_sec END AS start_sec,
    CASE WHEN moved THEN be WHEN cutting THEN cut ELSE end_sec END AS end_sec, * EXCLUDE (id, video_id, start_sec, end_sec) FROM x
  UNION ALL
  SELECT id || '/' || CAST(floor(cut * fps + 5e-1) AS BIGINT), video_id, cut, end_sec, * EXCLUDE (id, video_id, start_sec, end_sec) FROM x WHERE cutting)
SELECT id, o.video_id, {duck_six("start_sec")} AS start_sec, {duck_six("end_sec")} AS end_sec,
  CASE WHEN retyped THEN 'static' ELSE motion_type END AS motion_type,
  CASE WHEN motion_code = 2 THEN target ELSE accepted END AS accepted,
  edited OR (origin = 'ai' AND (moved OR cutting OR retyped)) AS edited
FROM o LEFT JOIN acc ON o.video_id = acc.video_id""",
    "record_violations": f"""WITH {duck("videos", "segments")}
SELECT s.id, 'Segment ' || s.id || ' extends beyond the video duration' AS violation
FROM segments s JOIN videos v ON s.video_id = v.id WHERE end_sec > duration_sec + 5e-2""",
    "replace_segments": f"""WITH {duck("videos", "segments")},
inc AS (SELECT id, video_id, start_sec + 25e-2 AS start_sec, end_sec FROM segments WHERE origin = 'ai'),
bad AS (SELECT DISTINCT i.video_id FROM inc i LEFT JOIN videos v ON i.video_id = v.id
  WHERE i.end_sec > v.duration_sec + 5e-2 OR i.end_sec <= i.start_sec),
ok AS (SELECT * FROM inc WHERE video_id NOT IN (SELECT video_id FROM bad))
SELECT id, video_id, {duck_six("start_sec")} AS start_sec FROM ok
UNION ALL SELECT id, video_id, {duck_six("start_sec")} FROM segments WHERE video_id NOT IN (SELECT video_id FROM ok)""",
    "manifest": f"""WITH {duck("videos", "segments")}
SELECT s.id AS segment_id, video_id, project_id, CAST(floor(start_sec * fps + 5e-1) AS BIGINT) AS start_frame,
  CAST(floor(end_sec * fps + 5e-1) AS BIGINT) AS end_frame, {duck_six("floor(start_sec * fps + 5e-1) / fps")} AS start_sec,
  {duck_six("floor(end_sec * fps + 5e-1) / fps")} AS end_sec
FROM segments s JOIN videos v ON s.video_id = v.id WHERE accepted AND v.status = 'ready'""",
    "upload_duplicates": f"""WITH {duck("fingerprints")}
SELECT id AS key, count(*) OVER (PARTITION BY size_bytes, content_hash) AS match_count,
  min(id) OVER (PARTITION BY size_bytes, content_hash) AS first_video_id FROM fingerprints""",
    "earlier_duplicate": f"""WITH {duck("fingerprints")}
SELECT id, duplicate_of_id FROM (SELECT id, min(id) OVER (PARTITION BY size_bytes, content_hash) AS duplicate_of_id FROM fingerprints)
WHERE duplicate_of_id < id""",
    "duplicate_ref": f"""WITH {duck("fingerprints")},
d AS (SELECT id, min(id) OVER (PARTITION BY size_bytes, content_hash) AS dup FROM fingerprints)
SELECT d.id, f.id AS target_id, upper(f.project_id) AS target_project, 'DJI_' || f.id AS target_file
FROM d LEFT JOIN fingerprints f ON f.id = d.dup AND d.dup < d.id""",
    "storage_usage": f"""WITH {duck("file_inventory")}, {_CATEGORY}
SELECT 'total' AS scope, CAST(NULL AS BIGINT) AS project_id, {_usage} FROM cat
UNION ALL SELECT CASE WHEN project_id IS NULL THEN 'unassigned' ELSE 'project' END, project_id, {_usage} FROM cat GROUP BY project_id""",
    "cleanup_plan": f"""WITH {_DOOMED}, {duck("segments", "clips")},
d AS (SELECT project_id, CAST(sum(bytes) AS BIGINT) AS freed_bytes, count(*) AS files FROM doomed GROUP BY 1),
r AS (SELECT j.project_id, count(*) FILTER (WHERE status IN ('cut', 'done')) AS n FROM clips c JOIN jobs j ON c.job_id = j.job_id
  WHERE build_status <> 'building' GROUP BY 1),
s AS (SELECT j.project_id, CASE WHEN build_status = 'building' THEN 0 ELSE 1 END AS jobs_cleaned,
  coalesce(r.n, 0) AS clips_reset, build_status = 'building' AS skipped FROM jobs j LEFT JOIN r ON j.project_id = r.project_id)
SELECT coalesce(d.project_id, s.project_id) AS project_id, coalesce(freed_bytes, 0) AS freed_bytes, coalesce(files, 0) AS files,
  coalesce(jobs_cleaned, 0) AS jobs_cleaned, coalesce(clips_reset, 0) AS clips_reset, coalesce(skipped, false) AS skipped
FROM d FULL JOIN s ON d.project_id = s.project_id""",
    "freed_files": f"""WITH {_DOOMED}
SELECT file_id, bytes FROM doomed WHERE project_id IS NULL OR project_id NOT IN (SELECT project_id FROM jobs WHERE build_status = 'building')""",
    "file_owners": f"""WITH {duck("projects", "videos", "segments", "jobs", "clips")}
SELECT CAST(project_id AS VARCHAR) AS project_id, category, reclaimable, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT project_id, 'sources' AS category, false AS reclaimable, size_bytes AS bytes FROM videos
  UNION ALL SELECT project_id, 'archives', true, 10 FROM jobs
  UNION ALL SELECT project_id, 'encodedClips', true, 20 FROM jobs
  UNION ALL SELECT j.project_id, 'aiLogs', false, 5 FROM clips c LEFT JOIN jobs j ON c.job_id = j.job_id) GROUP BY 1, 2, 3""",
    "distinct_files": f"""WITH {duck("file_inventory")} SELECT file_id AS file_key, 'export-work/j/c/cut.mov' AS path, bytes FROM file_inventory""",
    "job_progress": f"""WITH {duck("segments", "clips")},
w AS (SELECT *, least(1e0, (CASE status WHEN 'geo' THEN 1 WHEN 'tech' THEN 2 WHEN 'llm' THEN 3 WHEN 'review' THEN 4 WHEN 'cut' THEN 4
  WHEN 'done' THEN 5 ELSE 0 END + CASE WHEN status = 'done' THEN 0e0 ELSE progress END) / 5) AS p FROM clips)
SELECT job_id, count(*) AS total, count(*) FILTER (WHERE excluded) AS excluded, {_statuses},
  {duck_six("coalesce(avg(p) FILTER (WHERE NOT excluded), 0e0)")} AS progress,
  count(*) FILTER (WHERE NOT excluded) > 0 AND count(*) FILTER (WHERE NOT excluded AND status <> 'done') = 0 AS can_build FROM w GROUP BY job_id""",
    "work_list": f"""WITH {duck("segments", "clips")}
SELECT clip_id, CASE WHEN status = 'llm' THEN 'model' ELSE 'general' END AS queue FROM clips
WHERE NOT excluded AND (status NOT IN ('review', 'done', 'failed') OR (status = 'review' AND approved))""",
    "clip_labels": f"""WITH {duck("segments", "clips")}
SELECT clip_id, CASE WHEN excluded THEN 'Excluded' WHEN status = 'review' AND approved THEN 'Approved · waiting for encoding'
  ELSE CASE status {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.STATUS_LABELS.items())} END END AS label FROM clips""",
    "state_transitions": f"""WITH {duck("segments", "clips")},
a AS (SELECT *, CASE CAST(floor(start_sec) AS BIGINT) % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'exclude' WHEN 2 THEN 'include'
  WHEN 3 THEN 'retry' WHEN 4 THEN 'regenerate' ELSE 'rerun' END AS action FROM clips),
e AS (SELECT *, CASE WHEN action = 'approve' AND (status <> 'review' OR excluded) THEN 'Only clips in review can be approved'
  WHEN action = 'retry' AND status <> 'failed' THEN 'Only failed clips can be retried'
  WHEN action = 'regenerate' AND motion_code < 3 THEN 'The clip has not reached the metadata step yet' END AS error FROM a),
f AS (SELECT *, error IS NULL AND (action IN ('retry', 'regenerate') OR (action = 'rerun' AND status NOT IN ('queued', 'frames'))) AS again FROM e)
SELECT clip_id, action, CASE WHEN NOT again THEN status WHEN action = 'retry' THEN coalesce(failed_step, 'queued')
    WHEN action = 'regenerate' THEN 'llm' ELSE 'geo' END AS status,
  CASE WHEN again THEN NULL ELSE failed_step END AS failed_step, {duck_six("CASE WHEN again THEN 0e0 ELSE progress END")} AS progress,
  CASE action WHEN 'exclude' THEN true WHEN 'include' THEN false ELSE excluded END AS excluded,
  CASE WHEN action = 'approve' AND error IS NULL THEN true WHEN action = 'regenerate' AND again THEN false ELSE approved END AS approved,
  CASE WHEN action = 'regenerate' AND again THEN 'hint' END AS user_hint,
  CASE WHEN motion_code < 3 THEN 'frames' WHEN action = 'regenerate' AND again THEN 'frames,tech' ELSE 'frames,llm,tech' END AS hashes,
  error FROM f""",
    "stale_steps": f"""WITH {duck("segments", "clips")}
SELECT clip_id, CASE WHEN CAST(floor(start_sec) AS BIGINT) % 3 = 0 THEN 'done' ELSE 'stale' END AS outcome FROM clips""",
    "new_clips": f"""WITH {duck("videos", "segments")},
m AS (SELECT v.project_id AS job_id, s.id AS segment_id, motion_code, created_at, s.video_id,
  floor(start_sec * fps + 5e-1) / fps AS start_sec FROM segments s JOIN videos v ON s.video_id = v.id WHERE accepted AND v.status = 'ready'),
old AS (SELECT job_id, count(*) AS n FROM m WHERE motion_code < 4 GROUP BY 1)
SELECT m.job_id, segment_id, coalesce(old.n, 0) + row_number() OVER (PARTITION BY m.job_id ORDER BY created_at, video_id, start_sec, segment_id) - 1 AS ordinal
FROM m LEFT JOIN old ON m.job_id = old.job_id WHERE motion_code >= 4""",
    "videos_of_export": f"""WITH {duck("videos", "segments", "clips")}
SELECT id, original_filename FROM videos WHERE id IN (SELECT video_id FROM clips WHERE status = 'done')""",
    "missing_hashes": f"""WITH {duck("videos")}
SELECT id FROM videos WHERE status IN ('ready', 'failed') AND id % 4 <> 0 AND (id % 3 = 0 OR id % 5 = 0)""",
    "next_video": f"""WITH {duck("videos")},
q AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS rn FROM videos WHERE status = 'ready' AND NOT reviewed),
r AS (SELECT id, lead(id) OVER (PARTITION BY project_id ORDER BY created_at, id) AS following FROM videos WHERE status = 'ready')
SELECT v.id, v.project_id, coalesce(CASE WHEN q1.id <> v.id THEN q1.id ELSE q2.id END, r.following) AS next_id FROM videos v
LEFT JOIN q q1 ON v.project_id = q1.project_id AND q1.rn = 1 LEFT JOIN q q2 ON v.project_id = q2.project_id AND q2.rn = 2
LEFT JOIN r ON v.id = r.id""",
    "review_queue": f"WITH {duck('videos')} SELECT id, project_id FROM videos WHERE status = 'ready' AND NOT reviewed",
    "selection_totals": f"""WITH {duck("segments")}
SELECT video_id, count(*) FILTER (WHERE accepted) AS accepted, {duck_six("sum(end_sec - start_sec)")} AS seconds
FROM segments WHERE origin = 'ai' GROUP BY 1""",
    "processing_total": f"""WITH {duck("videos")}
SELECT project_id, count(*) FILTER (WHERE status NOT IN ('ready', 'failed')) AS processing FROM videos GROUP BY 1""",
    "reanalysis_counts": f"""WITH {duck("videos")},
c AS (SELECT DISTINCT user_id FROM events)
SELECT project_id, count(*) FILTER (WHERE user_id IS NOT NULL AND user_id % 3 <> 0) AS segmented,
  count(*) FILTER (WHERE user_id IS NULL OR user_id % 3 = 0) AS queued
FROM videos LEFT JOIN c ON id = user_id WHERE status = 'ready' GROUP BY 1""",
    "upsert_latest": """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "cascade_delete": f"""WITH {duck("projects", "videos", "segments")},
gone AS (SELECT id FROM projects WHERE status = 'confirmed'), gv AS (SELECT id FROM videos WHERE project_id IN (SELECT id FROM gone)),
kept AS (SELECT id, CASE WHEN id % 7 = 0 THEN id - 1 END AS link FROM videos WHERE id NOT IN (SELECT id FROM gv))
SELECT 'video' AS kind, CAST(id AS VARCHAR) AS id, CASE WHEN link NOT IN (SELECT id FROM gv) THEN link END AS link FROM kept
UNION ALL SELECT 'project', CAST(id AS VARCHAR), NULL FROM projects WHERE status <> 'confirmed'
UNION ALL SELECT 'segment', id, NULL FROM segments WHERE video_id NOT IN (SELECT id FROM gv)""",
    "largest_projects": f"""WITH {duck("file_inventory")}
SELECT project_id, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM file_inventory WHERE project_id IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "project_transitions": f"""WITH {_SUMMARY},
a AS (SELECT *, CASE project_id % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reopen' ELSE 'edit' END AS action FROM summary),
e AS (SELECT *, CASE WHEN action = 'confirm' AND status = 'confirmed' THEN 'The project is confirmed and read-only'
  WHEN action = 'confirm' AND blockers <> '' THEN 'Cannot confirm: ' || blockers
  WHEN action = 'reopen' AND status <> 'confirmed' THEN 'The project is not confirmed'
  WHEN action = 'edit' AND status = 'confirmed' THEN 'The project is confirmed and read-only' END AS error FROM a)
SELECT project_id, action, CASE WHEN error IS NULL AND action = 'confirm' THEN 'confirmed' WHEN error IS NULL AND action = 'reopen' THEN 'draft' ELSE status END AS status,
  error IS NULL AND action IN ('confirm', 'reopen') AS discard_export, error IS NULL AND action = 'reopen' AS remove_manifest, error FROM e""",
    "listing_order": f"""WITH {duck("projects")}
SELECT id, row_number() OVER (ORDER BY created_on DESC, id) - 1 AS position FROM projects""",
}
ORACLES["stored_catalog"] = ORACLES["cascade_delete"]
