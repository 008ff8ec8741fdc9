from pyspark.sql import functions as F

from reelgrid.operators import catalog as C
from reelgrid.operators import clips as K
from reelgrid.operators import intervals as I
from reelgrid.operators import storage as S

SEG = "id string, video_id string, start_sec double, end_sec double, motion_type string, score double, origin string, accepted boolean, edited boolean"


def seg(id_, a, b, origin="ai", accepted=True, edited=False, video="v", motion="forward", score=0.5):
    return (id_, video, float(a), float(b), motion, score, origin, accepted, edited)


def video_table(spark, rows):
    return spark.createDataFrame(rows, "id string, project_id string, status string, duration_sec double, fps double")


def test_reconcile_keeps_user_work(spark):
    current = spark.createDataFrame([seg("u", 12, 20, "user"), seg("e", 30, 40, edited=True), seg("old", 0, 10)], SEG)
    fresh = spark.createDataFrame([seg("p1", 0, 11), seg("p2", 18, 25), seg("p3", 35, 45), seg("p4", 45, 55), seg("p5", 20, 30)], SEG)
    assert {r.id for r in I.reconcile_segments(current, fresh).collect()} == {"u", "e", "p1", "p4", "p5"}


def test_summary_and_issues(spark):
    projects = spark.createDataFrame([("p", "P", "draft"), ("empty", "E", "draft"), ("done", "D", "confirmed")], "id string, name string, status string")
    videos = video_table(spark, [("v", "p", "ready", 100.0, 25.0), ("f", "p", "failed", None, None), ("d", "done", "analyzing", 10.0, 25.0)])
    segments = spark.createDataFrame([seg("a", 0, 20), seg("b", 10, 30), seg("c", 50, 53), seg("r", 0, 500, accepted=False), seg("x", 0, 9, video="d")], SEG)
    settings = projects.select(F.col("id").alias("project_id"), F.lit(7.0).alias("min_duration"), F.lit(40.0).alias("max_duration"))
    issues = I.segment_issues(segments, videos, settings)
    assert {(r.segment_id, r.kind) for r in issues.collect()} == {("a", "overlap"), ("b", "overlap"), ("c", "too_short")}
    assert issues.where("kind = 'too_short'").first().message == "Shorter than 7 s (3.0 s)"
    got = {r.project_id: r for r in C.project_summary(projects, videos, segments, issues).collect()}
    assert got["p"].blockers == ["Invalid segments: 3"] and got["p"].accepted_duration_sec == 43.0 and not got["p"].can_confirm
    assert got["empty"].blockers == ["No videos", "No accepted segments"]
    assert got["done"].blockers == ["The project is already confirmed", "Not all videos are processed", "No accepted segments"]


def test_overlap_looks_at_neighbours_only(spark):
    rows = spark.createDataFrame([seg("long", 0, 2000), seg("m", 700, 710), seg("n", 1300, 1310), seg("t", 2000, 2010)], SEG)
    assert sorted(r.segment_id for r in I.overlap_issues(rows).collect()) == ["long", "m"]


def test_edits(spark):
    videos = video_table(spark, [("v", "p", "ready", 100.0, 25.0)])
    segments = spark.createDataFrame(
        [seg("m", 0, 10), seg("tiny", 20, 30), seg("s", 40, 50), seg("x", 60, 70), seg("a1", 80, 85, accepted=False), seg("a2", 85, 90), seg("u", 90, 95, "user")], SEG
    )
    edits = spark.createDataFrame(
        [
            ("v", "m", "bounds", 12.01, -3.0, None, None), ("v", "tiny", "bounds", 22.0, 22.01, None, None),
            ("v", "s", "split", None, None, 44.97, None), ("v", "x", "remove", None, None, None, None),
            ("v", "a1", "accept", None, None, None, None), ("v", "a2", "accept", None, None, None, None),
            ("v", "u", "retype", None, None, None, "static"), ("v", "new", "create", 55.03, 52.0, None, "erratic"),
        ],
        "video_id string, id string, op string, start_sec double, end_sec double, at_sec double, motion_type string",
    )
    got = {r.id: r for r in I.apply_segment_edits(segments, edits, videos).collect()}
    assert (got["m"].start_sec, got["m"].end_sec, got["m"].edited) == (0.0, 12.0, True)
    assert (got["tiny"].start_sec, got["tiny"].edited) == (20.0, False) and "x" not in got
    assert got["s"].end_sec == 44.96 and got["s/1124"].start_sec == 44.96 and got["s/1124"].edited
    assert got["a1"].accepted and got["a2"].accepted and not got["a1"].edited
    assert got["u"].motion_type == "static" and not got["u"].edited
    assert (got["new"].start_sec, got["new"].end_sec, got["new"].motion_type, got["new"].origin) == (52.0, 55.04, "forward", "user")


def test_merge_and_lookup(spark):
    rows = [seg("a", 0, 10, score=0.4), seg("b", 10, 30, "user", accepted=False, motion="static", score=0.8), seg("c", 5, 8)]
    df = spark.createDataFrame(rows, SEG).withColumns({"pos": F.monotonically_increasing_id(), "reasons": F.array(F.lit("same"), F.col("id"))})
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("one", "c")], "group_id string, id string")
    (m,) = I.merge_segments(df, groups).collect()
    assert (m.id, m.start_sec, m.end_sec, m.score, m.origin, m.accepted, m.motion_type) == ("b", 0.0, 30.0, 0.67, "user", True, "static")
    assert m.reasons == ["same", "a", "b"]
    points = spark.createDataFrame([("v", "p1", 6.0), ("v", "p2", 10.0), ("v", "p3", 30.0)], "video_id string, point_id string, t double")
    assert {r.point_id: r.segment_id for r in I.segment_at(points, df).collect()} == {"p1": "c", "p2": "b"}


def test_earlier_duplicate_tolerances(spark):
    base = ("h", 10, 1920, 1080, "hevc", None)
    rows = [("v1", 1, *base, 10.0, 30.0), ("v2", 2, *base, 10.04, 30.005), ("v3", 3, *base, 10.2, 30.0), ("v4", 4, *base, None, 30.0), ("v5", 5, *base, None, 30.0), ("v6", 6, None, *base[1:], 10.0, 30.0)]
    df = spark.createDataFrame(rows, "id string, created_at int, content_hash string, size_bytes int, width int, height int, codec string, creation_time string, duration_sec double, fps double")
    assert {r.id: r.duplicate_of_id for r in C.find_earlier_duplicate(df).collect()} == {"v2": "v1", "v5": "v4"}


def test_upload_matches_unknown_duration(spark):
    stored = spark.createDataFrame([("v1", 5, "f", 10.0, 1, "ready"), ("v2", 5, "f", None, 2, "ready"), ("v3", 5, "f", 10.0, 0, "uploading"), ("v4", 6, "f", 10.0, 0, "ready")], "video_id string, size_bytes int, fingerprint string, duration_sec double, created_at int, status string")
    files = spark.createDataFrame([("k1", 5, "f", 10.03), ("k2", 5, "f", 99.0), ("k3", 5, "f", None), ("k4", 7, "f", 1.0)], "key string, size_bytes int, fingerprint string, duration_sec double")
    got = {r.key: (r.match_count, r.first_video_id) for r in C.find_upload_duplicates(files, stored).collect()}
    assert got == {"k1": (2, "v1"), "k2": (1, "v2"), "k3": (2, "v1")}


def test_storage_counts_hard_links_once(spark):
    listing = spark.createDataFrame(
        [(1, "exports/a/videos/1.mov", 4000, "p"), (1, "export-work/j/1/cut.mov", 4000, "p"), (2, "exports/a/videos/2.mov", 4000, "p"),
         (2, "export-work/j/2/cut.mov", 4000, "p"), (3, "exports/a.zip", 8030, "p"), (4, "export-work/gone/1/cut.mov", 500, None), (5, "videos/v/source.mp4", 100, "p")],
        "file_key int, path string, bytes bigint, project_id string",
    )
    usage = {(r.scope, r.project_id): r for r in S.storage_usage(S.distinct_files(listing)).collect()}
    p = usage["project", "p"]
    assert (p.encodedClips, p.archives, p.reclaimable_bytes) == (8000, 8030, 16030)
    assert usage["unassigned", None].total_bytes == 500 and usage["total", None].total_bytes == 16630


def test_second_run_of_a_step_is_empty(spark):
    clips = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "clip_id string, start_sec double")
    step = K.Step("cut", lambda: [F.col("start_sec")], lambda df: df.withColumn("out", F.col("start_sec") * 2))
    none = spark.createDataFrame([], "clip_id string, step string, hash string, complete boolean")
    done, hashes = K.run_step(clips, none, step)
    assert done.count() == 2
    again, _ = K.run_step(clips, hashes, step)
    assert again.count() == 0
    moved = clips.withColumn("start_sec", F.when(F.col("clip_id") == "c2", 3.0).otherwise(F.col("start_sec")))
    assert [r.clip_id for r in K.run_step(moved, hashes, step)[0].collect()] == ["c2"]


def test_request_rules_and_motion_dimension(spark):
    from reelgrid.functions.motion import motion_dim

    rows = [("r1", "a", 5, "0" * 64, 1.0), ("r1", "b", -1, "0" * 64, None), ("r1", "c", 5, "XYZ", 0.0)]
    files = spark.createDataFrame(rows, "request_id string, key string, size_bytes bigint, fingerprint string, duration_sec double")
    got = sorted((r.key or "", r.violation) for r in I.upload_request_violations(files, 2).collect())
    assert got == [
        ("", "files: at most 2"), ("b", "sizeBytes: must not be negative"), ("c", "durationSec: must be positive"),
        ("c", "fingerprint: expected 64 hex digits"),
    ]
    assert motion_dim(spark).where("slug = 'reveal'").first().motion == "backward"


def test_upsert_keeps_values_of_rows_without_version(spark):
    schema = "id int, value string, version int"
    stored = spark.createDataFrame([(1, "old", 1), (2, "kept", None), (3, "tie", 5), (4, "newer", 9)], schema)
    fresh = spark.createDataFrame([(1, "new", 2), (3, "update", 5), (4, "older", 3), (5, "first", None)], schema)
    found = {r.id: (r.value, r.version) for r in C.upsert_latest(stored, fresh, ["id"], "version").collect()}
    assert found == {1: ("new", 2), 2: ("kept", None), 3: ("update", 5), 4: ("newer", 9), 5: ("first", None)}


def test_a_file_has_one_owner(spark):
    files = spark.createDataFrame([("exports/day/x.csv",), ("exports",), ("videos/v1/source.mp4",), ("projects/p9/a/b.json",)], "path string")
    videos = spark.createDataFrame([("v1", "p3")], "id string, project_id string")
    jobs = spark.createDataFrame(
        [("j1", "p2", "out/day", None), ("j2", "p1", "out/day", None)],
        "job_id string, project_id string, archive_dir string, archive_zip string",
    )
    clips = spark.createDataFrame([("c", "j1")], "clip_id string, job_id string")
    found = sorted((r.path, r.project_id) for r in S.assign_owner(files, videos, jobs, clips).collect())
    assert found == [("exports", None), ("exports/day/x.csv", "p1"), ("projects/p9/a/b.json", "p9"), ("videos/v1/source.mp4", "p3")]


def test_violations_move_rows_by_video_only(spark):
    """Repeated ids are joined back alone; rows without one aren't matched with counts of all ids."""
    segments = spark.createDataFrame(
        [("a", 1, 0.0, 2.0), ("a", 1, 3.0, 4.0), ("b", 2, 0.0, 99.0), ("c", 2, 0.0, 5.0)],
        "id string, video_id long, start_sec double, end_sec double",
    ).selectExpr("*", "'static' AS motion_type", "1D AS score", "'ai' AS origin")
    videos = spark.createDataFrame([(1, 10.0), (2, 10.0)], "id long, duration_sec double")
    found = I.record_violations(segments, videos)
    assert sorted((r.id, r.violation) for r in found.collect()) == [
        ("a", "Duplicate segment id a"), ("a", "Duplicate segment id a"), ("b", "Segment b extends beyond the video duration"),
    ]
    assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()


def test_outcomes_of_steps_need_one_join(spark):
    now = spark.createDataFrame([("a", "cut", "1"), ("b", "cut", "1"), ("c", "cut", "1")], "clip_id string, step string, input_hash string")
    stored = spark.createDataFrame([("a", "cut", "1", True), ("b", "cut", "1", False)], "clip_id string, step string, hash string, complete boolean")
    out = K.step_outcomes(now, stored)
    assert {r.clip_id: r.next_status is None for r in out.collect()} == {"a": False, "b": True, "c": True}
    stale, advance = K.stale_steps(now, stored)
    assert {r.clip_id for r in stale.collect()} == {"b", "c"} and [r.clip_id for r in advance.collect()] == ["a"]
