"""How often catalog operators move rows: plans without broadcasts, as on tables of any size."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from reelgrid.operators import catalog as C
from reelgrid.operators import intervals as I

SEG = "id string, video_id string, start_sec double, end_sec double, motion_type string, score double, origin string, accepted boolean, edited boolean"
VIDEO = "id string, project_id string, duration_sec double, fps double"


@contextmanager
def settings(spark, **values):
    keys = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(spark, df):
    with settings(spark, adaptive__enabled="false", autoBroadcastJoinThreshold="-1"):
        return df.select("*")._jdf.queryExecution().executedPlan().toString()


def seg(id_, video="v", accepted=True, a=0.0, b=10.0):
    return (id_, video, a, b, "forward", 0.5, "ai", accepted, False)


def test_edits_move_segments_once_by_id_and_once_by_video(spark):
    segments = spark.createDataFrame([seg("a"), seg("b", accepted=False), seg("c", "w"), seg("d", "w", None), seg("e", "gone")], SEG)
    videos = spark.createDataFrame([("v", "p", 100.0, 25.0), ("w", "p", 100.0, 25.0)], VIDEO)
    edits = spark.createDataFrame(
        [("v", "a", "accept", 1.0, 2.0, 5.0, "static"), ("v", "b", "accept", 1.0, 2.0, 5.0, "static"), ("w", "c", "bounds", 3.0, 1.0, 7.0, "static"), ("w", "d", "accept", None, None, None, None), ("gone", "e", "accept", None, None, None, None)],
        "video_id string, id string, op string, start_sec double, end_sec double, at_sec double, motion_type string",
    )
    out = I.apply_segment_edits(segments, edits, videos)
    got = {r.id: (r.start_sec, r.end_sec, r.motion_type, r.accepted, r.edited) for r in out.collect()}
    assert got == {
        "a": (0.0, 10.0, "forward", True, False), "b": (0.0, 10.0, "forward", True, False),
        "c": (1.0, 3.0, "forward", True, True), "d": (0.0, 10.0, "forward", None, False),
    }
    # Segments, edits, videos; selection: segments, edits, flags by video; created ones: edits, videos.
    assert plan_of(spark, out).count("Exchange hashpartitioning") <= 9


def test_removed_videos_are_looked_up_without_sorting_segments(spark):
    catalog = {
        "projects": spark.createDataFrame([("p", "P"), ("q", "Q")], "id string, name string"),
        "videos": spark.createDataFrame([("v", "p", None), ("w", "q", "v"), ("x", "q", "w"), ("y", None, "v")], "id string, project_id string, duplicate_of_id string"),
        "segments": spark.createDataFrame([seg("a"), seg("b", "w"), seg("c", "w"), seg("d", None), seg("e", "lost")], SEG),
    }
    left = C.cascade_delete(catalog, spark.createDataFrame([("p",), ("p",), (None,)], "id string"))
    assert sorted(r.id for r in left["projects"].collect()) == ["q"]
    assert sorted(tuple(r) for r in left["videos"].collect()) == [("w", "q", None), ("x", "q", "w"), ("y", None, None)]
    assert sorted(r.id for r in left["segments"].collect()) == ["b", "c", "d", "e"]
    assert "SortMergeJoin [video_id" not in plan_of(spark, left["segments"])
    assert "SortMergeJoin [duplicate_of_id" not in plan_of(spark, left["videos"])
    assert "Aggregate" not in plan_of(spark, left["segments"])  # repeated ids of projects do no harm


def test_merge_joins_and_fuses_the_parts_once(spark):
    listed = {"a": ["x", "y"], "b": ["z", "x"], "c": None, "d": ["x", "y"], "e": ["y"], "f": ["q"], "g": ["q"], "h": []}
    place = {"a": 5, "b": 3, "c": 1, "d": 2, "e": 0, "f": 6, "g": 7, "h": 8}
    info = spark.createDataFrame([(i, place[i], r) for i, r in listed.items()], "id string, pos bigint, reasons array<string>")
    segments = spark.createDataFrame([seg(i, a=float(place[i]), b=20.0) for i in listed], SEG).join(info, "id")
    groups = spark.createDataFrame([("g", i) for i in "abcd"] + [("one", "e"), (None, "f"), (None, "g"), ("bare", "h"), ("bare", "c")], "group_id string, id string")
    out = I.merge_segments(segments, groups)
    got = {r.group_id: (r.id, r.start_sec, r.end_sec, r.score, r.reasons) for r in out.collect()}
    assert got == {"g": ("c", 1.0, 20.0, 0.5, ["x", "y", "z"]), "bare": ("c", 1.0, 20.0, 0.5, [])}  # no group is no null group
    # Info; segments and groups by id; lists, groups.
    assert plan_of(spark, out).count("Exchange hashpartitioning") <= 6
