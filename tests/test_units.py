"""Stores of units: replaced, emptied, half-written, merged and concurrent units, and every sink built on them."""

import random

import pytest
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.operators import catalog as OC
from reelgrid.sources import delivery as SD
from reelgrid.sources import tables as ST
from reelgrid.sources import units as U
from reelgrid.streaming import events as SE

SCHEMA = "video_id string, i bigint, x double"


def rows(spark, *units):
    return spark.createDataFrame([(v, i, x) for v, n, x in units for i in range(n)], SCHEMA)


def ids(spark, *values, name="video_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def counts(df, key):
    return {r[key]: r["count"] for r in df.groupBy(key).count().collect()}


def test_replaced_emptied_and_new_units(spark, tmp_path):
    path, keys = str(tmp_path / "s"), ("video_id",)
    one = U.commit(spark, path, {"t": U.Change(rows(spark, ("a", 3, 1.0), ("b", 2, 1.0), (None, 1, 1.0)), keys)})
    two = U.commit(spark, path, {"t": U.Change(rows(spark, ("b", 1, 2.0), (None, 2, 2.0)), keys, ids(spark, "a"))})
    three = U.commit(spark, path, {"t": U.Change(None, keys, ids(spark, "b"))})
    assert [one, two, three] == [1, 2, 3] == U.versions(spark, path)
    assert counts(U.read(spark, path, "t", version=1), "video_id") == {"a": 3, "b": 2, None: 1}
    assert counts(U.read(spark, path, "t", version=2), "video_id") == {"b": 1, None: 2}
    assert counts(U.read(spark, path, "t"), "video_id") == {None: 2}
    assert U.read(spark, path, "u", SCHEMA).count() == 0
    with pytest.raises(ValueError, match="no table"):
        U.read(spark, path, "u")
    with pytest.raises(ValueError, match="units by"):
        U.commit(spark, path, {"t": U.Change(rows(spark, ("a", 1, 1.0)), ("i",))})


def test_readers_keep_their_version_and_may_feed_a_commit(spark, tmp_path):
    path = str(tmp_path / "s")
    U.commit(spark, path, {"t": U.Change(rows(spark, ("a", 3, 1.0)), ("video_id",))})
    pinned = U.read(spark, path, "t")
    U.commit(spark, path, {"t": U.Change(pinned.withColumn("x", F.col("x") + 1), ("video_id",))})
    assert {r.x for r in pinned.collect()} == {1.0} and {r.x for r in U.read(spark, path, "t").collect()} == {2.0}
    U.commit(spark, path, {"t": U.Change(rows(spark, ("z", 1, 9.0)))})  # without keys: the whole table
    assert counts(U.read(spark, path, "t"), "video_id") == {"z": 1}
    U.remove_unused(spark, path)
    assert U.versions(spark, path) == [3] and len(list((tmp_path / "s" / "data" / "t").iterdir())) == 1
    assert counts(U.read(spark, path, "t"), "video_id") == {"z": 1}


def test_failed_writes_leave_every_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "s")
    U.commit(spark, path, {n: U.Change(rows(spark, ("a", 2, 1.0)), ("video_id",)) for n in ("t", "u")})
    broken = rows(spark, ("a", 5, 2.0)).withColumn("x", F.when(F.col("i") < 4, F.col("x")).otherwise(F.raise_error(F.lit("torn"))))
    with pytest.raises(Exception, match="torn"):
        U.commit(spark, path, {"t": U.Change(rows(spark, ("a", 9, 3.0)), ("video_id",)), "u": U.Change(broken, ("video_id",))})
    assert U.versions(spark, path) == [1]
    assert [U.read(spark, path, n).count() for n in ("t", "u")] == [2, 2]
    U.remove_unused(spark, path)
    assert len(list((tmp_path / "s" / "data" / "t").iterdir())) == 1


def test_a_faster_writer_is_built_upon(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "s"), ("video_id",)
    U.commit(spark, path, {"t": U.Change(rows(spark, ("a", 1, 1.0), ("b", 1, 1.0)), keys)})
    put, raced = U._put_entry, []

    def slow(session, at, version):
        if not raced:
            raced.append(version.number)
            U.commit(session, at, {"t": U.Change(rows(spark, ("b", 4, 2.0), ("c", 1, 2.0)), keys)})
        return put(session, at, version)

    monkeypatch.setattr(U, "_put_entry", slow)
    assert U.commit(spark, path, {"t": U.Change(rows(spark, ("a", 3, 3.0)), keys)}) == 3
    assert raced == [2] and counts(U.read(spark, path, "t"), "video_id") == {"a": 3, "b": 4, "c": 1}


def test_many_commits_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "MOST_PARTS", 3)
    path, rng, want = str(tmp_path / "s"), random.Random(4), {}
    for k in range(12):
        units = {rng.choice("abcdefgh"): rng.randint(1, 3) for _ in range(2)}
        gone = rng.choice("abcdefgh")
        want |= units
        if gone not in units:
            want.pop(gone, None)
        data = rows(spark, *((v, n, float(k)) for v, n in units.items())).coalesce(1)
        U.commit(spark, path, {"t": U.Change(data, ("video_id",), ids(spark, gone).coalesce(1))})
        assert len(U._at(spark, path, None).tables["t"]) <= 4
    assert counts(U.read(spark, path, "t"), "video_id") == want


@pytest.mark.parametrize("whole", [True, False])
def test_deleted_projects_leave_the_stored_catalog(spark, tmp_path, whole):
    path = str(tmp_path / "catalog")
    table = lambda name, data: spark.createDataFrame(data, schemas.CATALOG[name]) if data else spark.createDataFrame([], schemas.CATALOG[name])
    fill = lambda table_name, **known: tuple(known.get(f.name) for f in spark.createDataFrame([], schemas.CATALOG[table_name]).schema)
    projects = ("p1", "p2", "p3")
    catalog = {
        "projects": table("projects", [fill("projects", id=p, name=p) for p in projects]),
        "videos": table("videos", [fill("videos", id=f"{p}-{k}", project_id=p, duplicate_of_id="p2-0" if k else None) for p in projects for k in range(2)]),
        "segments": table("segments", [fill("segments", id=f"s{p}{k}", video_id=f"{p}-{k}") for p in projects for k in range(2)]),
        "export_jobs": table("export_jobs", [fill("export_jobs", id=f"j{p}", project_id=p) for p in projects]),
        "export_clips": table("export_clips", [fill("export_clips", id=f"c{p}", job_id=f"j{p}") for p in projects]),
    }
    ST.write_catalog(catalog, path)
    gone = ids(spark, "p2", name="project_id")
    if whole:  # the result of the operator, stored as it is
        stored = ST.read_catalog(spark, path)
        jobs = stored["export_jobs"].withColumnRenamed("id", "job_id")
        left = OC.cascade_delete(stored | {"export_jobs": jobs}, ids(spark, "p2", name="id"))
        left["export_jobs"] = left["export_jobs"].withColumnRenamed("job_id", "id").select(stored["export_jobs"].columns)
        ST.write_catalog(left, path, gone)
    else:
        ST.delete_projects(spark, path, gone)
    after = ST.read_catalog(spark, path)
    assert {n: after[n].count() for n in catalog} == {"projects": 2, "videos": 4, "segments": 4, "export_jobs": 2, "export_clips": 2}
    assert after["videos"].where("duplicate_of_id IS NOT NULL OR project_id = 'p2'").count() == 0
    assert U.versions(spark, path) == [1, 2]  # five tables in one step
    assert ST.read_catalog(spark, path, ["videos"], version=1)["videos"].count() == 6
    assert after["geo_cache"].count() == 0


def test_emptied_videos_leave_features_and_metrics(spark, tmp_path):
    base = dict.fromkeys(schemas.FRAME_FIELDS, 0.5)
    fields = ", ".join(f"{'mag_var' if f == 'magVar' else f} double" for f in schemas.FRAME_FIELDS)
    features = lambda *videos: spark.createDataFrame([(v, 5.0, k, *base.values()) for v, n in videos for k in range(n)], f"video_id string, analysis_fps double, i bigint, {fields}")
    path = str(tmp_path / "features")
    ST.write_frame_features(features(("a", 3), ("b", 2)), path)
    ST.write_frame_features(features(("a", 1)), path, emptied=spark.createDataFrame([(5.0, "b")], "analysis_fps double, video_id string"))
    assert counts(ST.read_stored_features(spark, path), "video_id") == {"a": 1}
    series = lambda *videos: spark.createDataFrame([(v, k, k / 5, 0.5, 0.9, "static") for v, n in videos for k in range(n)], "video_id string, i bigint, t double, speed double, smoothness double, motion string")
    ST.write_metrics(series(("a", 3), ("b", 2)), 5.0, str(tmp_path / "m"))
    ST.write_metrics(series(("c", 1)), 5.0, str(tmp_path / "m"), emptied=ids(spark, "a"))
    assert counts(ST.read_metrics(spark, str(tmp_path / "m")), "video_id") == {"b": 2, "c": 1}


def test_emptied_projects_and_jobs_leave_manifests_and_documents(spark, tmp_path):
    segment = lambda p, v, k: (p, v, f"{v}.mp4", 100.0, 25.0, 1920, 1080, f"{v}-{k}", k / 25, (k + 5) / 25, k, k + 5, "forward", 0.5, "ai")
    schema = "project_id string, video_id string, original_filename string, duration_sec double, fps double, width int, height int, segment_id string, start_sec double, end_sec double, start_frame bigint, end_frame bigint, motion_type string, score double, origin string"
    data = spark.createDataFrame([segment(p, f"{p}v{v}", k) for p in ("p1", "p2") for v in range(2) for k in range(3)], schema)
    path = str(tmp_path / "manifest")
    SD.write_manifest(data, path)
    # p1 loses one of its videos, p2 all of them.
    SD.write_manifest(data.where("video_id = 'p1v0'"), path, emptied=ids(spark, "p2", name="project_id"))
    assert counts(SD.read_manifest(spark, path), "video_id") == {"p1v0": 3}
    documents = lambda job, *values: spark.createDataFrame([(job, v) for v in values], "job_id string, value string")
    SD.write_delivery_metadata(documents("j1", "a", "b"), str(tmp_path / "d"))
    SD.write_delivery_metadata(documents("j2", "c"), str(tmp_path / "d"), emptied=ids(spark, "j1", name="job_id"))
    assert content(SD.read_delivery_metadata(spark, str(tmp_path / "d"))) == [("j2", "c")]


def test_video_that_loses_all_segments(spark, tmp_path):
    """Incremental analysis clears a video whose samples no longer make a segment."""
    schema = "video_id string, i bigint, good boolean, arrived_at timestamp"
    for part in ([("v", 0, True), ("w", 0, True)], [("v", 1, False)]):
        data = spark.createDataFrame(part, "video_id string, i bigint, good boolean").coalesce(1)
        data.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    analyse = lambda df: df.groupBy("video_id").agg(F.min("good").alias("good")).where("good")
    query = SE.incremental_analysis(stream, analyse, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination(120)
    found = {v: [r.video_id for r in SE.analysed_segments(spark, str(tmp_path / "out"), v).collect()] for v in (1, 2)}
    assert sorted(found[1]) == ["v", "w"] and found[2] == ["w"]
