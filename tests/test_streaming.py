import json

import pytest
from pyspark.sql import functions as F

from reelgrid.config import AnalysisSettings
from reelgrid.operators import geo as OG
from reelgrid.operators import segments as OS
from reelgrid.streaming import events as SE


@pytest.fixture
def feed(spark, tmp_path):
    """A file stream fed in three batches."""
    rows = []
    for k in range(90):
        kind = ["video.updated", "video.progress", "video.progress", "video.deleted"][(k * 7) % 23 % 4]
        entity = f"v{k % 5}"
        doc = {"type": kind, "videoId": entity, "status": "queued", "progress": (k * 37 % 100) / 100}
        if kind == "video.updated":
            doc = {"type": kind, "video": {"id": entity, "projectId": "p", "status": "ready", "progress": 1.0}}
        rows.append((k, json.dumps(doc) if k % 11 else "{torn"))
    schema = "event_id bigint, value string"
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    return stream, spark.createDataFrame(rows, schema), tmp_path


def test_latest_state_stream_equals_batch(spark, feed):
    stream, batch, tmp = feed
    typed, rejects = SE.parse_events(batch)
    assert rejects.count() == 9
    live, _ = SE.parse_events(stream)
    query = SE.stream_latest_state(live, ["event_id"], str(tmp / "state"), str(tmp / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = SE.stored_state(spark, str(tmp / "state")).collect()
    assert sorted(got) == sorted(SE.latest_state(typed, ["event_id"]).collect()) and got


def test_removals_reach_the_children(spark):
    entity = lambda i, **more: {"id": i, "status": "done", "progress": 0.5, **more}
    docs = [
        {"type": "project.updated", "project": entity("p")}, {"type": "project.updated", "project": entity("q")},
        {"type": "export.updated", "job": entity("j", projectId="p")},
        {"type": "export.clip.updated", "clip": entity("c", jobId="j")},
        {"type": "video.updated", "video": entity("v", projectId="p")},
        {"type": "video.updated", "video": entity("w", projectId="q")},
        {"type": "export.reset", "projectId": "p"},
        {"type": "export.clip.updated", "clip": entity("d", jobId="j", excluded=True)},
        {"type": "export.clip.progress", "clipId": "d", "status": "cut", "progress": 0.25},
        {"type": "segments.updated", "videoId": "v"},
    ]
    rows = [(k, json.dumps(d)) for k, d in enumerate([*docs, {"type": "project.deleted", "projectId": "p"}])]
    events, rejects = SE.parse_events(spark.createDataFrame(rows, "event_id bigint, value string"))
    assert rejects.count() == 0
    alive = lambda df: {(r.entity, r.entity_id) for r in SE.latest_state(df, ["event_id"]).collect()}
    before = events.where("event_id < 10")
    # The reset took job j and clip c; clip d came later and belongs to p by its job.
    assert alive(before) == {("project", "p"), ("project", "q"), ("video", "v"), ("video", "w"), ("clip", "d")}
    assert alive(events) == {("project", "q"), ("video", "w")}
    job = SE.live_jobs(SE.latest_state(before, ["event_id"])).first()
    assert (job.job_id, job.total, job.excluded, job.n_cut, job.can_build) == ("j", 1, 1, 0, False)
    halves = [SE.event_summary(events.where(f"event_id % 2 = {k}"), ["event_id"]) for k in (0, 1)]
    assert {(r.entity, r.entity_id) for r in SE.state_of(SE.merge_summaries(*halves)).collect()} == alive(events)


def test_throttle_stream_equals_batch(spark, feed):
    stream, batch, tmp = feed
    pick = lambda df: SE.parse_events(df)[0].where("type = 'video.progress'").select("entity_id", "event_id", "progress")
    expected = OG.progress_throttle(pick(batch), "entity_id", ["event_id"], 0.25)
    query = (
        SE.throttle_stream(pick(stream), "entity_id", 0.25, "string")
        .writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "cp2"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp / "out")).select("entity_id", "event_id").collect()
    want = expected.select("entity_id", "event_id").collect()
    assert sorted(got) == sorted(want) and len(want) < pick(batch).count()


def test_event_rate_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", k % 2, "video.progress") for k in range(120)]
    df = spark.createDataFrame(rows, "event_id bigint, at string, project_id bigint, type string")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in")).withColumn("ts", F.col("at").cast("timestamp"))
    query = (
        SE.event_rate(stream, "20 minutes").writeStream.format("memory").queryName("rates").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.table("rates").collect()) == [20] * 6
    live = SE.live_job_progress(df.withColumns({"progress": F.lit(0.5), "type": F.lit("export.clip.progress")}))
    assert {(r.project_id, r.events) for r in live.collect()} == {(0, 60), (1, 60)}


def test_incremental_analysis_sees_each_video_once(spark, tmp_path):
    settings = AnalysisSettings(2, 6, 4, 5, 1.0, False)
    base = dict(dx=-0.05, dy=0.0, div=0.0, rot=0.0, px=0.0, py=0.0, fit=0.95, coherence=0.95, mag_var=1e-4, sharpness=500.0, brightness=120.0, overexposed=0.0)
    rows = [{"video_id": "v", "i": i, "t": i / 5, "arrived_at": "2024-01-01 00:00:00", **base} for i in range(40)]
    schema = "video_id string, i bigint, t double, arrived_at timestamp, " + ", ".join(f"{k} double" for k in base)
    # Three files: the second half of the video, all of it, and another video; one micro-batch each.
    for part in (rows[20:], rows, [{**r, "video_id": "w"} for r in rows[:30]]):
        spark.createDataFrame([{**r} for r in part], schema.replace("arrived_at timestamp", "arrived_at string")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    analyse = lambda df: OS.segment_video_features(df, settings)
    seen = []
    keep_all = lambda current, fresh: seen.append({r.video_id for r in current.collect()}) or fresh
    SE.incremental_analysis(stream, analyse, str(tmp_path / "out"), str(tmp_path / "cp"), keep_all).trigger(availableNow=True).start().awaitTermination(120)
    got = SE.analysed_segments(spark, str(tmp_path / "out"))
    whole = spark.createDataFrame([{**r} for r in rows], schema.replace("arrived_at timestamp", "arrived_at string")).drop("arrived_at")
    want = analyse(whole)
    columns = ["video_id", "start_sec", "end_sec", "motion_type"]
    assert sorted(got.where("video_id = 'v'").select(columns).collect()) == sorted(want.select(columns).collect())
    assert {r.video_id for r in got.collect()} == {"v", "w"} and seen == [{"v"}, set()]
