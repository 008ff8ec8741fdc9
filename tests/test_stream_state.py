"""Keyed stream state: any order of arrival, repetitions, late rows, ends of states."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reelgrid.operators import geo as OG
from reelgrid.sources import units
from reelgrid.streaming import events as SE

START = datetime(2024, 5, 1)
SCHEMA = "event_id bigint, ts timestamp, value string"


def feed(spark, folder, parts):
    """A stream that takes one list of (event_id, minutes, document) per micro-batch."""
    for part in parts:
        rows = [(k, (START + timedelta(minutes=m)).isoformat(sep=" "), json.dumps(doc)) for k, m, doc in part]
        data = spark.createDataFrame(rows, "event_id bigint, ts string, value string")
        data.coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def batch_of(spark, parts):
    rows = [(k, START + timedelta(minutes=m), json.dumps(doc)) for part in parts for k, m, doc in part]
    return spark.createDataFrame(rows, SCHEMA)


def video(i, status="ready", progress=1.0):
    return {"type": "video.updated", "video": {"id": i, "projectId": "p", "status": status, "progress": progress}}


def moved(i, progress, status="analyzing"):
    return {"type": "video.progress", "videoId": i, "status": status, "progress": progress}


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(90):
        query.stop()
    assert query.exception() is None
    return query


def state_rows(query):
    """State rows of the last micro-batch that ran, and rows dropped behind the watermark in all of them."""
    found = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    return found[-1]["numRowsTotal"], sum(p["numRowsDroppedByWatermark"] for p in found)


def test_state_of_shuffled_late_and_repeated_events(spark, tmp_path):
    rng = random.Random(6)
    events, n = [], 0
    for k in range(160):
        entity = f"v{rng.randrange(7)}"
        doc = rng.choice([video(entity, "queued", 0.0), moved(entity, k % 100 / 100), moved(entity, 0.5), {"type": "video.deleted", "videoId": entity}])
        events.append((k, k / 60, doc))
    events += [(k, k / 60, {"type": "project.updated", "project": {"id": "p", "status": "draft"}}) for k in (160, 161)]
    events += rng.sample(events, 40)
    rng.shuffle(events)
    parts = [events[i : i + 60] for i in range(0, len(events), 60)]
    live, _ = SE.parse_events(feed(spark, tmp_path / "in", parts))
    query = finish(SE.stream_latest_state(live, ["event_id"], str(tmp_path / "state"), str(tmp_path / "cp"), "ts"))
    want = SE.latest_state(SE.parse_events(batch_of(spark, parts))[0], ["event_id"]).collect()
    assert sorted(SE.stored_state(spark, str(tmp_path / "state")).collect()) == sorted(want) and len(want) > 2
    assert state_rows(query)[1] == 0
    assert len(units.versions(spark, str(tmp_path / "state"))) <= 2  # old versions are not kept
    assert {r.entity_id for r in units.read(spark, str(tmp_path / "state"), "state").collect()} == {r.entity_id for r in want}


def test_state_ends_with_deletions_and_silence(spark, tmp_path):
    first = [(k, 0, video(f"v{k}")) for k in range(20)]
    second = [(100 + k, 1, {"type": "video.deleted", "videoId": f"v{k}"}) for k in range(12)]
    later = [(200, 240, video("w", "analyzing", 0.1))]
    after = [(300, 241, moved("w", 0.7))]  # the states end here
    late = [(3, 2, video("v3")), (400, 242, moved("w", 0.8))]  # v3 was deleted long before: must not come back
    parts = [first, second, later, after, late, [(500, 243, moved("w", 0.9))]]
    live, _ = SE.parse_events(feed(spark, tmp_path / "in", parts))
    writer = SE.stream_latest_state(live, ["event_id"], str(tmp_path / "state"), str(tmp_path / "cp"), "ts", ttl_ms=3_600_000)
    query = finish(writer)
    rows, dropped = state_rows(query)
    assert dropped == 1
    # of 21 entities one is neither deleted nor final and silent; a value and no expiry is left of it
    assert rows <= 3
    found = {r.entity_id: (r.status, r.progress) for r in SE.stored_state(spark, str(tmp_path / "state")).collect()}
    assert found == {f"v{k}": ("ready", 1.0) for k in range(12, 20)} | {"w": ("analyzing", 0.9)}


def test_throttle_keeps_late_rows_apart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"v{k % 3}", rng.random()) for k in range(300)]
    parts = [rows[:100], rows[100:200] + rows[40:60], rows[200:] + [(5, "v2", 0.5), rows[299]]]
    for part in parts:
        shuffled = rng.sample(part, len(part))
        data = spark.createDataFrame(shuffled, "event_id bigint, entity_id string, progress double").coalesce(1)
        data.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, entity_id string, progress double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = SE.throttle_stream(stream, "entity_id", 0.3, "string", with_late=True)
    finish(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    batch = spark.createDataFrame(rows, "event_id bigint, entity_id string, progress double")
    want = OG.progress_throttle(batch, "entity_id", ["event_id"], 0.3).collect()
    kept = sorted((r.entity_id, r.event_id) for r in got if not r.late)
    assert kept == sorted((r.entity_id, r.event_id) for r in want) and len(kept) < 250
    late = sorted(r.event_id for r in got if r.late)
    assert late == sorted([*range(40, 60), 5])  # a repetition within one micro-batch is no row of its own


def test_event_rate_drops_and_counts_late_rows(spark, tmp_path):
    parts = [[(k, k, moved("v", 0.1)) for k in range(0, 60, 5)], [(100, 180, moved("v", 0.2))], [(110, 182, moved("v", 0.2))], [(101, 2, moved("v", 0.3)), (102, 181, moved("v", 0.4))], [(103, 400, moved("v", 0.4))]]
    live, _ = SE.parse_events(feed(spark, tmp_path / "in", parts))
    live = live.withColumn("project_id", F.lit(1))
    rates = SE.event_rate(live, "1 hour")
    query = finish(rates.writeStream.format("memory").queryName("late_rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")))
    assert state_rows(query)[1] == 1
    hours = {r.start: r.n for r in spark.table("late_rates").collect()}
    assert hours == {START: 12, START + timedelta(hours=3): 3}
