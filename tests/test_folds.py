"""Greedy thinning in pieces and ranks of hot keys, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import folds, geo, scale


def throttle(values, step):
    last, kept = -1.0, []
    for k, v in enumerate(values):
        if v is not None and (abs(v - last) >= step or v == 1):
            kept.append(k)
            last = v
    return kept


def thin(times, step):
    last, kept = -math.inf, []
    for k, t in enumerate(times):
        if t - last >= step:
            kept.append(k)
            last = t
    return kept


def progress_case(rng, n):
    kind = rng.randrange(4)
    if kind == 0:  # slow rise
        return [min(1.0, k / n + rng.random() / 500) for k in range(n)]
    if kind == 1:
        return [rng.choice([None, 0.0, 0.25, 0.5, 0.51, 0.75, 1.0]) for _ in range(n)]
    if kind == 2:  # slow fall
        return [1 - k / n for k in range(n)]
    return [rng.random() for _ in range(n)]


@pytest.mark.parametrize("piece", [7, 64, 100_000])
def test_progress_throttle_in_pieces_equals_the_loop(spark, piece):
    rng = random.Random(piece)
    tracks = {k: progress_case(rng, rng.choice([1, 3, 40, 900])) for k in range(25)} | {None: progress_case(rng, 300)}
    rows = [(k, i, v, "x") for k, track in tracks.items() for i, v in enumerate(track)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "entity_id bigint, event_id bigint, progress double, more string").repartition(6)
    for step in (0.02, 0.3):
        got = {}
        for r in geo.progress_throttle(events, "entity_id", ["event_id"], step, piece).collect():
            got.setdefault(r.entity_id, []).append(r.event_id)
        # the operator clips first; greatest and least skip nulls, so a null becomes 1
        want = {k: throttle([1.0 if v is None else v for v in track], step) for k, track in tracks.items()}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("piece", [5, 50, 100_000])
def test_sample_track_in_pieces_equals_the_loop(spark, piece):
    rng = random.Random(piece)
    tracks = {}
    for k in range(20):
        t, times = 0.0, []
        for _ in range(rng.choice([1, 2, 60, 700])):
            t += rng.choice([0.0, 0.1, 0.2, 0.1, 0.7])
            times.append(t)
        tracks[f"v{k}"] = times
    rows = [(k, i, t, 59.0, 30.0) for k, track in tracks.items() for i, t in enumerate(track)]
    rng.shuffle(rows)
    points = spark.createDataFrame(rows, "video_id string, i bigint, t double, lat double, lon double").repartition(5)
    for step in (0.5, 3.0):
        got = {}
        for r in geo.sample_track(points, step, piece).collect():
            got.setdefault(r.video_id, []).append(r.t)
        assert {k: sorted(v) for k, v in got.items()} == {k: [track[i] for i in thin(track, step)] for k, track in tracks.items()}
    assert geo.sample_track(points.limit(0)).count() == 0


def test_one_key_is_the_work_of_many_tasks(spark):
    """A single entity: every piece is bounded, the pieces lie in many partitions, and the rows are the loop's."""
    n = 40_000
    values = [abs(math.sin(k / 900)) for k in range(n)]
    events = spark.range(n, numPartitions=8).select(
        F.lit(1).alias("entity_id"), F.col("id").alias("event_id"), F.abs(F.sin(F.col("id") / 900)).alias("progress")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        laid = scale.in_pieces(events, ["entity_id"], ["event_id"], 1000)
        sizes = [r["count"] for r in laid.groupBy("_piece").count().collect()]
        assert max(sizes) <= 1000 and len(sizes) >= 40
        assert laid.select(F.shiftright("_piece", 33)).distinct().count() >= 7
        assert laid.groupBy().agg(F.count("*")).first()[0] == n
        got = sorted(r.event_id for r in geo.progress_throttle(events, "entity_id", ["event_id"], 0.05, 1000).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == throttle(values, 0.05)


def test_map_of_a_piece_is_small(spark):
    rising = folds.np.linspace(0, 0.9, 20_000)
    thresholds, falls, exits = folds._map(rising, folds.Move(0.02))
    assert len(thresholds) < 1000 and not any(falls[2:])  # the rows within two steps
    times = folds.np.arange(20_000) / 8
    assert len(folds._map(times, folds.Advance(0.5))[0]) == 5


def test_ranks_of_one_hot_key(spark):
    n = 60_000
    rows = spark.range(n, numPartitions=8).select(F.lit("job").alias("job_id"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("at"))
    rows = rows.unionByName(spark.createDataFrame([("other", 5), ("other", 3), (None, 9)], "job_id string, at bigint"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ranked = scale.ranks_in_pieces(rows, ["job_id"], ["at"], "rank", 5000)
        wrong = ranked.where("job_id = 'job' AND rank <> at").count()
        assert wrong == 0 and ranked.where("job_id = 'job'").count() == n
        assert {(r.at, r["rank"]) for r in ranked.where("job_id = 'other'").collect()} == {(3, 0), (5, 1)}
        assert ranked.columns == ["job_id", "at", "rank"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
