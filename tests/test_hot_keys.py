"""Hot keys: single files of any size, variants of one content, names and neighbours in one bucket."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.operators import catalog as C
from reelgrid.operators import clips as K
from reelgrid.operators import naming as N
from reelgrid.sources.ordered_files import write_ordered_files


def test_one_file_of_many_parts(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(20_000, numPartitions=8).select(
        F.when(F.col("id") % 1000 == 0, "small/b.txt").otherwise("big/a b%.txt").alias("file"),
        F.col("id").alias("at"), F.concat(F.lit("line é "), F.col("id").cast("string")).alias("value"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = write_ordered_files(lines, path, ["at"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    big = "".join(f"line é {k}\n" for k in range(20_000) if k % 1000).encode()
    assert (tmp_path / "out" / "big" / "a b%.txt").read_bytes() == big and sizes["big/a b%.txt"] == len(big)
    assert (tmp_path / "out" / "small" / "b.txt").read_text().count("\n") == 20
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"big", "small"}  # nothing staged is left


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = lambda *names: spark.createDataFrame([(n, k, f"{n}{k}") for n in names for k in range(3)], "file string, at int, value string")
    write_ordered_files(lines("a", "b", "c"), path, ["at"])
    broken = lines("a", "b").withColumn("value", F.when(F.col("at") == 2, F.raise_error(F.lit("torn")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="torn"):
        write_ordered_files(broken, path, ["at"])
    read = lambda: {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert read() == {n: f"{n}0\n{n}1\n{n}2\n" for n in "abc"}
    write_ordered_files(lines("a").withColumn("value", F.lit("x")), path, ["at"], emptied=["b", "a"])
    assert read() == {"a": "x\nx\nx\n", "c": "c0\nc1\nc2\n"}


def near(x, y, tolerance):
    return (x is None and y is None) or (x is not None and y is not None and abs(x - y) <= tolerance)


def brute_earlier(rows):
    out = {}
    for i, (vid, content, created, d, f) in enumerate(rows):
        matches = [r for r in rows if r[1] == content and near(r[3], d, C.DURATION_TOLERANCE) and near(r[4], f, C.FPS_TOLERANCE)]
        first = min(matches, key=lambda r: (r[2], r[0]))
        if (first[2], first[0]) < (created, vid):
            out[vid] = first[0]
    return out


def videos_of(spark, rows):
    df = spark.createDataFrame(rows, "id string, content_hash string, created_at bigint, duration_sec double, fps double")
    return df.withColumns({"size_bytes": F.lit(5), "width": F.lit(1), "height": F.lit(1), "codec": F.lit("h"), "creation_time": F.lit(None).cast("string")})


@pytest.mark.parametrize("paired", [0, 64])
def test_earlier_duplicates_swept_and_paired(spark, monkeypatch, paired):
    monkeypatch.setattr(C, "PAIRED_VARIANTS", paired)
    rng = random.Random(paired)
    rows = []
    for k in range(400):
        d = rng.choice([None, round(10 + rng.random() * 3, 3), 10 + rng.randrange(60) * 0.05])
        f = rng.choice([None, 25.0, 25.0, 25.01, 25.005, 24.99, round(25 + rng.random() / 20, 4)])
        rows.append((f"v{k:03d}", rng.choice(["x", "x", "x", "y"]), rng.randrange(300), d, f))
    found = {r.id: r.duplicate_of_id for r in C.find_earlier_duplicate(videos_of(spark, rows)).collect()}
    assert found == brute_earlier(rows) and len(found) > 100


def test_very_many_variants_of_one_content(spark):
    n = 20_000
    rows = spark.range(n, numPartitions=4).select(
        F.format_string("v%06d", "id").alias("id"), F.lit("x").alias("content_hash"), F.col("id").alias("created_at"),
        (F.col("id") * 7919 % n / 10_000).alias("duration_sec"), F.lit(25.0).alias("fps"),
    )
    rows = rows.withColumns({"size_bytes": F.lit(5), "width": F.lit(1), "height": F.lit(1), "codec": F.lit("h"), "creation_time": F.lit(None).cast("string")})
    found = {int(r.id[1:]): int(r.duplicate_of_id[1:]) for r in C.find_earlier_duplicate(rows).collect()}
    seconds = (np.arange(n) * 7919 % n) / 10_000
    order = np.argsort(seconds)
    assert len(found) > 0.99 * n
    for v in range(0, n, 997):
        window = order[(np.abs(seconds[order] - seconds[v]) <= C.DURATION_TOLERANCE)]
        assert found.get(v, v) == window.min()


def test_a_million_equal_names_are_one_interval():
    taken = N.Taken(76)
    assert [taken.take("mill") for _ in range(3)] == ["mill", "mill_2", "mill_3"]
    for _ in range(300_000):
        last = taken.take("mill")
    assert last == "mill_300003" and sum(len(first) for first, _ in taken.numbers.values()) == 1 + 1
    assert taken.take("mill_300004") == "mill_300004" and taken.take("mill") == "mill_300005"
    assert taken.take("mill_2") == "mill_2_2"
    long = "y" * 76
    names = [taken.take(long) for _ in range(120)]
    assert len(set(names)) == 120 and max(map(len, names)) == 76


def test_ordinals_and_neighbours_of_one_day(spark, monkeypatch):
    """All clips of one job and one day, all videos of one project and month: ranked in pieces."""
    n = 3000
    manifest = spark.range(n, numPartitions=6).select(
        F.lit("j").alias("job_id"), F.format_string("s%05d", F.col("id")).alias("segment_id"), (F.col("id") * 7 % n).alias("start_sec")
    )
    existing = manifest.where("start_sec < 100").select("job_id", "segment_id")
    fresh = K.new_clips(manifest, existing, ["start_sec", "segment_id"]).collect()
    assert sorted((r.start_sec, r.ordinal) for r in fresh) == [(k, k) for k in range(100, n)]
    videos = manifest.select(
        F.lit("p").alias("project_id"), F.col("segment_id").alias("id"), F.col("start_sec").alias("created_at"),
        F.lit("ready").alias("status"), F.lit(True).alias("reviewed"),
    )
    following = {r.id: r.next_id for r in C.next_video(videos).collect()}
    order = [r.id for r in videos.orderBy("created_at").select("id").collect()]
    assert following == dict(zip(order, [*order[1:], None], strict=True))
