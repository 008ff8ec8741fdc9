import random
import statistics

from pyspark.sql import functions as F

from reelgrid.operators import scale


def rows(spark, n=700, seed=1):
    """One key holds most of the rows."""
    rnd = random.Random(seed)
    data, at = [], {}
    for _ in range(n):
        k = "hot" if rnd.random() < 0.7 else rnd.choice("abc")
        i = at.get(k, 0)
        at[k] = i + 1
        data.append((k, i, rnd.choice([None, rnd.randrange(50)]), float(rnd.randrange(30))))
    return data, spark.createDataFrame(data, "k string, i bigint, v int, x double")


def test_running_last_crosses_spans(spark):
    data, df = rows(spark)
    got = {(r.k, r.i): r.last for r in scale.running_last(df, ["k"], "i", {"last": F.col("v")}, 16).collect()}
    last = {}
    for k, i, v, _ in data:
        last[k] = v if v is not None else last.get(k)
        assert got[k, i] == last[k]


def test_dense_rank_counts_over_buckets(spark):
    data, df = rows(spark)
    out = scale.dense_rank_in_order(df, ["k"], ["x", "i"], F.floor(F.col("x") / 4), "pos").collect()
    for key in "hot", "a":
        ordered = sorted((r.x, r.i, r.pos) for r in out if r.k == key)
        assert [p for *_, p in ordered] == list(range(len(ordered)))


def test_neighbours_across_buckets(spark):
    data, df = rows(spark)
    out = scale.with_neighbours(df, ["k"], ["x", "i"], F.floor(F.col("x") / 4), ["i"]).collect()
    hot = sorted((r for r in out if r.k == "hot"), key=lambda r: (r.x, r.i))
    assert [r.next.i for r in hot[:-1]] == [r.i for r in hot[1:]] and hot[-1].next is None
    assert [r.prev.i for r in hot[1:]] == [r.i for r in hot[:-1]] and hot[0].prev is None


def test_ranked_medians_equal_direct_ones(spark):
    data, df = rows(spark, 901)
    for slices in (4, 256):
        got = {r.k: r.x for r in scale.ranked_medians(df.select("k", "x"), ["k"], "x", slices).collect()}
        assert got == {k: statistics.median(x for kk, _, _, x in data if kk == k) for k in ("hot", "a", "b", "c")}


def test_halo_rows_belong_to_one_span(spark):
    df = spark.range(100).select(F.lit("v").alias("k"), F.col("id").alias("i"))
    out = scale.with_halo(df, "i", 5, 5, 32)
    assert out.where("own").count() == 100
    assert sorted(r.i for r in out.where("chunk = 1").collect()) == list(range(27, 69))
