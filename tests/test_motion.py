import dataclasses
import random

import pytest
from pyspark.sql import functions as F

import brute_motion as brute
from reelgrid.config import AnalysisSettings
from reelgrid.functions import motion as M
from reelgrid.operators import motion as OM
from reelgrid.operators import segments as OS

FPS = 5
BASE = dict(
    dx=0.0, dy=0.0, div=0.0, rot=0.0, px=0.0, py=0.0, fit=0.95, coherence=0.95, mag_var=1e-4, sharpness=500.0,
    brightness=120.0, overexposed=0.0,
)
PAN, FORWARD, ERRATIC, STATIC = dict(dx=-0.05), dict(div=0.08), dict(dx=0.03, dy=-0.02, fit=0.1), {}
S = AnalysisSettings(10, 50, 25, FPS, 1.0, False)


def timeline(*chunks):
    out = []
    for change, seconds in chunks:
        for _ in range(round(seconds * FPS)):
            out.append({"t": len(out) / FPS, **BASE, **change})
    return out


def frame(spark, videos):
    rows = [
        {"video_id": v, "i": i, **{k: float(x) for k, x in f.items()}} for v, fs in videos.items() for i, f in enumerate(fs)
    ]
    schema = "video_id string, i bigint, t double, " + ", ".join(f"{k} double" for k in BASE)
    return spark.createDataFrame(rows, schema)


def analyse(spark, videos, settings=S, span=None):
    df = frame(spark, videos)
    layout = OM.layout_of(df) if span is None else OM.layout_of(df, span=span)
    out = {v: [] for v in videos}
    for r in OS.segment_video_features(df, settings, layout).collect():
        out[r.video_id].append(r)
    return {v: sorted(rows, key=lambda r: r.start_sec) for v, rows in out.items()}


def test_golden_timelines(spark):
    got = analyse(
        spark,
        {
            "smooth": timeline((PAN, 30)),
            "classes": timeline((PAN, 25), (ERRATIC, 5), (FORWARD, 25)),
            "short": timeline((PAN, 10.5), (ERRATIC, 3), (FORWARD, 20)),
            "long": timeline((FORWARD, 121)),
            "hover": timeline((STATIC, 20)),
            "flicker": timeline((PAN, 15), (dict(dx=-0.012, px=0.05), 1), (PAN, 15)),
            "blur": timeline((PAN, 20), (dict(PAN, sharpness=20), 2), (PAN, 20)),
            "burnt": timeline((PAN, 20), (dict(PAN, overexposed=0.5, brightness=245), 2), (PAN, 20)),
            "speed": timeline((dict(dx=-0.03), 20), (dict(dx=-0.12), 20)),
            "jerk": timeline((PAN, 14), (dict(dx=-0.075), 0.2), (PAN, 16)),
            "wobble": timeline((dict(PAN, fit=0.6), 20)),
        },
    )
    kinds = {v: [r.motion_type for r in rows] for v, rows in got.items()}
    smooth = got["smooth"][0]
    assert kinds["smooth"] == ["pan_right"] and abs(smooth.start_sec - 0.5) < 1e-9 and abs(smooth.end_sec - 29.5) < 1e-9
    assert smooth.score > 0.85 and smooth.reasons[0] == "Smooth motion: pan right"
    assert kinds["classes"] == ["pan_right", "forward"]
    assert got["classes"][0].end_sec <= 25 and got["classes"][1].start_sec >= 30
    assert kinds["short"] == ["forward"]
    lengths = [r.end_sec - r.start_sec for r in got["long"]]
    assert len(lengths) == 5 and all(10 <= x <= 50 and abs(x - 24) < 5 for x in lengths)
    assert all(abs(a.end_sec - b.start_sec) < 1e-9 for a, b in zip(got["long"], got["long"][1:]))
    assert kinds["hover"] == []
    assert len(got["flicker"]) == 1 and abs(got["flicker"][0].end_sec - got["flicker"][0].start_sec - 30) < 1e-9
    assert len(got["blur"]) == len(got["burnt"]) == len(got["speed"]) == 2
    assert got["speed"][0].end_sec <= 20.5 and got["speed"][1].start_sec >= 19.5
    assert len(got["jerk"]) == 1 and got["jerk"][0].score < smooth.score
    assert "Slight jerk at 00:14" in got["jerk"][0].reasons
    assert len(got["wobble"]) == 1


def test_settings_change_the_outcome(spark):
    strict = dataclasses.replace(S, sensitivity=2)
    assert analyse(spark, {"w": timeline((dict(PAN, fit=0.6), 20))}, strict)["w"] == []
    hover = dataclasses.replace(S, include_static=True)
    assert [r.motion_type for r in analyse(spark, {"h": timeline((STATIC, 20))}, hover)["h"]] == ["static"]


def noisy(seed, n):
    """Regimes with flicker, bad frames, jumps and noise."""
    rnd = random.Random(seed)
    kinds = [PAN, FORWARD, STATIC, ERRATIC, dict(dx=-0.012, px=0.05), dict(dx=-0.12), dict(dy=0.05, py=0.04)]
    out = []
    while len(out) < n:
        kind = rnd.choice(kinds)
        for _ in range(rnd.choice([2, 4, 6, 9, 20, 60, 130])):
            f = {"t": len(out) / FPS, **BASE, **kind}
            f["dx"] += rnd.uniform(-1, 1) * 1e-3
            f["sharpness"] = 20.0 if rnd.random() < 0.01 else 500 + rnd.uniform(0, 50)
            f["brightness"] = rnd.choice([120.0, 120.0, 40.0, 215.0])
            f["overexposed"] = 0.5 if rnd.random() < 0.004 else rnd.choice([0.0, 0.03])
            f["mag_var"] = rnd.choice([1e-4, 1e-4, 9e-4])
            out.append(f)
    return out[:n]


@pytest.mark.parametrize(
    "settings", [AnalysisSettings(2, 6, 4, FPS, 1.0, True), AnalysisSettings(4, 7, 5, FPS, 0.5, False)]
)
def test_equals_plain_python_in_both_layouts(spark, settings):
    videos = {f"v{k}": noisy(k, n) for k, n in enumerate([900, 333, 61, 3, 500])}
    expected = {v: brute.segments(fs, settings) for v, fs in videos.items()}
    assert sum(map(len, expected.values())) > 20
    for span in (None, 128):
        got = analyse(spark, videos, settings, span)
        for v in videos:
            assert [(round(r.start_sec, 6), round(r.end_sec, 6), r.motion_type) for r in got[v]] == [
                e[:3] for e in expected[v]
            ]
            assert all(abs(r.score - e[3]) <= 0.0051 for r, e in zip(got[v], expected[v]))


def test_layouts_agree_on_signals(spark):
    df = frame(spark, {"a": noisy(7, 700), "b": noisy(8, 40)})
    cols = ["video_id", "i", "label", "speed", "jump", "bad", "jerk_onset", "instability", "run_start", "hard_start"]
    plain = OM.motion_signals(df, S, OM.Layout(2, 700)).select(*cols)
    chunked = OM.motion_signals(df, S, OM.Layout(2, 700, 64)).select(*cols)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, chunked.collect()), key=str)


def test_majority_rules(one):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(M.majority(arr("b", "a", "a", "b"), F.lit("b"))) == "b"
    assert one(M.majority(arr("c", "a", "a", "b", "b"), F.lit("c"))) == "a"
    assert one(M.running_median(arr(4.0, 1.0, 3.0, 2.0))) == 2.5


def test_one_exchange_before_merge(spark):
    df = frame(spark, {"a": noisy(1, 60)})
    runs = OM.motion_runs(OM.motion_signals(df, S, OM.Layout(1, 60)))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
