"""Registered queries of the motion chain with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motion as OM
from ..operators import segments as OS
from ..session import shared_path
from ..streaming import events as SE
from ..functions import motion as M
from ..operators.flow import exposure_stats, flow_stats
from . import bindings as B
from .bindings import SETTINGS, duck, duck_six, six


def motion_class(spark, sf):
    return B.frame_features(spark, sf).select(
        "video_id",
        "i",
        six(M.motion_activity()).alias("activity"),
        six(M.motion_speed()).alias("speed"),
        M.classify_motion(SETTINGS.strictness).alias("label"),
        six(M.exposure_quality()).alias("exposure"),
    )


def _signals(spark, sf):
    layout = B.features_layout(spark, sf)
    return OM.motion_signals(B.frame_features(spark, sf), SETTINGS, layout), layout


def motion_smooth(spark, sf):
    signals, _ = _signals(spark, sf)
    return signals.select(
        "video_id", "i", "label", six("speed").alias("speed"), six("smooth_fit").alias("smooth_fit")
    )


def motion_flags(spark, sf):
    signals, _ = _signals(spark, sf)
    return signals.select(
        "video_id", "i", six("change").alias("change"), six("jerk_threshold").alias("jerk_threshold"),
        six("var_threshold").alias("var_threshold"), six("sharpness_ref").alias("sharpness_ref"),
        "blur", "clipped", "jerk", "bad", "jerk_onset", six("instability").alias("instability"),
    )


def speed_jumps(spark, sf):
    signals, _ = _signals(spark, sf)
    return signals.select("video_id", "i", six("jump_score").alias("jump_score"), "jump")


def motion_runs(spark, sf):
    """Flagship: which steady camera moves does each video contain, how long and how fast?"""
    signals, _ = _signals(spark, sf)
    return OM.motion_runs(signals).select(
        "video_id", "run_start", "run_end", "label", "break_before",
        six("t_first").alias("t_first"), six("t_last").alias("t_last"), six("mean_speed").alias("mean_speed"),
    )


def motion_runs_trimmed(spark, sf):
    signals, _ = _signals(spark, sf)
    return OS.trim_runs(OM.motion_runs(signals), SETTINGS).select(
        "video_id", "label", "a", "b", six("start_sec").alias("start_sec"), six("end_sec").alias("end_sec")
    )


def _show(segments):
    return segments.select(
        "video_id", six("start_sec").alias("start_sec"), six("end_sec").alias("end_sec"), "motion_type", "score",
        F.array_join("reasons", "; ").alias("reasons"),
    )


def video_segments(spark, sf):
    layout = B.features_layout(spark, sf)
    return _show(OS.segment_video_features(B.frame_features(spark, sf), SETTINGS, layout))


def analysed_stream(spark, sf):
    """The same segments by the stream: samples arrive as files, videos are analysed per micro-batch and stored."""
    path = shared_path(spark, "arrivals")
    names = [f.name for f in B.frame_features(spark, sf).schema if f.name not in ("event_id", "k")]
    arrived = B.frame_features(spark, sf).select(*names)
    arrived.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(arrived.schema).parquet(f"{path}/in")
    query = SE.incremental_analysis(
        stream, lambda df: OS.segment_video_features(df, SETTINGS), f"{path}/out", f"{path}/checkpoint"
    )
    query.trigger(availableNow=True).start().awaitTermination()
    return _show(SE.analysed_segments(spark, f"{path}/out"))


def motion_names(spark, sf):
    """Samples per class, with the names of the class in every vocabulary."""
    labels = B.frame_features(spark, sf).select(M.classify_motion(SETTINGS.strictness).alias("motion"))
    return M.motion_dim(spark).join(labels.groupBy("motion").agg(F.count(F.lit(1)).alias("samples")), "motion")


def merged_runs(spark, sf):
    signals, _ = _signals(spark, sf)
    return OS.merge_runs(OM.motion_runs(signals), 6).select("video_id", "run_start", "run_end", "label")


def motion_series(spark, sf):
    signals, _ = _signals(spark, sf)
    return OS.motion_series(signals, SETTINGS)


def flow_summary(spark, sf):
    stats = flow_stats(B.flow_samples(spark, sf), width=320, height=180, fps=5.0)
    names = ["dx", "dy", "div", "rot", "px", "py", "fit", "coherence", "mag_var"]
    return stats.select("pair_id", *[six(n).alias(n) for n in names])


def exposure_summary(spark, sf):
    luma = B.flow_samples(spark, sf).select(
        "pair_id", F.floor(F.least(F.lit(255.0), F.abs("u") * 1500)).cast("int").alias("luma")
    )
    stats = exposure_stats(luma, "pair_id")
    return stats.select("pair_id", six("brightness").alias("brightness"), six("overexposed").alias("overexposed"))


QUERIES = {
    "motion_runs": motion_runs,
    "motion_class": motion_class,
    "motion_smooth": motion_smooth,
    "motion_flags": motion_flags,
    "speed_jumps": speed_jumps,
    "motion_runs_trimmed": motion_runs_trimmed,
    "merged_runs": merged_runs,
    "analysed_stream": analysed_stream,
    "motion_names": motion_names,
    "video_segments": video_segments,
    "motion_series": motion_series,
    "flow_stats": flow_summary,
    "exposure_stats": exposure_summary,
}

_CLASSIFIED = f"""{duck("frame_features")},
m AS (
  SELECT *, greatest(abs(dx), abs(dy), abs(div) * 35e-2, abs(rot) * 35e-2, abs(px) / 2, abs(py) / 2) AS activity,
    sqrt(dx * dx + dy * dy) + abs(div) * 35e-2 + abs(rot) * 35e-2 + abs(px) / 2 AS raw_speed,
    abs(div) * 35e-2 AS zoom, abs(rot) * 35e-2 AS spin, greatest(abs(dx), abs(dy)) AS shift
  FROM frame_features),
c AS (
  SELECT *, CASE
    WHEN activity < 6e-3 THEN 'static'
    WHEN fit < 45e-2 THEN 'erratic'
    WHEN spin >= 12e-1 * greatest(shift, zoom, abs(px) / 2) THEN CASE WHEN rot > 0 THEN 'orbit_left' ELSE 'orbit_right' END
    WHEN (zoom >= 6e-3 AND abs(dx) <= 6e-1 * abs(div) AND abs(dy) <= 45e-2 * abs(div))
      OR zoom >= 8e-1 * greatest(shift, abs(px) / 2) THEN CASE WHEN div > 0 THEN 'forward' ELSE 'backward' END
    WHEN greatest(abs(dx), abs(px) / 2) >= greatest(abs(dy), abs(py) / 2) THEN
      CASE WHEN abs(px) >= 1e-2 AND abs(dx) <= 6e-1 * abs(px) THEN CASE WHEN px > 0 THEN 'orbit_right' ELSE 'orbit_left' END
           WHEN dx < 0 THEN 'pan_right' ELSE 'pan_left' END
    WHEN abs(py) >= 35e-2 * abs(dy) THEN CASE WHEN dy > 0 THEN 'ascend' ELSE 'descend' END
    WHEN dy > 0 THEN 'tilt_up' ELSE 'tilt_down' END AS raw_label,
    least(1e0, greatest(0e0, 1 - overexposed / 12e-2)) * CASE
      WHEN brightness < 50 THEN least(1e0, greatest(0e0, (brightness - 25) / 25))
      WHEN brightness > 210 THEN least(1e0, greatest(0e0, (235 - brightness) / 25)) ELSE 1e0 END AS exposure
  FROM m)"""

# Majority per frame: the samples of each frame are joined and counted, no list functions involved.
_SMOOTHED = f"""{_CLASSIFIED},
votes AS (
  SELECT a.video_id, a.i, b.raw_label AS candidate, count(*) AS n, min(b.i) AS first_i,
         max(CASE WHEN b.raw_label = a.raw_label THEN 1 ELSE 0 END) AS is_centre
  FROM c a JOIN c b ON a.video_id = b.video_id AND b.i BETWEEN a.i - 4 AND a.i + 4
  GROUP BY ALL),
winner AS (
  SELECT video_id, i, candidate AS label FROM votes
  QUALIFY row_number() OVER (PARTITION BY video_id, i ORDER BY n DESC, is_centre DESC, first_i) = 1),
s AS (
  SELECT c.*, w.label,
    quantile_cont(raw_speed, 5e-1) OVER (PARTITION BY c.video_id ORDER BY c.i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS speed,
    quantile_cont(fit, 5e-1) OVER (PARTITION BY c.video_id ORDER BY c.i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS smooth_fit
  FROM c JOIN winner w ON c.video_id = w.video_id AND c.i = w.i)"""

_FLAGGED = f"""{_SMOOTHED},
d AS (
  SELECT *, coalesce(sqrt(pow(dx - lag(dx) OVER w, 2) + pow(dy - lag(dy) OVER w, 2))
      + abs(div - lag(div) OVER w) * 35e-2 + abs(rot - lag(rot) OVER w) * 35e-2, 0e0) AS change,
    coalesce(abs(speed - lag(speed) OVER w), 0e0) AS dspeed
  FROM s WINDOW w AS (PARTITION BY video_id ORDER BY i)),
th AS (
  SELECT video_id, greatest(2e-2, 6 * quantile_cont(change, 5e-1)) AS jerk_threshold,
    greatest(2e-2 * 2e-2, 6 * quantile_cont(mag_var, 5e-1)) AS var_threshold,
    quantile_cont(sharpness, 5e-1) AS sharpness_ref FROM d GROUP BY video_id),
f AS (
  SELECT d.*, jerk_threshold, var_threshold, sharpness_ref,
    sharpness_ref > 0 AND sharpness < 35e-2 * sharpness_ref AS blur,
    brightness < 25 OR brightness > 235 OR overexposed > 12e-2 AS clipped,
    change > 2 * jerk_threshold AS strong,
    NOT (change > 2 * jerk_threshold) AND (change > jerk_threshold OR mag_var > var_threshold) AS jerk,
    quantile_cont(change + dspeed, 5e-1) OVER (PARTITION BY d.video_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS instability
  FROM d JOIN th USING (video_id)),
g AS (
  SELECT *, strong OR blur OR clipped AS bad,
    jerk AND NOT coalesce(lag(jerk) OVER (PARTITION BY video_id ORDER BY i), false) AS jerk_onset FROM f)"""

_JUMPED = f"""{_FLAGGED},
j0 AS (
  SELECT *, quantile_cont(speed, 5e-1) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before,
    quantile_cont(speed, 5e-1) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS after,
    count(*) OVER (PARTITION BY video_id) AS n FROM g),
j1 AS (
  SELECT *, CASE WHEN i >= 10 AND i <= n - 10 AND greatest(before, after) >= 1e-2
      AND abs(after - before) / greatest(before, after) > 6e-1
    THEN abs(after - before) / greatest(before, after) ELSE 0e0 END AS jump_score FROM j0),
j AS (
  SELECT *, jump_score > 0
    AND jump_score > coalesce(max(jump_score) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)
    AND jump_score >= coalesce(max(jump_score) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0) AS jump
  FROM j1)"""

_RUNS = f"""{_JUMPED},
b AS (
  SELECT *, CASE WHEN bad THEN NULL WHEN lag(bad) OVER w IS NULL THEN 'start' WHEN lag(bad) OVER w THEN 'bad'
      WHEN jump THEN 'jump' WHEN label <> lag(label) OVER w THEN 'label' END AS break_before
  FROM j WINDOW w AS (PARTITION BY video_id ORDER BY i)),
island AS (
  SELECT *, count(break_before) OVER (PARTITION BY video_id ORDER BY i) AS run_no FROM b),
runs AS (
  SELECT video_id, min(i) AS run_start, max(i) + 1 AS run_end, arg_min(label, i) AS label,
    arg_min(break_before, i) AS break_before, min(t) AS t_first, max(t) AS t_last, avg(raw_speed) AS mean_speed
  FROM island WHERE NOT bad GROUP BY video_id, run_no)"""

#: Samples around the ideal place of a cut among which the calmest is chosen: 4 s at 5 samples a second.
SEARCH = 20
# A merged run ends where links between runs of its class end; the next one begins behind it.
_MERGED = f"""{_RUNS},
stretches AS (
  SELECT *, count(*) FILTER (WHERE break_before <> 'label') OVER (PARTITION BY video_id ORDER BY run_start) AS stretch FROM runs),
links AS (
  SELECT *, coalesce(lead(run_start) OVER (PARTITION BY video_id, stretch, label ORDER BY run_start) - run_end > 6, true) AS ends FROM stretches),
reaches AS (
  SELECT *, min(CASE WHEN ends THEN run_end END) OVER w AS reach, min(CASE WHEN ends THEN t_last END) OVER w AS t_reach
  FROM links WINDOW w AS (PARTITION BY video_id, stretch, label ORDER BY run_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
merged AS (
  SELECT * FROM reaches WHERE break_before <> 'label'
  UNION ALL SELECT r.* FROM merged m JOIN reaches r ON r.video_id = m.video_id AND r.stretch = m.stretch AND r.run_start = m.reach)"""

# Cuts of a run depend on each other: each is the calmest sample that leaves room for the others (20 samples around the ideal).
_SEGMENTS = f"""{_MERGED},
trimmed AS (
  SELECT video_id, label, run_start + 3 AS run_a, reach - 3 AS run_b, t_first + 5e-1 AS start_sec, t_reach + 2e-1 - 5e-1 AS end_sec
  FROM merged WHERE label NOT IN ('erratic', 'static') AND (t_reach + 2e-1 - 5e-1) - (t_first + 5e-1) >= 2),
planned AS (
  SELECT *, CAST(CASE WHEN run_b - run_a <= 30 THEN 1
      ELSE greatest(ceil((run_b - run_a) / 3e1), least(floor((run_b - run_a) / 1e1), floor((run_b - run_a) / 2e1 + 5e-1))) END AS BIGINT) AS n
  FROM trimmed),
cuts AS (
  SELECT *, CAST(0 AS BIGINT) AS k, run_a AS cut FROM planned
  UNION ALL
  SELECT c.video_id, c.label, c.run_a, c.run_b, c.start_sec, c.end_sec, c.n, c.k + 1, x.cut
  FROM cuts c JOIN LATERAL (
    WITH lim AS (
      SELECT CAST(floor(c.run_a + (c.k + 1) * (c.run_b - c.run_a) / CAST(c.n AS DOUBLE) + 5e-1) AS BIGINT) AS ideal),
    room AS (
      SELECT ideal, greatest(c.cut + 10, c.run_b - (c.n - c.k - 1) * 30, ideal - {SEARCH}) AS lo,
        least(c.cut + 30, c.run_b - (c.n - c.k - 1) * 10, ideal + {SEARCH}) AS hi FROM lim)
    SELECT CASE WHEN lo <= hi THEN (
        SELECT arg_min(g.i, (instability + abs(g.i - ideal) / {SEARCH}e0 * 1e-3, g.i)) FROM g
        WHERE g.video_id = c.video_id AND g.i BETWEEN lo AND hi)
      ELSE greatest(least(ideal, hi), lo) END AS cut FROM room) x ON true
  WHERE c.k + 1 < c.n),
pieces AS (
  SELECT *, cut AS a, coalesce(lead(cut) OVER (PARTITION BY video_id, run_a ORDER BY k), run_b) AS b FROM cuts),
rated AS (
  SELECT p.video_id, p.label, p.run_a, p.k, p.n, p.start_sec, p.end_sec,
    min(t) FILTER (WHERE i = a) AS t_a, min(t) FILTER (WHERE i = b) AS t_b,
    least(1e0, greatest(0e0, avg(smooth_fit) FILTER (WHERE i < b))) AS smoothness,
    avg(speed) FILTER (WHERE i < b) AS mean_speed, stddev_pop(speed) FILTER (WHERE i < b) AS sd_speed,
    quantile_cont(sharpness, 5e-1) FILTER (WHERE i < b) AS sharp_mid, max(sharpness_ref) AS sharp_ref,
    least(1e0, greatest(0e0, avg(exposure) FILTER (WHERE i < b))) AS light,
    coalesce(list(t + 1e-1 ORDER BY i) FILTER (WHERE i < b AND jerk_onset), []) AS jerks,
    arg_max(t + 1e-1, (overexposed, -i)) FILTER (WHERE i < b) AS worst_t, max(overexposed) FILTER (WHERE i < b) AS worst
  FROM pieces p JOIN g ON g.video_id = p.video_id AND g.i BETWEEN p.a AND p.b GROUP BY ALL),
scored AS (
  SELECT *, CASE WHEN k = 0 THEN start_sec ELSE t_a END AS seg_start, CASE WHEN k = n - 1 THEN end_sec ELSE t_b END AS seg_end,
    least(1e0, greatest(0e0, 1 - CASE WHEN mean_speed > 6e-3 THEN sd_speed / mean_speed ELSE 0e0 END / 6e-1)) AS steady,
    CASE WHEN sharp_ref > 0 THEN least(1e0, greatest(0e0, sharp_mid / sharp_ref)) ELSE 1e0 END AS sharp FROM rated),
mmss AS (SELECT *, list_transform(jerks, lambda s: printf('%02d:%02d', CAST(floor(s + 5e-1) AS BIGINT) // 60, CAST(floor(s + 5e-1) AS BIGINT) % 60)) AS marks,
    printf('%02d:%02d', CAST(floor(worst_t + 5e-1) AS BIGINT) // 60, CAST(floor(worst_t + 5e-1) AS BIGINT) % 60) AS worst_mark FROM scored
  WHERE seg_end - seg_start >= 2 - 1e-6)"""

_FLOW = f"""WITH {duck("flow_samples")},
ctr AS (SELECT pair_id, avg(x) AS cx, avg(y) AS cy FROM flow_samples GROUP BY 1),
rel AS (SELECT f.*, x - cx AS rx, y - cy AS ry FROM flow_samples f JOIN ctr USING (pair_id)),
fitted AS (
  SELECT pair_id, avg(u) AS a, avg(v) AS b, sum(u * rx) / sum(rx * rx) AS c1, sum(u * ry) / sum(ry * ry) AS c2,
    sum(v * rx) / sum(rx * rx) AS c3, sum(v * ry) / sum(ry * ry) AS c4, avg(u * u + v * v) AS f2,
    avg(sqrt(u * u + v * v)) AS mm FROM rel GROUP BY 1),
res AS (
  SELECT pair_id, avg(pow(u - (a + c1 * rx + c2 * ry), 2) + pow(v - (b + c3 * rx + c4 * ry), 2)) AS r2,
    count(*) FILTER (WHERE sqrt(u * u + v * v) > 5e-2) AS moving,
    count(*) FILTER (WHERE sqrt(u * u + v * v) > 5e-2 AND sqrt(a * a + b * b) > 1e-6
      AND (u * a + v * b) / (sqrt(u * u + v * v) * sqrt(a * a + b * b)) > 8e-1) AS aligned
  FROM rel JOIN fitted USING (pair_id) GROUP BY 1),
p AS (
  SELECT *, CASE WHEN c2 * c3 < 0 THEN sign(c3) * least(abs(c2), abs(c3)) ELSE 0e0 END AS spin,
    CASE WHEN c1 * c4 > 0 THEN sign(c1) * least(abs(c1), abs(c4)) ELSE 0e0 END AS zoom
  FROM fitted JOIN res USING (pair_id))
SELECT pair_id, {duck_six("a * (5e0 / 320)")} AS dx, {duck_six("b * (5e0 / 320)")} AS dy, {duck_six("zoom * 5")} AS div,
  {duck_six("spin * 5")} AS rot, {duck_six("-(c2 + spin) * 180 * (5e0 / 320)")} AS px,
  {duck_six("(c4 - zoom) * 180 * (5e0 / 320)")} AS py,
  {duck_six("CASE WHEN sqrt(f2) < 5e-2 THEN 1e0 ELSE least(1e0, greatest(0e0, 1 - sqrt(r2) / sqrt(f2))) END")} AS fit,
  {duck_six("CASE WHEN moving > 0 THEN aligned / moving ELSE 1e0 END")} AS coherence,
  {duck_six("greatest(0e0, f2 - mm * mm) * (5e0 / 320) * (5e0 / 320)")} AS mag_var
FROM p"""

ORACLES = {
    "motion_class": f"""WITH {_CLASSIFIED}
SELECT video_id, i, {duck_six("activity")} AS activity, {duck_six("raw_speed")} AS speed, raw_label AS label,
  {duck_six("exposure")} AS exposure FROM c""",
    "motion_smooth": f"""WITH {_SMOOTHED}
SELECT video_id, i, label, {duck_six("speed")} AS speed, {duck_six("smooth_fit")} AS smooth_fit FROM s""",
    "motion_flags": f"""WITH {_FLAGGED}
SELECT video_id, i, {duck_six("change")} AS change, {duck_six("jerk_threshold")} AS jerk_threshold,
  {duck_six("var_threshold")} AS var_threshold, {duck_six("sharpness_ref")} AS sharpness_ref,
  blur, clipped, jerk, bad, jerk_onset, {duck_six("instability")} AS instability FROM g""",
    "speed_jumps": f"""WITH {_JUMPED}
SELECT video_id, i, {duck_six("jump_score")} AS jump_score, jump FROM j""",
    "motion_runs": f"""WITH {_RUNS}
SELECT video_id, run_start, run_end, label, break_before, {duck_six("t_first")} AS t_first, {duck_six("t_last")} AS t_last,
  {duck_six("mean_speed")} AS mean_speed FROM runs""",
    "motion_runs_trimmed": f"""WITH {_RUNS}
SELECT video_id, label, run_start + 3 AS a, run_end - 3 AS b, {duck_six("t_first + 5e-1")} AS start_sec,
  {duck_six("t_last + 2e-1 - 5e-1")} AS end_sec
FROM runs WHERE label NOT IN ('erratic', 'static') AND (t_last + 2e-1 - 5e-1) - (t_first + 5e-1) >= 2""",
    "merged_runs": f"""WITH RECURSIVE {_MERGED}
SELECT video_id, run_start, reach AS run_end, label FROM merged""",
    "video_segments": f"""WITH RECURSIVE {_SEGMENTS}
SELECT video_id, {duck_six("seg_start")} AS start_sec, {duck_six("seg_end")} AS end_sec, label AS motion_type,
  floor(least(1e0, greatest(0e0, smoothness * 35e-2 + steady * 25e-2 + sharp * 2e-1 + light * 2e-1 - len(jerks) * 6e-2)) * 100 + 5e-1) / 100 AS score,
  array_to_string(list_filter([
    CASE WHEN smoothness >= 8e-1 THEN 'Smooth motion: ' WHEN smoothness >= 6e-1 THEN 'Fairly smooth motion: ' ELSE 'Uneven motion: ' END
      || CASE label {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in M.REASON_PHRASES.items())} END,
    CASE WHEN steady >= 8e-1 THEN 'Steady speed' WHEN steady < 5e-1 THEN 'Speed varies noticeably' END,
    CASE WHEN len(marks) > 0 THEN 'Slight jerk at ' || marks[1] END, CASE WHEN len(marks) > 1 THEN 'Slight jerk at ' || marks[2] END,
    CASE WHEN len(marks) > 2 THEN 'Slight jerk at ' || marks[3] END,
    CASE WHEN len(marks) > 3 THEN 'More jerks: ' || (len(marks) - 3) END,
    CASE WHEN sharp < 6e-1 THEN 'Softer than usual (possible blur)' END,
    CASE WHEN light < 7e-1 THEN CASE WHEN worst > 6e-2 THEN 'Overexposure at ' || worst_mark ELSE 'Imperfect exposure' END END],
    lambda r: r IS NOT NULL), '; ') AS reasons FROM mmss""",
    "motion_names": f"""WITH {_CLASSIFIED},
names AS (SELECT * FROM (VALUES {", ".join(str((k, m, M.MOTION_LABELS[m], M.REASON_PHRASES[m], M.PROMPT_PHRASES[m], M.MOTION_SLUGS[m], M.MOVEMENT_TERMS.get(m, ""))) for k, m in enumerate(M.MOTION_TYPES))})
  v(ord, motion, label, reason, prompt, slug, movement))
SELECT motion, ord, label, reason, prompt, slug, nullif(movement, '') AS movement, count(*) AS samples
FROM names JOIN c ON raw_label = motion GROUP BY ALL""",
    "motion_series": f"""WITH {_SMOOTHED}
SELECT video_id, i, floor((t + 1e-1) * 1000 + 5e-1) / 1000 AS t,
  floor(least(1e0, greatest(0e0, speed / 1e-1)) * 1000 + 5e-1) / 1000 AS speed,
  floor(least(1e0, greatest(0e0, smooth_fit)) * 1000 + 5e-1) / 1000 AS smoothness, label AS motion FROM s""",
    "flow_stats": _FLOW,
    "exposure_stats": f"""WITH {duck("flow_samples")},
l AS (SELECT pair_id, CAST(floor(least(255e0, abs(u) * 1500)) AS INT) AS luma FROM flow_samples)
SELECT pair_id, {duck_six("avg(luma)")} AS brightness,
  {duck_six("count(*) FILTER (WHERE luma >= 250) / count(*)")} AS overexposed FROM l GROUP BY 1""",
}
ORACLES["analysed_stream"] = ORACLES["video_segments"]
