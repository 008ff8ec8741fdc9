"""Runs -> merged runs -> trimmed runs -> pieces -> scored segments, and segment set algebra."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import AnalysisConfig, AnalysisSettings, round_half_up
from ..functions import motion as M
from ..functions.numeric import clamp01, compact, half_up, literal_map
from ..functions.numeric import round_half_up as round_digits
from ..functions.timecode import format_short_time
from . import folds, scale
from .motion import KEY, Layout, layout_of, motion_runs, stored_signals

RUN_SCHEMA = (
    "video_id {key}, run_start bigint, run_end bigint, label string, t_first double, t_last double"
)


def merge_runs(runs: DataFrame, max_gap: int, span: int | None = None) -> DataFrame:
    """Join same-class runs across short label flicker, left to right.

    Merging never crosses a bad sample or a jump, so each (video, hard_start) stretch is independent.
    Rows stream through sorted; the state is one open run and at most ``max_gap`` undecided ones. With ``span``
    (videos longer than one span) the stretches are cut into pieces as well, see ``_merge_in_spans``.
    """
    if span:
        return _merge_in_spans(runs, max_gap, span)
    key_type = dict(runs.dtypes)[KEY]

    # A run is a list: video_id, hard_start, run_start, run_end, label, t_first, t_last.
    start, end, label, t_last = 2, 3, 4, 6

    def stretch(rows):
        base, waiting, gap = None, [], 0
        for row in rows:
            pending = [row]
            while pending:
                run = pending.pop(0)
                if base is None:
                    base, waiting, gap = list(run), [], 0
                elif run[label] == base[label]:
                    base[end], base[t_last] = run[end], run[t_last]
                    waiting, gap = [], 0
                else:
                    waiting.append(run)
                    gap += run[end] - run[start]
                    if gap > max_gap:
                        yield base
                        pending = waiting + pending
                        base, waiting, gap = None, [], 0
        if base is not None:
            yield base
            # What the last base skipped over is looked at again on its own.
            yield from stretch(waiting)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [KEY, "hard_start", "run_start", "run_end", "label", "t_first", "t_last"]
        rows = (r for b in batches for r in zip(*[b[c].tolist() for c in columns]))
        out = []
        for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
            for run in stretch(group):
                out.append(run)
                if len(out) >= 8192:
                    yield pd.DataFrame(out, columns=columns).drop(columns="hard_start")
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns).drop(columns="hard_start")

    ordered = (
        runs.select(KEY, "hard_start", "run_start", "run_end", "label", "t_first", "t_last")
        .repartition(KEY, "hard_start")
        .sortWithinPartitions(KEY, "hard_start", "run_start")
    )
    return ordered.mapInPandas(fold, RUN_SCHEMA.format(key=key_type))


def _merge_in_spans(runs: DataFrame, max_gap: int, span: int) -> DataFrame:
    """The same runs without a task per stretch.

    A run takes up the next run of its class if at most ``max_gap`` samples lie between them, so a merged run that
    begins with it ends where such links end: an island of linked runs. The next merged run begins right behind that
    end, whatever was skipped, which leaves a chain of jumps from start to start, followed in pieces.
    """
    stretch = [KEY, "hard_start", "label"]
    columns = [KEY, "hard_start", "run_start", "run_end", "label", "t_first", "t_last"]
    linked = scale.with_neighbours(
        runs.select(*columns), stretch, ["run_start"], F.floor(F.col("run_start") / span), ["run_start"]
    )
    ends = F.coalesce(F.col("next.run_start") - F.col("run_end") > max_gap, F.lit(True))
    linked = linked.withColumn("_back", -F.col("run_start"))
    islands = scale.running_last(
        linked, stretch, "_back", {"_last": F.when(ends, F.struct("run_end", "t_last"))}, span
    ).withColumn("_reach", F.col("_last.run_end"))
    rows = islands.select(*columns, "_last", "_reach")
    starts = folds.thinned(rows, KEY, ["run_start"], "run_start", folds.Reach(), span, "_reach")
    return starts.select(
        KEY, "run_start", F.col("_last.run_end").alias("run_end"), "label", "t_first", F.col("_last.t_last").alias("t_last")
    )


def trim_runs(
    runs: DataFrame, settings: AnalysisSettings, cfg: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Cut the transition jitter off both ends and drop unusable or short runs."""
    fps, trim = settings.analysis_fps, cfg.segment.trim_sec
    samples = math.ceil(trim * fps - 1e-9)
    out = runs.withColumns(
        {
            "start_sec": F.col("t_first") + trim,
            "end_sec": F.col("t_last") + 1 / fps - trim,
            "a": F.col("run_start") + samples,
            "b": F.col("run_end") - samples,
        }
    )
    usable = F.col("label") != "erratic"
    if not settings.include_static:
        usable = usable & (F.col("label") != "static")
    return out.where(usable & (F.col("end_sec") - F.col("start_sec") >= settings.min_duration))


def split_runs(
    trimmed: DataFrame,
    signals: DataFrame,
    settings: AnalysisSettings,
    cfg: AnalysisConfig = AnalysisConfig(),
    span: int = scale.SPAN,
) -> DataFrame:
    """Pieces within [min, max] samples, cut at the stablest points.

    Output: video_id, label, run_a, k, n, a, b, start_sec, end_sec (run bounds), run_b.
    """
    fps = settings.analysis_fps
    lo_n, hi_n = round_half_up(settings.min_duration * fps), round_half_up(settings.max_duration * fps)
    target = settings.target_duration * fps
    search = round_half_up(cfg.segment.split_search_sec * fps)
    length = F.col("b") - F.col("a")
    fewest, most = F.ceil(length / hi_n), F.floor(length / lo_n)
    plan = trimmed.select(
        KEY, "label", F.col("a").alias("run_a"), F.col("b").alias("run_b"), "a", "b", "start_sec", "end_sec",
        F.when(length <= hi_n, F.lit(1))
        .when(fewest > most, F.lit(0))
        .otherwise(F.greatest(fewest, F.least(most, half_up(length / target))))
        .cast("bigint").alias("n"),
    )
    out = plan.where("n = 1").withColumn("k", F.lit(0).cast("bigint"))
    out = out.unionByName(_cut_pieces(plan.where("n > 1"), signals, lo_n, hi_n, search, span))
    if hi_n < 2 * lo_n:
        # Only then can a long run have no partition within the limits.
        out = out.unionByName(_calmest_window(plan.where("n = 0"), signals, hi_n, span))
    return out.select(KEY, "label", "run_a", "run_b", "k", "n", "a", "b", "start_sec", "end_sec")


def _cut_pieces(plan: DataFrame, signals, lo_n: int, hi_n: int, search: int, span: int) -> DataFrame:
    key_type = dict(plan.dtypes)[KEY]
    length = F.col("run_b") - F.col("run_a")
    cuts = plan.select(
        KEY, "run_a", "run_b", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") - 1)).alias("k")
    ).withColumn("ideal", half_up(F.col("run_a") + F.col("k") * length / F.col("n")))
    # When no search window can touch its neighbours' limits, cuts do not depend on each other and a
    # long run may be folded in blocks.
    piece = length / F.col("n")
    free = (piece - 1 - 2 * search >= lo_n) & (piece + 1 + 2 * search <= hi_n)
    cuts = cuts.withColumn("block", F.when(free, F.floor(F.col("k") / 64)).otherwise(F.lit(0)))
    wanted = cuts.select(
        KEY, "run_a", "k", "ideal",
        F.explode(
            scale.interval_chunks(F.greatest(F.lit(0), F.col("ideal") - search), F.col("ideal") + search + 1, span)
        ).alias("chunk"),
    )
    samples = signals.select(KEY, F.floor(F.col("i") / span).alias("chunk"), "i", "instability")
    near = (
        wanted.join(samples, [KEY, "chunk"])
        .where(F.abs(F.col("i") - F.col("ideal")) <= search)
        .groupBy(KEY, "run_a", "k")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("i", "instability"))), lambda s: s["instability"]
            ).alias("costs"),
            F.min("i").alias("first_i"),
        )
    )
    ready = (
        cuts.join(near, [KEY, "run_a", "k"], "left")
        .repartition(KEY, "run_a", "block")
        .sortWithinPartitions(KEY, "run_a", "k")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state_key, prev = None, 0
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                if (r.video_id, r.run_a, r.block) != state_key:
                    state_key = (r.video_id, r.run_a, r.block)
                    prev = r.run_a if r.block == 0 else r.ideal - search - lo_n
                left = r.n - r.k
                lo = max(prev + lo_n, r.run_b - left * hi_n, r.ideal - search)
                hi = min(prev + hi_n, r.run_b - left * lo_n, r.ideal + search)
                cut = max(min(r.ideal, hi), lo)
                if lo <= hi:
                    c = np.arange(lo, hi + 1)
                    calm = np.asarray(r.costs)[c - int(r.first_i)]
                    cut = int(c[np.argmin(calm + np.abs(c - r.ideal) / max(1, search) * 1e-3)])
                found.append((r.video_id, r.run_a, r.k, cut))
                prev = cut
            yield pd.DataFrame(found, columns=[KEY, "run_a", "k", "cut"])

    chosen = ready.mapInPandas(fold, f"video_id {key_type}, run_a bigint, k bigint, cut bigint")
    edges = plan.select(KEY, "run_a", F.lit(0).cast("bigint").alias("k"), F.col("run_a").alias("cut")).unionByName(
        chosen
    )
    following = F.lead("cut").over(W.partitionBy(KEY, "run_a").orderBy("k"))
    return (
        edges.withColumn("next", following)
        .join(plan.drop("a", "b"), [KEY, "run_a"])
        .withColumns({"a": F.col("cut"), "b": F.coalesce(F.col("next"), F.col("run_b"))})
        .select(*plan.columns, "k")
    )


def _calmest_window(plan: DataFrame, signals: DataFrame, size: int, span: int) -> DataFrame:
    """No partition exists (max < 2 min): keep the stablest window of ``size`` samples."""
    wanted = plan.select(
        KEY, "run_a", "run_b", F.explode(scale.interval_chunks(F.col("run_a"), F.col("run_b"), span)).alias("chunk")
    )
    inside = (
        wanted.join(signals.select(KEY, F.floor(F.col("i") / span).alias("chunk"), "i", "instability"), [KEY, "chunk"])
        .where((F.col("i") >= F.col("run_a")) & (F.col("i") < F.col("run_b")))
        .drop("chunk")
    )
    spread = scale.with_halo(inside, "i", 0, size, max(span, size))
    ahead = W.partitionBy(KEY, "run_a", "chunk").orderBy("i").rowsBetween(0, size - 1)
    rated = (
        spread.withColumns({"cost": F.avg("instability").over(ahead), "seen": F.count("i").over(ahead)})
        .where(F.col("own") & (F.col("seen") == size))
        .groupBy(KEY, "run_a")
        .agg(F.min_by("i", F.struct("cost", "i")).alias("best"))
    )
    return (
        plan.drop("a", "b")
        .join(rated, [KEY, "run_a"])
        .withColumns({"a": F.col("best"), "b": F.col("best") + size, "k": F.lit(0).cast("bigint"), "n": F.lit(1).cast("bigint")})
        .select(*plan.columns, "k")
    )


def score_segments(
    pieces: DataFrame,
    signals: DataFrame,
    settings: AnalysisSettings,
    cfg: AnalysisConfig = AnalysisConfig(),
    span: int = scale.SPAN,
) -> DataFrame:
    """Weighted quality score and ordered reasons of each piece (a piece holds at most max samples)."""
    fps, sc = settings.analysis_fps, cfg.score
    wanted = pieces.withColumn("chunk", F.explode(scale.interval_chunks(F.col("a"), F.col("b") + 1, span)))
    samples = signals.select(
        KEY, F.floor(F.col("i") / span).alias("chunk"), "i", "t", "smooth_fit", "speed", "sharpness",
        "sharpness_ref", "overexposed", "jerk_onset", M.exposure_quality(cfg.segment).alias("exposure_q"),
    )
    joined = wanted.join(samples, [KEY, "chunk"]).where(
        (F.col("i") >= F.col("a")) & (F.col("i") <= F.col("b"))
    )
    within = F.col("i") < F.col("b")
    inner = lambda c: F.when(within, F.col(c))
    middle = F.col("t") + 0.5 / fps
    stats = joined.groupBy(*pieces.columns).agg(
        F.min(F.when(F.col("i") == F.col("a"), F.col("t"))).alias("t_a"),
        F.min(F.when(F.col("i") == F.col("b"), F.col("t"))).alias("t_b"),
        clamp01(F.avg(inner("smooth_fit"))).alias("smoothness"),
        F.avg(inner("speed")).alias("mean_speed"),
        F.stddev_pop(inner("speed")).alias("sd_speed"),
        F.percentile(inner("sharpness"), F.lit(0.5)).alias("sharp_mid"),
        F.max("sharpness_ref").alias("sharp_ref"),
        clamp01(F.avg(inner("exposure_q"))).alias("exposure"),
        F.array_sort(F.collect_list(F.when(within & F.col("jerk_onset"), middle))).alias("jerks"),
        F.max_by(
            F.struct(middle.alias("t"), F.col("overexposed").alias("share")),
            F.when(within, F.struct("overexposed", -F.col("i"))),
        ).alias("worst"),
    )
    cv = F.when(
        F.col("mean_speed") > cfg.classify.static_max, F.col("sd_speed") / F.col("mean_speed")
    ).otherwise(0.0)
    stats = stats.withColumns(
        {
            "speed_stability": clamp01(F.lit(1.0) - cv / sc.speed_cv_max),
            "sharp": clamp01(F.when(F.col("sharp_ref") > 0, F.col("sharp_mid") / F.col("sharp_ref")).otherwise(1.0)),
            "seg_start": F.when(F.col("k") == 0, F.col("start_sec")).otherwise(F.col("t_a")),
            "seg_end": F.when(F.col("k") == F.col("n") - 1, F.col("end_sec")).otherwise(F.col("t_b")),
        }
    ).where(F.col("seg_end") - F.col("seg_start") >= settings.min_duration - 1e-6)
    raw = (
        F.col("smoothness") * sc.smoothness
        + F.col("speed_stability") * sc.speed_stability
        + F.col("sharp") * sc.sharpness
        + F.col("exposure") * sc.exposure
        - F.size("jerks") * sc.jerk_penalty
    )
    return stats.select(
        KEY,
        F.col("seg_start").alias("start_sec"),
        F.col("seg_end").alias("end_sec"),
        F.col("label").alias("motion_type"),
        round_digits(clamp01(raw), 2).alias("score"),
        _reasons(cfg).alias("reasons"),
    )


def _reasons(cfg: AnalysisConfig) -> Column:
    phrase = literal_map(M.REASON_PHRASES)[F.col("label")]
    grade = (
        F.when(F.col("smoothness") >= 0.8, "Smooth motion: ")
        .when(F.col("smoothness") >= 0.6, "Fairly smooth motion: ")
        .otherwise("Uneven motion: ")
    )
    steadiness = F.when(F.col("label") == "static", F.lit(None)).otherwise(
        F.when(F.col("speed_stability") >= 0.8, "Steady speed").when(
            F.col("speed_stability") < 0.5, "Speed varies noticeably"
        )
    )
    light = F.when(
        F.col("exposure") < 0.7,
        F.when(
            F.col("worst.share") > cfg.segment.clip_share / 2,
            F.concat(F.lit("Overexposure at "), format_short_time(F.col("worst.t"))),
        ).otherwise("Imperfect exposure"),
    )
    extra = F.size("jerks") - 3
    return F.concat(
        compact([F.concat(grade, phrase), steadiness]),
        F.transform(
            F.slice("jerks", 1, 3), lambda t: F.concat(F.lit("Slight jerk at "), format_short_time(t))
        ),
        compact(
            [
                F.when(extra > 0, F.concat(F.lit("More jerks: "), extra.cast("string"))),
                F.when(F.col("sharp") < 0.6, F.lit("Softer than usual (possible blur)")),
                light,
            ]
        ),
    )


def segment_signals(
    signals: DataFrame,
    settings: AnalysisSettings,
    layout: Layout,
    cfg: AnalysisConfig = AnalysisConfig(),
) -> DataFrame:
    """Stored signals -> scored segment proposals."""
    gap = round_half_up(cfg.segment.merge_gap_sec * settings.analysis_fps)
    merged = merge_runs(motion_runs(signals), gap, layout.span if layout.chunked else None)
    trimmed = trim_runs(merged, settings, cfg)
    pieces = split_runs(trimmed, signals, settings, cfg, layout.span)
    return score_segments(pieces, signals, settings, cfg, layout.span)


def segment_video_features(
    features: DataFrame,
    settings: AnalysisSettings,
    layout: Layout | None = None,
    cfg: AnalysisConfig = AnalysisConfig(),
) -> DataFrame:
    """The whole chain from features to segments."""
    layout = layout or layout_of(features)
    return segment_signals(stored_signals(features, settings, layout, cfg), settings, layout, cfg)


def motion_series(
    signals: DataFrame, settings: AnalysisSettings, cfg: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Graph series in long form: interval midpoint, speed and smoothness in 0..1, smoothed class."""
    return signals.select(
        KEY,
        "i",
        round_digits(F.col("t") + 0.5 / settings.analysis_fps, 3).alias("t"),
        M.graph_speed(cfg, settings).alias("speed"),
        round_digits(clamp01(F.col("smooth_fit")), 3).alias("smoothness"),
        F.col("label").alias("motion"),
    )
