"""Motion time-series: features -> signals -> runs.

``features`` is the long table (video_id, i, t, dx, dy, div, rot, px, py, fit, coherence, mag_var,
sharpness, brightness, overexposed) with ``i`` dense from 0 in every video.

While every video fits in one span, all windows share a single exchange on ``video_id``. As soon as
one video is longer, the same expressions run on (video_id, chunk) partitions with halo rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import AnalysisConfig, AnalysisSettings, round_half_up, window_samples
from ..functions import motion as M
from ..session import written_once
from . import scale

KEY = "video_id"


@dataclass(frozen=True)
class Layout:
    """How the samples of the videos are spread: decided once from two counts."""

    videos: int
    longest: int
    span: int = scale.SPAN

    @property
    def chunked(self) -> bool:
        return self.longest > self.span

    @property
    def keys(self) -> list[str]:
        return [KEY, "chunk"] if self.chunked else [KEY]

    def ordered(self):
        return W.partitionBy(*self.keys).orderBy("i")


def layout_of(samples: DataFrame, key: str = KEY, span: int = scale.SPAN) -> Layout:
    videos, longest = scale.group_profile(samples, [key])
    return Layout(videos, longest, span)


def _spread(features: DataFrame, layout: Layout, halo: int) -> DataFrame:
    if layout.chunked:
        return scale.with_halo(features, "i", halo, halo, layout.span)
    return features.withColumn("own", F.lit(True))


def _own(df: DataFrame) -> DataFrame:
    return df.where("own").drop("own")


def _delta(name: str, order) -> Column:
    return F.col(name) - F.lag(name).over(order)


def motion_change(order, cfg: AnalysisConfig) -> Column:
    """Sample-to-sample change of the motion vector; 0 at the first sample."""
    r = F.lit(cfg.classify.effective_radius)
    change = (
        F.hypot(_delta("dx", order), _delta("dy", order))
        + F.abs(_delta("div", order)) * r
        + F.abs(_delta("rot", order)) * r
    )
    return F.coalesce(change, F.lit(0.0))


def video_thresholds(
    features: DataFrame, settings: AnalysisSettings, layout: Layout, cfg: AnalysisConfig = AnalysisConfig()
) -> DataFrame:
    """Jerk, variance and sharpness references: one row per video."""
    spread = _spread(features.select(KEY, "i", "dx", "dy", "div", "rot", "mag_var", "sharpness"), layout, 1)
    measured = _own(spread.withColumn("change", motion_change(layout.ordered(), cfg)))
    medians = scale.exact_medians(measured, [KEY], ["change", "mag_var", "sharpness"], layout.longest)
    return medians.select(KEY, *_threshold_columns(settings, cfg, *map(F.col, ("change", "mag_var", "sharpness"))))


def _threshold_columns(settings, cfg, change: Column, mag_var: Column, sharpness: Column) -> list[Column]:
    s = cfg.segment
    sens = F.lit(settings.strictness)
    return [
        (F.greatest(F.lit(s.jerk_floor), change * s.jerk_factor) / sens).alias("jerk_threshold"),
        (F.greatest(F.lit(s.jerk_floor**2), mag_var * s.jerk_factor) / sens).alias("var_threshold"),
        sharpness.alias("sharpness_ref"),
    ]


def _with_thresholds(df, features, settings, layout: Layout, cfg) -> DataFrame:
    if not layout.chunked:
        # Same exchange as every other window: a whole-partition frame evaluated once per video.
        whole = W.partitionBy(KEY)
        medians = [F.percentile(F.col(c), F.lit(0.5)).over(whole) for c in ("change", "mag_var", "sharpness")]
        return df.select("*", *_threshold_columns(settings, cfg, *medians))
    stats = video_thresholds(features, settings, layout, cfg)
    if layout.videos <= scale.BROADCAST_ROWS:
        return df.join(F.broadcast(stats), [KEY])
    # One threshold row per span keeps the samples where they are: only span rows move.
    spans = features.groupBy(KEY).agg(F.max("i").alias("_last"))
    per_span = stats.join(spans, [KEY]).select(
        KEY,
        "jerk_threshold",
        "var_threshold",
        "sharpness_ref",
        F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / layout.span))).alias("chunk"),
    )
    return df.join(per_span, [KEY, "chunk"])


def motion_signals(
    features: DataFrame,
    settings: AnalysisSettings,
    layout: Layout | None = None,
    cfg: AnalysisConfig = AnalysisConfig(),
) -> DataFrame:
    """Smoothed class, speed and fit, quality flags, speed jumps and instability of each sample."""
    layout = layout or layout_of(features)
    fps = settings.analysis_fps
    half = window_samples(cfg.segment.smooth_window_sec, fps) // 2
    calm = window_samples(1, fps) // 2
    reach = max(2, round_half_up(cfg.segment.speed_jump_window_sec * fps))
    order = layout.ordered()
    near = order.rowsBetween(-half, half)
    before, after = order.rowsBetween(-reach, -1), order.rowsBetween(0, reach - 1)

    df = _spread(features, layout, max(2 * reach + half, calm + half + 1) + 1)
    df = df.withColumns(
        {
            "raw_label": M.classify_motion(settings.strictness, cfg.classify),
            "raw_speed": M.motion_speed(cfg.classify),
            "change": motion_change(order, cfg),
        }
    )
    df = df.withColumns(
        {
            "_labels": F.collect_list("raw_label").over(near),
            "_speeds": F.collect_list("raw_speed").over(near),
            "_fits": F.collect_list("fit").over(near),
        }
    )
    df = df.withColumns(
        {
            "label": M.majority(F.col("_labels"), F.col("raw_label")),
            "speed": M.running_median(F.col("_speeds")),
            "smooth_fit": M.running_median(F.col("_fits")),
        }
    ).drop("_labels", "_speeds", "_fits")
    df = df.withColumns(
        {
            "_before": F.collect_list("speed").over(before),
            "_after": F.collect_list("speed").over(after),
            "_step": F.col("change") + F.coalesce(F.abs(_delta("speed", order)), F.lit(0.0)),
        }
    )
    df = df.withColumn("jump_score", _jump_score(reach, settings, cfg)).drop("_before", "_after")
    df = df.withColumns(
        {
            "_earlier": F.max("jump_score").over(before),
            "_later": F.max("jump_score").over(order.rowsBetween(1, reach)),
            "_steps": F.collect_list("_step").over(order.rowsBetween(-calm, calm)),
        }
    )
    df = df.withColumns(
        {
            "jump": (F.col("jump_score") > 0)
            & (F.coalesce(F.col("_earlier"), F.lit(0.0)) < F.col("jump_score"))
            & (F.coalesce(F.col("_later"), F.lit(0.0)) <= F.col("jump_score")),
            "instability": M.running_median(F.col("_steps")),
        }
    ).drop("_step", "_steps", "_earlier", "_later")
    df = _with_thresholds(df, features, settings, layout, cfg)
    strong = F.col("change") > F.col("jerk_threshold") * 2
    df = df.withColumns(
        {
            "blur": M.blur_flag(F.col("sharpness_ref"), cfg.segment),
            "clipped": M.clipped_flag(cfg.segment),
            "strong_jerk": strong,
            "jerk": ~strong
            & ((F.col("change") > F.col("jerk_threshold")) | (F.col("mag_var") > F.col("var_threshold"))),
        }
    )
    df = df.withColumn("bad", F.col("strong_jerk") | F.col("blur") | F.col("clipped"))
    df = df.withColumns(
        {
            "jerk_onset": F.col("jerk") & ~F.coalesce(F.lag("jerk").over(order), F.lit(False)),
            "_prev_bad": F.lag("bad").over(order),
            "_prev_label": F.lag("label").over(order),
        }
    )
    reason = (
        F.when(F.col("bad"), F.lit(None))
        .when(F.col("_prev_bad").isNull(), "start")
        .when(F.col("_prev_bad"), "bad")
        .when(F.col("jump"), "jump")
        .when(F.col("label") != F.col("_prev_label"), "label")
    )
    signals = _own(df.withColumn("break_before", reason).drop("_prev_bad", "_prev_label"))
    return _mark_runs(signals, layout)


def _mark_runs(signals: DataFrame, layout: Layout) -> DataFrame:
    """Add run_start and hard_start: where the run and its unbroken stretch began (null while bad)."""
    good = ~F.col("bad")
    marks = {
        "run_start": F.when(F.col("break_before").isNotNull(), F.col("i")),
        "hard_start": F.when(F.col("break_before") != "label", F.col("i")),
    }
    if layout.chunked:
        tagged = scale.running_last(signals, [KEY], "i", marks, layout.span)
    else:
        so_far = layout.ordered().rowsBetween(W.unboundedPreceding, W.currentRow)
        tagged = signals.withColumns({n: F.last(v, ignorenulls=True).over(so_far) for n, v in marks.items()})
    return tagged.withColumns({n: F.when(good, F.col(n)) for n in marks})


def _jump_score(reach: int, settings: AnalysisSettings, cfg: AnalysisConfig) -> Column:
    ratio = min(0.95, cfg.segment.speed_jump_ratio / settings.strictness)
    before, after = M.running_median(F.col("_before")), M.running_median(F.col("_after"))
    high = F.greatest(before, after)
    relative = F.abs(after - before) / high
    full = (F.size("_before") == reach) & (F.size("_after") == reach)
    return F.when(full & (high >= cfg.segment.speed_jump_floor) & (relative > ratio), relative).otherwise(0.0)


def motion_runs(signals: DataFrame) -> DataFrame:
    """Gaps and islands: maximal stretches of good samples of one class.

    ``hard_start`` is the first sample of the enclosing stretch without bad samples or jumps.
    """
    return (
        signals.where(~F.col("bad"))
        .groupBy(KEY, "run_start")
        .agg(
            (F.max("i") + 1).alias("run_end"),
            F.min_by("label", "i").alias("label"),
            F.min_by("break_before", "i").alias("break_before"),
            F.min("hard_start").alias("hard_start"),
            F.min("t").alias("t_first"),
            F.max("t").alias("t_last"),
            F.avg("raw_speed").alias("mean_speed"),
        )
    )


#: What the steps after the window stage read.
SIGNAL_COLUMNS = [
    KEY, "i", "t", "label", "raw_speed", "speed", "smooth_fit", "sharpness", "sharpness_ref", "brightness",
    "overexposed", "instability", "jerk_onset", "bad", "break_before", "run_start", "hard_start",
]


def stored_signals(
    features: DataFrame,
    settings: AnalysisSettings,
    layout: Layout | None = None,
    cfg: AnalysisConfig = AnalysisConfig(),
) -> DataFrame:
    """Signals as a written table: runs, splits and scores all read it, the windows run once."""
    return written_once(motion_signals(features, settings, layout, cfg).select(*SIGNAL_COLUMNS))
