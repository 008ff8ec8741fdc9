"""Typed parameters of the engine. Every value ends up as a literal in the plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


# Motion classification and segmentation thresholds.
# Shifts are in frame widths per second, divergence per second, rotation in rad/s.
@dataclass(frozen=True)
class ClassifyConfig:
    static_max: float = 0.006
    erratic_fit_min: float = 0.45
    effective_radius: float = 0.35
    zoom_dominance: float = 0.8
    foe_max_x: float = 0.6
    foe_max_y: float = 0.45
    rotation_dominance: float = 1.2
    orbit_parallax_ratio: float = 0.6
    orbit_parallax_min: float = 0.01
    ascend_parallax_ratio: float = 0.35


@dataclass(frozen=True)
class SegmentConfig:
    smooth_window_sec: float = 1.6
    speed_jump_ratio: float = 0.6
    speed_jump_window_sec: float = 2.0
    speed_jump_floor: float = 0.01
    jerk_factor: float = 6.0
    jerk_floor: float = 0.02
    blur_ratio: float = 0.35
    dark_luma: float = 25.0
    bright_luma: float = 235.0
    clip_share: float = 0.12
    merge_gap_sec: float = 1.2
    trim_sec: float = 0.5
    split_search_sec: float = 4.0
    speed_graph_max: float = 0.1


@dataclass(frozen=True)
class ScoreConfig:
    smoothness: float = 0.35
    speed_stability: float = 0.25
    sharpness: float = 0.2
    exposure: float = 0.2
    jerk_penalty: float = 0.06
    speed_cv_max: float = 0.6


@dataclass(frozen=True)
class FlowConfig:
    clip_luma: int = 250


@dataclass(frozen=True)
class AnalysisConfig:
    analysis_width: int = 320
    classify: ClassifyConfig = field(default_factory=ClassifyConfig)
    segment: SegmentConfig = field(default_factory=SegmentConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    flow: FlowConfig = field(default_factory=FlowConfig)


@dataclass(frozen=True)
class AnalysisSettings:
    """User parameters of an analysis run."""

    min_duration: float = 7.0
    max_duration: float = 40.0
    target_duration: float = 25.0
    analysis_fps: float = 5.0
    sensitivity: float = 1.5
    include_static: bool = False

    @property
    def strictness(self) -> float:
        return max(0.25, self.sensitivity)


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def window_samples(seconds: float, fps: float) -> int:
    """Odd number of samples covering ``seconds``."""
    n = max(1, round_half_up(seconds * fps))
    return n + 1 if n % 2 == 0 else n


@dataclass(frozen=True)
class ShotTypeConfig:
    timelapse_ratio: float = 1.5
    high_frame_rate_fps: float = 100.0


@dataclass(frozen=True)
class EncodingSettings:
    codec: str = "h264"
    crf: int = 16
    max_bitrate_mbps: int = 100
    container: str = "mov"


@dataclass(frozen=True)
class ExportSettings:
    """Delivery settings; the defaults apply wherever a stored document has no value."""

    model: str = "gemma4:31b"
    think: bool = False
    temperature: float = 0.3
    auto_approve: bool = False
    concurrency: int = 2
    encoding: EncodingSettings = field(default_factory=EncodingSettings)
    slow_mo_conform: str = "off"
    embed_gps: bool = False
    creation_time_mode: str = "auto"
    filename_template: str = "{subject}_{place}_{motion}_{date}_{n}"
    adobe_author: str = "author"
    copyright: str = ""
    pond5_price: float = 50.0
    pond5_price_large: float = 100.0
    envato_price_single: float = 15.0
    envato_price_multi: float = 30.0
    poi_radius_m: int = 2000
    use_overpass: bool = False
    enabled_platforms: tuple[str, ...] = ("adobe", "shutterstock", "pond5", "envato")

    @property
    def conform_fps(self) -> float | None:
        return None if self.slow_mo_conform == "off" else float(self.slow_mo_conform)
