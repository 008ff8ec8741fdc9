"""Per-sample motion expressions over the frame feature columns (dx, dy, div, rot, px, py, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisConfig, AnalysisSettings, ClassifyConfig, SegmentConfig
from .numeric import case, clamp01

# Motion classes in their contract order, with the four vocabularies built on them.
MOTION_TYPES = [
    "forward", "backward", "pan_left", "pan_right", "tilt_up", "tilt_down",
    "orbit_left", "orbit_right", "ascend", "descend", "static", "erratic",
]
MOTION_LABELS = {
    "forward": "Forward",
    "backward": "Backward",
    "pan_left": "Pan left",
    "pan_right": "Pan right",
    "tilt_up": "Tilt up",
    "tilt_down": "Tilt down",
    "orbit_left": "Orbit left",
    "orbit_right": "Orbit right",
    "ascend": "Ascend",
    "descend": "Descend",
    "static": "Hover",
    "erratic": "Erratic",
}
REASON_PHRASES = {
    "forward": "forward fly-through",
    "backward": "backward fly-out",
    "pan_left": "pan left",
    "pan_right": "pan right",
    "tilt_up": "camera tilt up",
    "tilt_down": "camera tilt down",
    "orbit_left": "orbit left",
    "orbit_right": "orbit right",
    "ascend": "ascent",
    "descend": "descent",
    "static": "hover",
    "erratic": "erratic motion",
}
PROMPT_PHRASES = {
    "forward": "flying forward",
    "backward": "flying backward (reveal)",
    "pan_left": "panning / trucking left",
    "pan_right": "panning / trucking right",
    "tilt_up": "tilting up (reveal)",
    "tilt_down": "tilting down",
    "orbit_left": "orbiting around the subject",
    "orbit_right": "orbiting around the subject",
    "ascend": "ascending / rising",
    "descend": "descending",
    "static": "hovering (static shot)",
    "erratic": "free camera movement",
}
MOTION_SLUGS = {
    "forward": "forward",
    "backward": "reveal",
    "pan_left": "pan",
    "pan_right": "pan",
    "tilt_up": "tilt_up",
    "tilt_down": "tilt_down",
    "orbit_left": "orbit",
    "orbit_right": "orbit",
    "ascend": "ascend",
    "descend": "descend",
    "static": "hover",
    "erratic": "aerial",
}
MOVEMENT_TERMS = {
    "pan_left": "Tracking Left",
    "pan_right": "Tracking Right",
    "tilt_up": "Tilt Up",
    "tilt_down": "Tilt Down",
    "orbit_left": "Arc",
    "orbit_right": "Arc",
}


def motion_dim(spark: SparkSession) -> DataFrame:
    """The motion classes with their label, reason phrase, prompt phrase, slug and movement term."""
    rows = [
        (k, m, MOTION_LABELS[m], REASON_PHRASES[m], PROMPT_PHRASES[m], MOTION_SLUGS[m], MOVEMENT_TERMS.get(m))
        for k, m in enumerate(MOTION_TYPES)
    ]
    return spark.createDataFrame(
        rows, "ord int, motion string, label string, reason string, prompt string, slug string, movement string"
    )


def _edge(name: str, cfg: ClassifyConfig) -> Column:
    """Zoom or rotation converted to displacement at the frame edge."""
    return F.abs(F.col(name)) * F.lit(cfg.effective_radius)


def motion_activity(cfg: ClassifyConfig = ClassifyConfig()) -> Column:
    return F.greatest(
        F.abs("dx"), F.abs("dy"), _edge("div", cfg), _edge("rot", cfg), F.abs("px") / 2, F.abs("py") / 2
    )


def motion_speed(cfg: ClassifyConfig = ClassifyConfig()) -> Column:
    return F.hypot("dx", "dy") + _edge("div", cfg) + _edge("rot", cfg) + F.abs("px") / 2


def fit_floor(sensitivity: float, cfg: ClassifyConfig = ClassifyConfig()) -> float:
    return 1 - (1 - cfg.erratic_fit_min) / max(0.25, sensitivity)


def classify_motion(sensitivity: float = 1.0, cfg: ClassifyConfig = ClassifyConfig()) -> Column:
    """Twelve-way decision list as one CASE expression."""
    tx, ty = F.abs("dx"), F.abs("dy")
    half_px, half_py = F.abs("px") / 2, F.abs("py") / 2
    zoom, spin = _edge("div", cfg), _edge("rot", cfg)
    shift = F.greatest(tx, ty)
    sign = lambda name, yes, no: F.when(F.col(name) > 0, yes).otherwise(no)
    expands_inside = (
        (zoom >= cfg.static_max)
        & (tx <= F.abs("div") * cfg.foe_max_x)
        & (ty <= F.abs("div") * cfg.foe_max_y)
    )
    sideways = F.greatest(tx, half_px) >= F.greatest(ty, half_py)
    orbiting = (F.abs("px") >= cfg.orbit_parallax_min) & (tx <= F.abs("px") * cfg.orbit_parallax_ratio)
    lifting = F.abs("py") >= ty * cfg.ascend_parallax_ratio
    return case(
        [
            (motion_activity(cfg) < cfg.static_max, F.lit("static")),
            (F.col("fit") < fit_floor(sensitivity, cfg), F.lit("erratic")),
            (
                spin >= F.greatest(shift, zoom, half_px) * cfg.rotation_dominance,
                sign("rot", "orbit_left", "orbit_right"),
            ),
            (
                expands_inside | (zoom >= F.greatest(shift, half_px) * cfg.zoom_dominance),
                sign("div", "forward", "backward"),
            ),
            (sideways & orbiting, sign("px", "orbit_right", "orbit_left")),
            (sideways, F.when(F.col("dx") < 0, "pan_right").otherwise("pan_left")),
            (lifting, sign("dy", "ascend", "descend")),
        ],
        sign("dy", "tilt_up", "tilt_down"),
    )


def exposure_quality(cfg: SegmentConfig = SegmentConfig()) -> Column:
    """Luma inside 50..210 is perfect and fades over 25 levels; clipped highlights scale it down."""
    luma = case(
        [
            (F.col("brightness") < 50, clamp01((F.col("brightness") - cfg.dark_luma) / 25)),
            (F.col("brightness") > 210, clamp01((F.lit(cfg.bright_luma) - F.col("brightness")) / 25)),
        ],
        F.lit(1.0),
    )
    return luma * clamp01(F.lit(1.0) - F.col("overexposed") / cfg.clip_share)


def blur_flag(reference: Column, cfg: SegmentConfig = SegmentConfig()) -> Column:
    return (reference > 0) & (F.col("sharpness") < reference * cfg.blur_ratio)


def clipped_flag(cfg: SegmentConfig = SegmentConfig()) -> Column:
    return (
        (F.col("brightness") < cfg.dark_luma)
        | (F.col("brightness") > cfg.bright_luma)
        | (F.col("overexposed") > cfg.clip_share)
    )


def running_median(values: Column) -> Column:
    """Median of a framed array (mean of the middle two for even lengths)."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    return (F.get(ordered, F.shiftright(n - 1, 1)) + F.get(ordered, F.shiftright(n, 1))) / 2


def majority(values: Column, centre: Column) -> Column:
    """Most frequent member; the centre wins ties, otherwise the class seen first in the frame."""
    ballots = F.transform(
        F.array_distinct(values),
        lambda x, k: F.struct(
            F.size(F.filter(values, lambda y: y == x)).alias("votes"),
            (x == centre).alias("is_centre"),
            (-k).alias("first"),
            x.alias("value"),
        ),
    )
    return F.when(F.array_min(values) == F.array_max(values), centre).otherwise(
        F.array_max(ballots).getField("value")
    )


def movement_terms(motion: Column, top_down: Column | None = None) -> Column:
    """Movement vocabulary: always Aerial and Drone, then the class term, then Top Down."""
    from .numeric import compact, literal_map

    extra = F.when(top_down, F.lit("Top Down")) if top_down is not None else F.lit(None).cast("string")
    return compact([F.lit("Aerial"), F.lit("Drone"), literal_map(MOVEMENT_TERMS)[motion], extra])


def graph_speed(cfg: AnalysisConfig, settings: AnalysisSettings) -> Column:
    from .numeric import round_half_up

    return round_half_up(clamp01(F.col("speed") / cfg.segment.speed_graph_max), 3)
