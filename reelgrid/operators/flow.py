"""Statistics of sampled optical flow vectors and luma values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FlowConfig
from ..functions.numeric import clamp01


def flow_stats(samples: DataFrame, width: int, height: int, fps: float, key: str = "pair_id") -> DataFrame:
    """Least-squares affine motion of each frame pair from grid samples (x, y, u, v).

    On a regular grid the centred coordinates are uncorrelated, so every coefficient is a ratio of
    sums. Sums over raw coordinates are combined on the map side and re-centred afterwards, then a
    second aggregation takes the residuals.
    """
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    total = lambda c, name: F.sum(c).alias(name)
    x, y, u, v = (F.col(c).cast("double") for c in ("x", "y", "u", "v"))
    speed2 = u * u + v * v
    sums = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        total(x, "sx"), total(y, "sy"), total(u, "su"), total(v, "sv"),
        total(x * x, "sxx"), total(y * y, "syy"),
        total(u * x, "sux"), total(u * y, "suy"), total(v * x, "svx"), total(v * y, "svy"),
        total(speed2, "s2"), total(F.sqrt(speed2), "sm"),
    )

    def slope(product: Column, flow: Column, square: Column, axis: Column) -> Column:
        spread = square - axis * axis / n
        return F.when(spread > 0, (product - flow * axis / n) / spread).otherwise(0.0)

    model = sums.select(
        key,
        n.alias("n"),
        (sx / n).alias("cx"),
        (sy / n).alias("cy"),
        (F.col("su") / n).alias("a"),
        (F.col("sv") / n).alias("b"),
        slope(F.col("sux"), F.col("su"), F.col("sxx"), sx).alias("c1"),
        slope(F.col("suy"), F.col("su"), F.col("syy"), sy).alias("c2"),
        slope(F.col("svx"), F.col("sv"), F.col("sxx"), sx).alias("c3"),
        slope(F.col("svy"), F.col("sv"), F.col("syy"), sy).alias("c4"),
        (F.col("s2") / n).alias("mean2"),
        (F.col("sm") / n).alias("mean_len"),
    )
    joined = samples.join(model, key)
    rx, ry = x - F.col("cx"), y - F.col("cy")
    eu = u - (F.col("a") + F.col("c1") * rx + F.col("c2") * ry)
    ev = v - (F.col("b") + F.col("c3") * rx + F.col("c4") * ry)
    length, drift = F.hypot(u, v), F.hypot("a", "b")
    moving = length > 0.05
    aligned = moving & (drift > 1e-6) & ((u * F.col("a") + v * F.col("b")) / (length * drift) > 0.8)
    carried = [F.first(c).alias(c) for c in model.columns if c != key]
    out = joined.groupBy(key).agg(
        *carried,
        F.sum(eu * eu + ev * ev).alias("res2"),
        F.count_if(moving).alias("moving"),
        F.count_if(aligned).alias("aligned"),
    )
    c1, c2, c3, c4 = (F.col(f"c{k}") for k in range(1, 5))
    spin = F.when(c2 * c3 < 0, F.signum(c3) * F.least(F.abs(c2), F.abs(c3))).otherwise(0.0)
    zoom = F.when(c1 * c4 > 0, F.signum(c1) * F.least(F.abs(c1), F.abs(c4))).otherwise(0.0)
    k = fps / width
    rms = F.sqrt("mean2")
    return out.select(
        key,
        (F.col("a") * k).alias("dx"),
        (F.col("b") * k).alias("dy"),
        (zoom * fps).alias("div"),
        (spin * fps).alias("rot"),
        (-(c2 + spin) * height * k).alias("px"),
        ((c4 - zoom) * height * k).alias("py"),
        F.when(rms < 0.05, F.lit(1.0))
        .otherwise(clamp01(F.lit(1.0) - F.sqrt(F.col("res2") / F.col("n")) / rms))
        .alias("fit"),
        F.when(F.col("moving") > 0, F.col("aligned") / F.col("moving")).otherwise(1.0).alias("coherence"),
        (F.greatest(F.lit(0.0), F.col("mean2") - F.col("mean_len") * F.col("mean_len")) * k * k).alias("mag_var"),
    )


def exposure_stats(luma: DataFrame, key: str, cfg: FlowConfig = FlowConfig(), weight: str | None = None) -> DataFrame:
    """Mean luma and clipped share from samples (or a histogram when ``weight`` names the counts)."""
    n = F.col(weight) if weight else F.lit(1)
    return luma.groupBy(key).agg(
        (F.sum(F.col("luma") * n) / F.sum(n)).alias("brightness"),
        (F.sum(F.when(F.col("luma") >= cfg.clip_luma, n).otherwise(0)) / F.sum(n)).alias("overexposed"),
    )
