"""Export jobs and clips: creation, incremental steps, transitions, progress, work lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import literal_map
from . import scale
from .catalog import CLIP_STATUSES, is_terminal

# Position of each status on the five-step scale, successor of each step, labels.
STEP_WEIGHT = {
    "queued": 0, "frames": 0, "geo": 1, "tech": 2, "llm": 3, "review": 4, "cut": 4, "done": 5, "failed": 0,
}
NEXT_STATUS = {"frames": "geo", "geo": "tech", "tech": "llm", "llm": "review", "cut": "done"}
STATUS_LABELS = {
    "queued": "Queued",
    "frames": "Extracting frames",
    "geo": "Locating",
    "tech": "Analysing",
    "llm": "Writing metadata",
    "review": "Needs review",
    "cut": "Encoding",
    "done": "Done",
    "failed": "Failed",
}
AWAITING_CUT = "Approved · waiting for encoding"


def step_hash(*parts: Column) -> Column:
    """Stable 32-digit digest of the inputs of a step, in fixed field order."""
    named = [p.alias(f"p{k:02d}") for k, p in enumerate(parts)]
    return F.substring(F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256), 1, 32)


def is_awaiting_cut() -> Column:
    return (F.col("status") == "review") & F.col("approved") & ~F.col("excluded")


def clip_status_label() -> Column:
    return (
        F.when(F.col("excluded"), "Excluded")
        .when(is_awaiting_cut(), AWAITING_CUT)
        .otherwise(literal_map(STATUS_LABELS)[F.col("status")])
    )


def place_label(geo: Column) -> Column:
    """City and country, else the typed text, else unknown; a dash before the location is resolved."""
    full = lambda name: F.when(F.length(geo[name]) > 0, geo[name])
    place = F.concat_ws(", ", full("city"), full("country"))
    return F.when(geo.isNull(), "—").otherwise(
        F.coalesce(F.when(F.length(place) > 0, place), full("manual_text"), F.lit("unknown"))
    )


def clip_progress() -> Column:
    inside = F.when(F.col("status") == "done", F.lit(0.0)).otherwise(F.col("progress"))
    return F.least(F.lit(1.0), (literal_map(STEP_WEIGHT)[F.col("status")] + inside) / 5)


def job_progress(clips: DataFrame) -> DataFrame:
    """Totals, dense status counts, mean weighted progress and the build gate of each job."""
    active = ~F.col("excluded")
    counts = [F.count_if(active & (F.col("status") == s)).alias(f"n_{s}") for s in CLIP_STATUSES]
    return (
        clips.groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("excluded").alias("excluded"),
            *counts,
            F.coalesce(F.avg(F.when(active, clip_progress())), F.lit(0.0)).alias("progress"),
        )
        .withColumn(
            "can_build",
            (F.col("total") > F.col("excluded")) & (F.col("n_done") == F.col("total") - F.col("excluded")),
        )
    )


def new_clips(manifest: DataFrame, clips: DataFrame, order: Sequence[str]) -> DataFrame:
    """Manifest segments not yet in the job, with ordinals continuing after the existing clips.

    ``manifest`` has job_id and segment_id; ``order`` is the manifest order. A job of any size is ranked in pieces.
    """
    fresh = manifest.join(clips.select("job_id", "segment_id"), ["job_id", "segment_id"], "left_anti")
    existing = clips.select("job_id", "segment_id").distinct().groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_existing")
    )
    placed = scale.ranks_in_pieces(fresh, ["job_id"], order, "_pos")
    return (
        placed.join(existing, "job_id", "left")
        .withColumn("ordinal", F.coalesce("_existing", F.lit(0)) + F.col("_pos"))
        .drop("_existing", "_pos")
    )


@dataclass(frozen=True)
class Step:
    """One idempotent step: the hash covers ``inputs``; ``transform`` recomputes stale clips."""

    name: str
    inputs: Callable[[], list[Column]]
    transform: Callable[[DataFrame], DataFrame]

    def hash(self) -> Column:
        return step_hash(F.lit(f"{self.name}.v1"), *self.inputs())


def step_outcomes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(clip_id, step, input_hash) work with ``next_status``: null where the step is stale, empty without a successor.

    ``stored`` has clip_id, step, hash and complete; a row is current when the hash is equal and its
    output is still there.
    """
    rows = current.join(stored, ["clip_id", "step"], "left")
    fresh = F.col("input_hash").eqNullSafe(F.col("hash")) & F.coalesce("complete", F.lit(False))
    after = F.coalesce(literal_map(NEXT_STATUS)[F.col("step")], F.lit(""))
    return rows.select("clip_id", "step", "input_hash", F.when(fresh, after).alias("next_status"))


def stale_steps(current: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``step_outcomes`` split into stale rows and rows that just advance (a step without a successor: null)."""
    rows = step_outcomes(current, stored)
    advance = rows.where(F.col("next_status").isNotNull()).withColumn("next_status", F.nullif("next_status", F.lit("")))
    stale = rows.where(F.col("next_status").isNull())
    return stale.select("clip_id", "step", "input_hash"), advance.select("clip_id", "step", "next_status")


def run_step(clips: DataFrame, stored: DataFrame, step: Step) -> tuple[DataFrame, DataFrame]:
    """Recompute only clips whose inputs changed. Returns (recomputed rows, new step hashes)."""
    hashed = clips.withColumns({"step": F.lit(step.name), "input_hash": step.hash()})
    stale, _ = stale_steps(hashed.select("clip_id", "step", "input_hash"), stored)
    todo = clips.join(stale.select("clip_id"), "clip_id", "left_semi")
    hashes = stale.select("clip_id", "step", F.col("input_hash").alias("hash"), F.lit(True).alias("complete"))
    return step.transform(todo), hashes


def invalidate_location(clips: DataFrame, changed_videos: DataFrame) -> DataFrame:
    """A changed manual location sends every clip of the video that passed frames back to geo."""
    hit = clips.join(changed_videos.select("video_id"), "video_id", "left_semi")
    hit = hit.where(F.col("step_hashes")["frames"].isNotNull() & ~F.col("status").isin("queued", "frames"))
    return hit.withColumns({"status": F.lit("geo"), "progress": F.lit(0.0), "failed_step": F.lit(None).cast("string")})


def work_list(clips: DataFrame, auto_approve: bool = False) -> DataFrame:
    """Clips that need processing, with the queue they belong to."""
    approved = F.col("approved") | F.lit(auto_approve)
    waiting = ~is_terminal(F.col("status")) | ((F.col("status") == "review") & approved)
    return clips.where(~F.col("excluded") & waiting).withColumn(
        "queue", F.when(F.col("status") == "llm", "model").otherwise("general")
    )


def clip_state_transition(clips: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply approve / exclude / include / retry / regenerate / rerun; refused ones carry the reason.

    ``actions``: clip_id, action, step (for rerun), hint, poi_name.
    """
    rows = clips.join(actions, "clip_id")
    a, status = F.col("action"), F.col("status")
    early = status.isin("queued", "frames")
    error = (
        F.when((a == "approve") & ((status != "review") | F.col("excluded")), "Only clips in review can be approved")
        .when((a == "retry") & (status != "failed"), "Only failed clips can be retried")
        .when(
            (a == "regenerate") & F.col("step_hashes")["tech"].isNull(),
            "The clip has not reached the metadata step yet",
        )
    )
    ok = F.col("error").isNull()
    regenerated = ok & (a == "regenerate")
    restarted = ok & (a.isin("retry", "regenerate") | ((a == "rerun") & ~early))
    trimmed = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    text = lambda cond, new, old: F.when(cond, new).otherwise(F.col(old))
    rows = rows.withColumn("error", error)
    return rows.select(
        "clip_id",
        "action",
        F.when(ok & (a == "retry"), F.coalesce("failed_step", F.lit("queued")))
        .when(regenerated, "llm")
        .when(ok & (a == "rerun") & ~early, F.col("step"))
        .otherwise(status)
        .alias("status"),
        F.when(restarted, F.lit(None)).otherwise(F.col("failed_step")).alias("failed_step"),
        F.when(restarted, 0.0).otherwise(F.col("progress")).alias("progress"),
        F.when(ok & a.isin("exclude", "include"), a == "exclude").otherwise(F.col("excluded")).alias("excluded"),
        F.when(ok & (a == "approve"), True).when(regenerated, False).otherwise(F.col("approved")).alias("approved"),
        text(regenerated, trimmed(F.col("hint")), "user_hint").alias("user_hint"),
        text(regenerated, trimmed(F.col("poi_name")), "poi_override").alias("poi_override"),
        F.when(regenerated, F.map_filter("step_hashes", lambda k, v: k != "llm"))
        .otherwise(F.col("step_hashes"))
        .alias("step_hashes"),
        "error",
    )
