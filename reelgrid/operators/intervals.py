"""Segments as half-open intervals: validation, reconciliation, editing and range joins.

Range joins replicate intervals over fixed time buckets and join on (video, bucket), so a video with
very many rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import compact, half_up
from ..functions.numeric import round_half_up
from ..functions.timecode import snap_to_frame
from ..session import written_once
from . import scale

#: Seconds per time bucket of range joins.
BUCKET_SEC = 32.0
EPS = 1e-3


def _bucket(sec: Column) -> Column:
    return F.floor(sec / F.lit(BUCKET_SEC))


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "bucket", F.explode(scale.interval_chunks(F.col("start_sec"), F.col("end_sec"), BUCKET_SEC))
    )


def segment_issues(segments: DataFrame, videos: DataFrame, settings: DataFrame) -> DataFrame:
    """Length, bounds and overlap issues of accepted segments.

    ``settings`` gives min_duration / max_duration per project_id.
    """
    facts = videos.select(F.col("id").alias("video_id"), "project_id", "duration_sec").join(
        settings.select("project_id", "min_duration", "max_duration"), "project_id"
    )
    rows = segments.where("accepted").join(facts, "video_id")
    length = F.col("end_sec") - F.col("start_sec")
    outside = (F.col("start_sec") < -EPS) | (F.col("end_sec") > F.col("duration_sec") + EPS)

    def issue(kind: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"))

    def limit(prefix: str, bound: str) -> Column:
        return F.format_string(f"{prefix} than %s s (%.1f s)", number_text(F.col(bound)), length)

    own = compact(
        [
            F.when(length < F.col("min_duration") - EPS, issue("too_short", limit("Shorter", "min_duration"))),
            F.when(length > F.col("max_duration") + EPS, issue("too_long", limit("Longer", "max_duration"))),
            F.when(
                F.col("duration_sec").isNotNull() & outside,
                issue("out_of_bounds", F.lit("Extends beyond the video")),
            ),
        ]
    )
    single = scale.explode_present(rows, "issue", own).select(
        F.col("id").alias("segment_id"), "video_id", "issue.*"
    )
    return single.unionByName(overlap_issues(segments))


def number_text(c: Column) -> Column:
    """Number as text without a trailing .0 for whole values."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def overlap_issues(segments: DataFrame) -> DataFrame:
    """Neighbours in start order that overlap by more than EPS: both sides are flagged."""
    around = scale.with_neighbours(
        segments.where("accepted").select("video_id", "id", "start_sec", "end_sec"),
        ["video_id"],
        ["start_sec", "id"],
        F.floor(F.col("start_sec") / 600),
        ["start_sec", "end_sec"],
    )
    with_prev = F.when(F.col("start_sec") < F.col("prev.end_sec") - EPS, F.lit(1))
    with_next = F.when(F.col("next.start_sec") < F.col("end_sec") - EPS, F.lit(1))
    return around.select(
        F.col("id").alias("segment_id"),
        "video_id",
        F.explode(compact([with_prev, with_next])).alias("_side"),
        F.lit("overlap").alias("kind"),
        F.lit("Overlaps an adjacent segment").alias("message"),
    ).drop("_side")


def reconcile_segments(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """Keep user-made or edited segments; add proposals that overlap none of them."""
    kept = current.where((F.col("origin") == "user") | F.col("edited"))
    k = _by_bucket(kept.select("video_id", "start_sec", "end_sec")).alias("k")
    p = _by_bucket(proposals.select("video_id", "id", "start_sec", "end_sec")).alias("p")
    clash = (
        p.join(
            k,
            (F.col("p.video_id") == F.col("k.video_id"))
            & (F.col("p.bucket") == F.col("k.bucket"))
            & (F.col("k.start_sec") < F.col("p.end_sec"))
            & (F.col("p.start_sec") < F.col("k.end_sec")),
            "left_semi",
        )
        .select(F.col("p.id").alias("id"))
        .distinct()
    )
    return kept.unionByName(proposals.join(clash, "id", "left_anti"), allowMissingColumns=True)


def _samples_in(segments: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    s = _by_bucket(segments.select("id", "video_id", "start_sec", "end_sec"))
    m = metrics.select("video_id", "i", "t", *columns).withColumn("bucket", _bucket(F.col("t")))
    return s.join(m, ["video_id", "bucket"]).where((F.col("t") >= F.col("start_sec")) & (F.col("t") < F.col("end_sec")))


def segment_motion(segments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Most frequent class (``motion_type``) and mean ``smoothness`` of the samples inside each segment.

    The class that is seen first wins ties; erratic is reported as forward, and so is a segment without
    samples. Smoothness has two digits, 0 without samples; stored values have three digits, so thousandths
    are summed: exact in any order of the rows.
    """
    counted = _samples_in(segments, metrics, ["motion", "smoothness"]).groupBy("id", "motion").agg(
        F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"), F.sum(half_up(F.col("smoothness") * 1000)).alias("s")
    )
    per_segment = counted.groupBy("id").agg(
        F.max_by("motion", F.struct("n", -F.col("first_i"))).alias("_motion"),
        round_half_up(F.sum("s") / (F.sum("n") * 1000), 2).alias("smoothness"),
    )
    chosen = F.when(F.col("_motion").isNull() | (F.col("_motion") == "erratic"), "forward").otherwise(F.col("_motion"))
    return (
        segments.join(per_segment, "id", "left")
        .withColumns({"motion_type": chosen, "smoothness": F.coalesce("smoothness", F.lit(0.0))})
        .drop("_motion")
    )


def dominant_motion(segments: DataFrame, metrics: DataFrame) -> DataFrame:
    """``motion_type`` of segment_motion."""
    return segment_motion(segments.drop("smoothness"), metrics).drop("smoothness")


def mean_smoothness(segments: DataFrame, metrics: DataFrame) -> DataFrame:
    """``smoothness`` of segment_motion; the segments keep their own class."""
    found = segment_motion(segments.select("id", "video_id", "start_sec", "end_sec"), metrics)
    return segments.join(found.select("id", "smoothness"), "id", "left")


def segment_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment under each point (video_id, point_id, t): the shortest when several contain it."""
    p = points.withColumn("bucket", _bucket(F.col("t")))
    s = _by_bucket(segments.select("video_id", "id", "start_sec", "end_sec"))
    inside = p.join(s, ["video_id", "bucket"]).where(
        (F.col("t") >= F.col("start_sec")) & (F.col("t") < F.col("end_sec"))
    )
    order = F.struct(F.col("end_sec") - F.col("start_sec"), F.col("start_sec"), F.col("id"))
    return inside.groupBy("point_id").agg(F.min_by("id", order).alias("segment_id"))


def merge_segments(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Fuse each group of segments into one spanning them all; groups of one stay as they are.

    ``groups`` has (group_id, id). Needs ``pos`` (list position) and ``reasons`` on the segments.
    """
    parts = segments.join(groups.where("group_id IS NOT NULL"), "id")
    length = F.col("end_sec") - F.col("start_sec")
    order = F.struct(length, -F.col("pos"))
    # One pass: parts with the same list of reasons are fused first, so that each list is collected once per group.
    alike = parts.groupBy("group_id", F.coalesce("reasons", F.array().cast("array<string>")).alias("listed")).agg(
        F.count(F.lit(1)).alias("parts"),
        F.min("pos").alias("pos"),
        F.max_by(F.struct("id", "video_id", "motion_type"), order).alias("longest"),
        F.max(order).alias("order"),
        F.min("start_sec").alias("start_sec"),
        F.max("end_sec").alias("end_sec"),
        F.sum(F.col("score") * length).alias("weighted"),
        F.sum(length).alias("seconds"),
        F.bool_and(F.col("origin") == "ai").alias("made"),
        F.bool_or("accepted").alias("accepted"),
    )
    fused = alike.groupBy("group_id").agg(
        F.sum("parts").alias("parts"),
        F.max_by("longest", "order").alias("longest"),
        F.min("start_sec").alias("start_sec"),
        F.max("end_sec").alias("end_sec"),
        round_half_up(F.sum("weighted") / F.sum("seconds"), 2).alias("score"),
        F.collect_list(F.struct("pos", "listed")).alias("lists"),
        F.when(F.bool_and("made"), "ai").otherwise("user").alias("origin"),
        F.bool_or("accepted").alias("accepted"),
    )
    # Reasons in the order in which the list of segments names them first.
    named = F.transform(
        "lists", lambda x: F.transform(x["listed"], lambda r, k: F.struct(x["pos"].alias("pos"), k.alias("k"), r.alias("reason")))
    )
    reasons = F.array_distinct(F.transform(F.array_sort(F.flatten(named)), lambda x: x["reason"]))
    return fused.where("parts >= 2").select(
        "group_id", "longest.*", "start_sec", "end_sec", "score", reasons.alias("reasons"),
        "origin", "accepted", F.lit(True).alias("edited"),
    )


def apply_segment_edits(segments: DataFrame, edits: DataFrame, videos: DataFrame) -> DataFrame:
    """Apply one batch of editor operations, at most one per segment.

    ``edits`` columns: video_id, id (target; a new id for create), op in create / bounds / accept /
    remove / split / retype, start_sec, end_sec, at_sec, motion_type.
    """
    facts = videos.select(F.col("id").alias("video_id"), "fps", "duration_sec")
    op, at = F.col("op"), F.col("at_sec")
    # An edit carries only what its operation reads: rows move once by id and once by video, next to the facts.
    e = edits.where("op <> 'create'").select(
        "id", "op", F.when(op == "bounds", F.least("start_sec", "end_sec")).when(op == "split", at).alias("e_start"),
        F.when(op == "bounds", F.greatest("start_sec", "end_sec")).alias("e_end"),
        F.when(op == "retype", F.col("motion_type")).alias("e_motion"),
    )
    # Accept works on the selection of a video as a group: all on if any is off, else all off.
    # The selection is the small side: hashed by partition, so that the segments are not sorted once more.
    chosen = edits.where("op = 'accept'").select("id").hint("shuffle_hash")
    selected = segments.select("id", "video_id", "accepted").join(chosen, "id")
    target = selected.groupBy("video_id").agg(F.bool_or(~F.col("accepted")).alias("accept_all"))
    rows = segments.join(e, "id", "left").where(F.coalesce(op != "remove", F.lit(True)))
    rows = rows.join(facts.join(target, "video_id", "left"), "video_id")
    op = F.coalesce("op", F.lit(""))
    fps = F.col("fps")
    new_start = F.greatest(F.lit(0.0), snap_to_frame(F.col("e_start"), fps))
    new_end = F.least(F.col("duration_sec"), snap_to_frame(F.col("e_end"), fps))
    moved = (
        (op == "bounds")
        & (new_end - new_start >= F.lit(1.0) / fps / 2)
        & ~((new_start == F.col("start_sec")) & (new_end == F.col("end_sec")))
    )
    cut = snap_to_frame(F.col("e_start"), fps)
    split = (op == "split") & (cut > F.col("start_sec")) & (cut < F.col("end_sec"))
    retyped = (op == "retype") & (F.col("e_motion") != F.col("motion_type"))
    flags = {"_moved": moved, "_split": split, "_retyped": retyped}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    start = F.when(F.col("_moved"), new_start).otherwise(F.col("start_sec"))
    end = F.when(F.col("_moved"), new_end).otherwise(F.col("end_sec"))
    part = lambda id_, s, t: F.struct(id_.alias("id"), s.alias("start_sec"), t.alias("end_sec"))
    parts = F.when(
        F.col("_split"),
        F.array(
            part(F.col("id"), F.col("start_sec"), cut),
            part(F.concat("id", F.lit("/"), half_up(cut * fps).cast("string")), cut, F.col("end_sec")),
        ),
    ).otherwise(F.array(part(F.col("id"), start, end)))
    touched = (F.col("_moved") | F.col("_split") | F.col("_retyped")) & (F.col("origin") == "ai")
    edited = rows.select(
        "video_id",
        F.explode(parts).alias("part"),
        F.when(F.col("_retyped"), F.col("e_motion")).otherwise(F.col("motion_type")).alias("motion_type"),
        "score",
        "origin",
        F.when(op == "accept", F.col("accept_all")).otherwise(F.col("accepted")).alias("accepted"),
        (F.col("edited") | touched).alias("edited"),
    ).select("part.id", "video_id", "part.start_sec", "part.end_sec", "motion_type", "score", "origin", "accepted", "edited")
    made = edits.where("op = 'create'").join(facts, "video_id")
    created = made.select(
        "id",
        "video_id",
        snap_to_frame(F.least("start_sec", "end_sec"), fps).alias("start_sec"),
        snap_to_frame(F.greatest("start_sec", "end_sec"), fps).alias("end_sec"),
        F.when(F.coalesce("motion_type", F.lit("erratic")) == "erratic", "forward")
        .otherwise(F.col("motion_type"))
        .alias("motion_type"),
        F.lit(0.0).alias("score"),
        F.lit("user").alias("origin"),
        F.lit(True).alias("accepted"),
        F.lit(False).alias("edited"),
    )
    return edited.unionByName(created)


def record_violations(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Schema and cross-field violations of segment rows, one row each."""
    from ..functions.motion import MOTION_TYPES

    # Only repeated ids are joined back; they are few, so the rows move by video alone.
    repeated = segments.groupBy("id").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    rows = segments.join(
        videos.select(F.col("id").alias("video_id"), "duration_sec"), "video_id", "left"
    ).join(written_once(repeated), "id", "left")
    checks = compact(
        [
            F.when(F.length("id") == 0, F.lit("id: must not be empty")),
            F.when(F.col("start_sec") < 0, F.lit("startSec: must not be negative")),
            F.when(F.col("end_sec") <= 0, F.lit("endSec: must be positive")),
            F.when(F.col("end_sec") <= F.col("start_sec"), F.lit("endSec must be greater than startSec")),
            F.when(~F.col("score").between(0, 1), F.lit("score: must be within 0..1")),
            F.when(~F.col("origin").isin("ai", "user"), F.lit("origin: unknown value")),
            F.when(~F.col("motion_type").isin(*MOTION_TYPES), F.lit("motionType: unknown value")),
            F.when(F.col("_copies") > 1, F.concat(F.lit("Duplicate segment id "), F.col("id"))),
            F.when(
                F.col("end_sec") > F.col("duration_sec") + 0.05,
                F.concat(F.lit("Segment "), F.col("id"), F.lit(" extends beyond the video duration")),
            ),
        ]
    )
    return scale.explode_present(rows, "violation", checks).select("id", "video_id", "violation")


def replace_segments(current: DataFrame, incoming: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the whole set of every touched video; a video with any violation keeps its old set.

    Returns (segments, violations).
    """
    violations = record_violations(incoming, videos)
    refused = violations.select("video_id").distinct()
    accepted = incoming.join(refused, "video_id", "left_anti")
    touched = accepted.select("video_id").distinct()
    return current.join(touched, "video_id", "left_anti").unionByName(accepted), violations


def upload_request_violations(files: DataFrame, limit: int = 500) -> DataFrame:
    """Problems of duplicate-check requests (request_id, key, size_bytes, fingerprint, duration_sec)."""
    checks = compact(
        [
            F.when(F.col("size_bytes") < 0, F.lit("sizeBytes: must not be negative")),
            F.when(~F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit("fingerprint: expected 64 hex digits")),
            F.when(F.col("duration_sec") <= 0, F.lit("durationSec: must be positive")),
        ]
    )
    single = scale.explode_present(files, "violation", checks).select("request_id", "key", "violation")
    crowded = files.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return single.unionByName(
        crowded.select(
            "request_id", F.lit(None).cast("string").alias("key"), F.lit(f"files: at most {limit}").alias("violation")
        )
    )
