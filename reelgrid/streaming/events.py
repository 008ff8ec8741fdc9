"""Change events: parsing, latest state, throttling, live progress and rates.

Batch functions define the semantics; the streaming functions run them incrementally with Structured
Streaming, with checkpoints and bounded state.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import folds, scale
from ..operators.catalog import CLIP_STATUSES, VIDEO_STATUSES
from ..operators.clips import job_progress
from ..session import written_once
from ..sources import units

# Event types with their required payload fields.
EVENT_FIELDS = {
    "video.progress": ["videoId", "status", "progress"],
    "video.updated": ["video"],
    "video.deleted": ["videoId"],
    "segments.updated": ["videoId"],
    "project.updated": ["project"],
    "project.deleted": ["projectId"],
    "export.updated": ["job"],
    "export.reset": ["projectId"],
    "export.clip.updated": ["clip"],
    "export.clip.progress": ["clipId", "status", "progress"],
}
ENTITY = "struct<id:string,projectId:string,jobId:string,status:string,progress:double,excluded:boolean>"
EVENT = (
    "struct<type:string,videoId:string,clipId:string,projectId:string,status:string,progress:double,"
    f"video:{ENTITY},project:{ENTITY},job:{ENTITY},clip:{ENTITY}>"
)
WATERMARK = "10 minutes"
FULL_UPDATES = ("video.updated", "export.clip.updated", "export.updated", "project.updated")
REMOVALS = ("video.deleted", "project.deleted", "export.reset")
#: Statuses after which an entity is not expected to change.
FINAL_STATUSES = ("ready", "failed", "done")


def parse_events(raw: DataFrame, document: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON events -> (typed events, rejects). Works on batches and streams alike.

    Unknown types, malformed payloads and bad status values are rejected, never raised.
    """
    e = F.col("event")
    rows = scale.pinned(raw, {"event": F.from_json(document, EVENT)})
    complete = F.lit(False)
    for kind, fields in EVENT_FIELDS.items():
        present = F.lit(True)
        for f in fields:
            present = present & (e[f]["id"].isNotNull() if f in ("video", "project", "job", "clip") else e[f].isNotNull())
        complete = complete | ((e["type"] == kind) & present)
    known = {"video.progress": VIDEO_STATUSES, "export.clip.progress": CLIP_STATUSES}
    for kind, statuses in known.items():
        complete = complete & ((e["type"] != kind) | F.coalesce(e["status"].isin(*statuses), F.lit(False)))
    ok = F.coalesce(complete, F.lit(False))
    rest = [c for c in raw.columns if c != document]
    typed = rows.where(ok).select(
        *rest,
        e["type"].alias("type"),
        F.coalesce(
            e["videoId"], e["clipId"], e["video"]["id"], e["clip"]["id"], e["job"]["id"], e["project"]["id"], e["projectId"]
        ).alias("entity_id"),
        F.coalesce(
            e["projectId"], e["video"]["projectId"], e["clip"]["projectId"], e["job"]["projectId"], e["project"]["id"]
        ).alias("project_ref"),
        e["clip"]["jobId"].alias("job_ref"),
        F.coalesce(e["status"], e["video"]["status"], e["clip"]["status"], e["job"]["status"], e["project"]["status"]).alias("status"),
        F.coalesce(e["progress"], e["video"]["progress"], e["clip"]["progress"]).alias("progress"),
        e["clip"]["excluded"].alias("excluded"),
    )
    return typed, rows.where(~ok).select(*raw.columns)


def entity_kind(kind: Column) -> Column:
    """What an event is about; a reset removes the jobs and clips of its project."""
    return (
        F.when(kind.startswith("export.clip"), "clip")
        .when(kind == "export.reset", "reset")
        .when(kind.startswith("export."), "job")
        .when(kind.startswith("video."), "video")
        .when(kind.startswith("project."), "project")
    )


def is_full(kind: Column) -> Column:
    return kind.isin(*FULL_UPDATES)


def is_removal(kind: Column) -> Column:
    return kind.isin(*REMOVALS)


def event_summary(events: DataFrame, order: list[str]) -> DataFrame:
    """Collapse events per entity to what decides its state.

    Kept: the last removal, the last full update, the last progress and the last known project and job. Each
    is a mergeable maximum, so batches combine in any grouping and a hot entity is reduced on the map side.
    """
    kind = F.col("type")
    at = F.struct(*order)
    value = F.struct(at.alias("at"), "status", "progress", "excluded")
    last = lambda cond: F.max_by(value, F.when(cond, at))
    known = lambda c: F.max_by(F.struct(at.alias("at"), F.col(c).alias("id")), F.when(F.col(c).isNotNull(), at))
    partial = kind.endswith(".progress")
    return (
        events.withColumn("entity", entity_kind(kind))
        .where(F.col("entity").isNotNull())
        .groupBy("entity", "entity_id")
        .agg(
            last(is_removal(kind)).alias("removed"),
            last(is_full(kind)).alias("full"),
            # Progress patches a row that was already known, so it needs an earlier full update.
            last(partial).alias("partial"),
            known("project_ref").alias("project"),
            known("job_ref").alias("job"),
        )
    )


def merge_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.unionByName(b)
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(c)["at"])).alias(c)
    return rows.groupBy("entity", "entity_id").agg(*map(newest, ("removed", "full", "partial", "project", "job")))


def state_of(summary: DataFrame) -> DataFrame:
    """Current rows: a full update after every removal that reaches the row, patched by later progress.

    A deleted project removes its videos, jobs and clips, a reset the jobs and clips of its project; a clip
    that does not name its project belongs to that of its job. Columns: entity, entity_id, status, progress,
    excluded, job_id, project_id.
    """
    full, removed, partial = F.col("full"), F.col("removed"), F.col("partial")
    gone = summary.where(removed.isNotNull() & F.col("entity").isin("project", "reset")).groupBy(
        F.col("entity_id").alias("project_id")
    )
    gone = gone.agg(
        F.max(F.when(F.col("entity") == "project", removed["at"])).alias("_deleted"),
        F.max(F.when(F.col("entity") == "reset", removed["at"])).alias("_reset"),
    )
    rows = summary.where((F.col("entity") != "reset") & full.isNotNull()).withColumns(
        {"job_id": F.col("job.id"), "_own": F.col("project.id")}
    )
    jobs = rows.where("entity = 'job'").select(F.col("entity_id").alias("job_id"), F.col("_own").alias("_by_job"))
    rows = rows.join(jobs, "job_id", "left").withColumn("project_id", F.coalesce("_own", "_by_job"))
    below = F.when(F.col("entity").isin("job", "clip"), F.greatest("_deleted", "_reset")).otherwise(F.col("_deleted"))
    after = lambda at: F.coalesce(full["at"] > at, F.lit(True))
    patched = F.coalesce(partial["at"] > full["at"], F.lit(False))
    pick = lambda f: F.when(patched, F.coalesce(partial[f], full[f])).otherwise(full[f]).alias(f)
    alive = rows.join(gone, "project_id", "left").where(after(removed["at"]) & after(below))
    return alive.select("entity", "entity_id", pick("status"), pick("progress"), pick("excluded"), "job_id", "project_id")


def latest_state(events: DataFrame, order: list[str]) -> DataFrame:
    return state_of(event_summary(events, order))


def stream_latest_state(
    events: DataFrame, order: list[str], table: str, checkpoint: str,
    event_time: str | None = None, watermark: str = WATERMARK, ttl_ms: int | None = None,
):
    """Keep the event summary of a stream in ``table`` (a store of units, see ``stored_state``).

    Each entity is a keyed state that late and repeated events reach in any order; a micro-batch writes the entities
    that it touched and nothing else. With ``event_time``, rows later than the watermark are dropped, so the state of
    a deleted video ends when the watermark passes the deletion, and with ``ttl_ms`` also that of an entity that was
    silent for so long since a final status: its stored row stays, and its next full update starts anew. Deleted
    videos leave the table as well; deleted projects and resets stay, as they reach rows of others.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        changed = written_once(_summaries(batch, order))
        gone = (F.col("entity") == "video") & F.coalesce(F.col("removed.at") > F.col("full.at"), F.col("full").isNull())
        keys = ("entity", "entity_id")
        units.commit(batch.sparkSession, table, {"state": units.Change(changed.where(~gone), keys, changed.select(*keys))})
        units.remove_unused(batch.sparkSession, table, keep=2)

    states = entity_states(events, order, event_time, watermark, ttl_ms)
    return states.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint)


def stored_state(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Current rows of the entities in the table of ``stream_latest_state``."""
    return state_of(units.read(spark, table, "state", version=version))


def entity_states(
    events: DataFrame, order: list[str], event_time: str | None = None, watermark: str = WATERMARK, ttl_ms: int | None = None
) -> DataFrame:
    """The changed summary of each entity per micro-batch, flat: the columns that ``_summaries`` puts together.

    A summary appears once a full update or a removal is known; until then progress waits in the state.
    """
    use_state_store(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    values = {"status": "string", "progress": "double", "excluded": "boolean"}
    fields = {}
    for part in ("removed", "full", "partial", "project", "job"):
        known = {"id": "string"} if part in ("project", "job") else values
        fields |= {f"{part}_{n}": k for n, k in ({f"at_{o}": kinds[o] for o in order} | known).items()}
    state = ", ".join(f"{n} {k}" for n, k in fields.items())
    source = events.withColumn("entity", entity_kind(F.col("type"))).where(F.col("entity").isNotNull())
    if event_time:
        source = source.withWatermark(event_time, watermark)
    processor = EntitySummary(tuple(order), tuple(fields), state, event_time, ttl_ms)
    columns = ["entity", "entity_id", "type", *dict.fromkeys([*order, *([event_time] if event_time else [])]), *values, "project_ref", "job_ref"]
    return (
        source.select(*columns)
        .groupBy("entity", "entity_id")
        .transformWithState(
            processor, f"entity string, entity_id string, {state}", "Update", "EventTime" if event_time else "None"
        )
    )


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the state store on disk; a provider that the session sets itself is kept if it is one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _summaries(states: DataFrame, order: list[str]) -> DataFrame:
    """Flat states in the form of ``event_summary``."""

    def part(name: str, *values: str) -> Column:
        at = F.struct(*(F.col(f"{name}_at_{o}").alias(o) for o in order)).alias("at")
        known = F.coalesce(*(F.col(f"{name}_at_{o}").isNotNull() for o in order))
        return F.when(known, F.struct(at, *(F.col(f"{name}_{v}").alias(v) for v in values))).alias(name)

    full = [part(n, "status", "progress", "excluded") for n in ("removed", "full", "partial")]
    return states.select("entity", "entity_id", *full, part("project", "id"), part("job", "id"))


class EntitySummary(StatefulProcessor):
    """The last removal, full update, progress, project and job of an entity, each a maximum by order."""

    def __init__(self, order: tuple[str, ...], fields: tuple[str, ...], schema: str, event_time: str | None, ttl_ms: int | None):
        self.order, self.fields, self.schema = order, fields, schema
        self.event_time, self.ttl_ms = event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", self.schema)
        self.expiry = handle.getValueState("expiry", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = dict(zip(self.fields, self.summary.get(), strict=True)) if self.summary.exists() else dict.fromkeys(self.fields)
        latest = 0
        for row in rows:
            at = tuple(row[o] for o in self.order)
            values = {"status": row["status"], "progress": row["progress"], "excluded": row["excluded"]}
            kind = row["type"]
            if kind in REMOVALS:
                self._newer(known, "removed", at, values)
            elif kind in FULL_UPDATES:
                self._newer(known, "full", at, values)
            elif kind.endswith(".progress"):
                self._newer(known, "partial", at, values)
            for part, ref in (("project", row["project_ref"]), ("job", row["job_ref"])):
                if ref is not None:
                    self._newer(known, part, at, {"id": ref})
            if self.event_time and row[self.event_time] is not None:
                latest = max(latest, int(row[self.event_time].timestamp() * 1000))
        self.summary.update(tuple(known[f] for f in self.fields))
        if self.event_time:
            self._plan_end(key, known, latest)
        if known[f"full_at_{self.order[0]}"] is not None or known[f"removed_at_{self.order[0]}"] is not None:
            yield Row(**{"entity": key[0], "entity_id": key[1], **known})

    def _newer(self, known: dict, part: str, at: tuple, values: dict) -> None:
        old = tuple(known[f"{part}_at_{o}"] for o in self.order)
        if old[0] is None or at > old:
            known.update({f"{part}_at_{o}": x for o, x in zip(self.order, at, strict=True)})
            known.update({f"{part}_{n}": x for n, x in values.items()})

    def _plan_end(self, key, known: dict, latest: int) -> None:
        """A timer for the end of a deleted video, or of a final entity that stays silent; one is valid at a time."""
        moment = lambda part: tuple(known[f"{part}_at_{o}"] for o in self.order)
        removed, full, partial = moment("removed"), moment("full"), moment("partial")
        gone = removed[0] is not None and (full[0] is None or removed > full)
        last = "partial" if partial[0] is not None and full[0] is not None and partial > full else "full"
        end = None
        if gone and key[0] == "video":
            end = latest
        elif not gone and self.ttl_ms and known[f"{last}_status"] in FINAL_STATUSES:
            end = latest + self.ttl_ms
        if end is None:
            self.expiry.clear()
        else:
            self.expiry.update((end,))
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.expiry.exists() and self.expiry.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.summary.clear()
            self.expiry.clear()
        return iter([])

    def close(self) -> None:
        pass


def throttle_stream(
    events: DataFrame, key: str, step: float, key_type: str = "bigint", order: str = "event_id", ttl_ms: int | None = None,
    with_late: bool = False,
) -> DataFrame:
    """Streaming throttle: the state of a key is its last passed value and the last order that it has seen.

    ``events``: key, ``order`` (bigint), progress. What was passed on can't be taken back, so a row at or before an
    order that an earlier micro-batch brought is late: it is left out, or kept apart in rows with ``late``, if asked
    for; so are repetitions. A silent key's state ends after ``ttl_ms`` of processing time, which needs a query that is
    triggered continuously (a run-once query would wait for the ends).
    """
    use_state_store(events.sparkSession)
    late = ", late boolean" if with_late else ""
    return (
        events.select(key, order, "progress")
        .groupBy(key)
        .transformWithState(
            Throttle(key, order, step, ttl_ms, with_late),
            f"{key} {key_type}, {order} bigint, progress double{late}",
            "Append",
            "ProcessingTime" if ttl_ms else "None",
        )
    )


class Throttle(StatefulProcessor):
    """Rows of a key that differ enough from the last one passed on; a micro-batch is taken in order."""

    def __init__(self, key: str, order: str, step: float, ttl_ms: int | None, with_late: bool):
        self.key, self.order, self.rule, self.ttl_ms, self.with_late = key, order, folds.Move(step), ttl_ms, with_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double, seen bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        value, seen = self.last.get() if self.last.exists() else (self.rule.start, None)
        at, values = array("q"), array("d")
        for row in rows:
            if seen is not None and row[self.order] <= seen:
                if self.with_late:
                    yield self._row(key, row[self.order], row["progress"], True)
                continue
            at.append(row[self.order])
            values.append(float("nan") if row["progress"] is None else min(1.0, max(0.0, row["progress"])))
        if not at:
            return
        places, first = np.unique(np.frombuffer(at, np.int64), return_index=True)
        v = np.frombuffer(values, np.float64)[first]
        to = self.rule.following(v, np.full(len(v), len(v)))
        k = self.rule.first(v, value)
        while k < len(v):
            value = float(v[k])
            yield self._row(key, int(places[k]), value, False)
            k = int(to[k])
        self.last.update((value, int(places[-1])))

    def _row(self, key, at: int, value: float, late: bool) -> Row:
        found = {self.key: key[0], self.order: at, "progress": value}
        return Row(**(found | {"late": late} if self.with_late else found))

    def close(self) -> None:
        pass


def live_jobs(state: DataFrame) -> DataFrame:
    """Totals, status counts, weighted progress and build gate of every job, from the clips in ``latest_state``."""
    clips = state.where("entity = 'clip' AND job_id IS NOT NULL")
    known = {"excluded": F.coalesce("excluded", F.lit(False)), "progress": F.coalesce("progress", F.lit(0.0))}
    return job_progress(clips.withColumns(known))


def live_job_progress(events: DataFrame) -> DataFrame:
    """Number of clip events and best progress per project, maintained in update mode."""
    clip = events.where(F.col("type").startswith("export.clip"))
    return clip.groupBy("project_id").agg(F.count(F.lit(1)).alias("events"), F.max("progress").alias("best"))


def event_rate(
    events: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Events per project and type over event-time windows; rows later than the watermark are dropped."""
    slot = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(slot.alias("slot"), "project_id", "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("slot.start").alias("start"), F.col("slot.end").alias("end"), "project_id", "type", "n")
    )


def event_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Bursts of activity per project."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap).alias("s"), "project_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "project_id", "n")
    )


#: Folders that arrived samples are dealt into by video, so that a batch reads only those it touches.
SAMPLE_BUCKETS = 256


def incremental_analysis(
    features: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    reconcile: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
):
    """Analyse the videos of every micro-batch as a whole and keep one result per video.

    Arrived samples are stored in ``out``/samples, once per batch id, so replays are idempotent and a video
    that is split over batches, or arrives again, is analysed with all its samples, each counted once.
    ``out``/segments holds the latest segments, replaced video by video, also when a video has none any more (see
    ``analysed_segments``); ``reconcile(current, fresh)`` decides what stays of the current ones (C5), by default
    nothing. The stream itself keeps no state.
    """
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(SAMPLE_BUCKETS)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch.drop("arrived_at").withColumn("bucket", bucket)
        arrived.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/samples/batch={batch_id}")
        stored = spark.read.parquet(f"{out}/samples").where(F.col("batch") <= batch_id)
        fresh = stored.where(F.col("batch") == batch_id)
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # SAMPLE_BUCKETS rows at most
        videos = fresh.select("video_id").distinct()
        whole = stored.where(F.col("bucket").isin(touched)).join(videos, "video_id", "left_semi")
        found = analyse(whole.drop("batch", "bucket").dropDuplicates(["video_id", "i"]))
        if reconcile and units.versions(spark, f"{out}/segments"):
            current = units.read(spark, f"{out}/segments", "segments", found.schema)
            found = written_once(reconcile(current.join(videos, "video_id", "left_semi"), found))
        units.commit(spark, f"{out}/segments", {"segments": units.Change(found, ("video_id",), videos)})

    return features.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def analysed_segments(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """Segments that ``incremental_analysis`` keeps in ``out``."""
    return units.read(spark, f"{out}/segments", "segments", version=version)
