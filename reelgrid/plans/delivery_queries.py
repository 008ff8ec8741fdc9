"""Registered queries over documents, deliveries and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import geo as OG
from ..operators import platforms as P
from ..operators import prompts as PR
from ..sources import delivery as SD
from ..sources import files as SF
from ..sources import media as SM
from ..sources import tables as ST
from ..session import shared_path, written_once
from ..streaming import events as SE
from . import bindings as B
from . import motion_queries as MQ
from .bindings import SETTINGS, duck, duck_six, six
from .text_queries import _ALL_ROWS as ALL_ROWS
from .text_queries import CONTEXT, RULES


def stored_features(spark, sf):
    out = ST.rounded_features(B.frame_features(spark, sf))
    return out.select("video_id", "i", *[six(c).alias(c) for c in ("t", "dx", "fit", "mag_var", "sharpness", "brightness")])


def metric_pages(spark, sf):
    """Stored arrays per page of 64 samples, reported by size and end points."""
    pages = ST.metric_pages(MQ.motion_series(spark, sf), SETTINGS.analysis_fps, 64)
    return pages.select(
        "video_id", "page", F.size("t").alias("n"), F.element_at("t", 1).alias("first_t"), F.element_at("t", -1).alias("last_t"),
        F.array_max("speed").alias("max_speed"), F.element_at("motion", -1).alias("last_motion"),
    )


def fingerprints(spark, sf):
    docs = B.table(spark, sf, "documents")
    content = F.encode("text", "UTF-8")
    return docs.select("doc_id", SF.fingerprint(content).alias("fingerprint"), F.sha2(content, 256).alias("content_hash"))


def probe_facts(spark, sf):
    """Probe documents built from the videos, normalised back into typed facts."""
    v = B.videos(spark, sf)
    k = F.col("id") % 6
    stream = F.struct(
        F.lit("video").alias("codec_type"), F.lit("hevc").alias("codec_name"), F.col("width"), F.col("height"),
        F.when(k == 1, "yuv420p").otherwise("yuv420p10le").alias("pix_fmt"), F.lit("arib-std-b67").alias("color_transfer"),
        F.concat(F.floor(F.col("fps") * 1000).cast("string"), F.lit("/1000")).alias("avg_frame_rate"),
        F.create_map(F.lit("Encoder"), F.lit("DJI Mini"), F.lit("rotate"), F.when(k == 2, "90").otherwise("0")).alias("tags"),
    )
    sound = F.struct(*[F.lit("audio" if n == "codec_type" else None).cast(t).alias(n) for n, t in (("codec_type", "string"), ("codec_name", "string"), ("width", "int"), ("height", "int"), ("pix_fmt", "string"), ("color_transfer", "string"), ("avg_frame_rate", "string"), ("tags", "map<string,string>"))])
    doc = F.struct(
        F.when(k == 3, F.array(sound)).when(k == 4, F.array(stream)).otherwise(F.array(sound, stream)).alias("streams"),
        F.struct(
            F.when(k != 5, F.col("duration_sec").cast("string")).alias("duration"),
            F.create_map(F.lit("LOCATION"), F.lit("+59.9386+030.3141/"), F.lit("creation_time"), F.date_format("created_at", "yyyy-MM-dd")).alias("tags"),
        ).alias("format"),
    )
    docs = v.select("id", F.to_json(doc).alias("probe"))
    facts, rejects = SM.normalize_probe(docs)
    good = facts.select(
        "id", "width", "height", six("fps").alias("fps"), six("duration_sec").alias("duration_sec"), "bit_depth", "color_transfer", "has_audio",
        "make", "model", "creation_time", six("location.lat").alias("lat"), F.lit(None).cast("string").alias("reason"),
    )
    return good.unionByName(rejects.select("id", "reason"), allowMissingColumns=True)


def telemetry_packets(spark, sf):
    """GPS points packed as messages and decoded again."""
    t = B.telemetry(spark, sf)

    def field(n, payload):
        head = F.unhex(F.lpad(F.hex(F.lit(n * 8 + 2)), 2, "0"))
        return F.concat(head, F.unhex(F.lpad(F.hex(F.octet_length(payload)), 2, "0")), payload)

    # Doubles as little-endian bytes: exact because the values are binary fractions of the radian.
    def double(n, c):
        return F.concat(F.unhex(F.lpad(F.hex(F.lit(n * 8 + 1)), 2, "0")), _double_bytes(c))

    lat, lon = (F.floor(F.radians(c) * 2**40) / 2.0**40 for c in ("lat", "lon"))
    spot = F.concat(double(2, lat), double(3, lon))
    payload = field(3, field(3, field(4, field(1, spot))))
    points = SM.decode_telemetry(t.select("video_id", "t", payload.alias("payload")))
    return points.select("video_id", six("t").alias("t"), six("lat").alias("lat"), six("lon").alias("lon"))


def _double_bytes(c):
    """IEEE bytes of a positive double, least significant first."""
    exponent = F.floor(F.log2(c))
    mantissa = F.floor((c / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52).cast("bigint")
    bits = F.shiftleft((exponent + 1023).cast("bigint"), 52) + mantissa
    text = F.lpad(F.hex(bits), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 15 - 2 * k, 2) for k in range(8)]))


def place_responses(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey") % 5
    address = F.create_map(
        F.when(k == 0, "city").when(k == 1, "village").otherwise("county"), F.col("c_name"), F.lit("state"), F.col("c_mktsegment"),
        F.lit("country_code"), F.lit("ru"), F.lit("country"), F.lit("Russia"),
    )
    good = F.struct(F.concat("c_name", F.lit(", Russia")).alias("display_name"), F.when(k == 2, F.lit("Кижи")).alias("name"), address.alias("address"))
    body = F.when(k == 4, F.lit('{"error":"Unable to geocode"}')).otherwise(F.to_json(good))
    en = c.select(F.col("c_custkey").alias("grid_key"), F.lit("en").alias("lang"), body.alias("response"))
    local = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("grid_key"), F.lit("local").alias("lang"), body.alias("response"))
    return SM.parse_place_responses(en.unionByName(local))


def landmark_responses(spark, sf):
    s = B.table(spark, sf, "supplier")
    k = F.col("s_suppkey") % 4
    page = F.struct(
        F.col("s_name").alias("title"), F.when(k == 1, "a church").alias("description"),
        F.when(k != 3, F.array(F.struct(F.lit(59.9).alias("lat"), F.col("s_acctbal").alias("lon"), F.when(k == 2, "city").alias("type")))).alias("coordinates"),
        F.struct(F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("wikibase_item")).alias("pageprops"),
    )
    wiki = s.select(F.col("s_suppkey").alias("grid_key"), F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query"))).alias("response"))
    tags = F.create_map(
        F.lit("name"), F.col("s_name"), F.when(k == 0, "historic").when(k == 1, "tourism").when(k == 2, "natural").otherwise("shop"),
        F.when(k == 1, "hotel").otherwise("castle"), F.lit("int_name"), F.upper("s_name"),
    )
    element = F.struct(F.struct(F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon")).alias("center"), tags.alias("tags"))
    osm = s.select(F.col("s_suppkey").alias("grid_key"), F.to_json(F.struct(F.array(element).alias("elements"))).alias("response"))
    found = OG.union_pois([SM.parse_encyclopedia_responses(wiki), SM.parse_map_responses(osm)])
    return found.select("grid_key", "source_rank", "name", "name_en", "type", six("lat").alias("lat"), "wikidata_id")


def settings_documents(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey") % 5
    doc = (
        F.when(k == 0, F.lit("not json"))
        .when(k == 1, F.concat(F.lit('{"concurrency":'), (F.col("c_custkey") % 12).cast("string"), F.lit("}")))
        .when(k == 2, F.lit('{"adobeAuthor":"Jane","temperature":0.5}'))
        .when(k == 3, F.lit('{"adobeAuthor":null}'))
        .otherwise(F.lit("{}"))
    )
    out = ST.resolve_settings(c.select("c_custkey", doc.alias("value")))
    return out.select("c_custkey", "settings.concurrency", F.col("settings.adobeAuthor").alias("author"), six("settings.temperature").alias("temperature"))


def settings_violations(spark, sf):
    p = B.projects(spark, sf).withColumns(
        {
            "min_duration": (F.col("id") % 50).cast("double"), "max_duration": F.lit(40.0), "target_duration": F.lit(25.0),
            "analysis_fps": (F.col("id") % 33).cast("double"), "sensitivity": F.lit(1.0), "include_static": F.lit(False),
        }
    )
    out = ST.validate_settings(p)
    return out.select("id", F.array_join(F.transform("violations", lambda v: v["path"]), ",").alias("paths"))


def manifest_documents(spark, sf):
    """Manifest pages read back: segments and seconds per video."""
    rows = C.build_manifest_rows(B.videos(spark, sf), B.segments(spark, sf)).withColumn("motion_type", F.lit("forward"))
    docs = SD.manifest_documents(rows).select(F.from_json("value", SD._MANIFEST).alias("d"))
    rows = docs.select(F.col("d.projectId").cast("bigint").alias("project_id"), F.col("d.video.videoId").cast("bigint").alias("video_id"), F.inline("d.video.segments"))
    return rows.groupBy("project_id", "video_id").agg(F.count(F.lit(1)).alias("segments"), six(F.sum(F.col("endSec") - F.col("startSec"))).alias("seconds"))


def prompts(spark, sf):
    d = B.delivery_clips(spark, sf)
    geo = F.when(
        F.col("clip_id") % 4 != 0,
        F.struct(
            F.lit("embedded").alias("source"), F.lit(61.7).alias("lat"), F.lit(35.2).alias("lon"), F.lit(12.4).alias("altitude_m"),
            F.col("city").alias("city"), F.lit("Region & Co").alias("region"), F.col("country").alias("country"), F.lit(None).cast("string").alias("country_code"),
            F.lit(None).cast("string").alias("display_name"), F.lit("Кижи").alias("local_name"), F.lit(None).cast("string").alias("manual_text"),
            F.lit(None).cast("double").alias("camera_heading_deg"),
            F.array(F.struct(F.lit("Кижи").alias("name"), F.lit("Kizhi").alias("name_en"), F.lit("church").alias("type"), F.lit(120).cast("bigint").alias("distance_m"), F.lit(90.4).alias("bearing_deg"), F.lit(True).alias("in_camera_sector"), F.lit(None).cast("string").alias("wikidata_id"))).alias("poi_candidates"),
        ),
    )
    tech = F.struct(
        "duration_sec", "movement", "shot_type", F.lit("orbit_left").alias("motion_type"), F.lit("day").alias("time_of_day"),
        F.lit("summer").alias("season"), F.col("capture_date").alias("capture_date"), F.lit(None).cast("double").alias("altitude_m"),
    )
    rows = d.select("clip_id", geo.alias("geo"), tech.alias("tech"), F.lit(None).cast("string").alias("user_hint"), F.when(F.col("clip_id") % 2 == 0, "Kizhi").alias("poi_override"))
    return PR.render_prompts(rows, RULES).select("clip_id", "user_text")


def _jobs(spark, sf):
    jobs = B.table(spark, sf, "documents").select(F.col("source").alias("job_id")).distinct()
    return jobs.withColumns({"project_name": F.upper("job_id"), "folder": F.concat(F.lit("export_"), "job_id"), "built_at": F.lit("2024-08-02T10:30:00.000Z"), "excluded": F.lit(0)})


def report_lines(spark, sf):
    clips = P.csv_clip_view(B.delivery_clips(spark, sf)).withColumn("ordinal", F.col("clip_id").cast("int"))
    results = written_once(P.platform_results(clips, CONTEXT).drop("title", "description", "keywords"))
    lines = SD.report_lines(_jobs(spark, sf), results, CONTEXT)
    return lines.groupBy("job_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"))


def delivery_documents(spark, sf):
    clips = P.csv_clip_view(B.delivery_clips(spark, sf))
    docs = SD.delivery_metadata(P.platform_results(clips, CONTEXT))
    v = F.from_json("value", "struct<filename:string,final:struct<editorial:boolean,keywords:array<string>>,validations:array<struct<platform:string,level:string>>>")
    docs = docs.withColumn("d", v)
    return docs.select("clip_id", "d.filename", "d.final.editorial", F.size("d.final.keywords").alias("keywords"), F.size("d.validations").alias("platforms"))


def build_delivery(spark, sf):
    """Two passes: the second knows the hash of half of the jobs and reuses those."""
    clips = B.delivery_clips(spark, sf).withColumns(
        {"status": F.when((F.col("job_id") == "src3") & (F.col("clip_id") % 2 == 1), "cut").otherwise("done"), "excluded": F.lit(False), "progress": F.lit(0.0)}
    )
    jobs = _jobs(spark, sf).select("job_id", F.lit(None).cast("string").alias("archive_hash"))
    first = SD.build_delivery(clips, jobs, CONTEXT)["jobs"]
    known = first.select("job_id", F.when(F.length("job_id") == 4, F.col("delivery_hash")).alias("archive_hash"))
    again = SD.build_delivery(clips, known, CONTEXT)["jobs"]
    return again.select("job_id", "outcome")


def delivery_files(spark, sf):
    """Every CSV file of the built jobs, read back from its place: job, platform and the row as written."""
    clips = B.delivery_clips(spark, sf).withColumns(
        {"status": F.lit("done"), "excluded": F.lit(False), "progress": F.lit(0.0), "ordinal": F.col("clip_id").cast("int")}
    )
    jobs = _jobs(spark, sf).select("job_id", F.lit(None).cast("string").alias("archive_hash"))
    path = shared_path(spark, "delivery")
    SD.write_delivery(SD.build_delivery(clips, jobs, CONTEXT), CONTEXT, path)
    out = None
    for platform in P.REGISTRY:
        name = "adobe_stock_jane_doe_2024_08_02.csv" if platform == "adobe" else f"{platform}.csv"
        names = [f"c{k}" for k in range(len(CONTEXT.rules[platform]["header"]))]
        rows = spark.read.csv(
            f"{path}/files/*/{name}", ", ".join(f"{n} string" for n in names), header=True, escape='"', enforceSchema=True
        )
        rows = rows.select(
            F.element_at(F.split(F.input_file_name(), "/"), -2).alias("job_id"), F.lit(platform).alias("platform"),
            F.concat_ws("|", *(F.coalesce(n, F.lit("")) for n in names)).alias("row"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _event_documents(spark, sf):
    """Change events as JSON; every eighth is malformed or unknown."""
    e = B.change_events(spark, sf)
    entity = F.struct(F.col("entity_id").cast("string").alias("id"), F.lit("p").alias("projectId"), F.lit("ready").alias("status"), F.col("progress").alias("progress"))
    kind = F.col("type")
    doc = F.struct(
        F.when(F.col("event_id") % 8 == 3, "video.renamed").otherwise(kind).alias("type"),
        F.when(kind.isin("video.progress", "video.deleted"), F.col("entity_id").cast("string")).alias("videoId"),
        F.when(kind == "export.clip.progress", F.col("entity_id").cast("string")).alias("clipId"),
        F.when(kind.endswith("progress"), F.when(F.col("event_id") % 8 == 5, "sleeping").otherwise("queued")).alias("status"),
        F.when(kind.endswith("progress"), F.col("progress")).alias("progress"),
        F.when(kind == "video.updated", entity).alias("video"),
        F.when(kind == "export.updated", entity).alias("job"),
    )
    return e.select("event_id", "ts", F.when(F.col("event_id") % 8 == 7, "{broken").otherwise(F.to_json(doc)).alias("value"))


def parsed_events(spark, sf):
    typed, rejects = SE.parse_events(_event_documents(spark, sf))
    good = typed.select("event_id", "type", "entity_id", "status", six("progress").alias("progress"))
    return good.unionByName(rejects.select("event_id", F.lit("rejected").alias("type")), allowMissingColumns=True)


def latest_state(spark, sf):
    typed, _ = SE.parse_events(_event_documents(spark, sf))
    return SE.latest_state(typed, ["ts", "event_id"]).select("entity", "entity_id", "status", six("progress").alias("progress"))


def _feed(spark, sf):
    """Change events of all ten types: projects of jobs of clips, and videos, by user."""
    k, s = F.col("event_id") % 16, lambda c: c.cast("string")
    user, n = F.col("user_id"), F.col("event_id")
    project, job = F.concat(F.lit("p"), s(user % 10)), F.concat(F.lit("j"), s(user % 20))
    kind = (
        F.when(k < 4, "export.clip.updated").when(k < 8, "export.clip.progress").when(k == 8, "video.updated")
        .when(k.isin(9, 15), "video.progress").when(k == 10, "video.deleted").when(k == 11, "export.updated")
        .when(k == 12, "project.updated").when(n % 128 == 13, "export.reset").when(n % 256 == 14, "project.deleted")
        .otherwise("segments.updated")
    )
    status = F.element_at(F.array(*[F.lit(x) for x in ("queued", "cut", "done", "review")]), (n % 4 + 1).cast("int"))
    progress = F.least(F.lit(1.0), F.col("value") / 200)
    entity = lambda i: F.struct(
        i.alias("id"), F.when(kind != "export.clip.updated", project).alias("projectId"),
        F.when(kind == "export.clip.updated", job).alias("jobId"), status.alias("status"), progress.alias("progress"),
        (user % 7 == 0).alias("excluded"),
    )
    doc = F.struct(
        kind.alias("type"),
        F.when(kind.isin("video.progress", "video.deleted", "segments.updated"), s(user)).alias("videoId"),
        F.when(kind == "export.clip.progress", s(user)).alias("clipId"),
        F.when(kind.isin("export.reset", "project.deleted"), project).alias("projectId"),
        F.when(kind == "export.clip.progress", status).when(kind == "video.progress", "queued").alias("status"),
        F.when(kind.endswith("progress"), progress).alias("progress"),
        F.when(kind == "video.updated", entity(s(user))).alias("video"),
        F.when(kind == "project.updated", entity(project)).alias("project"),
        F.when(kind == "export.updated", entity(job)).alias("job"),
        F.when(kind == "export.clip.updated", entity(s(user))).alias("clip"),
    )
    return B.table(spark, sf, "events").select("event_id", "ts", F.to_json(doc).alias("value"))


def _feed_state(spark, sf):
    return SE.latest_state(SE.parse_events(_feed(spark, sf))[0], ["ts", "event_id"])


def feed_state(spark, sf):
    state = _feed_state(spark, sf)
    return state.select("entity", "entity_id", "status", six("progress").alias("progress"), "job_id", "project_id")


def live_jobs(spark, sf):
    jobs = SE.live_jobs(_feed_state(spark, sf))
    return jobs.select("job_id", "total", "excluded", "n_done", "n_cut", six("progress").alias("progress"), "can_build")


def event_rate(spark, sf):
    rate = SE.event_rate(B.change_events(spark, sf), "6 hours")
    return rate.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_sec"), "project_id", "type", "n")


def event_rate_sliding(spark, sf):
    rate = SE.event_rate(B.change_events(spark, sf), "6 hours", "3 hours")
    return rate.groupBy(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_sec")).agg(F.sum("n").alias("n"))


def event_sessions(spark, sf):
    out = SE.event_sessions(B.change_events(spark, sf), "20 minutes")
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "project_id", "n")


def live_job_progress(spark, sf):
    return SE.live_job_progress(B.change_events(spark, sf)).select("project_id", "events", six("best").alias("best"))


QUERIES = {
    f.__name__: f
    for f in (
        stored_features, metric_pages, fingerprints, probe_facts, telemetry_packets, place_responses,
        landmark_responses, settings_documents, settings_violations, manifest_documents, prompts, report_lines,
        delivery_documents, build_delivery, delivery_files, parsed_events, latest_state, event_rate, event_rate_sliding,
        event_sessions, live_job_progress, feed_state, live_jobs,
    )
}

_r = lambda e, d: duck_six(f"floor(({e}) * 1e{d} + 5e-1) / 1e{d}")
_FEED = """
f AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS o, user_id AS u, event_id AS n, 'p' || user_id % 10 AS p, 'j' || user_id % 20 AS j,
  ['queued', 'cut', 'done', 'review'][CAST(event_id % 4 + 1 AS INT)] AS status, least(1e0, value / 2e2) AS progress,
  CASE WHEN event_id % 16 < 4 THEN 'cu' WHEN event_id % 16 < 8 THEN 'cp' WHEN event_id % 16 = 8 THEN 'vu' WHEN event_id % 16 IN (9, 15) THEN 'vp'
    WHEN event_id % 16 = 10 THEN 'vd' WHEN event_id % 16 = 11 THEN 'ju' WHEN event_id % 16 = 12 THEN 'pu'
    WHEN event_id % 128 = 13 THEN 'r' WHEN event_id % 256 = 14 THEN 'pd' END AS kind FROM events),
gone AS (SELECT p, max(o) FILTER (WHERE kind = 'pd') AS deleted, max(o) FILTER (WHERE kind = 'r') AS reset FROM f GROUP BY 1),
named AS (SELECT *, CASE kind[1] WHEN 'c' THEN 'clip' WHEN 'v' THEN 'video' WHEN 'j' THEN 'job' ELSE 'project' END AS entity,
  CASE kind[1] WHEN 'j' THEN j WHEN 'p' THEN p ELSE CAST(u AS VARCHAR) END AS id FROM f WHERE kind <> 'r'),
l AS (SELECT entity, id, max(o) FILTER (WHERE kind[2] = 'u') AS full_at, max(o) FILTER (WHERE kind[2] = 'd') AS removed, max(o) FILTER (WHERE kind[2] = 'p') AS partial,
  arg_max(p, o) AS p, arg_max(j, o) AS j FROM named GROUP BY 1, 2),
jobs AS (SELECT id AS j, p AS job_project FROM l WHERE entity = 'job' AND full_at IS NOT NULL),
owned AS (SELECT l.* EXCLUDE (p), CASE WHEN entity = 'clip' THEN job_project ELSE l.p END AS p FROM l LEFT JOIN jobs USING (j)),
state AS (SELECT o.*, f.status, f.progress FROM owned o LEFT JOIN gone g ON g.p = o.p JOIN f ON f.o = greatest(full_at, coalesce(partial, 0))
  WHERE full_at > coalesce(removed, 0) AND full_at > coalesce(deleted, 0) AND (entity IN ('video', 'project') OR full_at > coalesce(reset, 0))),
feed AS (SELECT entity, id AS entity_id, CASE WHEN entity = 'video' AND coalesce(partial, 0) > full_at THEN 'queued' ELSE status END AS status,
  CASE WHEN entity IN ('job', 'project') THEN NULL ELSE progress END AS progress, CASE WHEN entity = 'clip' THEN j END AS job_id, p AS project_id, id FROM state)"""

_EVENTS = f"""{duck("change_events")},
ev AS (SELECT *, CASE WHEN event_id % 8 IN (3, 7) OR (event_id % 8 = 5 AND type LIKE '%progress') THEN 'rejected' ELSE type END AS kind,
  CASE WHEN type LIKE '%progress' THEN 'queued' WHEN type LIKE '%updated' THEN 'ready' END AS status,
  CASE WHEN type = 'video.deleted' OR type = 'export.updated' THEN NULL ELSE progress END AS p FROM change_events)"""

ORACLES = {
    "stored_features": f"""WITH {duck("frame_features")}
SELECT video_id, i, {_r("t", 4)} AS t, {_r("dx", 5)} AS dx, {_r("fit", 4)} AS fit, {_r("mag_var", 8)} AS mag_var, {_r("sharpness", 2)} AS sharpness, {_r("brightness", 2)} AS brightness FROM frame_features""",
    "metric_pages": MQ.ORACLES["motion_series"].replace("SELECT video_id, i, floor((t", ", out AS (SELECT video_id, i, floor((t", 1)
    + """)
SELECT video_id, i // 64 AS page, CAST(count(*) AS INT) AS n, arg_min(t, i) AS first_t, arg_max(t, i) AS last_t, max(speed) AS max_speed, arg_max(motion, i) AS last_motion
FROM out GROUP BY 1, 2""",
    "fingerprints": "SELECT doc_id, sha256(strlen(text) || chr(10) || text) AS fingerprint, sha256(text) AS content_hash FROM documents",
    "probe_facts": f"""WITH {duck("videos")}
SELECT id, CASE WHEN id % 6 IN (3, 5) THEN NULL WHEN id % 6 = 2 THEN height ELSE width END AS width, CASE WHEN id % 6 IN (3, 5) THEN NULL WHEN id % 6 = 2 THEN width ELSE height END AS height,
  CASE WHEN id % 6 NOT IN (3, 5) THEN {duck_six("fps")} END AS fps, CASE WHEN id % 6 NOT IN (3, 5) THEN {duck_six("duration_sec")} END AS duration_sec,
  CASE WHEN id % 6 NOT IN (3, 5) THEN CASE WHEN id % 6 = 1 THEN 8 ELSE 10 END END AS bit_depth, CASE WHEN id % 6 NOT IN (3, 5) THEN 'hlg' END AS color_transfer,
  CASE WHEN id % 6 NOT IN (3, 5) THEN id % 6 <> 4 END AS has_audio, CASE WHEN id % 6 NOT IN (3, 5) THEN 'DJI' END AS make, CASE WHEN id % 6 NOT IN (3, 5) THEN 'DJI Mini' END AS model,
  CASE WHEN id % 6 NOT IN (3, 5) THEN strftime(created_at, '%Y-%m-%d') END AS creation_time, CASE WHEN id % 6 NOT IN (3, 5) THEN 599386e-4 END AS lat,
  CASE id % 6 WHEN 3 THEN 'no video stream found' WHEN 5 THEN 'could not determine the duration' END AS reason FROM videos""",
    "telemetry_packets": f"""WITH {duck("telemetry")}
SELECT video_id, {duck_six("t")} AS t, {duck_six("floor(degrees(floor(radians(lat) * 1099511627776e0) / 1099511627776e0) * 1e7 + 5e-1) / 1e7")} AS lat,
  {duck_six("floor(degrees(floor(radians(lon) * 1099511627776e0) / 1099511627776e0) * 1e7 + 5e-1) / 1e7")} AS lon FROM telemetry""",
    "place_responses": """SELECT c_custkey AS grid_key, CASE WHEN c_custkey % 5 <> 4 THEN c_name END AS city, CASE WHEN c_custkey % 5 <> 4 THEN c_mktsegment END AS region,
  CASE WHEN c_custkey % 5 <> 4 THEN 'Russia' END AS country, CASE WHEN c_custkey % 5 <> 4 THEN 'RU' END AS country_code,
  CASE WHEN c_custkey % 5 <> 4 THEN c_name || ', Russia' END AS display_name,
  CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 5 = 2 THEN 'Кижи' WHEN c_custkey % 5 <> 4 THEN c_name END END AS local_name FROM customer""",
    "landmark_responses": """SELECT s_suppkey AS grid_key, CAST(0 AS INT) AS source_rank, s_name AS name, s_name AS name_en, CASE s_suppkey % 4 WHEN 1 THEN 'a church' ELSE 'landmark' END AS type, 599e-1 AS lat, 'Q' || s_suppkey AS wikidata_id
FROM supplier WHERE s_suppkey % 4 IN (0, 1)
UNION ALL SELECT s_suppkey, 1, s_name, upper(s_name), CASE s_suppkey % 4 WHEN 0 THEN 'historic=castle' ELSE 'natural=castle' END, 15e-1, NULL FROM supplier WHERE s_suppkey % 4 IN (0, 2)""",
    "settings_documents": """SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 = 1 AND c_custkey % 12 BETWEEN 1 AND 8 THEN c_custkey % 12 ELSE 2 END AS INT) AS concurrency,
  CASE c_custkey % 5 WHEN 2 THEN 'Jane' ELSE 'author' END AS author, CASE c_custkey % 5 WHEN 2 THEN 5e-1 ELSE 3e-1 END AS temperature FROM customer""",
    "settings_violations": f"""WITH {duck("projects")}
SELECT id, concat_ws(',', CASE WHEN id % 50 < 1 THEN 'minDuration' END, CASE WHEN id % 33 NOT BETWEEN 1 AND 30 THEN 'analysisFps' END,
  CASE WHEN id % 50 >= 40 THEN 'maxDuration' END, CASE WHEN id % 50 > 25 THEN 'targetDuration' END) AS paths FROM projects""",
    "manifest_documents": f"""WITH {duck("videos", "segments")}
SELECT project_id, video_id, count(*) AS segments, {duck_six("sum(floor(end_sec * fps + 5e-1) / fps - floor(start_sec * fps + 5e-1) / fps)")} AS seconds
FROM segments s JOIN videos v ON s.video_id = v.id WHERE accepted AND v.status = 'ready' GROUP BY 1, 2""",
    "prompts": f"""WITH {duck("delivery")},
p AS (SELECT *, concat_ws(', ', CASE WHEN clip_id % 6 <> 0 THEN 'Zürich ' || lang END, 'Region & Co', CASE WHEN clip_id % 7 <> 0 THEN 'Côte (West)' END) AS place FROM delivery)
SELECT clip_id, 'Clip context:' || chr(10) || concat_ws(chr(10),
  CASE WHEN clip_id % 4 <> 0 THEN concat_ws(chr(10), 'Location: ' || place || ' (source: GPS from the video file).', 'Local name: Кижи.', 'Coordinates: 61.70000, 35.20000.',
    'Nearby landmark candidates (closest first; "in view" = inside the camera field of view):', '- Kizhi / Кижи (church), 120 m away, bearing 90°, in view: yes')
  ELSE 'Location: UNKNOWN. Do not guess or name any place, city or country; use generic terms and set placeConfidence to "unknown".' END,
  CASE WHEN clip_id % 4 <> 0 THEN 'GPS altitude: 12 m above sea level.' END,
  'Camera movement: orbiting around the subject (' || CASE WHEN clip_id % 2 = 0 THEN 'Aerial, Drone, Arc' ELSE 'Aerial, Drone, Unknown' END || ').',
  'Shot type: ' || CASE clip_id % 3 WHEN 0 THEN 'real time' WHEN 1 THEN 'slow motion' ELSE 'hyperlapse' END || '.', 'Time of day: daytime.', 'Season: summer.',
  'Capture date: 2024-07-' || day || '.', 'Clip duration: ' || CAST(duration_sec AS BIGINT) || ' s.') || chr(10)
  || CASE WHEN clip_id % 2 = 0 THEN chr(10) || 'The user confirmed that the main subject is: Kizhi. Name it in the title and keywords and set placeConfidence to "high".' || chr(10) ELSE '' END
  || chr(10) || 'Write the metadata for this clip.' AS user_text FROM p""",
    "delivery_documents": f"""WITH {duck("delivery")} SELECT clip_id, filename, editorial, CAST(len(keywords) AS INT) AS keywords, CAST(4 AS INT) AS platforms FROM delivery""",
    "build_delivery": """SELECT DISTINCT source AS job_id, CASE WHEN source = 'src3' AND (SELECT count(*) FROM documents WHERE source = 'src3' AND doc_id % 2 = 1) > 0 THEN 'blocked' WHEN length(source) = 4 THEN 'reused' ELSE 'built' END AS outcome FROM documents""",
    "delivery_files": f"WITH {ALL_ROWS} "
    + " UNION ALL ".join(f"SELECT job_id, '{p}' AS platform, row FROM {t}" for p, t in (("adobe", "adobe"), ("shutterstock", "shutter"), ("pond5", "pond"), ("envato", "env"))),
    "parsed_events": f"""WITH {_EVENTS}
SELECT event_id, kind AS type, CASE WHEN kind <> 'rejected' THEN CAST(entity_id AS VARCHAR) END AS entity_id, CASE WHEN kind <> 'rejected' THEN status END AS status,
  CASE WHEN kind <> 'rejected' THEN {duck_six("p")} END AS progress FROM ev""",
    "latest_state": f"""WITH {_EVENTS},
k AS (SELECT *, CASE WHEN kind LIKE 'export.clip%' THEN 'clip' WHEN kind LIKE 'export%' THEN 'job' ELSE 'video' END AS entity,
  row_number() OVER (ORDER BY ts, event_id) AS o FROM ev WHERE kind <> 'rejected'),
s AS (SELECT entity, entity_id, max(o) FILTER (WHERE kind LIKE '%.updated') AS f, max(o) FILTER (WHERE kind LIKE '%.deleted') AS d, max(o) FILTER (WHERE kind LIKE '%.progress') AS g FROM k GROUP BY 1, 2)
SELECT s.entity, CAST(s.entity_id AS VARCHAR) AS entity_id, k.status, {duck_six("k.p")} AS progress FROM s JOIN k ON k.o = greatest(f, coalesce(g, 0)) WHERE f > coalesce(d, 0)""",
    "feed_state": f"""WITH {_FEED} SELECT entity, entity_id, status, {duck_six("progress")} AS progress, job_id, project_id FROM feed""",
    "live_jobs": f"""WITH {_FEED}, c AS (SELECT *, CAST(id AS BIGINT) % 7 = 0 AS ex, least(1e0, (CASE status WHEN 'queued' THEN 0 WHEN 'done' THEN 5 ELSE 4 END + CASE WHEN status = 'done' THEN 0 ELSE progress END) / 5) AS w FROM feed WHERE entity = 'clip')
SELECT job_id, count(*) AS total, count(*) FILTER (WHERE ex) AS excluded, count(*) FILTER (WHERE NOT ex AND status = 'done') AS n_done, count(*) FILTER (WHERE NOT ex AND status = 'cut') AS n_cut,
  {duck_six("coalesce(avg(w) FILTER (WHERE NOT ex), 0)")} AS progress, count(*) FILTER (WHERE NOT ex) > 0 AND count(*) FILTER (WHERE NOT ex AND status = 'done') = count(*) FILTER (WHERE NOT ex) AS can_build FROM c GROUP BY 1""",
    "event_rate": f"""WITH {duck("change_events")}
SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start_sec, project_id, type, count(*) AS n FROM change_events GROUP BY 1, 2, 3""",
    "event_rate_sliding": f"""WITH {duck("change_events")}
SELECT start_sec, count(*) AS n FROM (SELECT CAST(floor(epoch(ts) / 10800) * 10800 AS BIGINT) - k * 10800 AS start_sec FROM change_events, range(2) r(k)) GROUP BY 1""",
    "event_sessions": f"""WITH {duck("change_events")},
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM change_events WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS sid FROM g)
SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, project_id, count(*) AS n FROM s GROUP BY project_id, sid""",
    "live_job_progress": f"""WITH {duck("change_events")} SELECT project_id, count(*) AS events, {duck_six("max(progress)")} AS best FROM change_events WHERE type LIKE 'export.clip%' GROUP BY 1""",
}
