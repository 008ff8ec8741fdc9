"""Registered queries over media facts, time codes, telemetry and landmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EncodingSettings
from ..functions import geo as G
from ..functions import media as D
from ..functions import motion as M
from ..functions import suntime as S
from ..functions import timecode as TC
from ..operators import catalog as C
from ..operators import geo as OG
from . import bindings as B
from .bindings import duck, duck_six, six
from .catalog_queries import _short_segments

_MOTION_SQL = "['" + "', '".join(M.MOTION_TYPES) + "']"


def _motion_names():
    return F.array(*[F.lit(m) for m in M.MOTION_TYPES])


def shot_type(spark, sf):
    v = B.videos(spark, sf)
    kind = D.shot_type(F.col("fps"), F.col("duration_sec"), F.col("original_filename"), None, F.when(F.col("id") % 2 == 0, "static").otherwise("forward"), 30.0)
    return v.withColumn("kind", kind).select(
        "id", "kind", six(D.output_fps(F.col("fps"), F.col("kind"), 30.0)).alias("output_fps"),
        six(D.output_duration(F.col("duration_sec"), F.col("fps"), F.col("kind"), 30.0)).alias("output_sec"),
    )


def resolution_mix(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 170).alias("w"), (F.col("p_size") * 95).alias("h"))
    return p.groupBy(D.resolution_label(F.col("w"), F.col("h")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def normalization(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, 10).otherwise(8).alias("depth"), F.when(F.col("p_size") % 5 == 0, "hlg").otherwise("rec709").alias("transfer"))
    return p.select("p_partkey", D.needs_normalization(F.col("depth"), F.col("transfer")).alias("stretch"))


def accept_uploads(spark, sf):
    pages = B.table(spark, sf, "pages")
    name = F.concat("url", F.lit("x"), F.when(F.col("page_id") % 3 == 0, ".MP4").when(F.col("page_id") % 3 == 1, ".mov").otherwise(".avi"))
    return pages.select("page_id", F.inline(F.array(D.accept_upload(name))))


def encode_plan(spark, sf):
    rows = C.build_manifest_rows(B.videos(spark, sf), B.segments(spark, sf)).withColumn("conform_fps", F.when(F.col("fps") >= 100, 30.0))
    plan = rows.withColumns(D.encode_plan(EncodingSettings(), False))
    return plan.select("segment_id", "frame_count", six("seek_sec").alias("seek_sec"), "playback_fps", "max_rate_mbps", "buffer_mbps", "pixel_format")


def sprite_layout(spark, sf):
    v = B.videos(spark, sf).withColumn("s", D.sprite_layout(F.col("duration_sec") * 7, F.col("width"), F.col("height") + 1))
    v = v.withColumn("a", D.analysis_size(F.col("width"), F.col("height") + 1))
    return v.select("id", six("s.interval").alias("interval"), "s.count", "s.rows", "s.tile_height", F.col("a.height").alias("analysis_height"))


def timecodes(spark, sf):
    s = B.segments(spark, sf).withColumn("sec", F.col("start_sec") * 41 + 0.25)
    return s.select(
        "id", TC.format_timecode(F.col("sec")).alias("timecode"), TC.format_short_time(F.col("sec")).alias("short"),
        TC.format_duration(F.col("sec")).alias("duration"), six(TC.snap_to_frame(F.col("sec"), F.lit(29.97))).alias("snapped"),
        six(TC.parse_timecode(TC.format_timecode(F.col("sec")))).alias("parsed"),
    )


def byte_sizes(spark, sf):
    """Ties are rounded as by the printf of the SQL; the library's default rounds them up."""
    return B.videos(spark, sf).select("id", TC.format_bytes(F.col("size_bytes"), ties_to_even=True).alias("size"))


def movement_terms(spark, sf):
    named = F.element_at(_motion_names(), F.col("motion_code").cast("int") + 1)
    return B.segments(spark, sf).select("id", F.array_join(M.movement_terms(named, F.col("edited")), ",").alias("terms"))


def seasons(spark, sf):
    v = B.videos(spark, sf)
    return v.select("id", S.season(F.month("created_at"), F.when(F.col("id") % 2 == 0, 59.9).otherwise(-33.8)).alias("season"))


def wall_clocks(spark, sf):
    """Capture time read back from camera file names in a fixed zone."""
    v = B.videos(spark, sf)
    name = F.concat(F.lit("DJI_"), F.date_format("created_at", "yyyyMMdd_HHmmss"), F.lit("_0001.MP4"))
    got = S.resolve_capture_time(F.lit(None).cast("string"), "auto", F.lit("DJI"), F.lit("Asia/Tokyo"), name)
    return v.withColumn("c", got).select("id", F.unix_seconds("c.utc").alias("utc_sec"), F.col("c.local_date").cast("string").alias("local_date"), F.col("c.local_month").alias("local_month"))


def daylight(spark, sf):
    """Sun altitude at each telemetry point, hours after a fixed start."""
    t = B.telemetry(spark, sf).withColumn("at", F.timestamp_seconds(F.lit(1720915200) + F.col("i") * 3600))
    alt = S.sun_altitude_deg(F.col("at"), F.col("lat"), F.col("lon"))
    return t.select("video_id", "i", six(F.floor(alt * 1000 + 0.5) / 1000).alias("altitude"), S.time_of_day(F.col("at"), F.col("lat"), F.col("lon")).alias("light"))


def haversine_bearing(spark, sf):
    t = B.telemetry(spark, sf)
    here = (F.col("lat"), F.col("lon"), F.lit(59.94), F.lit(30.3158))
    t = t.withColumns({"d": G.haversine_m(*here), "b": G.bearing_deg(*here)})
    return t.select(
        "video_id", "i", six(F.floor(F.col("d") * 100 + 0.5) / 100).alias("distance"), six(F.floor(F.col("b") * 1000 + 0.5) / 1000).alias("bearing"),
        six(F.floor(G.angle_diff(F.col("b"), F.lit(300.0)) * 1000 + 0.5) / 1000).alias("off"),
        G.in_camera_sector(F.lit(300.0), F.col("b"), F.col("d"), F.lit(-20.0), F.lit(120.0)).alias("in_view"),
    )


def grid_key(spark, sf):
    return B.telemetry(spark, sf).select("video_id", "i", G.grid_key(F.col("lat"), F.col("lon"))["key"].alias("key"))


def _clips(spark, sf):
    named = F.element_at(_motion_names(), F.col("motion_code").cast("int") % 2 + 1)
    return _short_segments(spark, sf).select(F.col("id").alias("clip_id"), "video_id", "start_sec", "end_sec", named.alias("motion_type"))


_POINT = "struct<lat:double,lon:double,altitude_m:double>"


def _tracked(spark, sf):
    clips = _clips(spark, sf).withColumn("static", F.lit(None).cast(_POINT))
    return OG.nearest_telemetry(clips, B.telemetry(spark, sf))


def nearest_telemetry(spark, sf):
    out = _tracked(spark, sf)
    heading = G.heading_from_track(F.col("start_point"), F.col("end_point"), F.col("motion_type"))
    return out.select(
        "clip_id", six("start_point.t").alias("start_t"), six("mid_point.t").alias("mid_t"), six("end_point.t").alias("end_t"),
        six(heading).alias("heading"),
    )


def resolve_location(spark, sf):
    clips = _tracked(spark, sf).withColumn(
        "manual_location",
        F.when(F.col("video_id") % 5 == 0, " 59.9, 30.3 ").when(F.col("video_id") % 5 == 1, "Kizhi   Pogost").when(F.col("video_id") % 5 == 2, "nowhere").otherwise(" "),
    )
    searches = B.pois(spark, sf).groupBy(F.lit("kizhi pogost").alias("query")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return OG.resolve_location(clips, searches).select("clip_id", "source", six("lat").alias("lat"), six("lon").alias("lon"))


def gps_jumps(spark, sf):
    return OG.drop_gps_jumps(B.telemetry(spark, sf)).select("video_id", "i")


def track_sample(spark, sf):
    return OG.sample_track(B.telemetry(spark, sf)).select("video_id", "i")


def throttled_progress(spark, sf):
    events = B.change_events(spark, sf).where("type = 'video.progress'").select("entity_id", "ts", "event_id", "progress")
    return OG.progress_throttle(events, "entity_id", ["ts", "event_id"], 0.02).select("event_id", six("progress").alias("progress"))


def _positions(spark, sf):
    t = B.telemetry(spark, sf)
    return t.select(F.concat_ws("-", F.col("video_id").cast("string"), F.col("i").cast("string")).alias("clip_id"), "lat", "lon", F.when(F.col("video_id") % 2 == 0, 90.0).alias("heading"))


def _landmarks(spark, sf):
    p = B.pois(spark, sf)
    return p.select("id", "name", F.col("name").alias("name_en"), F.lit("landmark").alias("type"), "lat", "lon", "wikidata_id")


def poi_rank(spark, sf):
    ranked = OG.ranked_within_radius(_positions(spark, sf), _landmarks(spark, sf).withColumn("ord", F.col("id")), 2000.0)
    return ranked.select("clip_id", "rank", "id", "distance_m", six("bearing_deg").alias("bearing_deg"), "in_camera_sector")


def poi_entities(spark, sf):
    """Every landmark under two names and ids: the pairs become one entity again."""
    base = _landmarks(spark, sf)
    other = base.withColumns({"name": F.concat(F.lit("The "), "name"), "wikidata_id": F.lit(None).cast("string")})
    merged = OG.entities_within_radius(_positions(spark, sf), OG.union_pois([base, other]), 2000.0, ["source_rank", "id"])
    return merged.select("clip_id", "ord", "name", "name_en", "distance_m", "wikidata_id")


def poi_bulk(spark, sf):
    pois = OG.union_pois([_landmarks(spark, sf), _landmarks(spark, sf)])
    return OG.merge_poi_bulk(pois).select("id", "name", "wikidata_id")


def geo_misses(spark, sf):
    cached = B.telemetry(spark, sf).where("i % 2 = 0").select(G.grid_key(F.col("lat"), F.col("lon"))["key"].alias("key")).distinct()
    return OG.geo_misses(B.telemetry(spark, sf), cached).select("key")


def geo_lookup(spark, sf):
    cache = B.pois(spark, sf).groupBy(G.grid_key(F.col("lat"), F.col("lon"))["key"].alias("key")).agg(F.min("name").alias("city"))
    return OG.geo_lookup(B.telemetry(spark, sf), cache).select("video_id", "i", "city")


def timezones(spark, sf):
    """Zone of every position from a grid dimension derived from the landmarks."""
    grid = B.pois(spark, sf).select(F.floor("lat").cast("int").alias("lat_cell"), F.floor("lon").cast("int").alias("lon_cell"), F.lit("Europe/Moscow").alias("tz")).distinct()
    return OG.timezone_lookup(B.telemetry(spark, sf), grid).select("video_id", "i", "tz")


def pick_frames(spark, sf):
    out = OG.pick_frames(_clips(spark, sf), B.frame_features(spark, sf))
    return out.select("clip_id", "idx", six("time_sec").alias("time_sec"), six("sharpness").alias("sharpness"))


def tech_context(spark, sf):
    v = B.videos(spark, sf).select(
        F.col("id").alias("video_id"), "fps", "width", "height", "codec", "original_filename",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creation_time"),
    )
    clips = _clips(spark, sf).join(v, "video_id").withColumns(
        {
            "bit_depth": F.lit(10), "color_transfer": F.lit("rec709"), "has_audio": F.lit(False), "make": F.lit("DJI"),
            "model": F.lit("DJI Air 3"), "tags": F.create_map().cast("map<string,string>"), "lat": F.lit(59.9), "lon": F.lit(30.3),
            "altitude_m": F.lit(None).cast("double"), "tz": F.lit("Europe/Moscow"),
        }
    )
    out = OG.tech_context(clips, 30.0, "auto")
    return out.select(
        "clip_id", "shot_type", six("duration_sec").alias("duration_sec"), "output_fps", "resolution_label",
        F.array_join("movement", ",").alias("movement"), "season", "capture_date", F.unix_millis("captured_at").alias("captured_ms"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        shot_type, resolution_mix, normalization, accept_uploads, encode_plan, sprite_layout, timecodes, byte_sizes,
        movement_terms, seasons, wall_clocks, daylight, haversine_bearing, grid_key, nearest_telemetry,
        resolve_location, gps_jumps, track_sample, throttled_progress, poi_rank, poi_entities, poi_bulk, geo_misses,
        geo_lookup, timezones, pick_frames, tech_context,
    )
}

_HAV = "2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
_BEAR = "(degrees(atan2(sin(radians({b}lon - {a}lon)) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos(radians({b}lon - {a}lon)))) + 360) % 360"
_SHORT = """short AS (SELECT id AS clip_id, video_id, start_sec % 9 AS start_sec, start_sec % 9 + 2 + end_sec % 5 AS end_sec, motion_code % 2 AS m FROM segments)"""
_GRID = """g0 AS (SELECT *, floor(lat / (5e1 / 111320) + 5e-1) * (5e1 / 111320) AS glat FROM {src}),
g1 AS (SELECT *, (5e1 / 111320) / greatest(1e-2, cos(radians(glat))) AS step FROM g0),
grid AS (SELECT *, printf('%.5f,%.5f', floor(glat * 1e5 + 5e-1) / 1e5, floor(floor(lon / step + 5e-1) * step * 1e5 + 5e-1) / 1e5) AS key FROM g1)"""
_NEAREST = f"""{duck("segments", "telemetry")}, {_SHORT},
spot AS (SELECT clip_id, video_id, 'start' AS s, start_sec AS t0 FROM short UNION ALL SELECT clip_id, video_id, 'mid', (start_sec + end_sec) / 2 FROM short
  UNION ALL SELECT clip_id, video_id, 'end', end_sec FROM short),
hit AS (SELECT clip_id, s, t, lat, lon FROM spot JOIN telemetry USING (video_id)
  QUALIFY row_number() OVER (PARTITION BY clip_id, s ORDER BY abs(t - t0), t) = 1),
near AS (SELECT c.clip_id, c.video_id, c.m, a.t AS start_t, b.t AS mid_t, e.t AS end_t, a.lat AS alat, a.lon AS alon, e.lat AS elat, e.lon AS elon, b.lat AS mlat, b.lon AS mlon
  FROM short c LEFT JOIN hit a ON c.clip_id = a.clip_id AND a.s = 'start' LEFT JOIN hit b ON c.clip_id = b.clip_id AND b.s = 'mid'
  LEFT JOIN hit e ON c.clip_id = e.clip_id AND e.s = 'end')"""
_IN_RADIUS = f"""{duck("telemetry", "pois")},
pos AS (SELECT video_id || '-' || i AS clip_id, video_id, lat, lon FROM telemetry),
cand AS (SELECT clip_id, video_id, p.id, p.name, p.wikidata_id, floor({_HAV.format(a="t.", b="p.")} + 5e-1) AS d,
  floor(({_BEAR.format(a="t.", b="p.")}) * 10 + 5e-1) / 10 AS b
  FROM pos t JOIN pois p ON abs(t.lat - p.lat) < 3e-2),
hits AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN CASE WHEN abs(b - 90) > 180 THEN 360 - abs(b - 90) ELSE abs(b - 90) END <= 42 END AS v FROM cand WHERE d <= 2000)"""

ORACLES = {
    "shot_type": f"""WITH {duck("videos")},
k AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'hyperlapse' WHEN id % 11 = 0 THEN CASE WHEN id % 2 = 0 THEN 'timelapse' ELSE 'hyperlapse' END
  WHEN fps >= 100 THEN 'slow_motion' ELSE 'real_time' END AS kind FROM videos)
SELECT id, kind, {duck_six("CASE WHEN kind = 'slow_motion' THEN 30e0 ELSE fps END")} AS output_fps,
  {duck_six("CASE WHEN kind = 'slow_motion' THEN duration_sec * fps / 30 ELSE duration_sec END")} AS output_sec FROM k""",
    "resolution_mix": """SELECT CASE WHEN w >= 7680 THEN '8K' WHEN w >= 5120 THEN '5K' WHEN w >= 3840 THEN '4K' WHEN w >= 2688 THEN '2.7K' WHEN w >= 1280 THEN 'HD' ELSE 'SD' END AS label,
  count(*) AS n FROM (SELECT greatest(p_size * 170, p_size * 95) AS w FROM part) GROUP BY 1""",
    "normalization": "SELECT p_partkey, p_size % 3 = 0 OR p_size % 5 = 0 AS stretch FROM part",
    "accept_uploads": "SELECT page_id, page_id % 3 < 2 AS accepted, CASE WHEN page_id % 3 = 2 THEN 'Only these formats are supported: .mp4, .mov' END AS reason FROM pages",
    "encode_plan": f"""WITH {duck("videos", "segments")},
m AS (SELECT s.id AS segment_id, CAST(floor(start_sec * fps + 5e-1) AS BIGINT) AS a, CAST(floor(end_sec * fps + 5e-1) AS BIGINT) AS b, fps, width, height
  FROM segments s JOIN videos v ON s.video_id = v.id WHERE accepted AND v.status = 'ready')
SELECT segment_id, greatest(1, b - a) AS frame_count, {duck_six("a / fps")} AS seek_sec, CASE WHEN fps >= 100 THEN 30e0 ELSE fps END AS playback_fps,
  CAST(CASE width WHEN 3840 THEN 100 ELSE 25 END AS BIGINT) AS max_rate_mbps, CAST(CASE width WHEN 3840 THEN 200 ELSE 50 END AS BIGINT) AS buffer_mbps, 'yuv420p' AS pixel_format FROM m""",
    "sprite_layout": f"""WITH {duck("videos")}, s AS (SELECT *, greatest(2e0, duration_sec * 7 / 600) AS iv FROM videos)
SELECT id, {duck_six("iv")} AS interval, CAST(greatest(1, ceil(duration_sec * 7 / iv)) AS BIGINT) AS count,
  CAST(ceil(greatest(1, ceil(duration_sec * 7 / iv)) / 10) AS BIGINT) AS rows,
  CAST(greatest(2, floor(160e0 * (height + 1) / width / 2 + 5e-1) * 2) AS BIGINT) AS tile_height,
  CAST(greatest(2, floor(320e0 * (height + 1) / width / 2 + 5e-1) * 2) AS BIGINT) AS analysis_height FROM s""",
    "timecodes": f"""WITH {duck("segments")}, s AS (SELECT id, start_sec * 41 + 25e-2 AS sec FROM segments),
p AS (SELECT *, CAST(floor(sec) AS BIGINT) AS f, CAST(floor(sec + 5e-1) AS BIGINT) AS r, CAST(floor((sec * 100) % 100) AS BIGINT) AS cs FROM s)
SELECT id, CASE WHEN f >= 3600 THEN (f // 3600) || ':' ELSE '' END || printf('%02d:%02d.%02d', f % 3600 // 60, f % 60, cs) AS timecode,
  printf('%02d:%02d', r // 60, r % 60) AS short,
  CASE WHEN r >= 3600 THEN printf('%d:%02d:%02d', r // 3600, r % 3600 // 60, r % 60) ELSE printf('%d:%02d', r // 60, r % 60) END AS duration,
  {duck_six("floor(sec * 2997e-2 + 5e-1) / 2997e-2")} AS snapped, {duck_six("f + cs / 1e2")} AS parsed FROM p""",
    "byte_sizes": f"""WITH {duck("videos")}
SELECT id, CASE WHEN size_bytes < 1024 THEN printf('%.0f B', size_bytes * 1e0)
  WHEN size_bytes < 1048576 THEN CASE WHEN size_bytes >= 102400 THEN printf('%.0f KB', size_bytes / 1024e0) ELSE printf('%.1f KB', size_bytes / 1024e0) END
  ELSE CASE WHEN size_bytes >= 104857600 THEN printf('%.0f MB', size_bytes / 1048576e0) ELSE printf('%.1f MB', size_bytes / 1048576e0) END END AS size FROM videos""",
    "movement_terms": f"""WITH {duck("segments")}
SELECT id, concat_ws(',', 'Aerial', 'Drone', CASE motion_code WHEN 2 THEN 'Tracking Left' WHEN 3 THEN 'Tracking Right' WHEN 4 THEN 'Tilt Up' WHEN 5 THEN 'Tilt Down'
  WHEN 6 THEN 'Arc' WHEN 7 THEN 'Arc' END, CASE WHEN edited THEN 'Top Down' END) AS terms FROM segments""",
    "seasons": f"""WITH {duck("videos")}
SELECT id, CASE WHEN month(created_at) IN (12, 1, 2) THEN CASE WHEN id % 2 = 0 THEN 'winter' ELSE 'summer' END
  WHEN month(created_at) <= 5 THEN CASE WHEN id % 2 = 0 THEN 'spring' ELSE 'autumn' END
  WHEN month(created_at) <= 8 THEN CASE WHEN id % 2 = 0 THEN 'summer' ELSE 'winter' END
  ELSE CASE WHEN id % 2 = 0 THEN 'autumn' ELSE 'spring' END END AS season FROM videos""",
    "wall_clocks": f"""WITH {duck("videos")}
SELECT id, CASE WHEN year(created_at) >= 2000 THEN CAST(epoch(date_trunc('second', created_at)) AS BIGINT) - 32400 END AS utc_sec,
  CASE WHEN year(created_at) >= 2000 THEN CAST(CAST(created_at AS DATE) AS VARCHAR) END AS local_date,
  CASE WHEN year(created_at) >= 2000 THEN CAST(month(created_at) AS INT) END AS local_month FROM videos""",
    "daylight": f"""WITH {duck("telemetry")},
a AS (SELECT *, (1720915200 + i * 3600) / 864e2 - 109575e-1 AS d FROM telemetry),
b AS (SELECT *, radians(3575291e-4 + 98560028e-8 * d) AS m FROM a),
c AS (SELECT *, m + radians(19148e-4 * sin(m) + 2e-2 * sin(2 * m) + 3e-4 * sin(3 * m)) + radians(1029372e-4) + pi() AS l FROM b),
e AS (SELECT *, asin(sin(l) * sin(radians(234397e-4))) AS dec, atan2(sin(l) * cos(radians(234397e-4)), cos(l)) AS ra FROM c),
h AS (SELECT *, asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians(28016e-2 + 3609856235e-7 * d + lon) - ra)) AS h FROM e),
z AS (SELECT *, degrees(h + 2967e-7 / tan(greatest(0e0, h) + 312536e-8 / (greatest(0e0, h) + 8901179e-8))) AS alt,
  floor(d - 9e-4 + lon / 360 + 5e-1) - lon / 360 + 9e-4 AS ap FROM h),
n AS (SELECT *, radians(3575291e-4 + 98560028e-8 * ap) AS am FROM z),
q AS (SELECT *, am + radians(19148e-4 * sin(am) + 2e-2 * sin(2 * am) + 3e-4 * sin(3 * am)) + radians(1029372e-4) + pi() AS al FROM n)
SELECT video_id, i, {duck_six("floor(alt * 1000 + 5e-1) / 1000")} AS altitude,
  CASE WHEN alt < -6 THEN 'night' WHEN alt < -833e-3 THEN 'blue_hour' WHEN alt < 2 THEN CASE WHEN d < ap + 53e-4 * sin(am) - 69e-4 * sin(2 * al) THEN 'sunrise' ELSE 'sunset' END
  WHEN alt < 6 THEN 'golden_hour' ELSE 'day' END AS light FROM q""",
    "haversine_bearing": f"""WITH {duck("telemetry")}, o AS (SELECT *, 5994e-2 AS plat, 303158e-4 AS plon FROM telemetry),
d AS (SELECT *, {_HAV.format(a="", b="p")} AS d, {_BEAR.format(a="", b="p")} AS b FROM o),
f AS (SELECT *, CASE WHEN abs(b - 300) > 180 THEN 360 - abs(b - 300) ELSE abs(b - 300) END AS off FROM d)
SELECT video_id, i, {duck_six("floor(d * 100 + 5e-1) / 100")} AS distance, {duck_six("floor(b * 1000 + 5e-1) / 1000")} AS bearing,
  {duck_six("floor(off * 1000 + 5e-1) / 1000")} AS off, off <= 42 AND d >= 120 / tan(radians(452e-1)) * 8e-1 AS in_view FROM f""",
    "grid_key": f"""WITH {duck("telemetry")}, {_GRID.format(src="telemetry")} SELECT video_id, i, key FROM grid""",
    "nearest_telemetry": f"""WITH {_NEAREST}, h AS (SELECT *, {_HAV.format(a="a", b="e")} AS d, {_BEAR.format(a="a", b="e")} AS c FROM near)
SELECT clip_id, {duck_six("start_t")} AS start_t, {duck_six("mid_t")} AS mid_t, {duck_six("end_t")} AS end_t,
  CASE WHEN d >= 15 THEN {duck_six("floor(CASE m WHEN 0 THEN c ELSE (c + 180) % 360 END * 10 + 5e-1) / 10")} END AS heading FROM h""",
    "resolve_location": f"""WITH {_NEAREST}, {duck("pois")}, k AS (SELECT min(lat) AS lat, min(lon) AS lon FROM pois)
SELECT clip_id, CASE WHEN video_id % 5 < 3 THEN 'manual' WHEN mlat IS NOT NULL THEN 'embedded' ELSE 'none' END AS source,
  {duck_six("CASE video_id % 5 WHEN 0 THEN 599e-1 WHEN 1 THEN k.lat WHEN 2 THEN NULL ELSE mlat END")} AS lat,
  {duck_six("CASE video_id % 5 WHEN 0 THEN 303e-1 WHEN 1 THEN k.lon WHEN 2 THEN NULL ELSE mlon END")} AS lon FROM near, k""",
    "gps_jumps": f"""WITH {duck("telemetry")},
n AS (SELECT *, coalesce(lag(lat) OVER w, lead(lat) OVER w) AS plat, coalesce(lag(lon) OVER w, lead(lon) OVER w) AS plon, count(*) OVER (PARTITION BY video_id) AS n
  FROM telemetry WINDOW w AS (PARTITION BY video_id ORDER BY t)),
o AS (SELECT *, plat IS NULL OR sqrt(pow((lat - plat) * 111000, 2) + pow((lon - plon) * 111000 * cos(radians(lat)), 2)) < 2000 AS ok FROM n),
k AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY video_id) AS kept FROM o)
SELECT video_id, i FROM k WHERE n < 3 OR (ok AND kept * 2 >= n)""",
    "track_sample": f"""WITH RECURSIVE {duck("telemetry")},
r AS (SELECT video_id, i, t FROM telemetry WHERE i = 0
  UNION ALL SELECT n.video_id, n.i, n.t FROM r JOIN LATERAL (SELECT q.video_id, q.i, q.t FROM telemetry q WHERE q.video_id = r.video_id AND q.t - r.t >= 5e-1 ORDER BY q.t LIMIT 1) n ON true)
SELECT video_id, i FROM r""",
    "throttled_progress": f"""WITH RECURSIVE {duck("change_events")},
p AS (SELECT entity_id, event_id, progress, row_number() OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS rn FROM change_events WHERE type = 'video.progress'),
r AS (SELECT entity_id, event_id, progress, rn, CASE WHEN abs(progress + 1) >= 2e-2 OR progress = 1 THEN progress ELSE -1e0 END AS last, true AS pass FROM p WHERE rn = 1
  UNION ALL SELECT p.entity_id, p.event_id, p.progress, p.rn, CASE WHEN abs(p.progress - r.last) >= 2e-2 OR p.progress = 1 THEN p.progress ELSE r.last END,
    abs(p.progress - r.last) >= 2e-2 OR p.progress = 1 FROM r JOIN p ON p.entity_id = r.entity_id AND p.rn = r.rn + 1)
SELECT event_id, {duck_six("progress")} AS progress FROM r WHERE pass""",
    "poi_rank": f"""WITH {_IN_RADIUS},
k AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN v THEN 0 ELSE 1 END, d, id) AS rank FROM hits)
SELECT clip_id, CAST(rank AS INT) AS rank, id, CAST(d AS BIGINT) AS distance_m, {duck_six("b")} AS bearing_deg, v AS in_camera_sector FROM k WHERE rank <= 12""",
    "poi_entities": f"""WITH {_IN_RADIUS}
SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY id) - 1 AS ord, name, name AS name_en, CAST(d AS BIGINT) AS distance_m, wikidata_id FROM hits""",
    "poi_bulk": f"WITH {duck('pois')} SELECT id, name, wikidata_id FROM pois",
    "geo_misses": f"""WITH {duck("telemetry")}, {_GRID.format(src="telemetry")}
SELECT DISTINCT key FROM grid WHERE key NOT IN (SELECT key FROM grid WHERE i % 2 = 0)""",
    "geo_lookup": f"""WITH {duck("telemetry", "pois")}, {_GRID.format(src="telemetry")}, {_GRID.format(src="pois").replace("g0 ", "p0 ").replace("g1 ", "p1 ").replace("FROM g0", "FROM p0").replace("FROM g1", "FROM p1").replace("grid AS", "pgrid AS")},
c AS (SELECT key, min(name) AS city FROM pgrid GROUP BY 1)
SELECT video_id, i, city FROM grid LEFT JOIN c ON grid.key = c.key""",
    "timezones": f"""WITH {duck("telemetry", "pois")}, c AS (SELECT DISTINCT floor(lat) AS a, floor(lon) AS b FROM pois)
SELECT video_id, i, CASE WHEN a IS NOT NULL THEN 'Europe/Moscow' END AS tz FROM telemetry LEFT JOIN c ON floor(lat) = a AND floor(lon) = b""",
    "pick_frames": f"""WITH {duck("segments", "frame_features")}, {_SHORT},
x AS (SELECT clip_id, video_id, start_sec, end_sec, start_sec + 5e-1 * (end_sec - start_sec) AS target, least(1e-1, (end_sec - start_sec) / 10) AS mg FROM short),
b AS (SELECT clip_id, t, sharpness FROM x JOIN frame_features f ON f.video_id = x.video_id AND t >= greatest(start_sec + mg, target - 1) AND t <= least(end_sec - mg, target + 1)
  QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY sharpness DESC, t) = 1)
SELECT x.clip_id, CAST(0 AS INT) AS idx, {duck_six("floor(coalesce(t, target) * 1000 + 5e-1) / 1000")} AS time_sec, {duck_six("sharpness")} AS sharpness
FROM x LEFT JOIN b ON x.clip_id = b.clip_id""",
    "tech_context": f"""WITH {duck("segments", "videos")}, {_SHORT},
j AS (SELECT s.*, v.fps, v.width, v.created_at, CASE WHEN v.id % 9 = 0 OR v.id % 11 = 0 THEN 'hyperlapse' WHEN fps >= 100 THEN 'slow_motion' ELSE 'real_time' END AS kind
  FROM short s JOIN videos v ON s.video_id = v.id)
SELECT clip_id, kind AS shot_type, {duck_six("CASE WHEN kind = 'slow_motion' THEN (end_sec - start_sec) * fps / 30 ELSE end_sec - start_sec END")} AS duration_sec,
  CASE WHEN kind = 'slow_motion' THEN 30e0 ELSE fps END AS output_fps, CASE width WHEN 3840 THEN '4K' ELSE 'HD' END AS resolution_label, 'Aerial,Drone' AS movement,
  CASE WHEN year(created_at) < 2000 THEN NULL WHEN month(created_at) IN (12, 1, 2) THEN 'winter' WHEN month(created_at) <= 5 THEN 'spring' WHEN month(created_at) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
  CASE WHEN year(created_at) >= 2000 THEN CAST(CAST(created_at AS DATE) AS VARCHAR) END AS capture_date,
  CASE WHEN year(created_at) >= 2000 THEN CAST(epoch(timezone('Europe/Moscow', date_trunc('second', created_at))) * 1000 + floor(start_sec * 1000 + 5e-1) AS BIGINT) END AS captured_ms FROM j""",
}
