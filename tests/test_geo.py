import math
import random

from pyspark.sql import functions as F

from reelgrid.functions import geo as G
from reelgrid.functions import media as D
from reelgrid.functions import suntime as S
from reelgrid.operators import geo as OG


def at(text):
    return F.lit(text).cast("timestamp")


def test_light(one):
    light = lambda t, lat, lon: one(S.time_of_day(at(t), F.lit(lat), F.lit(lon)))
    assert light("2024-07-14T09:00:00Z", 59.9386, 30.3141) == "day"
    assert light("2024-01-14T22:00:00Z", 59.9386, 30.3141) == "night"
    sydney = (-33.86, 151.21)
    assert light("2024-01-15T09:05:00Z", *sydney) == "sunset"
    assert light("2024-01-14T19:00:00Z", *sydney) == "sunrise"
    assert light("2024-01-15T08:45:00Z", *sydney) == "golden_hour"
    assert light("2024-01-15T09:30:00Z", *sydney) == "blue_hour"


def test_season(one):
    cases = [(7, 59.9, "summer"), (7, -33.86, "winter"), (1, 10.0, "winter"), (10, -40.0, "spring"), (4, 50.0, "spring")]
    for month, lat, name in cases:
        assert one(S.season(F.lit(month), F.lit(lat))) == name


def capture(one, creation, make=None, tz=None, name="clip.mp4", mode="auto"):
    text = lambda v: F.lit(v).cast("string")
    c = S.resolve_capture_time(text(creation), mode, text(make), text(tz), text(name))
    r = one(F.struct(F.date_format(c["utc"], "yyyy-MM-dd HH:mm:ss").alias("utc"), c["local_date"].cast("string").alias("day"), c["local_month"].alias("month")))
    return r["utc"], r["day"], r["month"]


def test_capture_time(one):
    moscow = "Europe/Moscow"
    assert capture(one, "2024-07-14T21:30:00.000000Z", "DJI", moscow) == ("2024-07-14 18:30:00", "2024-07-14", 7)
    assert capture(one, "2024-07-14T22:30:00Z", "Apple", moscow) == ("2024-07-14 22:30:00", "2024-07-15", 7)
    named = capture(one, None, None, "Europe/Berlin", "dji_fly_20260811_133558_0001.mp4")
    assert named == ("2026-08-11 11:35:58", "2026-08-11", 8)
    assert capture(one, "1970-01-01T00:00:00Z", "DJI", moscow) == (None, None, None)
    assert capture(one, "2024-07-14T21:30:00Z", "DJI", None) == (None, "2024-07-14", 7)
    # Impossible days roll over.
    assert one(S.filename_wall_clock(F.lit("DJI_20240231_101010.MP4")).cast("string")) == "2024-03-02 10:10:10"


def test_labels_and_shots(one):
    for w, h, label in [(4096, 2160, "4K"), (2720, 1530, "2.7K"), (1080, 1920, "HD"), (5472, 3078, "5K"), (640, 360, "SD")]:
        assert one(D.resolution_label(F.lit(w), F.lit(h))) == label

    def shot(name, fps=30.0, motion="forward", conform=None, elapsed=None, tag=None):
        tags = F.create_map(F.lit("mode"), F.lit(tag)) if tag else None
        real = F.lit(elapsed) if elapsed else None
        return one(D.shot_type(F.lit(fps), F.lit(20.0), F.lit(name), tags, F.lit(motion), conform, real))

    assert shot("HYPERLAPSE_0003.MP4") == "hyperlapse"
    assert shot("DJI_TL_0004.MP4", motion="static") == "timelapse" and shot("DJI_TL_0004.MP4") == "hyperlapse"
    assert shot("a.mp4", elapsed=29.0, motion="static") == "real_time"
    assert shot("a.mp4", elapsed=31.0, motion="static") == "timelapse"
    assert shot("a.mp4", 119.88, conform=30.0) == "slow_motion" and shot("a.mp4", 119.88) == "high_frame_rate"
    assert shot("a.mp4", tag="Time-lapse") == "hyperlapse"


def test_parsers(one):
    iso = one(D.parse_iso6709(F.lit("+59.9386+030.3141+012.000/")))
    assert (iso["lat"], iso["lon"], iso["altitude_m"]) == (59.9386, 30.3141, 12.0)
    assert one(D.parse_iso6709(F.lit("+00.0000+000.0000/"))) is None and one(D.parse_iso6709(F.lit("+99+10/"))) is None
    assert tuple(one(D.parse_coordinates(F.lit(" 59.9 ; 30.3 ")))) == (59.9, 30.3)
    assert one(D.parse_coordinates(F.lit("Kizhi"))) is None
    assert one(D.bit_depth(F.lit("yuv420p10le"), F.lit(None).cast("string"))) == 10
    assert one(D.frame_rate(F.lit("30000/1001"))) == 30000 / 1001 and one(D.frame_rate(F.lit("0/0"))) is None


def test_camera_sector(one):
    inside = lambda d, b, p, h: one(G.in_camera_sector(F.lit(0.0), F.lit(b), F.lit(d), F.lit(p), F.lit(h)))
    assert inside(500.0, 40.0, 0.0, 100.0) and not inside(500.0, 43.0, 0.0, 100.0)
    assert inside(149.0, 180.0, -85.0, 50.0) and not inside(160.0, 0.0, -90.0, 100.0)
    assert not inside(10.0, 0.0, -20.0, 100.0)
    assert one(G.in_camera_sector(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))) is None


def landmarks(spark, rows):
    return spark.createDataFrame(rows, "ord_in int, name string, name_en string, type string, lat double, lon double, wikidata_id string")


def test_merge_and_rank(spark):
    pois = landmarks(
        spark,
        [
            (0, "Near ahead", "Near ahead", "church", 59.945, 30.3158, None),
            (1, "Дальний", "Far behind", "bridge", 59.93, 30.3158, None),
            (2, "Far behind", "Far behind", "bridge", 59.9301, 30.3158, "Q1"),
            (3, "Too far", "Too far", "tower", 60.2, 30.3158, None),
        ],
    )
    for yaw, order in ((0.0, ["Near ahead", "Far behind"]), (180.0, ["Far behind", "Near ahead"])):
        point = spark.createDataFrame([("c", 59.94, 30.3158, yaw)], "clip_id string, lat double, lon double, heading double")
        near = OG.poi_within_radius(point, pois, 2000.0)
        ranked = OG.rank_pois(OG.merge_poi_entities(near, ["ord_in"])).orderBy("rank").collect()
        assert [r.name_en for r in ranked] == order
        far = next(r for r in ranked if r.name_en == "Far behind")
        assert far.wikidata_id == "Q1" and far.name == "Дальний" and far.distance_m < 1112


def test_radius_join_finds_every_pair(spark):
    rnd = random.Random(5)
    spots = [(f"c{k}", rnd.uniform(-89.5, 89.5), rnd.uniform(-180, 180), None) for k in range(60)]
    spots += [("edge", 10.0, 179.999, None), ("pole", 89.97, 20.0, None)]
    pois = []
    for k in range(400):
        c, lat, lon, _ = rnd.choice(spots)
        la = max(-89.99, min(89.99, lat + rnd.uniform(-0.04, 0.04)))
        lo = lon + rnd.uniform(-0.04, 0.04) / max(0.001, math.cos(math.radians(lat)))
        pois.append((k, f"p{k}", f"p{k}", "x", la, (lo + 180) % 360 - 180, None))

    def distance(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    expected = {(c, n) for c, la, lo, _ in spots for _, n, _, _, lb, lp, _ in pois if math.floor(distance(la, lo, lb, lp) + 0.5) <= 3000}
    df = spark.createDataFrame(spots, "clip_id string, lat double, lon double, heading double")
    got = OG.poi_within_radius(df, landmarks(spark, pois), 3000.0).select("clip_id", "name").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == expected and len(expected) > 100


def test_nearest_point_over_gaps(spark):
    rnd = random.Random(3)
    track = sorted({round(rnd.uniform(0, 40) + (500 if rnd.random() < 0.3 else 0), 1) for _ in range(80)})
    points = spark.createDataFrame([("v", t, t, -t, None) for t in track], "video_id string, t double, lat double, lon double, altitude_m double")
    clips = [(f"c{k}", "v", a, a + rnd.uniform(0, 90), None) for k in range(40) for a in [round(rnd.uniform(0, 600), 1)]]
    clips += [("none", "w", 0.0, 1.0, (1.0, 2.0, 3.0)), ("empty", "u", 0.0, 1.0, None)]
    df = spark.createDataFrame(clips, "clip_id string, video_id string, start_sec double, end_sec double, static struct<lat:double,lon:double,altitude_m:double>")
    got = {r.clip_id: r for r in OG.nearest_telemetry(df, points, span=7.0).collect()}
    nearest = lambda x: min(track, key=lambda t: (abs(t - x), t))
    for cid, v, a, b, _ in clips[:-2]:
        assert (got[cid].start_point.t, got[cid].mid_point.t, got[cid].end_point.t) == (nearest(a), nearest((a + b) / 2), nearest(b))
    assert got["none"].mid_point.lat == 1.0 and got["none"].start_point is None and got["empty"].mid_point is None


def test_geo_context_composes_position_place_and_landmarks(spark):
    point = "struct<t:double,lat:double,lon:double,altitude_m:double>"
    here = (0.0, 59.9, 30.3, 120.0)
    rows = [
        ("gps", None, here, (0.0, 59.89, 30.3, 1.0), (9.0, 59.91, 30.3, 1.0), "forward"),
        ("typed", "40.0, -3.7", here, None, None, "pan_left"),
        ("named", "  Kizhi  POGOST ", here, None, None, "pan_left"),
        ("lost", "nowhere", here, None, None, "pan_left"),
        ("none", None, None, None, None, "pan_left"),
    ]
    clips = spark.createDataFrame(rows, f"clip_id string, manual_location string, mid_point {point}, start_point {point}, end_point {point}, motion_type string")
    searches = spark.createDataFrame([("kizhi pogost", 62.07, 35.22)], "query string, lat double, lon double")
    key = lambda lat, lon: spark.range(1).select(G.grid_key(F.lit(lat), F.lit(lon))["key"]).first()[0]
    place = "key string, city string, region string, country string, country_code string, display_name string, local_name string"
    cache = spark.createDataFrame([(key(59.9, 30.3), "Town", "R", "Land", "LA", "Town, Land", "Stadt")], place)
    marks = [(k, f"Mark {k:02d}", f"Mark {k:02d}", "castle", 59.9 + k * 5e-4, 30.3, None) for k in range(15)]
    marks += [(20, "Mark 03", "Third", "castle", 59.9, 30.3001, "Q3"), (21, "Far", None, "castle", 10.0, 10.0, None)]
    pois = OG.union_pois([spark.createDataFrame(marks, "id int, name string, name_en string, type string, lat double, lon double, wikidata_id string")])
    found = {r.clip_id: r.geo for r in OG.geo_context(clips, searches, cache, pois).collect()}
    gps = found["gps"]
    assert (gps.source, gps.lat, gps.city, gps.country_code, gps.altitude_m) == ("embedded", 59.9, "Town", "LA", 120.0)
    assert gps.camera_heading_deg is not None and len(gps.poi_candidates) == 12
    third = next(p for p in gps.poi_candidates if p.name == "Mark 03")
    assert (third.name_en, third.wikidata_id) == ("Third", "Q3") and third.distance_m < 20
    assert {k: (g.source, g.lat, g.city, g.poi_candidates) for k, g in found.items() if k != "gps"} == {
        "typed": ("manual", 40.0, None, []), "named": ("manual", 62.07, None, []),
        "lost": ("manual", None, None, []), "none": ("none", None, None, []),
    }


def test_landmarks_at_one_position(spark):
    """Copies at a position are ranked and merged as if each was matched with every clip."""
    points = spark.createDataFrame(
        [(f"c{k}", 59.9 + k * 0.004, 30.3, 90.0 if k % 2 else None) for k in range(9)],
        "clip_id string, lat double, lon double, heading double",
    )
    pois = spark.createDataFrame(
        [
            (k, f"N{k % 7}" if k % 3 else f"M{k}", f"E{k % 5}", "t", 59.9 + k % 4 * 0.01, 30.3 + k % 2 * 0.01, f"Q{k % 6}" if k % 4 == 1 else None)
            for k in range(60)
        ],
        "id long, name string, name_en string, type string, lat double, lon double, wikidata_id string",
    ).withColumn("source_rank", F.lit(0))
    near = OG.poi_within_radius(points, OG.with_name_keys(pois), 2000.0)
    columns = ["clip_id", "ord", *OG._POI_FIELDS]
    rows = lambda df, *names: sorted(map(tuple, df.select(*names).collect()), key=str)
    merged = OG.entities_within_radius(points, pois, 2000.0, ["source_rank", "id"])
    assert rows(merged, *columns) == rows(OG.merge_poi_entities(near, ["source_rank", "id"]), *columns)
    ranked = OG.ranked_within_radius(points, pois.withColumn("ord", F.col("id")), 2000.0, 5)
    plain = OG.rank_pois(near.withColumn("ord", F.col("id")), 5)
    columns = ["clip_id", "rank", "id", "distance_m", "bearing_deg", "in_camera_sector"]
    assert rows(ranked, *columns) == rows(plain, *columns)


def test_manual_text_is_parsed_once(spark):
    point = "CAST(NULL AS STRUCT<t: DOUBLE, lat: DOUBLE, lon: DOUBLE, altitude_m: DOUBLE>)"
    clips = spark.createDataFrame([("a", " 59.9, 30.3 "), ("b", "nowhere"), ("c", " ")], "clip_id string, manual_location string")
    clips = clips.selectExpr("*", f"{point} AS start_point", f"{point} AS mid_point", f"{point} AS end_point", "'static' AS motion_type")
    searches = spark.createDataFrame([], "query string, lat double, lon double")
    out = OG.resolve_location(clips, searches).select("clip_id", "source", "lat", "lon")
    assert sorted(map(tuple, out.collect())) == [("a", "manual", 59.9, 30.3), ("b", "manual", None, None), ("c", "none", None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(r"^\s+|\s+$") == 1
