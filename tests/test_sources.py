import hashlib
import io
import json
import os
import struct

import pytest

from reelgrid import schemas
from reelgrid.operators import geo as OG
from reelgrid.sources import delivery as SD
from reelgrid.sources import files as SF
from reelgrid.sources import media as SM
from reelgrid.sources import tables as ST
from reelgrid.sources import units


def test_probe(spark):
    video = {
        "codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 2160, "pix_fmt": "yuv420p10le",
        "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "color_transfer": "bt709",
        "tags": {"Creation_Time": "old", "Encoder": "DJI.AVC"}, "side_data_list": [{"rotation": -90}],
    }
    docs = {
        "ok": {"streams": [{"codec_type": "audio"}, video, {"codec_type": "data", "codec_tag_string": "djmd", "index": 2}], "format": {"duration": "12.5", "tags": {"creation_time": "2024-07-14T21:30:00Z", "location": "+59.9+030.3/"}}},
        "log": {"streams": [{**video, "tags": {"comment": "D-Log M"}, "side_data_list": []}], "format": {"duration": "1"}},
        "mute": {"streams": [{"codec_type": "audio"}], "format": {}},
        "still": {"streams": [{**video, "r_frame_rate": "0/0"}], "format": {"duration": "1"}},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("junk", "{")]
    facts, rejects = SM.normalize_probe(spark.createDataFrame(rows, "id string, probe string"))
    got = {r.id: r for r in facts.collect()}
    ok = got["ok"]
    assert (ok.width, ok.height, ok.bit_depth, ok.color_transfer, ok.has_audio) == (2160, 3840, 10, "rec709", True)
    assert ok.creation_time == "2024-07-14T21:30:00Z" and ok.location.lat == 59.9 and ok.telemetry_stream == 2
    assert ok.make == "DJI" and ok.model is None and abs(ok.fps - 29.97) < 0.01
    assert got["log"].color_transfer == "log" and got["log"].width == 3840 and got["log"].make is None
    assert {r.id: r.reason for r in rejects.collect()} == {
        "mute": "no video stream found", "still": "could not determine the frame rate", "junk": "invalid document",
    }


def _message(lat, lon, alt_mm, name=b"dvtm_Mini4_Pro.proto"):
    varint = lambda n: bytes([n & 0x7F | 0x80]) + varint(n >> 7) if n > 0x7F else bytes([n])
    block = lambda field, body: varint(field << 3 | 2) + varint(len(body)) + body
    number = lambda field, x: varint(field << 3 | 1) + struct.pack("<d", x)
    spot = block(1, number(2, lat) + number(3, lon)) + varint(2 << 3) + varint(alt_mm & (1 << 64) - 1)
    return block(1, block(1, block(1, name))) + block(3, block(3, block(4, spot)))


def test_telemetry_packets(spark):
    rad = 3.141592653589793 / 180
    rows = [
        ("v", 0.0, bytearray(_message(59.9 * rad, 30.3 * rad, 12_340))),
        ("v", 0.2, bytearray(_message(59.9 * rad, 30.3 * rad, -500))),
        ("v", 0.6, bytearray(_message(0.0, 0.0, 0))),
        ("v", 0.7, bytearray(_message(59.91 * rad, 30.3 * rad, -500))),
        ("v", 0.9, bytearray(b"\xff\xff")),
    ]
    points = SM.decode_telemetry(spark.createDataFrame(rows, "video_id string, t double, payload binary"))
    got = sorted(points.collect(), key=lambda r: r.t)
    assert [(r.t, r.lat, r.lon, r.altitude_m) for r in got] == [(0.0, 59.9, 30.3, 12.3), (0.2, 59.9, 30.3, -0.5), (0.7, 59.91, 30.3, -0.5)]
    assert got[0].schema == "dvtm_Mini4_Pro.proto"
    assert [r.t for r in OG.sample_track(points).collect()] == [0.0, 0.7]


def test_damaged_packets_end_early():
    import time

    good = _message(1.0, 2.0, 3_000)
    assert SM._decoded(good) == ("dvtm_Mini4_Pro.proto", 1.0, 2.0, 3000.0)
    assert SM._decoded(good + b"\xff" * 200_000)[1:] == (1.0, 2.0, 3000.0)
    started = time.perf_counter()
    assert SM._decoded(b"\x80" * 2_000_000) == (None,) * 4
    assert time.perf_counter() - started < 0.5  # no number is longer than ten bytes
    assert SM._decoded(good[: len(good) // 2])[0] == "dvtm_Mini4_Pro.proto"
    assert SM._decoded(None) == (None,) * 4 == SM._decoded(b"")
    # the first message on a path may lack the rest of it
    empty = b"\x1a\x02\x1a\x00"
    assert SM._decoded(empty + good) == SM._decoded(good)


def test_feature_documents_round_trip(spark, tmp_path):
    sample = {f: 0.123456789 for f in schemas.FRAME_FIELDS}
    for video, doc in {
        "good": {"analysisFps": 5, "width": 320, "height": 180, "features": [sample, {**sample, "t": 0.2}]},
        "torn": {"analysisFps": 5, "features": [{**sample, "dx": "far"}]},
        "holes": {"analysisFps": 5, "features": [{"t": 1.0}]},
    }.items():
        (tmp_path / "in" / video).mkdir(parents=True)
        (tmp_path / "in" / video / "features.json").write_text(json.dumps(doc))
    df = ST.read_frame_features(spark, str(tmp_path / "in"))
    assert sorted((r.video_id, r.i) for r in df.collect()) == [("good", 0), ("good", 1)]
    ST.write_frame_features(df, str(tmp_path / "out"))
    back = ST.read_stored_features(spark, str(tmp_path / "out")).orderBy("i").first()
    assert (back.t, back.dx, back.mag_var, back.sharpness, back.analysis_fps) == (0.1235, 0.12346, 0.12345679, 0.12, 5.0)


def test_second_writes_keep_other_units(spark, tmp_path):
    """Every sink replaces the units it is given and leaves the others."""
    base = dict.fromkeys(schemas.FRAME_FIELDS, 0.5)
    fields = ", ".join(f"{'mag_var' if f == 'magVar' else f} double" for f in schemas.FRAME_FIELDS)
    features = lambda video, fps, n: spark.createDataFrame([(video, fps, k, *base.values()) for k in range(n)], f"video_id string, analysis_fps double, i bigint, {fields}")
    path = str(tmp_path / "features")
    for video, fps, n in (("v1", 5.0, 3), ("v2", 5.0, 2), ("v1", 10.0, 6), ("v2", 5.0, 4)):
        ST.write_frame_features(features(video, fps, n), path)
    stored = ST.read_stored_features(spark, path).groupBy("video_id", "analysis_fps").count().collect()
    assert {tuple(r) for r in stored} == {("v1", 5.0, 3), ("v2", 5.0, 4), ("v1", 10.0, 6)}
    series = lambda video, n: spark.createDataFrame([(video, k, k / 5, 0.5, 0.9, "static") for k in range(n)], "video_id string, i bigint, t double, speed double, smoothness double, motion string")
    for video, n in (("v1", 3), ("v2", 2), ("v1", 5)):
        ST.write_metrics(series(video, n), 5.0, str(tmp_path / "metrics"))
    stored = ST.read_metrics(spark, str(tmp_path / "metrics")).groupBy("video_id").count().collect()
    assert {tuple(r) for r in stored} == {("v1", 5), ("v2", 2)}
    documents = lambda job, *values: spark.createDataFrame([(job, v) for v in values], "job_id string, value string")
    lines = lambda job, *values: spark.createDataFrame([(job, 1, k, 0, v) for k, v in enumerate(values)], "job_id string, section int, ord bigint, sub int, line string")
    for job, values in (("j1", "ab"), ("j2", "c"), ("j1", "xyz")):
        SD.write_delivery_metadata(documents(job, *values), str(tmp_path / "documents"))
        SD.write_report(lines(job, *values), str(tmp_path / "report"))
    found = SD.read_delivery_metadata(spark, str(tmp_path / "documents")).collect()
    assert {tuple(r) for r in found} == {("j1", "x"), ("j1", "y"), ("j1", "z"), ("j2", "c")}
    assert [(tmp_path / "report" / j / "report.md").read_text() for j in ("j1", "j2")] == ["x\ny\nz\n", "c\n"]
    video = lambda project, n: spark.createDataFrame([(f"v{k}", project) for k in range(n)], "id string, project_id string")
    for project, n in (("p1", 3), ("p2", 2), ("p1", 1)):
        ST.write_catalog({"videos": video(project, n)}, str(tmp_path / "catalog"))
    stored = ST.read_catalog(spark, str(tmp_path / "catalog"), ["videos"])["videos"].groupBy("project_id").count().collect()
    assert {tuple(r) for r in stored} == {("p1", 1), ("p2", 2)}


def test_metrics_round_trip(spark, tmp_path):
    series = spark.createDataFrame([("v", i, i / 5, 0.5, 0.9, "static") for i in range(70)], "video_id string, i bigint, t double, speed double, smoothness double, motion string")
    assert ST.metric_pages(series, 5.0, 32).count() == 3
    ST.write_metrics(series, 5.0, str(tmp_path / "m"), page=32)
    assert sorted(map(tuple, ST.read_metrics(spark, str(tmp_path / "m"), 32).collect())) == sorted(map(tuple, series.collect()))


def test_fingerprints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SF, "CHUNK", 16)
    files = {"a.bin": b"x" * 10, "b.bin": bytes(range(40)), "c.bin": b"", "d.bin": bytes(range(20))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)

    def quick(data):
        tail = max(min(16, len(data)), len(data) - 16)
        return hashlib.sha256(f"{len(data)}\n".encode() + data[:16] + data[tail:]).hexdigest()

    expected = {n: (quick(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
    for block in (3, 7, 1000):
        monkeypatch.setattr(SF, "READ_BLOCK", block)
        assert {n: SF._digests(io.BytesIO(d), len(d)) for n, d in files.items()} == expected
    # One block covers these files on the workers, where CHUNK is the real one; empty files are not listed.
    monkeypatch.undo()
    found = SF.fingerprint_files(spark, str(tmp_path)).collect()
    whole = {n: (hashlib.sha256(f"{len(d)}\n".encode() + d).hexdigest(), expected[n][1]) for n, d in files.items() if d}
    assert {r.path.split("/")[-1]: (r.fingerprint, r.content_hash) for r in found} == whole


def test_inventory_keeps_names(spark, tmp_path):
    names = {"a+b.mp4": 3, "100%.mov": 4, "sp ace/ü%20.txt": 5}
    for name, size in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "sp ace" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "sp ace" / "deep" / "er" / "empty").touch()
    os.link(tmp_path / "a+b.mp4", tmp_path / "sp ace" / "second name.mp4")
    listed = {r.path: r for r in SF.read_file_inventory(spark, str(tmp_path)).collect()}
    more = {"sp ace/deep/er/empty": 0, "sp ace/second name.mp4": 3}
    assert {p: r.bytes for p, r in listed.items()} == names | more
    assert listed["a+b.mp4"].file_key == listed["sp ace/second name.mp4"].file_key
    assert len({r.file_key for r in listed.values()}) == 4
    assert SF.read_file_inventory(spark, str(tmp_path / "sp ace" / "deep")).first().path == "er/empty"
    os.remove(tmp_path / "sp ace" / "second name.mp4")
    assert {r.size_bytes for r in SF.fingerprint_files(spark, str(tmp_path)).collect()} == {3, 4, 5}


def test_manifest_round_trip(spark, tmp_path):
    rows = [(p, v, f"{v}.mp4", 100.0, 25.0, 1920, 1080, f"{v}-{k}", k / 25, (k + 5) / 25, k, k + 5, "forward", 0.5, "ai") for p, v in (("p1", "a"), ("p2", "b")) for k in range(3)]
    schema = "project_id string, video_id string, original_filename string, duration_sec double, fps double, width int, height int, segment_id string, start_sec double, end_sec double, start_frame bigint, end_frame bigint, motion_type string, score double, origin string"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "m")
    SD.write_manifest(df, path)
    SD.write_manifest(df.where("project_id = 'p1' AND start_frame < 2"), path)
    SD.write_manifest(df.where("project_id = 'p2'"), path, page=2)
    got = SD.read_manifest(spark, path).groupBy("project_id").count().collect()
    assert {r.project_id: r["count"] for r in got} == {"p1": 2, "p2": 3}


def test_missing_manifest_pages_are_noticed(spark, tmp_path):
    pages = [json.dumps({"manifestVersion": 1, "projectId": "p", "page": k, "pages": 3, "video": {"videoId": "v", "segments": [{"segmentId": str(k)}]}}) for k in range(3)]
    for n, fine in ((3, True), (2, False)):
        stored = spark.createDataFrame([("p", x) for x in pages[:n]], "project_id string, value string")
        units.commit(spark, str(tmp_path / str(n)), {"manifest": units.Change(stored, ("project_id",))})
        read = SD.read_manifest(spark, str(tmp_path / str(n)))
        if fine:
            assert read.count() == 3
        else:
            with pytest.raises(Exception, match="pages are missing"):
                read.collect()


def test_settings(spark):
    docs = {
        "over": '{"adobeAuthor":"Jane","temperature":1}', "empty": "{}", "null": '{"adobeAuthor":null}', "range": '{"concurrency":9}',
        "kind": '{"think":"yes"}', "broken": "{",
    }
    got = {r.key: r.settings for r in ST.resolve_settings(spark.createDataFrame(list(docs.items()), "key string, value string")).collect()}
    assert got["over"].adobeAuthor == "Jane" and got["over"].temperature == 1.0 and got["over"].concurrency == 2
    assert all(got[k].adobeAuthor == "author" and got[k].concurrency == 2 and got[k].think is False for k in ("empty", "null", "range", "kind", "broken"))


def test_responses(spark):
    place = lambda **a: json.dumps({"display_name": "X", "name": a.pop("name", None), "address": a})
    rows = [("g1", "en", place(town="Kizhi", county="C", state="S", country="Russia", country_code="ru")), ("g1", "local", place(name="Кижи")), ("g2", "en", '{"error":"no"}')]
    got = {r.grid_key: r for r in SM.parse_place_responses(spark.createDataFrame(rows, "grid_key string, lang string, response string")).collect()}
    assert (got["g1"].city, got["g1"].region, got["g1"].country_code, got["g1"].local_name) == ("Kizhi", "S", "RU", "Кижи")
    assert got["g2"].city is None and got["g2"].display_name is None
    osm = {"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": "A", "historic": "castle", "name:en": "B"}}, {"lat": 1.0, "lon": 2.0, "tags": {"name": "T", "natural": "tree"}}, {"center": {"lat": 3.0, "lon": 4.0}, "tags": {"historic": "x"}}]}
    found = SM.parse_map_responses(spark.createDataFrame([("g", json.dumps(osm))], "grid_key string, response string")).collect()
    assert [(r.name, r.name_en, r.type) for r in found] == [("A", "B", "historic=castle")]


def test_catalog_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("s", "v", 0.0, 1.0, "forward", 0.5, ["r"], "ai", True, False)], schemas.CATALOG["segments"])
    ST.write_catalog({"segments": seg}, str(tmp_path))
    assert ST.read_catalog(spark, str(tmp_path), ["segments"])["segments"].collect() == seg.collect()
    log = {"model": "m", "promptVersion": "v1", "attempt": 2, "durationMs": 5, "response": {"message": {"content": "x"}}, "errors": ["e"]}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "c1_2024-01-01_a2.json").write_text(json.dumps(log))
    r = ST.read_answer_log(spark, str(tmp_path / "logs")).first()
    assert (r.clip_id, r.attempt, r.answer, r.errors) == ("c1", 2, "x", ["e"])
