import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from reelgrid.config import ExportSettings
from reelgrid.operators import platforms as P
from reelgrid.sources import delivery as SD
from reelgrid.sources.rules import DEFAULTS, RulesError, load_platform_rules

CTX = P.DeliveryContext(
    ExportSettings(
        adobe_author="Jane Doe", copyright="© Jane Doe 2024", pond5_price=79, pond5_price_large=149,
        envato_price_single=19, envato_price_multi=39.5,
    ),
    date(2024, 8, 2),
)
SCHEMA = (
    "job_id string, clip_id int, ordinal int, filename string, title string, description string, keywords array<string>, "
    "adobe_category int, shutterstock_categories array<string>, envato_category string, recognizable_buildings boolean, "
    "editorial boolean, editorial_suggested boolean, city string, region string, country string, duration_sec double, "
    "shot_type string, movement array<string>, capture_date string, drone_model string, output_size_bytes bigint"
)
FIELDS = [f.split(" ")[0] for f in SCHEMA.split(", ")]
WORDS = ["harbour", "boats", "masts", "quay", "dawn", "calm", "gulls", "rope"]
LIMITS = {p: DEFAULTS[p]["limits"] for p in P.REGISTRY}


def clip(n, **changes):
    """A clip that keeps every rule, but for what is changed."""
    base = {
        "job_id": "j", "clip_id": n, "ordinal": n, "filename": f"take_{n}.mov", "title": "Quiet harbour at dawn",
        "description": "Boats at rest.", "keywords": WORDS, "adobe_category": 1, "shutterstock_categories": ["Nature"],
        "envato_category": "Nature", "recognizable_buildings": False, "editorial": False, "editorial_suggested": False,
        "city": "Bergen", "region": "Vestland", "country": "Norway", "duration_sec": 12.0, "shot_type": "real_time",
        "movement": ["Aerial", "Drone"], "capture_date": "2024-03-09", "drone_model": "Air 3", "output_size_bytes": 10**8,
    }
    assert set(changes) <= set(base)
    return tuple((base | changes)[f] for f in FIELDS)


# One clip per rule: (what it shows, changes, platform, expected messages there).
STEPS = " ".join(["step"] * 480)  # 2,399 characters, cut after whole words
whole = lambda limit: " ".join(["step"] * ((limit + 1) // 5))
RULE_CLIPS = {
    "long title": {"title": STEPS},
    "many keywords": {"keywords": [f"kw{k}" for k in range(LIMITS["adobe"]["keywordsMax"] + 4)]},
    "few keywords": {"keywords": ["sea", "sky"]},
    "too long": {"duration_sec": LIMITS["adobe"]["maxDurationSec"] + 1.5},
    "too short": {"duration_sec": 1.0},
    "too heavy": {"output_size_bytes": LIMITS["pond5"]["maxFileSizeBytes"] + 1},
    "category": {"adobe_category": 77, "shutterstock_categories": ["Moonlight"], "envato_category": "Moonlight"},
    "no date": {"capture_date": None},
    "quotes": {"title": 'Sign "Open", then closed', "keywords": ['"open" sign', *WORDS]},
    "accents": {"title": "Žižkov čeká", "keywords": ["žižkov", *WORDS]},
    "editorial": {"editorial": True},
    "slow": {"shot_type": "slow_motion"},
}
CLIPS = [clip(n, **changes) for n, changes in enumerate(RULE_CLIPS.values())]
NUMBER = {name: n for n, name in enumerate(RULE_CLIPS)}
KEEPS, NOTES = clip(50), clip(51, title="Ferry, seen from above", description='A "ferry" turns.', editorial=True)
GOLDEN = {
    "adobe": """Filename,Title,Keywords,Category,Releases
take_50.mov,Quiet harbour at dawn,"harbour, boats, masts, quay, dawn, calm, gulls, rope",1,
take_51.mov,"Ferry, seen from above","harbour, boats, masts, quay, dawn, calm, gulls, rope",1,
""",
    "shutterstock": """Filename,Description,Keywords,Categories,Editorial
take_50.mov,Quiet harbour at dawn. Boats at rest.,"harbour,boats,masts,quay,dawn,calm,gulls,rope",Nature,No
take_51.mov,"Ferry, seen from above. A ""ferry"" turns.","harbour,boats,masts,quay,dawn,calm,gulls,rope",Nature,Yes
""",
    "pond5": """originalfilename,title,description,keywords,city,region,country,specifysource,containsaudio,release,copyright,price,pricelarge,editorial,datecreated
take_50.mov,Quiet harbour at dawn,Boats at rest.,"harbour,boats,masts,quay,dawn,calm,gulls,rope",Bergen,Vestland,Norway,Air 3,no,,Jane Doe 2024,79,149,no,03/09/2024
take_51.mov,"Bergen, Norway 2024/03/09: Ferry, seen from above","Bergen, Norway 2024/03/09: A ferry turns.","harbour,boats,masts,quay,dawn,calm,gulls,rope",Bergen,Vestland,Norway,Air 3,no,,Jane Doe 2024,79,149,yes,03/09/2024
""",
    "envato": """Filename*,Title*,Description*,Keywords*,Category,Price: Single Use License ($USD)*,Price: Multi-use License ($USD)*,Recognisable people?,Recognisable buildings?,Is Motion Graphics?,AudioJungle Track (IDs),Color,Pace,Movement,Composition,Setting,No. of People,Gender,Age,Ethnicity,Alpha Channel,Looped,Source Audio
take_50.mov,Quiet harbour at dawn,Boats at rest.,"harbour,boats,masts,quay,dawn,calm,gulls,rope",Nature,$19,$39.50,No,No,,,Full Color,Real Time,"Aerial,Drone",Wide Shot,Outdoors,,,,,,,
take_51.mov,"Ferry, seen from above","A ""ferry"" turns.","harbour,boats,masts,quay,dawn,calm,gulls,rope",Nature,$19,$39.50,No,No,,,Full Color,Real Time,"Aerial,Drone",Wide Shot,Outdoors,,,,,,,
""",
}


@pytest.fixture(scope="module")
def results(spark):
    clips = spark.createDataFrame([NOTES, *CLIPS, KEEPS], SCHEMA)
    return P.platform_results(P.csv_clip_view(clips), CTX).cache()


def test_written_csv_matches_byte_for_byte(spark, results, tmp_path):
    for platform, expected in GOLDEN.items():
        rows = results.where("clip_id >= 50").select("job_id", "ordinal", F.inline("results")).where(F.col("platform") == platform)
        for job in ("j", "other", "j"):  # a second job, then the first one again
            SD.write_platform_csv(rows.withColumn("job_id", F.lit(job)), platform, CTX, str(tmp_path / platform), CTX.export_date)
        name = "adobe_stock_jane_doe_2024_08_02.csv" if platform == "adobe" else f"{platform}.csv"
        for job in ("j", "other"):
            assert (tmp_path / platform / job / name).read_bytes().decode() == expected
        SD.write_platform_csv(rows.limit(0), platform, CTX, str(tmp_path / platform), CTX.export_date, emptied=["other"])
        assert [p.name for p in (tmp_path / platform / "other").iterdir() if not p.name.startswith(".")] == []
        assert (tmp_path / platform / "j" / name).exists()


def test_every_rule_shows_in_its_clip(results):
    got = {(r.clip_id, r.platform): r for r in results.select("clip_id", F.inline("results")).collect()}
    at = lambda name, platform: got[NUMBER[name], platform]
    said = lambda name, platform: " / ".join(at(name, platform).messages)
    assert all(got[50, p].level == "ok" and got[50, p].messages == [] for p in P.REGISTRY)
    for platform, field, limit in (("adobe", 1, "titleMax"), ("shutterstock", 1, "descriptionMax"), ("pond5", 1, "titleMax"), ("envato", 1, "titleMax")):
        most = LIMITS[platform][limit]
        assert at("long title", platform).row[field] == whole(most) and at("long title", platform).level == "warning"
        assert f"to {most} characters" in said("long title", platform)
    for platform, separator in (("adobe", ", "), ("shutterstock", ","), ("pond5", ","), ("envato", ",")):
        kept = at("many keywords", platform).row[3 if platform in ("pond5", "envato") else 2].split(separator)
        assert kept == [f"kw{k}" for k in range(LIMITS[platform]["keywordsMax"])]
    assert "54 keywords" in said("many keywords", "adobe") and {at("few keywords", p).level for p in ("adobe", "shutterstock")} == {"error"}
    assert "61.5 s" in said("too long", "adobe") and got[NUMBER["too long"], "pond5"].level == "ok"
    assert {p for p in P.REGISTRY if "1.0 s" in said("too short", p)} == set(P.REGISTRY)
    assert {p for p in P.REGISTRY if "GB, the limit is" in said("too heavy", p)} == set(P.REGISTRY)
    assert [at("category", p).level for p in P.REGISTRY] == ["error", "error", "ok", "error"]
    assert said("no date", "pond5").startswith("Capture date unknown") and at("no date", "pond5").row[-1] == "08/02/2024"
    assert at("quotes", "pond5").row[1] == "Sign Open, then closed" and at("quotes", "adobe").row[1] == RULE_CLIPS["quotes"]["title"]
    assert at("quotes", "adobe").row[2].split(", ")[0] == "open sign"
    assert at("accents", "envato").row[3].split(",")[0] == "zizkov" and at("accents", "pond5").row[1] == "Zizkov ceka"
    assert at("accents", "shutterstock").row[2].split(",")[0] == "žižkov"
    assert at("editorial", "pond5").row[1].startswith("Bergen, Norway 2024/03/09: ") and at("editorial", "pond5").row[13] == "yes"
    assert at("slow", "envato").row[12] == "Slow Motion"


def test_report_and_documents(spark, results, tmp_path):
    jobs = spark.createDataFrame([("j", "Fjords", "export_fjords", "2024-08-02T10:30:00.000Z", 1)], "job_id string, project_name string, folder string, built_at string, excluded int")
    rows = results.withColumns({"place_confidence": F.lit("low"), "editorial_reason": F.lit(None).cast("string")})
    SD.write_report(SD.report_lines(jobs, rows, CTX).coalesce(1), str(tmp_path / "report"))
    text = (tmp_path / "report" / "j" / "report.md").read_text(encoding="utf-8")
    assert text.startswith("# Export report: Fjords\n\n- Folder: `export_fjords`\n")
    assert f"- Clips: {len(CLIPS) + 2} (excluded by the user: 1)\n" in text
    levels = [r.level for r in results.select(F.inline("results")).where("platform = 'adobe'").collect()]
    counts = " | ".join(str(levels.count(x)) for x in ("ok", "warning", "error"))
    assert f"| Adobe Stock | {counts} | no (checked {DEFAULTS['adobe']['lastVerified']}) |" in text
    troubled = [n for n in range(len(CLIPS)) if f"### take_{n}.mov\n" in text]
    order = [text.index(f"### take_{n}.mov\n") for n in troubled]
    assert len(troubled) >= 7 and order == sorted(order) and "- **Pond5** (Warning): Capture date unknown" in text
    assert f"- take_{NUMBER['editorial']}.mov: editorial. set by the user" in text and text.endswith("\n")
    doc = json.loads(SD.delivery_metadata(results).where(f"clip_id = {NUMBER['many keywords']}").first().value)
    assert doc["filename"] == f"take_{NUMBER['many keywords']}.mov" and len(doc["validations"]) == 4
    assert len(doc["final"]["keywords"]) == LIMITS["adobe"]["keywordsMax"] + 4


def test_delivery_is_reused_until_something_changes(spark):
    clips = spark.createDataFrame([KEEPS, NOTES], SCHEMA).withColumns(
        {"status": F.lit("done"), "excluded": F.lit(False), "progress": F.lit(0.0)}
    )
    jobs = spark.createDataFrame([("j", None)], "job_id string, archive_hash string")
    first = SD.build_delivery(clips, jobs, CTX)["jobs"].first()
    assert first.outcome == "built"
    known = spark.createDataFrame([("j", first.delivery_hash)], "job_id string, archive_hash string")
    again = SD.build_delivery(clips, known, CTX)
    assert again["jobs"].first().outcome == "reused" and again["results"].count() == 0
    edited = clips.withColumn("title", F.concat("title", F.lit("!")))
    assert SD.build_delivery(edited, known, CTX)["jobs"].first().outcome == "built"
    titled = lambda name: jobs.withColumn("project_name", F.lit(name))
    named = SD.build_delivery(clips, titled("A"), CTX)["jobs"].first().delivery_hash
    assert named not in (first.delivery_hash, SD.build_delivery(clips, titled("B"), CTX)["jobs"].first().delivery_hash)
    waiting = clips.withColumn("status", F.lit("review"))
    assert SD.build_delivery(waiting, known, CTX)["jobs"].first().outcome == "blocked"


def test_delivery_as_one_product(spark, tmp_path):
    """Gate, names, four files, report and documents of one build, stored together."""
    clips = spark.createDataFrame(CLIPS[:4], SCHEMA).withColumns(
        {"status": F.lit("done"), "excluded": F.lit(False), "progress": F.lit(0.0), "first_name": F.lit("coast_001.mov")}
    )
    jobs = spark.createDataFrame(
        [("j", None, "Fjords", "export_fjords", "2024-08-02T10:30:00.000Z", 0)],
        "job_id string, archive_hash string, project_name string, folder string, built_at string, excluded int",
    )
    delivery = SD.build_delivery(clips, jobs, CTX)
    order = [r.filename for r in delivery["results"].orderBy("ordinal").select("filename").collect()]
    assert order == ["coast_001.mov", "coast_001_2.mov", "coast_001_3.mov", "coast_001_4.mov"]
    sizes = SD.write_delivery(delivery, CTX, str(tmp_path / "out"))
    names = {"adobe_stock_jane_doe_2024_08_02.csv", "shutterstock.csv", "pond5.csv", "envato.csv", "report.md"}
    assert {n.split("/")[1] for n in sizes} == names and all(n.startswith("j/") for n in sizes)
    for platform in ("adobe", "shutterstock", "pond5", "envato"):
        name = next(n for n in names if n.startswith(platform))
        text = (tmp_path / "out" / "files" / "j" / name).read_text(encoding="utf-8")
        assert len(text) <= sizes[f"j/{name}"] and [text.index(n) for n in order] == sorted(text.index(n) for n in order)
    report = (tmp_path / "out" / "files" / "j" / "report.md").read_text(encoding="utf-8")
    assert report.startswith("# Export report: Fjords") and "### coast_001_3.mov" in report
    documents = [json.loads(r.value) for r in SD.read_delivery_metadata(spark, str(tmp_path / "out" / "documents")).collect()]
    assert sorted(d["filename"] for d in documents) == order
    done = delivery["jobs"].first()
    again = SD.build_delivery(clips, jobs.withColumn("archive_hash", F.lit(done.delivery_hash)), CTX)
    assert done.outcome == "built" and again["jobs"].first().outcome == "reused" and again["results"].count() == 0


def test_rules_fail_by_name(tmp_path):
    for name, doc in DEFAULTS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert load_platform_rules(str(tmp_path)).adobe["limits"]["titleMax"] == 70
    (tmp_path / "pond5.json").write_text(json.dumps({**DEFAULTS["pond5"], "header": []}))
    with pytest.raises(RulesError, match="pond5.json"):
        load_platform_rules(str(tmp_path))
    os.remove(tmp_path / "pond5.json")
    with pytest.raises(RulesError, match="Cannot read"):
        load_platform_rules(str(tmp_path))


def test_file_names(one):
    assert one(SD.platform_file_name("adobe", CTX.settings, CTX.export_date)) == "adobe_stock_jane_doe_2024_08_02.csv"
    assert one(SD.platform_file_name("pond5", CTX.settings, CTX.export_date)) == "pond5.csv"
