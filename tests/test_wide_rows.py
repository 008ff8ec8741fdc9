"""Rows with whole texts move and wait as few times as they can."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgrid.functions import text as T
from reelgrid.operators import geo as OG
from reelgrid.operators import platforms as P
from reelgrid.plans import bindings as B
from reelgrid.plans import delivery_queries as DQ
from reelgrid.session import written_once
from reelgrid.sources import delivery as SD

CTX = P.DeliveryContext()
TEXT = "title string, description string, keywords array<string>"
SCHEMA = (
    f"job_id string, clip_id int, filename string, {TEXT}, adobe_category int, shutterstock_categories array<string>, "
    "envato_category string, recognizable_buildings boolean, editorial boolean, editorial_suggested boolean, city string, "
    "region string, country string, duration_sec double, shot_type string, movement array<string>, capture_date string, "
    "drone_model string, output_size_bytes bigint"
)


@pytest.fixture(scope="module")
def clips(spark):
    rows = [
        ("j", 1, "a.mov", "Old  mill", "By the\tstream.", ["mill", "Mill", None, "water;"], 1, ["Nature"], "Nature", True, True, None, "Graz", None, "", 9.0, "real_time", ["Aerial"], "2024-02-03", "Ünit", 5),
        ("j", 2, None, "Mole", None, None, 2, ["Art"], "City", False, None, False, None, None, None, 9.0, None, [], None, None, None),
        ("j", 3, "c.mov", "", "", [], 2, [], "City", False, True, True, "&", "R & B", "Perú", 9.0, "x", [], "bad", "", 7),
    ]
    return P.csv_clip_view(spark.createDataFrame(rows, SCHEMA))


def python_passes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_platforms_share_one_pass_over_the_texts(clips):
    assert python_passes(P.report_counts(P.validations(clips, CTX, ("clip_id", "job_id")))) == 1
    assert all(python_passes(build(clips, CTX)) == 1 for build in P.REGISTRY.values())


def test_one_pass_gives_what_each_function_gives(clips):
    forbidden = CTX.rules.pond5["forbiddenCharacters"]
    text = P._text
    got = P._with_texts(clips, CTX, *P.REGISTRY).select(
        text("csv_list").eqNullSafe(T.csv_keywords(F.col("keywords"), 51)),
        text("pond5_list").eqNullSafe(T.pond5_keywords(F.col("keywords"), forbidden, 51)),
        text("envato_list").eqNullSafe(T.envato_keywords(F.col("keywords"), CTX.rules.tag_rules)),
        text("plain_description").eqNullSafe(T.collapse_text(F.col("description"))),
        T.fitted(text("adobe_title"), 70, "Title").eqNullSafe(T.fit(F.col("title"), 70, "Title")),
        *[text(f"pond5_{c}") == T.pond5_sanitize(F.coalesce(c, F.lit("")), forbidden) for c in ("city", "region", "country")],
    )
    assert got.count() == 3 and all(all(r) for r in got.collect())
    named = {r.clip_id: r.row[1] for r in P.pond5_rows(clips, CTX).collect()}
    assert named == {1: "Graz 2024/02/03: Old mill", 2: "Mole", 3: "and, Peru 2024/01/01:"}
    # The texts of one platform aren't enough for the next.
    both = P.pond5_rows(P.adobe_rows(clips, CTX).drop("row", "issues"), CTX)
    assert {r.clip_id: r.row[1] for r in both.collect()} == named


def test_words_are_read_as_far_as_needed():
    words = T._Words(pa.array([f"w{k // 2}" for k in range(1000)]), 10, 1000)
    assert T._csv_keywords(3, str)()(words) == ["w5", "w6", "w7"] and words.at < 100
    assert list(words) == list(words) == [f"w{k}" for k in range(5, 500)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(
        [(1, "A b", "en", "s", 3), (2, "C", "de", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )
    docs.write.parquet(str(path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_documents_meet_their_labels_before_texts_are_split(spark, tables):
    clips = B.delivery_clips(spark, tables)
    got = sorted((r.clip_id, r.editorial, r.keywords) for r in clips.collect() if r.clip_id == 1)
    assert got == [(1, False, ["a", "b"]), (1, True, ["a", "b"])] and clips.where("editorial IS NULL").count() == 1
    plan = clips._jdf.queryExecution().optimizedPlan().toString()
    assert clips.columns[0] == "clip_id" and 0 <= plan.find("split(") < plan.find("Join")


def test_entities_are_listed_without_looking_up_their_distance_each(spark):
    points = spark.createDataFrame([("a", 60.0, 30.0, 90.0), ("b", 60.001, 30.0, None)], "clip_id string, lat double, lon double, heading double")
    pois = spark.createDataFrame(
        [(1, "Pier", 60.0, 30.001), (2, "Tower", 60.002, 30.0), (3, "Pier", 60.002, 30.0), (4, "Mill", 60.002, 30.0)], "id bigint, name string, lat double, lon double"
    ).withColumns({"name_en": F.col("name"), "type": F.lit("x"), "wikidata_id": F.lit(None).cast("string")})
    merged = OG.entities_within_radius(points, pois, 2000.0, ["id"])
    near = OG.poi_within_radius(points, pois, 2000.0)
    one_by_one = OG.merge_poi_entities(near, ["id"]).select(*merged.columns)
    assert sorted(map(str, merged.collect())) == sorted(map(str, one_by_one.collect())) and merged.count() == 6
    last = merged._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "_seen" not in last and "get(" not in last and "lambda" not in last


def test_jobs_to_build_are_few_rows_beside_their_clips(spark, clips):
    """The plan of the jobs is hashed once and read as a file, so clips aren't dealt out by job to be kept."""
    done = clips.withColumns({"status": F.lit("done"), "excluded": F.lit(False), "progress": F.lit(0.0)})
    jobs = spark.createDataFrame([("j", None), ("k", None)], "job_id string, archive_hash string")
    delivery = SD.build_delivery(done, jobs, CTX)
    plan = delivery["results"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "sha2" not in plan
    assert {r.job_id: r.outcome for r in delivery["jobs"].collect()} == {"j": "built", "k": "blocked"}
    assert delivery["results"].count() == 3


def test_delivery_documents_need_one_pass(spark, tables):
    docs = DQ.delivery_documents(spark, tables)
    assert python_passes(docs) == 1
    assert sorted(map(tuple, docs.select("clip_id", "keywords", "platforms").collect())) == [(1, 2, 4), (1, 2, 4), (2, 1, 4)]


def test_report_lines_need_one_pass(spark, tables, monkeypatch):
    written = []
    monkeypatch.setattr(DQ, "written_once", lambda df: written.append(df) or written_once(df))
    lines = {r.section: r.lines for r in DQ.report_lines(spark, tables).collect()}
    assert [python_passes(df) for df in written] == [1] and sorted(lines) == list(range(1, 10))
    assert lines[2] == 4 and lines[8] == 1  # four platforms, one editorial clip
