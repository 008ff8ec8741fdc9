import random

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import text as T
from reelgrid.functions import timecode as TC
from reelgrid.operators import naming as N
from reelgrid.operators import quality as Q
from reelgrid.sources.rules import load_platform_rules

RULES = load_platform_rules()


def words(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_truncation(one):
    assert one(T.truncate_at_word(F.lit("Aerial Orbit Around Kizhi Pogost, Russia"), 30)) == "Aerial Orbit Around Kizhi"
    assert one(T.truncate_text(F.lit("First sentence here. Second sentence is long."), 30)) == "First sentence here."
    assert one(T.truncate_at_word(F.lit("x" * 50), 10)) == "x" * 10
    # Astral characters count once.
    assert one(T.fit(F.lit("🚁" * 11), 10, "Title"))["value"] == "🚁" * 10
    assert one(T.collapse(F.lit(" a 　\n b﻿"))) == "a b"


def test_transliteration_and_slugs(one):
    assert one(T.transliterate(F.lit("Кижи Погост, Zürich, Straße"))) == "Kizhi Pogost, Zurich, Strasse"
    assert one(T.slugify(F.lit("Saint Isaac’s Cathedral — Санкт-Петербург"))) == "saint_isaac_s_cathedral_sankt_peterburg"
    tricky = 'Café "Zum Löwen" (Zürich) & 50% @home / ß ñ å ø © ®'
    assert one(T.pond5_sanitize(F.lit(tricky), RULES.pond5["forbiddenCharacters"])) == (
        "Cafe Zum Lowen Zurich and 50 percent at home ss n a o"
    )
    assert one(T.norm_name(F.lit("Löwen-Brücke №1"))) == "lo wen bru cke No1"


def test_keyword_rules(one):
    raw = words(
        "Churches", "church", "Aerial!", "4K", "dji mini", "city", "cities", "2024", "60fps", "golden hour",
        "drone shot", "footage", " - ",
    )
    assert one(T.clean_keywords(raw, RULES.keyword_rules, 49)) == ["churches", "aerial", "city", "golden hour", "drone shot"]
    envato = words("café", "old town, square", ".hidden", "2024", "church & tower", "кафе", "4.5")
    assert one(T.envato_keywords(envato, RULES.tag_rules)) == ["cafe", "old town square", "hidden", "church tower", "kafe"]
    split = T.TagRules(50, 100, 2048, True)
    assert one(T.envato_keywords(words("wooden church", "church", "old wooden house"), split)) == [
        "wooden", "church", "old", "house",
    ]
    # The list ends at the first overflow of the field budget.
    assert one(T.envato_keywords(words("aaaa", "bbbb", "cccccc", "d"), T.TagRules(50, 100, 10))) == ["aaaa", "bbbb"]
    assert one(T.csv_keywords(words("A, b", "a  b", '"q"', ";"))) == ["A b", "q"]
    assert one(T.nfc(F.lit("é"))) == "é"


def test_time_texts(one):
    assert one(TC.format_timecode(F.lit(3725.5))) == "1:02:05.50" and one(TC.format_timecode(F.lit(-1.0))) == "00:00.00"
    assert one(TC.parse_timecode(F.lit("1:02:05.5"))) == 3725.5 and one(TC.parse_timecode(F.lit("1:x"))) is None
    assert one(TC.format_short_time(F.lit(59.5))) == "01:00"
    assert one(TC.format_bytes(F.lit(1536))) == "1.5 KB" and one(TC.format_bytes(F.lit(12))) == "12 B"
    assert one(TC.format_duration(F.lit(3661.0))) == "1:01:01"


def test_answers(spark):
    good = (
        '{"title":"T","description":"D","keywords":["a"],"subject":"s","placeConfidence":"high","adobeCategory":2,'
        '"shutterstockCategories":["Nature"],"envatoCategory":"Nature","recognizableBuildings":true,'
        '"editorialSuggested":false,"editorialReason":null}'
    )
    cases = {
        "ok": good,
        "fenced": f"Sure!\n```json\n{good}\n```",
        "tail": good + " x",
        "category": good.replace('"adobeCategory":2', '"adobeCategory":99'),
        "kind": good.replace('"title":"T"', '"title":5'),
        "extra": good.replace("{", '{"more":1,', 1),
        "three": good.replace('["Nature"]', '["Nature","Art","People"]'),
        "text": "no json",
    }
    df = spark.createDataFrame(list(cases.items()), "clip_id string, answer string")
    got = {r.clip_id: r.errors for r in Q.validate_answers(df, RULES).collect()}
    assert got["ok"] == got["fenced"] == [] and got["tail"] and got["text"] == ["the answer is not valid JSON"]
    assert got["category"] == ["adobeCategory: not in the list"] and got["kind"] == ["title: expected string"]
    assert got["extra"] == ["answer: unrecognized keys more"]
    assert got["three"] == ["shutterstockCategories: 1 or 2 values are required"]


@pytest.mark.parametrize("seed", [1, 2])
def test_names_are_unique_and_sequential(spark, seed):
    """Collisions between natural and numbered names follow ordinal order."""
    rnd = random.Random(seed)
    long = "x" * 74
    pool = ["church", "church_2", "church_2_2", "church_3", "mill", long + "ab", long + "_2", long + "ac"]
    clips = [("j" + rnd.choice("12"), k, k, rnd.choice(pool)[:76] + ".mov") for k in range(120)]
    df = spark.createDataFrame(clips, "job_id string, clip_id bigint, ordinal int, first_name string")
    got = {r.clip_id: r.filename for r in N.assign_filenames(df, "mov", bucket=16).collect()}
    for job in ("j1", "j2"):
        used = set()
        for _, cid, _, first in (c for c in clips if c[0] == job):
            base, name, k = first[:-4], first, 2
            while name in used:
                name = f"{base[: 76 - len(str(k)) - 1]}_{k}.mov"
                k += 1
            used.add(name)
            assert got[cid] == name and len(name) <= 80


def test_rendered_names(one):
    render = lambda template, subject, place: one(
        N.render_filename(template, "mp4", F.lit(subject), F.lit(place), F.lit("orbit_left"), F.lit("2024-07-14"), F.lit(0))
    )
    assert render("{subject}_{motion}_{n}", None, None) == "aerial_orbit_001.mp4"
    assert render("{subject}_{place}_{motion}_{date}_{n}", "Wooden Church", "Кижи") == "wooden_church_kizhi_orbit_20240714_001.mp4"
    long = render("{subject}_{place}_{n}", "an extremely long subject for a single clip name", "a place with very many words in it too")
    assert len(long) <= 80 and long.startswith("an_extremely_long_subject") and long.endswith("_001.mp4")


def test_keywords_with_line_ends_and_early_stop(one):
    # A line end behind a plain word is whitespace like any other.
    assert one(T.csv_keywords(words("River\n", "river", "Lake"))) == ["River", "Lake"]
    assert one(T.envato_keywords(words("river\n", "River"), RULES.tag_rules)) == ["river"]
    # Words behind the limit don't change the list; a list without enough distinct words is read to its end.
    assert one(T.csv_keywords(words("b", "a", "B", "c"), 2)) == ["b", "a"]
    assert one(T.pond5_keywords(words("b;", "B", "b", "c"), RULES.pond5["forbiddenCharacters"], 2)) == ["b", "c"]
    assert one(T.fit(F.lit("One. Two three"), 8, "Title", "sentence"))["value"] == "One. Two"
    assert one(T.csv_keywords(F.lit(None).cast("array<string>"))) is None


def test_byte_size_ties(one):
    shown = lambda n, even: one(TC.format_bytes(F.lit(n).cast("bigint"), ties_to_even=even))
    assert [shown(n, True) for n in (1280, 1792, 184832, 185856, 1310720)] == ["1.2 KB", "1.8 KB", "180 KB", "182 KB", "1.2 MB"]
    assert [shown(n, False) for n in (1280, 184832)] == ["1.3 KB", "181 KB"]
