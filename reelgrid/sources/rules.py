"""Platform rules: limits, headers, category lists and stop lists as validated dimensions."""

from __future__ import annotations

import copy
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import KeywordRules, TagRules

# Official limits, headers, categories and word lists of the four platforms.
ADOBE = {
    "platform": "adobe",
    "label": "Adobe Stock",
    "lastVerified": "2026-10-07",
    "verified": False,
    "header": ["Filename", "Title", "Keywords", "Category", "Releases"],
    "limits": {
        "titleMax": 70, "keywordsMax": 50, "keywordsMin": 5,
        "minDurationSec": 5, "maxDurationSec": 60, "maxFileSizeBytes": 4187593113,
    },
    "categories": [
        {"id": 1, "label": "Animals"},
        {"id": 2, "label": "Buildings and Architecture"},
        {"id": 3, "label": "Business"},
        {"id": 4, "label": "Drinks"},
        {"id": 5, "label": "The Environment"},
        {"id": 6, "label": "States of Mind"},
        {"id": 7, "label": "Food"},
        {"id": 8, "label": "Graphic Resources"},
        {"id": 9, "label": "Hobbies and Leisure"},
        {"id": 10, "label": "Industry"},
        {"id": 11, "label": "Landscapes"},
        {"id": 12, "label": "Lifestyle"},
        {"id": 13, "label": "People"},
        {"id": 14, "label": "Plants and Flowers"},
        {"id": 15, "label": "Culture and Religion"},
        {"id": 16, "label": "Science"},
        {"id": 17, "label": "Social Issues"},
        {"id": 18, "label": "Sports"},
        {"id": 19, "label": "Technology"},
        {"id": 20, "label": "Transport"},
        {"id": 21, "label": "Travel"},
    ],
}
SHUTTERSTOCK = {
    "platform": "shutterstock",
    "label": "Shutterstock",
    "lastVerified": "2026-10-08",
    "verified": False,
    "header": ["Filename", "Description", "Keywords", "Categories", "Editorial"],
    "limits": {
        "descriptionMax": 200, "keywordsMax": 50, "keywordsMin": 7,
        "minDurationSec": 5, "maxDurationSec": 60, "maxFileSizeBytes": 4294967296,
    },
    "categories": [
        "Animals/Wildlife", "Art", "Backgrounds/Textures", "Buildings/Landmarks", "Business/Finance", "Education",
        "Food and drink", "Health care", "Holidays", "Industrial", "Nature", "Objects", "People", "Religion",
        "Science", "Signs/Symbols", "Sports/Recreation", "Technology", "Transportation",
    ],
}
POND5 = {
    "platform": "pond5",
    "label": "Pond5",
    "lastVerified": "2026-10-08",
    "verified": False,
    "header": [
        "originalfilename", "title", "description", "keywords", "city", "region", "country", "specifysource",
        "containsaudio", "release", "copyright", "price", "pricelarge", "editorial", "datecreated",
    ],
    "limits": {
        "titleMax": 80, "descriptionMax": 2000, "keywordsMin": 5, "keywordsMax": 50,
        "minDurationSec": 5, "maxDurationSec": 600, "maxFileSizeBytes": 10737418240,
    },
    "forbiddenCharacters": "&åñéß®©§çäøü\"'()\\/?@%",
}
ENVATO = {
    "platform": "envato",
    "label": "Envato (Stock Video)",
    "lastVerified": "2026-10-08",
    "verified": False,
    "header": [
        "Filename*", "Title*", "Description*", "Keywords*", "Category", "Price: Single Use License ($USD)*",
        "Price: Multi-use License ($USD)*", "Recognisable people?", "Recognisable buildings?", "Is Motion Graphics?",
        "AudioJungle Track (IDs)", "Color", "Pace", "Movement", "Composition", "Setting", "No. of People", "Gender",
        "Age", "Ethnicity", "Alpha Channel", "Looped", "Source Audio",
    ],
    "limits": {
        "titleMax": 99, "keywordsMax": 50, "keywordMaxLength": 100, "keywordsFieldMax": 2048,
        "minDurationSec": 5, "maxDurationSec": 60, "maxFileSizeBytes": 4294967296,
    },
    "splitMultiwordKeywords": False,
    "categories": [
        "Buildings", "Business Corporate", "Cartoons", "City", "Construction", "Education", "Food", "Holidays",
        "Industrial", "Kids", "Lifestyle", "Medical", "Military", "Nature", "Overhead", "People", "Religious",
        "Science", "Slow Motion", "Special Events", "Sports", "Stop Motion", "Technology", "Time Lapse", "Vehicles",
        "Weather",
    ],
    "movement": [
        "Aerial", "Arc", "Drone", "Tilt Down", "Tilt Up", "Top Down", "Tracking Left", "Tracking Right",
    ],
    "pace": {
        "real_time": "Real Time", "slow_motion": "Slow Motion", "timelapse": "Time Lapse",
        "hyperlapse": "Time Lapse", "high_frame_rate": "Real Time",
    },
}
COMMON = {
    "lastVerified": "2026-10-07",
    "llm": {
        "titleMax": 70, "descriptionMax": 200, "keywordsMin": 35, "keywordsMax": 49, "keywordsHardMin": 5,
    },
    "technicalTerms": [
        "4k", "8k", "5k", "6k", "2.7k", "uhd", "hd", "full hd", "fullhd", "1080p", "2160p", "720p", "4k uhd",
        "ultra hd", "fps", "frame rate", "60fps", "30fps", "25fps", "24fps", "120fps", "codec", "h264", "h.264",
        "h265", "h.265", "hevc", "prores", "hdr", "hlg", "d-log", "dlog", "log", "10-bit", "10bit", "8-bit", "raw",
        "mov", "mp4", "resolution", "bitrate", "footage", "stock footage", "video", "clip", "stock video",
        "high resolution",
    ],
    "brandNames": [
        "dji", "mavic", "phantom", "inspire", "avata", "mini 3", "mini 4", "air 2s", "air 3", "autel", "skydio",
        "gopro", "parrot", "anafi", "sony", "canon", "nikon", "apple", "iphone", "insta360",
    ],
    "fillerWords": [
        "beautiful", "amazing", "stunning", "breathtaking", "awesome", "incredible", "gorgeous", "epic",
    ],
}

DEFAULTS = {"adobe": ADOBE, "shutterstock": SHUTTERSTOCK, "pond5": POND5, "envato": ENVATO, "common": COMMON}
PLATFORM_ORDER = ["adobe", "shutterstock", "pond5", "envato"]

_POSITIVE = {
    "adobe": ["titleMax", "keywordsMax"],
    "shutterstock": ["descriptionMax", "keywordsMax"],
    "pond5": ["titleMax", "descriptionMax", "keywordsMax"],
    "envato": ["titleMax", "keywordsMax", "keywordMaxLength", "keywordsFieldMax"],
}


class RulesError(ValueError):
    """A rules document is unreadable or invalid; the message names it."""


@dataclass(frozen=True)
class PlatformRules:
    adobe: dict
    shutterstock: dict
    pond5: dict
    envato: dict
    common: dict

    def __getitem__(self, name: str) -> dict:
        return getattr(self, name)

    @property
    def keyword_rules(self) -> KeywordRules:
        c = self.common
        return KeywordRules(tuple(c["technicalTerms"]), tuple(c["brandNames"]), tuple(c["fillerWords"]))

    @property
    def tag_rules(self) -> TagRules:
        e = self.envato["limits"]
        return TagRules(
            e["keywordsMax"], e["keywordMaxLength"], e["keywordsFieldMax"], self.envato["splitMultiwordKeywords"]
        )

    def categories(self, spark: SparkSession) -> DataFrame:
        """Category dimension: platform, id (Adobe only), label."""
        rows = [("adobe", c["id"], c["label"]) for c in self.adobe["categories"]]
        for p in ("shutterstock", "envato"):
            rows += [(p, None, c) for c in self[p]["categories"]]
        return spark.createDataFrame(rows, "platform string, id int, label string")

    def platforms(self, spark: SparkSession) -> DataFrame:
        """Platform dimension in output order."""
        rows = [
            (k, p, self[p]["label"], self[p]["lastVerified"], self[p]["verified"])
            for k, p in enumerate(PLATFORM_ORDER)
        ]
        return spark.createDataFrame(
            rows, "ord int, platform string, label string, last_verified string, verified boolean"
        )


def _validate(name: str, doc: dict, where: str) -> dict:
    def need(ok: bool, what: str):
        if not ok:
            raise RulesError(f"Invalid platform rules {where}: {what}")

    if name == "common":
        for key in ("technicalTerms", "brandNames", "fillerWords"):
            need(isinstance(doc.get(key), list) and all(isinstance(x, str) for x in doc[key]), f"{key} must be a list of text")
        for key in ("titleMax", "descriptionMax", "keywordsMin", "keywordsMax", "keywordsHardMin"):
            value = doc.get("llm", {}).get(key)
            need(isinstance(value, int) and value > 0, f"llm.{key} must be a positive integer")
        return doc
    need(isinstance(doc.get("header"), list) and len(doc["header"]) > 0, "header must not be empty")
    need(isinstance(doc.get("lastVerified"), str) and bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", doc["lastVerified"])), "lastVerified must be a date")
    need(isinstance(doc.get("verified"), bool), "verified must be a boolean")
    limits = doc.get("limits", {})
    for key in [*_POSITIVE[name], "minDurationSec", "maxDurationSec", "maxFileSizeBytes"]:
        value = limits.get(key)
        need(isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0, f"limits.{key} must be positive")
    if name != "pond5":
        need(bool(doc.get("categories")), "categories must not be empty")
    else:
        need(isinstance(doc.get("forbiddenCharacters"), str), "forbiddenCharacters must be text")
    return doc


def load_platform_rules(folder: str | None = None) -> PlatformRules:
    """Built-in rules, or ``<platform>.json`` documents of a folder. A broken file fails by name."""
    docs = {}
    for name, default in DEFAULTS.items():
        if folder is None:
            docs[name] = _validate(name, copy.deepcopy(default), name)
            continue
        path = os.path.join(folder, f"{name}.json")
        try:
            with open(path, encoding="utf-8") as f:
                doc = json.load(f)
        except (OSError, ValueError) as err:
            raise RulesError(f"Cannot read platform rules {path}: {err}") from err
        docs[name] = _validate(name, doc, path)
    return PlatformRules(**docs)
