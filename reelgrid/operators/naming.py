"""Delivery file names: rendering from a template and unique assignment inside a job."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.motion import MOTION_SLUGS
from ..functions.numeric import let, literal_map
from . import scale

MAX_LENGTH = 80


def _trim_to_words(slug: Column, limit: Column) -> Column:
    """Longest run of whole words within the limit; a single long word is cut."""
    head = F.substring(slug, F.lit(1), limit + 1)
    back = F.instr(F.reverse(head), "_")
    cut = F.when(back > 0, F.length(head) - back).otherwise(limit)
    return F.when(F.length(slug) <= limit, slug).otherwise(F.substring(slug, F.lit(1), F.least(cut, limit)))


def _tidy(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.regexp_replace(flat, "^_+|_+$", "")


def render_filename(
    template: str, ext: str, subject: Column, place: Column, motion: Column, capture_date: Column, ordinal: Column
) -> Column:
    """[a-z0-9_] name of at most 80 characters; place, then subject, give way word by word."""
    budget = MAX_LENGTH - len(ext) - 1
    single, many = T._transliteration()
    ascii_template = "".join(single.get(ch, many.get(ch, ch)) for ch in template)
    tokens = re.split(r"(\{\w+\})", ascii_template)
    fixed = {
        "motion": literal_map(MOTION_SLUGS)[motion],
        "date": F.replace(F.coalesce(capture_date, F.lit("")), F.lit("-"), F.lit("")),
        "n": F.when(ordinal + 1 < 1000, F.lpad((ordinal + 1).cast("string"), 3, "0")).otherwise(
            (ordinal + 1).cast("string")
        ),
    }

    def render(subject_slug: Column, place_slug: Column) -> Column:
        values = {**fixed, "subject": subject_slug, "place": place_slug}
        parts = [
            values.get(t[1:-1], F.lit("")) if t.startswith("{") and t.endswith("}") else F.lit(t)
            for t in tokens
            if t
        ]
        return _tidy(F.concat(*parts))

    def shrink(slug: Column, name: Column) -> Column:
        excess = F.length(name) - budget
        return F.when(
            excess > 0, _trim_to_words(slug, F.greatest(F.lit(0), F.length(slug) - excess))
        ).otherwise(slug)

    def with_slugs(s: Column) -> Column:
        first = lambda place_slug: let(
            render(s["subject"], place_slug), lambda name: F.struct(place_slug.alias("place"), name.alias("name"))
        )
        second = let(first(s["place"]), lambda a: first(shrink(s["place"], a["name"])))
        third = let(second, lambda b: render(shrink(s["subject"], b["name"]), b["place"]))
        name = let(third, lambda n: F.regexp_replace(F.substring(n, 1, budget), "_+$", ""))
        return let(name, lambda n: F.concat(F.when(n == "", "clip").otherwise(n), F.lit(f".{ext}")))

    slug = lambda c: T.slugify(F.coalesce(c, F.lit("")))
    return let(
        F.struct(
            let(slug(subject), lambda x: F.when(x == "", "aerial").otherwise(x)).alias("subject"),
            slug(place).alias("place"),
        ),
        with_slugs,
    )


def _suffixed(base: Column, k: Column, ext: str) -> Column:
    suffix = F.concat(F.lit("_"), k.cast("string"))
    room = F.lit(MAX_LENGTH - len(ext) - 1) - F.length(suffix)
    return F.concat(F.substring(base, F.lit(1), room), suffix, F.lit(f".{ext}"))


class Taken:
    """Names in use, as intervals of numbers per name without its number: a million repeats are one interval."""

    def __init__(self, room: int):
        self.room = room
        self.numbers: dict[str, tuple[list[int], list[int]]] = {}  # per root: first and last numbers, 0 for none

    def take(self, base: str) -> str:
        """The name itself, or with the smallest number from 2 on that is free."""
        root, number = self._split(base)
        if self._free_from(root, number) == number:
            self._add(root, number)
            return base
        k = 2
        while True:
            root = base[: self.room - len(str(k)) - 1]
            free = self._free_from(root, k)
            if len(str(free)) == len(str(k)):
                self._add(root, free)
                return f"{root}_{free}"
            k = 10 ** len(str(k))  # a longer number leaves less of the name

    @staticmethod
    def _split(base: str) -> tuple[str, int]:
        found = re.fullmatch(r"(.*)_([1-9][0-9]*)", base, re.DOTALL)
        return (found[1], int(found[2])) if found else (base, 0)

    def _free_from(self, root: str, k: int) -> int:
        first, last = self.numbers.get(root, ((), ()))
        i = bisect.bisect_right(first, k) - 1
        return last[i] + 1 if i >= 0 and last[i] >= k else k

    def _add(self, root: str, k: int) -> None:
        first, last = self.numbers.setdefault(root, ([], []))
        i = bisect.bisect_right(first, k)
        before, after = i > 0 and last[i - 1] == k - 1, i < len(first) and first[i] == k + 1
        if before and after:
            last[i - 1] = last[i]
            del first[i], last[i]
        elif before:
            last[i - 1] = k
        elif after:
            first[i] = k
        else:
            first.insert(i, k)
            last.insert(i, k)


def assign_filenames(clips: DataFrame, ext: str, bucket: int = 4096) -> DataFrame:
    """Unique names per job in ordinal order: repeats of a name get _2, _3 and so on.

    ``clips`` has job_id, clip_id, ordinal and first_name. Repeats are numbered per (job, name) in
    ordinal buckets. Only where a numbered name meets another name are the clips that share its stem
    renamed one after the other, with the numbers taken held as intervals.
    """
    base = F.substring("first_name", F.lit(1), F.length("first_name") - (len(ext) + 1))
    ranked = scale.dense_rank_in_order(
        clips, ["job_id", "first_name"], ["ordinal", "clip_id"], F.floor(F.col("ordinal") / bucket), "_k"
    )
    ranked = ranked.withColumns(
        {
            "base": base,
            "filename": F.when(F.col("_k") == 0, F.col("first_name")).otherwise(_suffixed(base, F.col("_k") + 1, ext)),
            # Names that can ever meet share their first characters once numbers are stripped.
            "stem": F.regexp_replace(F.substring(base, 1, MAX_LENGTH - len(ext) - 12), "(_[0-9]*)+$", ""),
        }
    )
    clash = (
        ranked.groupBy("job_id", "filename")
        .agg(F.count(F.lit(1)).alias("n"), F.max("stem").alias("stem"))
        .where("n > 1")
        .select("job_id", "stem")
        .distinct()
    )
    clean = ranked.join(clash, ["job_id", "stem"], "left_anti")
    entangled = ranked.join(clash, ["job_id", "stem"], "left_semi")
    columns = ["job_id", "clip_id", "ordinal", "first_name", "base", "stem"]
    types = dict(ranked.dtypes)

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        for _, group in itertools.groupby(rows, key=lambda r: (r.job_id, r.stem)):
            taken, out = Taken(MAX_LENGTH - len(ext) - 1), []
            for r in group:
                out.append((r.job_id, r.clip_id, r.ordinal, f"{taken.take(r.base)}.{ext}"))
                if len(out) >= 8192:
                    yield pd.DataFrame(out, columns=["job_id", "clip_id", "ordinal", "filename"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["job_id", "clip_id", "ordinal", "filename"])

    schema = ", ".join(f"{c} {types[c]}" for c in ("job_id", "clip_id", "ordinal")) + ", filename string"
    renamed = (
        entangled.select(*columns)
        .repartition("job_id", "stem")
        .sortWithinPartitions("job_id", "stem", "ordinal", "clip_id")
        .mapInPandas(rename, schema)
    )
    return clean.select("job_id", "clip_id", "ordinal", "filename").unionByName(renamed)
