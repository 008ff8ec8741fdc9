"""Telemetry and landmarks: as-of lookup, jumps, thinning, radius join, entity merge, ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo as G
from ..functions.media import parse_coordinates
from ..functions.numeric import half_up, round_half_up
from ..functions.text import collapse, norm_name
from ..session import written_once
from . import folds, scale

#: Seconds of track handled by one window partition.
TRACK_SPAN = 600.0


def nearest_telemetry(clips: DataFrame, track: DataFrame, span: float = TRACK_SPAN) -> DataFrame:
    """Track point closest to the start, middle and end of each clip; the earlier one on ties.

    ``clips``: clip_id, video_id, start_sec, end_sec, static (struct lat/lon/altitude_m or null).
    ``track``: video_id, t, lat, lon, altitude_m. Adds start_point, mid_point, end_point; without a
    track the static location is the middle point.
    """
    s, e = F.col("start_sec"), F.col("end_sec")
    spots = F.array(
        F.struct(F.lit("start").alias("spot"), s.alias("t")),
        F.struct(F.lit("mid").alias("spot"), ((s + e) / 2).alias("t")),
        F.struct(F.lit("end").alias("spot"), e.alias("t")),
    )
    targets = clips.select("video_id", "clip_id", F.inline(spots)).withColumn("kind", F.lit(1))
    point = F.struct("t", "lat", "lon", "altitude_m")
    points = track.select("video_id", "t", point.alias("point")).withColumn("kind", F.lit(0))
    mixed = points.unionByName(targets, allowMissingColumns=True).withColumn("chunk", F.floor(F.col("t") / span))
    # One exchange on (video, chunk): the last point up to the target, the first one after it, and the ends
    # of the chunk, through which neighbouring chunks are reached.
    mixed = mixed.repartition("video_id", "chunk")
    chunk, whole = W.partitionBy("video_id", "chunk"), W.partitionBy("video_id").orderBy("chunk")
    so_far = lambda *order: F.last("point", True).over(chunk.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    when = F.when(F.col("kind") == 0, F.col("t"))
    ends = mixed.groupBy("video_id", "chunk").agg(F.min_by("point", when).alias("a"), F.max_by("point", when).alias("b"))
    reached = ends.select(
        "video_id", "chunk",
        F.last("b", True).over(whole.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.last("a", True).over(W.partitionBy("video_id").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"),
    )
    both = mixed.withColumns({"_in": so_far("t", "kind"), "_out": so_far(F.desc("t"), "kind")}).where("kind = 1")
    both = both.join(reached, ["video_id", "chunk"]).withColumns(
        {"earlier": F.coalesce("_in", "_before"), "later": F.coalesce("_out", "_after")}
    )
    gap = lambda p: F.abs(F.col(p)["t"] - F.col("t"))
    closer = F.when(
        F.col("later").isNull() | (gap("earlier") <= gap("later")), F.col("earlier")
    ).otherwise(F.col("later"))
    found = both.select("clip_id", "spot", closer.alias("p"))
    per_clip = found.groupBy("clip_id").agg(
        *[F.max(F.when(F.col("spot") == n, F.col("p"))).alias(f"{n}_point") for n in ("start", "mid", "end")]
    )
    out = clips.join(per_clip, "clip_id", "left")
    fixed = F.when(
        F.col("static").isNotNull(),
        F.struct(F.lit(0.0).alias("t"), F.col("static.lat"), F.col("static.lon"), F.col("static.altitude_m")),
    )
    return out.withColumn("mid_point", F.coalesce("mid_point", fixed))


def drop_gps_jumps(points: DataFrame, limit_m: float = 2000.0) -> DataFrame:
    """Remove points 2 km or more from the previous raw point; the first compares with the second.

    A track that loses more than half of its points is dropped; tracks under three stay.
    """
    around = scale.with_neighbours(
        points, ["video_id"], ["t", "lat", "lon"], F.floor(F.col("t") / TRACK_SPAN), ["lat", "lon"]
    )
    other = F.coalesce("prev", "next")
    away = G.flat_distance_m(F.col("lat"), F.col("lon"), other["lat"], other["lon"])
    judged = around.withColumn("_ok", F.coalesce(away < limit_m, F.lit(True)))
    totals = judged.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_ok").alias("_kept"))
    keep = (F.col("_n") < 3) | (F.col("_ok") & (F.col("_kept") * 2 >= F.col("_n")))
    return judged.join(totals, "video_id").where(keep).select(*points.columns)


def valid_fix() -> Column:
    """Inside the globe and not exactly at the zero point."""
    lat, lon = F.abs("lat"), F.abs("lon")
    return (lat <= 90) & (lon <= 180) & ~((lat < 1e-6) & (lon < 1e-6))


def sample_track(points: DataFrame, step: float = 0.5, piece: int = scale.SPAN) -> DataFrame:
    """Thin a track: keep a valid fix once ``step`` seconds passed since the last kept one; long tracks in pieces."""
    return folds.thinned(points.where(valid_fix()), "video_id", ["t"], "t", folds.Advance(step), piece)


def progress_throttle(
    events: DataFrame, key: str, order: list[str], step: float = 0.01, piece: int = scale.SPAN
) -> DataFrame:
    """Keep a value once it moved by ``step`` since the last kept one; exactly 1 always passes."""
    clipped = events.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress"))))
    return folds.thinned(clipped, key, order, "progress", folds.Move(step), piece)


# ---- landmarks --------------------------------------------------------------------------------


def union_pois(sources: list[DataFrame | None]) -> DataFrame:
    """Concatenate landmark sources in priority order; a missing source contributes nothing."""
    present = [df.withColumn("source_rank", F.lit(k)) for k, df in enumerate(sources) if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def _cells(lat: Column, lon: Column, radius_m: float, reach: int) -> Column:
    """Grid cells (row, col) around a position: its own for reach 0, with neighbours for reach 1.

    Rows are one radius high. Each row has its own number of columns, wide enough that a radius never
    spans more than the neighbouring column even at the row's poleward edge.
    """
    height = radius_m * 1.001 / math.radians(1) / G.EARTH_M
    row = F.floor(lat / height)

    def in_row(r: Column) -> Column:
        edge = F.least(F.lit(89.99), (F.abs(r.cast("double")) + 2) * height)
        width = F.lit(height) / F.cos(F.radians(edge))
        n = F.greatest(F.lit(1), F.floor(F.lit(360.0) / width))
        c = F.floor((lon + 180) / 360 * n)
        offsets = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
        return F.transform(offsets, lambda k: F.struct(r.alias("row"), F.pmod(c + k, n).alias("col")))

    rows = F.array(*[row + k for k in range(-reach, reach + 1)])
    return F.array_distinct(F.flatten(F.transform(rows, in_row)))


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    few = df.limit(scale.BROADCAST_ROWS + 1).count() <= scale.BROADCAST_ROWS
    return F.broadcast(df) if few else df


def poi_within_radius(points: DataFrame, pois: DataFrame, radius_m: float) -> DataFrame:
    """Landmarks within the radius of each clip position, with rounded metres and bearing.

    ``points``: clip_id, lat, lon, heading. Cells join by equality; the exact distance decides. The landmarks, usually
    fewer, are entered in the neighbouring cells.
    """
    p = points.select("clip_id", "heading", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon"))
    p = p.withColumn("cell", _cells(F.col("at_lat"), F.col("at_lon"), radius_m, 0)[0])
    q = pois.withColumn("cell", F.explode(_cells(F.col("lat"), F.col("lon"), radius_m, 1)))
    here = (F.col("at_lat"), F.col("at_lon"), F.col("lat"), F.col("lon"))
    near = p.join(_broadcast_if_small(q), "cell").withColumn("distance_m", half_up(G.haversine_m(*here))).where(
        F.col("distance_m") <= radius_m
    )
    near = near.withColumn("bearing_deg", round_half_up(G.bearing_deg(*here), 1))
    view = G.in_camera_sector(F.col("heading"), F.col("bearing_deg"), F.col("distance_m").cast("double"))
    return near.withColumn("in_camera_sector", view).drop("cell", "at_lat", "at_lon", "heading")


def ranked_within_radius(points: DataFrame, pois: DataFrame, radius_m: float, limit: int = 12) -> DataFrame:
    """``rank_pois`` of the landmarks within the radius; ``pois`` need ``ord``, unique, for ties.

    Landmarks at one position have the same distance and view, so a position with any number of them is one
    candidate: at most ``limit`` of its landmarks and, per clip, at most ``limit`` positions can come into the list.
    """
    spot = ["lat", "lon"]
    first = W.partitionBy(*spot).orderBy("ord")
    kept = pois.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= limit).drop("_nth")
    spots = pois.groupBy(*spot).agg(F.min("ord").alias("ord"))
    best = rank_pois(poi_within_radius(points, spots, radius_m), limit).drop("rank", "ord")
    return rank_pois(best.join(_broadcast_if_small(kept), spot), limit)


def with_name_keys(pois: DataFrame) -> DataFrame:
    """Add the normalised names; done on the landmarks, before they are matched with many clips."""
    return pois.withColumns({"k_en": norm_name(F.col("name_en")), "k_name": norm_name(F.col("name"))})


_POI_FIELDS = ["name", "name_en", "type", "distance_m", "bearing_deg", "in_camera_sector", "wikidata_id"]


def merge_poi_entities(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Merge candidates of a clip that share a wikidata id or a name, in list order.

    A candidate belongs to the entity that first used its id, else its English name, else its name. The
    entity keeps name, type, bearing and sector of its first candidate, and takes the first id, the first
    proper English name and the shortest distance of all. Adds ``ord``, the position of the entity.

    Clips without a shared key are numbered by a window; only clips with one are walked in order.
    """
    own = ["bearing_deg", "in_camera_sector"]
    return _merged(candidates, order, own, {"distance_m": F.min("distance_m")}).select("clip_id", "ord", *_POI_FIELDS)


def _merged(candidates: DataFrame, order: list[str], own: list[str], common: dict[str, Column]) -> DataFrame:
    """Entities of ``merge_poi_entities``: ``own`` columns of the first candidate, ``common`` aggregates of all."""
    keyed = candidates if "k_en" in candidates.columns else with_name_keys(candidates)
    clip_type = dict(candidates.dtypes)["clip_id"]
    in_order = W.partitionBy("clip_id").orderBy(*order)
    keys = F.filter(F.array("wikidata_id", "k_en", "k_name"), lambda k: k.isNotNull() & (k != ""))
    fields = ["name", "name_en", "type", *own]
    used = [c for c in candidates.columns if c not in ("clip_id", "k_en", "k_name", "pos", "_keys", *fields, "wikidata_id")]
    listed = keyed.withColumns({"_keys": keys, "pos": F.row_number().over(in_order).cast("bigint") - 1}).select(
        "clip_id", "pos", "_keys", *fields, "wikidata_id", *used
    )
    uses = listed.select("clip_id", F.explode(F.array_distinct("_keys")).alias("key")).groupBy("clip_id", "key").count()
    clashing = uses.where("count > 1").select("clip_id").distinct()
    walked = scale.ordered_fold(
        listed.join(clashing, "clip_id", "left_semi").select("clip_id", "pos", "_keys"),
        ["clip_id"], ["pos"], _entities, f"clip_id {clip_type}, pos bigint, entity bigint",
    )
    placed = listed.join(walked, ["clip_id", "pos"], "left").withColumn("entity", F.coalesce("entity", "pos"))
    # An English name counts if it is not just the candidate's own name.
    proper = F.when(~F.col("name_en").eqNullSafe(F.col("name")), F.struct("pos", "name_en"))
    merged = placed.groupBy("clip_id", "entity").agg(
        F.min_by(F.struct(*fields), "pos").alias("_first"),
        F.min_by("wikidata_id", F.when(F.col("wikidata_id").isNotNull(), F.col("pos"))).alias("wikidata_id"),
        F.array_sort(F.collect_list(proper)).alias("_proper"),
        *[c.alias(n) for n, c in common.items()],
    )
    own_english = F.col("_first.name_en").eqNullSafe(F.col("_first.name"))
    better = F.filter("_proper", lambda p: ~p["name_en"].eqNullSafe(F.col("_first.name")))
    english = F.when(own_english, F.coalesce(F.get(better, F.lit(0))["name_en"], F.col("_first.name_en"))).otherwise(
        F.col("_first.name_en")
    )
    number = F.row_number().over(W.partitionBy("clip_id").orderBy("entity")).cast("bigint") - 1
    return merged.select(
        "clip_id", number.alias("ord"), "_first.name", english.alias("name_en"), "_first.type",
        *[f"_first.{c}" for c in own], *common, "wikidata_id",
    )


#: Clips whose entities are listed from one copy of the entities of their positions.
CLIPS_PER_COPY = 4096


def entities_within_radius(points: DataFrame, pois: DataFrame, radius_m: float, order: list[str]) -> DataFrame:
    """``merge_poi_entities`` of the landmarks within the radius, merged once per set of positions in reach.

    Which landmarks merge depends on the positions in reach only, so clips that reach the same ones share the entities.
    Distance, bearing and view depend on the positions an entity has, of which a set has few: they are looked up once per
    clip and combination of positions, and the entities of the combination are listed beside them.
    ``pois``: landmarks with the columns of ``order``.
    """
    spot = F.struct("lat", "lon")
    near = poi_within_radius(points, pois.select("lat", "lon").distinct(), radius_m)
    seen = F.struct("lat", "lon", "distance_m", "bearing_deg", "in_camera_sector")
    reach = near.groupBy("clip_id").agg(F.array_sort(F.collect_list(seen)).alias("_seen"))
    around = F.transform("_seen", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    reach = written_once(reach.withColumn("_set", F.sha2(F.to_json(F.struct(around)), 256)))
    sets = reach.groupBy("_set").agg(F.first("_seen").alias("_seen"), F.count(F.lit(1)).alias("_clips"))
    copies = F.ceil(F.col("_clips") / CLIPS_PER_COPY)
    sized = sets.select("_set", copies.alias("_copies"))
    places = sets.select(F.col("_set").alias("clip_id"), F.posexplode("_seen").alias("_at", "_p"))
    places = places.select("clip_id", "_at", F.struct("_p.lat", "_p.lon").alias("_spot"))
    keyed = (pois if "k_en" in pois.columns else with_name_keys(pois)).withColumn("_spot", spot).drop("lat", "lon")
    candidates = places.join(keyed, "_spot").drop("_spot")
    merged = _merged(candidates, order, ["_at"], {"_all": F.collect_set("_at")}).withColumnRenamed("clip_id", "_set")
    # The position of the first candidate, then all of the entity's positions.
    place = F.concat(F.array("_at"), F.array_sort("_all"))
    merged = written_once(merged.withColumn("_place", place).drop("_at", "_all"))
    asked = reach.join(merged.groupBy("_set").agg(F.collect_set("_place").alias("_places")).join(sized, "_set"), "_set")
    asked = asked.withColumns({"_copy": F.pmod(F.xxhash64("clip_id"), F.col("_copies")), "_place": F.explode("_places")})
    first = F.get("_seen", F.get("_place", F.lit(0)))
    shortest = F.when(F.size("_place") == 2, first["distance_m"]).otherwise(
        F.array_min(F.transform(F.slice("_place", 2, F.size("_place")), lambda k: F.get("_seen", k)["distance_m"]))
    )
    asked = asked.select(
        "clip_id", "_set", "_copy", "_place", shortest.alias("distance_m"), first["bearing_deg"].alias("bearing_deg"),
        first["in_camera_sector"].alias("in_camera_sector"),
    )
    merged = merged.join(sized, "_set").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    found = asked.join(merged.drop("_copies"), ["_set", "_copy", "_place"])
    return found.select(
        "clip_id", "ord", "name", "name_en", "type", "distance_m", "bearing_deg", "in_camera_sector", "wikidata_id"
    )


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entity (position of its first candidate) of the candidates of clashing clips, in order."""
    clip, owner = None, {}
    for batch in batches:
        entities = []
        for row_clip, pos, keys in zip(batch["clip_id"], batch["pos"], batch["_keys"], strict=True):
            if row_clip != clip:
                clip, owner = row_clip, {}
            known = [owner[k] for k in keys if k in owner]
            entity = known[0] if known else pos
            owner.update(dict.fromkeys(keys, entity))
            entities.append(entity)
        yield pd.DataFrame({"clip_id": batch["clip_id"], "pos": batch["pos"], "entity": entities})


def merge_poi_bulk(pois: DataFrame) -> DataFrame:
    """Set-based variant for whole catalogs: one landmark per wikidata id, then per name."""
    rows = pois.withColumn("_k", norm_name(F.col("name_en")))
    rank = F.struct("source_rank", "id")
    rest = [c for c in rows.columns if c not in ("wikidata_id", "_k")]
    with_id = rows.where(F.col("wikidata_id").isNotNull()).groupBy("wikidata_id").agg(
        F.min_by(F.struct(*rest, "_k"), rank).alias("_r")
    ).select("wikidata_id", "_r.*")
    without = rows.where(F.col("wikidata_id").isNull())
    merged = with_id.unionByName(without)
    rest = [c for c in merged.columns if c != "_k"]
    return merged.groupBy("_k").agg(F.min_by(F.struct(*rest), rank).alias("_r")).select("_r.*")


def rank_pois(candidates: DataFrame, limit: int = 12) -> DataFrame:
    """In-view landmarks first, then by distance, at most ``limit`` per clip.

    The limit is pushed below the exchange, so a crowded clip sends only its best rows per task.
    """
    unseen = F.when(F.coalesce("in_camera_sector", F.lit(False)), 0).otherwise(1)
    order = W.partitionBy("clip_id").orderBy(unseen, "distance_m", "ord")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


# ---- places -----------------------------------------------------------------------------------


def geo_lookup(points: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached place of each position by its grid key (null when missing)."""
    keyed = points.withColumn("grid", G.grid_key(F.col("lat"), F.col("lon"))["key"])
    return keyed.join(cache, keyed["grid"] == cache["key"], "left").drop("key")


def geo_misses(points: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct grid cells that still have to be resolved."""
    cells = points.select(F.inline(F.array(G.grid_key(F.col("lat"), F.col("lon"))))).distinct()
    return cells.join(cache.select("key"), "key", "left_anti")


def resolve_location(clips: DataFrame, searches: DataFrame) -> DataFrame:
    """Position of each clip by priority.

    ``clips``: manual_location, mid_point (telemetry or file tag), start_point, end_point,
    motion_type. ``searches``: query (normalised text), lat, lon. A manual text that cannot be found
    gives an unknown place and never falls back to GPS.
    """
    manual = F.trim("manual_location")
    manual = F.when(F.length(manual) > 0, manual)
    known = searches.select(
        F.col("query").alias("_query"), F.struct("lat", "lon").alias("_found")
    )
    # The text is parsed once per clip, whatever reads the result.
    parsed = scale.pinned(clips, {"_typed": parse_coordinates(manual)})
    rows = parsed.withColumn("_query", F.lower(collapse(manual))).join(known, "_query", "left")
    chosen = F.coalesce("_typed", "_found")
    heading = G.heading_from_track(F.col("start_point"), F.col("end_point"), F.col("motion_type"))
    gps = manual.isNull() & F.col("mid_point").isNotNull()
    source = F.when(manual.isNotNull(), "manual").when(gps, "embedded").otherwise("none")
    return rows.withColumns(
        {
            "source": source,
            "lat": F.when(manual.isNotNull(), chosen["lat"]).otherwise(F.col("mid_point")["lat"]),
            "lon": F.when(manual.isNotNull(), chosen["lon"]).otherwise(F.col("mid_point")["lon"]),
            "altitude_m": F.when(gps, F.col("mid_point")["altitude_m"]),
            "manual_text": manual,
            "heading": F.when(gps, heading),
        }
    ).drop("_query", "_typed", "_found")


def geo_context(
    clips: DataFrame, searches: DataFrame, cache: DataFrame, pois: DataFrame, radius_m: float = 2000.0, limit: int = 12
) -> DataFrame:
    """Geographic context (``geo``) of every clip: position by priority, place of its grid cell, ranked landmarks.

    ``clips``: clip_id and what ``resolve_location`` reads. ``cache``: key, city, region, country, country_code,
    display_name, local_name. ``pois``: landmarks in priority order (source_rank, id and the landmark fields). A clip
    without a position has no place and no landmarks; without landmarks near by the list is empty.
    """
    located = resolve_location(clips, searches)
    placed = geo_lookup(located, cache)
    spots = located.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("clip_id", "lat", "lon", "heading")
    ranked = rank_pois(entities_within_radius(spots, pois, radius_m, ["source_rank", "id"]), limit)
    landmarks = ranked.groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*_POI_FIELDS).alias("poi")))).alias("_ranked")
    )
    candidates = F.transform(F.coalesce("_ranked", F.array().cast(landmarks.schema["_ranked"].dataType)), lambda r: r["poi"])
    geo = F.struct(
        "source", "lat", "lon", "altitude_m", "city", "region", "country", "country_code", "display_name", "local_name",
        "manual_text", F.col("heading").alias("camera_heading_deg"), candidates.alias("poi_candidates"),
    )
    return placed.join(landmarks, "clip_id", "left").select("clip_id", geo.alias("geo"))


def timezone_lookup(points: DataFrame, tz_grid: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Time zone by grid cell from a supplied dimension (lat_cell, lon_cell, tz); null when unknown."""
    cells = {
        "lat_cell": F.floor(F.col("lat") / cell_deg).cast("int"),
        "lon_cell": F.floor(F.col("lon") / cell_deg).cast("int"),
    }
    return points.withColumns(cells).join(tz_grid, ["lat_cell", "lon_cell"], "left").drop("lat_cell", "lon_cell")


def pick_frames(clips: DataFrame, features: DataFrame) -> DataFrame:
    """Frame times of each clip: 30 % and 70 % (50 % under 15 s), moved to the sharpest sample near by.

    ``clips``: clip_id, video_id, start_sec, end_sec. Output: clip_id, idx, time_sec, sharpness.
    """
    length = F.col("end_sec") - F.col("start_sec")
    shares = F.when(length < 15, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.3), F.lit(0.7)))
    margin = F.least(F.lit(0.1), length / 10)
    targets = clips.select(
        "clip_id", "video_id", "start_sec", "end_sec", F.posexplode(shares).alias("idx", "share"), margin.alias("margin")
    ).withColumn("target", F.col("start_sec") + F.col("share") * (F.col("end_sec") - F.col("start_sec")))
    targets = targets.withColumns(
        {
            "lo": F.greatest(F.col("start_sec") + F.col("margin"), F.col("target") - 1),
            "hi": F.least(F.col("end_sec") - F.col("margin"), F.col("target") + 1),
        }
    )
    span = 32.0
    spread = targets.withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("lo") / span), F.greatest(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))))
    )
    samples = features.select("video_id", "t", "sharpness", F.floor(F.col("t") / span).alias("bucket"))
    usable = (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")) & ~F.isnan("sharpness")
    best = (
        spread.join(samples, ["video_id", "bucket"])
        .where(usable)
        .groupBy("clip_id", "idx")
        .agg(F.max_by(F.struct("t", "sharpness"), F.struct("sharpness", -F.col("t"))).alias("best"))
    )
    return targets.join(best, ["clip_id", "idx"], "left").select(
        "clip_id",
        "idx",
        round_half_up(F.coalesce(F.col("best.t"), F.col("target")), 3).alias("time_sec"),
        F.col("best.sharpness").alias("sharpness"),
    )


def tech_context(clips: DataFrame, conform_fps: float | None, mode: str) -> DataFrame:
    """All technical facts of a clip.

    ``clips``: start_sec, end_sec, motion_type, original_filename, fps, width, height, codec,
    bit_depth, color_transfer, has_audio, creation_time, make, model, tags, lat, lon, altitude_m, tz.
    """
    from ..functions import media as D
    from ..functions import suntime as S
    from ..functions.motion import movement_terms

    source = F.col("end_sec") - F.col("start_sec")
    df = clips.withColumns(
        {
            "source_duration_sec": source,
            "shot_type": D.shot_type(
                F.col("fps"), source, F.col("original_filename"), F.col("tags"), F.col("motion_type"), conform_fps
            ),
        }
    )
    capture = S.resolve_capture_time(
        F.col("creation_time"), mode, F.col("make"), F.col("tz"), F.col("original_filename")
    )
    df = scale.pinned(df, {"_capture": capture})
    # The recording starts at the container time; the clip starts later.
    micros = F.unix_micros("_capture.utc") + F.floor(F.col("start_sec") * 1_000_000 + 0.5)
    df = df.withColumn("captured_at", F.timestamp_micros(micros))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return df.withColumns(
        {
            "duration_sec": D.output_duration(F.col("source_duration_sec"), F.col("fps"), F.col("shot_type"), conform_fps),
            "output_fps": D.output_fps(F.col("fps"), F.col("shot_type"), conform_fps),
            "resolution_label": D.resolution_label(F.col("width"), F.col("height")),
            "movement": movement_terms(F.col("motion_type")),
            "time_of_day": S.time_of_day(F.col("captured_at"), F.col("lat"), F.col("lon")),
            "season": F.when(
                placed & F.col("_capture.local_month").isNotNull(), S.season(F.col("_capture.local_month"), F.col("lat"))
            ),
            "capture_date": F.date_format("_capture.local_date", "yyyy-MM-dd"),
            "drone_model": F.col("model"),
        }
    ).drop("_capture")
