"""Domain tables derived from the driver's Parquet tables.

``duck`` holds the same derivations as SQL text for the oracle. Both sides cover whole tables and
whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisSettings
from ..operators import scale
from ..operators.motion import Layout, layout_of

#: Settings used with the derived features: about 66 samples (13 s) per video.
SETTINGS = AnalysisSettings(min_duration=2, max_duration=6, target_duration=4, analysis_fps=5, sensitivity=1)


#: Tables whose rows are expensive to process.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scale.spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), "event_id", "ts", "value"
    )
    hour = F.unix_seconds(F.date_trunc("hour", "ts").cast("timestamp"))
    return scale.dense_rank_in_order(events, ["video_id"], ["ts", "event_id"], hour)


def features_layout(spark: SparkSession, sf_dir: str) -> Layout:
    return layout_of(table(spark, sf_dir, "events"), "user_id")


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fifth of the videos keeps one class throughout, a fifth changes half as often; both flicker.
    regime = (
        "(CASE video_id % 5 WHEN 0 THEN 0 WHEN 1 THEN floor(i / 48) ELSE floor(i / 24) END * 5 + video_id"
        " + CASE WHEN video_id % 5 < 2 AND i % 24 BETWEEN 12 AND 16 THEN 3 ELSE 0 END) % 12"
    )
    noise = "((event_id * 37) % 101 - 50) * 1e-5D"
    return (
        _positions(spark, sf_dir)
        .withColumn("k", F.expr(f"CAST({regime} AS BIGINT)"))
        .selectExpr(
            "video_id",
            "i",
            "event_id",
            "i / 5e0D AS t",
            f"CASE WHEN k = 2 THEN 5e-2D WHEN k = 3 THEN -5e-2D WHEN k = 11 THEN 3e-2D WHEN k IN (6, 7) THEN 2e-3D ELSE 0e0D END + {noise} AS dx",
            "CASE WHEN k IN (4, 8) THEN 5e-2D WHEN k IN (5, 9) THEN -5e-2D WHEN k = 11 THEN -2e-2D ELSE 0e0D END AS dy",
            "CASE WHEN k = 0 THEN 8e-2D WHEN k = 1 THEN -8e-2D ELSE 0e0D END AS div",
            "CASE WHEN k = 10 AND video_id % 3 = 0 THEN 9e-2D WHEN k = 10 AND video_id % 3 = 1 THEN -9e-2D ELSE 0e0D END AS rot",
            "CASE WHEN k = 6 THEN -5e-2D WHEN k = 7 THEN 5e-2D ELSE 0e0D END AS px",
            "CASE WHEN k IN (8, 9) THEN 4e-2D ELSE 0e0D END AS py",
            "CASE WHEN k = 11 THEN 1e-1D ELSE 95e-2D - (event_id % 7) * 1e-2D END AS fit",
            "95e-2D AS coherence",
            "(1 + event_id % 5) * 1e-4D AS mag_var",
            "CASE WHEN event_id % 97 = 0 THEN 2e1D ELSE 500 + value END AS sharpness",
            "120 + value / 1e1D AS brightness",
            "CASE WHEN event_id % 89 = 0 THEN 5e-1D ELSE 0e0D END AS overexposed",
        )
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).selectExpr(
        "video_id",
        "i",
        "i * 3e-1D AS t",
        "599e-1D + (video_id % 50) * 1e-2D + i * 1e-4D AS lat",
        "303e-1D + (video_id % 20) * 1e-2D + i * 2e-4D + CASE WHEN i % 41 = 40 THEN 5e-1D ELSE 0e0D END AS lon",
        "CAST(NULL AS DOUBLE) AS altitude_m",
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "CASE WHEN c_custkey % 4 = 0 THEN 'confirmed' ELSE 'draft' END AS status",
        "date_add(DATE'2024-01-01', CAST(c_custkey % 365 AS INT)) AS created_on",
        "7e0D AS min_duration",
        "40e0D AS max_duration",
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS project_id",
        """concat(CASE WHEN o_orderkey % 9 = 0 THEN 'HYPERLAPSE_' WHEN o_orderkey % 11 = 0 THEN 'DJI_TL_' ELSE 'DJI_' END,
             CAST(o_orderkey AS STRING), '.MP4') AS original_filename""",
        "CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes",
        "60e0D + o_orderkey % 240 AS duration_sec",
        "CASE WHEN o_orderkey % 5 = 0 THEN 120e0D WHEN o_orderkey % 2 = 0 THEN 25e0D ELSE 30e0D END AS fps",
        "CASE WHEN o_orderkey % 3 = 0 THEN 1920 ELSE 3840 END AS width",
        "CASE WHEN o_orderkey % 3 = 0 THEN 1080 ELSE 2160 END AS height",
        "'hevc' AS codec",
        "CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 10 = 0 THEN 'analyzing' ELSE 'ready' END AS status",
        "o_orderkey % 2 = 0 AS reviewed",
        "o_orderdate AS created_at",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are content keys, so no global ordering is needed to number the rows."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        """concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
             CAST(l_suppkey AS STRING), CAST(CAST(floor(l_extendedprice * 100 + 0.5D) AS BIGINT) AS STRING)) AS id""",
        "l_orderkey AS video_id",
        "(l_partkey % 200) + l_linenumber * 5e-1D AS start_sec",
        "(l_partkey % 200) + l_linenumber * 5e-1D + l_quantity AS end_sec",
        "CAST(l_suppkey % 12 AS BIGINT) AS motion_code",
        "l_discount * 10 AS score",
        "CASE WHEN l_returnflag = 'R' THEN 'user' ELSE 'ai' END AS origin",
        "l_tax < 6e-2D AS accepted",
        "l_linestatus = 'O' AS edited",
    )


def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS clip_id",
        "source AS job_id",
        "lang",
        "text AS title",
        "text AS description",
        "lower(text) AS kw_text",
        "CAST(doc_id % 23 AS BIGINT) AS adobe_category",
        "3e0D + doc_id % 70 AS duration_sec",
        "CAST(n_chars * 1000000 AS BIGINT) AS output_size_bytes",
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "source AS project_id",
        "CAST(length(text) AS BIGINT) AS size_bytes",
        "md5(text) AS content_hash",
        "length(text) / 1e2D AS duration_sec",
        "doc_id AS created_ord",
    )


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "s_name AS name",
        "599e-1D + (s_suppkey % 50) * 1e-2D AS lat",
        "303e-1D + (s_suppkey % 20) * 1e-2D AS lon",
        "CASE WHEN s_suppkey % 3 = 0 THEN concat('Q', CAST(s_suppkey AS STRING)) END AS wikidata_id",
    )


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS file_id",
        """CASE page_id % 8 WHEN 0 THEN 'videos/v/source.mp4' WHEN 1 THEN 'videos/v/proxy.mp4' WHEN 2 THEN 'videos/v/features.json'
           WHEN 3 THEN 'export-work/j/c/cut.mov' WHEN 4 THEN 'export-work/j/c/frame_0.jpg' WHEN 5 THEN 'exports/a/x.csv'
           WHEN 6 THEN 'llm-logs/c_a1.json' ELSE 'uploads/u.part' END AS path""",
        "CAST(length(html) AS BIGINT) AS bytes",
        "CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 15 END AS project_id",
    )


def flow_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS pair_id", "embedding", "posexplode(embedding) AS (pos, val)").selectExpr(
        "pair_id",
        "pos",
        "pos % 8 * 4 AS x",
        "CAST(floor(pos / 8) AS INT) * 4 AS y",
        "CAST(val AS DOUBLE) AS u",
        "CAST(embedding[63 - pos] AS DOUBLE) AS v",
    )


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts",
        "user_id AS entity_id",
        "user_id % 10 AS project_id",
        """CASE event_type WHEN 'click' THEN 'video.progress' WHEN 'purchase' THEN 'video.updated'
           WHEN 'error' THEN 'export.clip.progress' WHEN 'signup' THEN 'export.updated' ELSE 'video.deleted' END AS type""",
        "least(1e0D, value / 2e2D) AS progress",
    )


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS clip_id", "turn + 1 AS attempt", "text AS answer", "CAST(length(text) AS BIGINT) AS n_chars"
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS clip_id", "toxic = 1 AS editorial", "quality = 1 AS approved"
    )


def delivery_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips ready for delivery: whole texts, every word a keyword, editorial decisions from labels.

    The decisions are joined before the texts are doubled and split, so a document moves with its text once.
    """
    choice = decisions(spark, sf_dir).select(F.col("clip_id").alias("doc_id"), "editorial")
    return table(spark, sf_dir, "documents").join(choice, "doc_id", "left").selectExpr(
        "doc_id AS clip_id",
        "source AS job_id",
        "concat('clip_', doc_id, '.mov') AS filename",
        "text AS title",
        "text AS description",
        "split(lower(text), ' ') AS keywords",
        "concat(lang, ' river valley') AS subject",
        "CAST(doc_id % 23 AS INT) AS adobe_category",
        "CASE doc_id % 4 WHEN 0 THEN array('Nature') WHEN 1 THEN array('Nature', 'Religion') WHEN 2 THEN array('Parks/Outdoor') ELSE array('Art', 'Parks/Outdoor') END AS shutterstock_categories",
        "CASE doc_id % 3 WHEN 0 THEN 'Nature' WHEN 1 THEN 'City' ELSE 'Parks' END AS envato_category",
        "doc_id % 2 = 0 AS recognizable_buildings",
        "doc_id % 5 = 0 AS editorial_suggested",
        "CASE WHEN doc_id % 10 = 0 THEN ' landmark ' END AS editorial_reason",
        "CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS place_confidence",
        "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('Zürich ', lang) END AS city",
        "'Region & Co' AS region",
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Côte (West)' END AS country",
        "3e0D + doc_id % 70 AS duration_sec",
        "CASE doc_id % 3 WHEN 0 THEN 'real_time' WHEN 1 THEN 'slow_motion' ELSE 'hyperlapse' END AS shot_type",
        "CASE doc_id % 2 WHEN 0 THEN array('Aerial', 'Drone', 'Arc') ELSE array('Aerial', 'Drone', 'Unknown') END AS movement",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('2024-07-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) END AS capture_date",
        "CASE WHEN doc_id % 2 = 0 THEN 'DJI Air 3' END AS drone_model",
        "CAST(n_chars * 1000000 AS BIGINT) AS output_size_bytes",
        "editorial",
    )


# Derived tables whose text is the same in both engines.
_SHARED = {
    "clips": (
        "segments",
        """
SELECT id AS clip_id, video_id % 15 AS job_id, video_id, id AS segment_id, start_sec, end_sec, motion_code,
  CASE motion_code % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'frames' WHEN 2 THEN 'geo' WHEN 3 THEN 'tech' WHEN 4 THEN 'llm'
    WHEN 5 THEN 'review' WHEN 6 THEN 'cut' WHEN 7 THEN 'done' ELSE 'failed' END AS status,
  origin = 'user' AND edited AS excluded, accepted AS approved, score AS progress,
  CASE WHEN motion_code % 9 = 8 THEN CASE WHEN accepted THEN 'geo' ELSE NULL END END AS failed_step
FROM {segments}""",
    ),
    "jobs": (
        "projects",
        """
SELECT id AS job_id, id AS project_id, CASE WHEN id % 5 = 0 THEN 'building' ELSE 'idle' END AS build_status
FROM {projects}""",
    ),
}


def shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = _SHARED[name]
    return spark.sql(text, **{source: globals()[source](spark, sf_dir)})


_DUCK = {
    "frame_features": """
WITH e AS (
  SELECT user_id AS video_id, event_id, value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i
  FROM events),
r AS (
  SELECT *, CAST((CAST(CASE video_id % 5 WHEN 0 THEN 0 WHEN 1 THEN floor(i / 48) ELSE floor(i / 24) END AS BIGINT) * 5 + video_id
           + CASE WHEN video_id % 5 < 2 AND i % 24 BETWEEN 12 AND 16 THEN 3 ELSE 0 END) % 12 AS BIGINT) AS k,
         ((event_id * 37) % 101 - 50) * 1e-5 AS n
  FROM e)
SELECT video_id, i, event_id, i / 5e0 AS t,
  CASE WHEN k = 2 THEN 5e-2 WHEN k = 3 THEN -5e-2 WHEN k = 11 THEN 3e-2 WHEN k IN (6, 7) THEN 2e-3 ELSE 0e0 END + n AS dx,
  CASE WHEN k IN (4, 8) THEN 5e-2 WHEN k IN (5, 9) THEN -5e-2 WHEN k = 11 THEN -2e-2 ELSE 0e0 END AS dy,
  CASE WHEN k = 0 THEN 8e-2 WHEN k = 1 THEN -8e-2 ELSE 0e0 END AS div,
  CASE WHEN k = 10 AND video_id % 3 = 0 THEN 9e-2 WHEN k = 10 AND video_id % 3 = 1 THEN -9e-2 ELSE 0e0 END AS rot,
  CASE WHEN k = 6 THEN -5e-2 WHEN k = 7 THEN 5e-2 ELSE 0e0 END AS px,
  CASE WHEN k IN (8, 9) THEN 4e-2 ELSE 0e0 END AS py,
  CASE WHEN k = 11 THEN 1e-1 ELSE 95e-2 - (event_id % 7) * 1e-2 END AS fit,
  95e-2 AS coherence,
  (1 + event_id % 5) * 1e-4 AS mag_var,
  CASE WHEN event_id % 97 = 0 THEN 2e1 ELSE 500 + value END AS sharpness,
  120 + value / 1e1 AS brightness,
  CASE WHEN event_id % 89 = 0 THEN 5e-1 ELSE 0e0 END AS overexposed
FROM r""",
    "projects": """
SELECT c_custkey AS id, c_name AS name,
  CASE WHEN c_custkey % 4 = 0 THEN 'confirmed' ELSE 'draft' END AS status,
  CAST('2024-01-01' AS DATE) + CAST(c_custkey % 365 AS INT) AS created_on,
  7e0 AS min_duration, 40e0 AS max_duration
FROM customer""",
    "videos": """
SELECT o_orderkey AS id, o_custkey AS project_id,
  concat(CASE WHEN o_orderkey % 9 = 0 THEN 'HYPERLAPSE_' WHEN o_orderkey % 11 = 0 THEN 'DJI_TL_' ELSE 'DJI_' END,
         CAST(o_orderkey AS VARCHAR), '.MP4') AS original_filename,
  CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes,
  60e0 + o_orderkey % 240 AS duration_sec,
  CASE WHEN o_orderkey % 5 = 0 THEN 120e0 WHEN o_orderkey % 2 = 0 THEN 25e0 ELSE 30e0 END AS fps,
  CASE WHEN o_orderkey % 3 = 0 THEN 1920 ELSE 3840 END AS width,
  CASE WHEN o_orderkey % 3 = 0 THEN 1080 ELSE 2160 END AS height,
  'hevc' AS codec,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 10 = 0 THEN 'analyzing' ELSE 'ready' END AS status,
  o_orderkey % 2 = 0 AS reviewed, o_orderdate AS created_at
FROM orders""",
    "segments": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(floor(l_extendedprice * 100 + 5e-1) AS BIGINT)) AS id,
  l_orderkey AS video_id,
  (l_partkey % 200) + l_linenumber * 5e-1 AS start_sec,
  (l_partkey % 200) + l_linenumber * 5e-1 + l_quantity AS end_sec,
  CAST(l_suppkey % 12 AS BIGINT) AS motion_code,
  l_discount * 10 AS score,
  CASE WHEN l_returnflag = 'R' THEN 'user' ELSE 'ai' END AS origin,
  l_tax < 6e-2 AS accepted, l_linestatus = 'O' AS edited
FROM lineitem""",
    "clip_text": """
SELECT doc_id AS clip_id, source AS job_id, lang, text AS title, text AS description, lower(text) AS kw_text,
  CAST(doc_id % 23 AS BIGINT) AS adobe_category,
  3e0 + doc_id % 70 AS duration_sec,
  CAST(n_chars * 1000000 AS BIGINT) AS output_size_bytes
FROM documents""",
    "fingerprints": """
SELECT doc_id AS id, source AS project_id, CAST(length(text) AS BIGINT) AS size_bytes, md5(text) AS content_hash,
  length(text) / 1e2 AS duration_sec, doc_id AS created_ord FROM documents""",
    "telemetry": """
SELECT video_id, i, i * 3e-1 AS t, 599e-1 + (video_id % 50) * 1e-2 + i * 1e-4 AS lat,
  303e-1 + (video_id % 20) * 1e-2 + i * 2e-4 + CASE WHEN i % 41 = 40 THEN 5e-1 ELSE 0e0 END AS lon
FROM (SELECT user_id AS video_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i FROM events) q""",
    "pois": """
SELECT s_suppkey AS id, s_name AS name, 599e-1 + (s_suppkey % 50) * 1e-2 AS lat,
  303e-1 + (s_suppkey % 20) * 1e-2 AS lon,
  CASE WHEN s_suppkey % 3 = 0 THEN concat('Q', CAST(s_suppkey AS VARCHAR)) END AS wikidata_id
FROM supplier""",
    "file_inventory": """
SELECT page_id AS file_id,
  CASE page_id % 8 WHEN 0 THEN 'videos/v/source.mp4' WHEN 1 THEN 'videos/v/proxy.mp4' WHEN 2 THEN 'videos/v/features.json'
    WHEN 3 THEN 'export-work/j/c/cut.mov' WHEN 4 THEN 'export-work/j/c/frame_0.jpg' WHEN 5 THEN 'exports/a/x.csv'
    WHEN 6 THEN 'llm-logs/c_a1.json' ELSE 'uploads/u.part' END AS path,
  CAST(length(html) AS BIGINT) AS bytes,
  CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 15 END AS project_id
FROM pages""",
    "flow_samples": """
SELECT vec_id AS pair_id, CAST(p AS INT) AS pos, CAST(p % 8 * 4 AS INT) AS x, CAST(floor(p / 8) AS INT) * 4 AS y,
  CAST(embedding[p + 1] AS DOUBLE) AS u, CAST(embedding[64 - p] AS DOUBLE) AS v
FROM embeddings, range(64) AS g(p)""",
    "change_events": """
SELECT event_id, ts, user_id AS entity_id, user_id % 10 AS project_id,
  CASE event_type WHEN 'click' THEN 'video.progress' WHEN 'purchase' THEN 'video.updated' WHEN 'error' THEN 'export.clip.progress'
    WHEN 'signup' THEN 'export.updated' ELSE 'video.deleted' END AS type,
  least(1e0, value / 2e2) AS progress
FROM events""",
    "delivery": """
SELECT d.doc_id AS clip_id, source AS job_id, 'clip_' || d.doc_id || '.mov' AS filename, text, lang,
  string_split(lower(text), ' ') AS keywords, CAST(d.doc_id % 23 AS INT) AS adobe_category,
  CASE d.doc_id % 4 WHEN 0 THEN 'Nature' WHEN 1 THEN 'Nature,Religion' WHEN 2 THEN '' ELSE 'Art' END AS sh_ok,
  d.doc_id % 4 IN (2, 3) AS sh_bad, CASE d.doc_id % 3 WHEN 0 THEN 'Nature' WHEN 1 THEN 'City' ELSE 'Parks' END AS envato_category,
  d.doc_id % 2 = 0 AS buildings, coalesce(toxic = 1, d.doc_id % 5 = 0) AS editorial, toxic = 1 AS decision,
  CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE 'Zurich ' || lang END AS city,
  CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE 'Cote West' END AS country,
  3e0 + d.doc_id % 70 AS duration_sec, CAST(n_chars * 1000000 AS BIGINT) AS size,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS day
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "answer_log": """
SELECT conv_id AS clip_id, turn + 1 AS attempt, text AS answer, CAST(length(text) AS BIGINT) AS n_chars FROM conversations""",
    "decisions": """
SELECT doc_id AS clip_id, toxic = 1 AS editorial, quality = 1 AS approved FROM labels""",
}


_DUCK |= {name: text.replace("{" + source + "}", source) for name, (source, text) in _SHARED.items()}


def duck(*names: str) -> str:
    """`WITH`-less CTE list for the named domain tables."""
    return ",\n".join(f"{n} AS ({_DUCK[n].strip()})" for n in names)


def six(c: Column | str) -> Column:
    """Six decimals, with the same arithmetic on both engines."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5) / 1e6


def duck_six(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 5e-1) / 1e6"
