"""The wide record per file, for Spark and in SQL, and adapters of the tables to the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryglass.functions.keys import digest
from quarryglass.functions.tags import parsed_date
from quarryglass.operators.assets import latest, merge_phases
from quarryglass.sources.tables import table

CONTENT_ORDER = ("phash", "sharpness_score", "quality_score", "brightness", "contrast", "noise_level", "warmth_score", "sharpness_level", "exposure", "color_temperature", "average_hash", "hash_error")


def images(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of image_metadata per file."""
    return latest(table(spark, d, "image_metadata"), "file_id", F.col("scanned_at"))


def contents(spark: SparkSession, d: str) -> DataFrame:
    """One row of content_analysis per file: of differing ones the greatest by hash and then by the statistics."""
    return latest(table(spark, d, "content_analysis"), "file_id", *map(F.col, CONTENT_ORDER))


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """One row of ml_analysis per file; its repeated rows are alike."""
    return table(spark, d, "ml_analysis").where("file_id IS NOT NULL").dropDuplicates(["file_id"])


def assets(spark: SparkSession, d: str) -> DataFrame:
    """The three phases merged by file."""
    i = images(spark, d).withColumn("datetime_taken", parsed_date(F.col("datetime_original")))
    c = contents(spark, d).withColumnRenamed("image_path", "file_path")
    m = analyses(spark, d).withColumnsRenamed({"image_path": "file_path", "error": "ml_error"})
    return merge_phases([i, c, m], "file_id")


def hashed_files(spark: SparkSession, d: str) -> DataFrame:
    """``(path, digest, size, mtime, width, height)`` of the files of the cache."""
    c = latest(table(spark, d, "file_cache"), "file_id", F.col("cached_at"))
    i = images(spark, d).select("file_id", "width", "height")
    return c.join(i, "file_id", "left").select(F.col("file_path").alias("path"), digest(F.col("file_hash")).alias("digest"), F.col("file_size").alias("size"), F.col("file_mtime").alias("mtime"), "width", "height")


IMG = "img AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) AS rn_i FROM image_metadata WHERE file_id IS NOT NULL) WHERE rn_i = 1)"
CON = "con AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY " + ", ".join(f"{c} DESC NULLS LAST" for c in CONTENT_ORDER) + ") AS rn_c FROM content_analysis WHERE file_id IS NOT NULL) WHERE rn_c = 1)"
ML = "ml AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id) AS rn_m FROM ml_analysis WHERE file_id IS NOT NULL) WHERE rn_m = 1)"
TAKEN = "CASE WHEN regexp_full_match(i.datetime_original, '\\d{4}([:-]\\d\\d){2}[ T]\\d\\d(:\\d\\d){2}') THEN coalesce(try_strptime(i.datetime_original, '%Y:%m:%d %H:%M:%S'), try_strptime(i.datetime_original, '%Y-%m-%d %H:%M:%S'), try_strptime(i.datetime_original, '%Y-%m-%dT%H:%M:%S')) END"
ASSET = f"""{IMG}, {CON}, {ML},
asset AS (
  SELECT coalesce(i.file_id, c.file_id, m.file_id) AS file_id, coalesce(m.image_path, c.image_path, i.file_path) AS file_path, i.file_size, i.width, i.height, i.mode, i.format,
    {TAKEN} AS taken, i.latitude, i.longitude, i.gps_coordinates, i.make, i.model, i.lens_model, i.f_number, i.exposure_time, i.iso_speed_ratings, i.focal_length, i.orientation, i.flash,
    c.sharpness_score, c.sharpness_level, c.quality_score, c.noise_level, c.brightness, c.contrast, c.exposure, c.warmth_score, c.color_temperature, c.phash,
    m.primary_scene, m.scene_scores, m.objects, m.object_counts, m.tags, m.error AS ml_error, i.error, c.hash_error, i.gps_error
  FROM img i FULL JOIN con c ON i.file_id = c.file_id FULL JOIN ml m ON m.file_id = coalesce(i.file_id, c.file_id))"""
BARE = "regexp_replace(regexp_replace(lower({0}), '^\\s*((md5:|sha256:|0x)\\s*)?', ''), '\\s+$', '')"
FILES = f"""{IMG}, cached AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cached_at DESC NULLS LAST) AS rn FROM file_cache WHERE file_id IS NOT NULL) WHERE rn = 1),
files AS (SELECT c.file_path AS path, CASE WHEN NOT regexp_full_match({BARE.format("file_hash")}, '0*') THEN {BARE.format("file_hash")} END AS digest, c.file_size AS size, c.file_mtime AS mtime, i.width, i.height
  FROM cached c LEFT JOIN img i ON i.file_id = c.file_id)"""
