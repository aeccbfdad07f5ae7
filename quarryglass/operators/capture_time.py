"""One unambiguous instant for each of a file's date texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryglass.functions.instants import utc_micros
from quarryglass.plans.sizing import broadcast_if_at_most

#: Rows up to which the camera table is broadcast; a larger one is joined by a shuffle.
CAMERAS_BROADCAST = 1_000_000
FIELDS = {"datetime_original": "offset_time_original", "datetime_modified": "offset_time"}


def _serial(c: str) -> Column:
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def camera_zones(cameras: DataFrame) -> DataFrame:
    """``(_serial, _zone)``: the clock zone of each normalised serial number; null where its rows disagree."""
    z = cameras.select(_serial("body_serial_number").alias("_serial"), F.trim("clock_zone").alias("_zone")).where("_serial <> ''")
    return z.groupBy("_serial").agg(F.when(F.min("_zone") == F.max("_zone"), F.min("_zone")).alias("_zone"))


def normalise_times(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """``(file_id, field, utc_us)``: the instants of ``datetime_original`` and ``datetime_modified``.

    One row per file and field whose text denotes exactly one instant (see ``utc_micros``). A file delivered again counts
    as its row with the latest ``scanned_at``; of rows that tie, the one with the greater instant. Rows without a
    ``file_id`` give nothing, nulls in other columns only lose what needs them, empty tables give an empty result, extra
    columns are ignored. The camera table is broadcast only up to ``CAMERAS_BROADCAST`` rows; beyond that, rows whose
    serial number is missing are spread over the tasks instead of meeting in one.
    """
    own = images.select("file_id", "scanned_at", *FIELDS, *FIELDS.values(), _serial("body_serial_number").alias("_serial")).where("file_id IS NOT NULL")
    own = own.withColumn("_serial", F.coalesce(F.when(F.col("_serial") != "", F.col("_serial")), F.concat(F.lit("\u0000"), F.pmod("file_id", F.lit(100_000)).cast("string"))))
    zones = broadcast_if_at_most(camera_zones(cameras), CAMERAS_BROADCAST)
    read = own.join(zones, "_serial", "left").select("file_id", "scanned_at", *(utc_micros(F.col(c), F.col(o), F.col("_zone")).alias(c) for c, o in FIELDS.items()))
    last = read.groupBy("file_id").agg(*(F.max_by(c, F.struct("scanned_at", c)).alias(c) for c in FIELDS))
    pairs = ", ".join(f"'{c}', {c}" for c in FIELDS)
    return last.selectExpr("file_id", f"stack({len(FIELDS)}, {pairs}) AS (field, utc_us)").where("utc_us IS NOT NULL")
