"""Plans for converting, copying and clearing files. Nothing is moved: the plans are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryglass.functions.texts import base_name, extension


def target_format(mode: Column, width: Column, height: Column) -> Column:
    """png for pictures with transparency and small ones with a palette or in grey, else jpg."""
    return F.when(mode.isin("RGBA", "LA", "PA"), "png").when((width < 1000) & (height < 1000) & mode.isin("P", "L"), "png").otherwise("jpg")


def conversion_plan(files: DataFrame) -> DataFrame:
    """``(path, ext, target, action, output)`` of files with ``path, mode, width, height``."""
    ext = F.expr("substring(_e, 2)")
    p = files.select("path", extension(F.col("path")).alias("_e"), target_format(F.col("mode"), F.col("width"), F.col("height")).alias("target"))
    p = p.withColumn("ext", ext)
    stem = F.expr("substring(path, 1, length(path) - length(_e))")
    return p.select("path", "ext", "target", F.when(F.col("ext") == F.col("target"), "keep").otherwise("convert").alias("action"), F.concat(stem, F.lit("."), F.col("target")).alias("output"))


def space_change(ext: Column, target: Column, size: Column) -> Column:
    """Bytes that a conversion is expected to add."""
    rate = F.when(ext.isin("png", "bmp", "tiff") & (target == "jpg"), -0.6).when(ext.isin("heic", "heif") & (target == "jpg"), -0.2).when(ext.isin("jpg", "jpeg") & (target == "png"), 0.5).otherwise(0.0)
    return size * rate


def destinations(files: DataFrame, end: str, source: str) -> DataFrame:
    """``(path, destination)``: below ``end`` by name, in-batch collisions numbered ``_001``… before the extension in path order."""
    name = base_name(F.col("path"))
    w = Window.partitionBy("_n").orderBy("path")
    p = files.where(F.startswith("path", F.lit(source))).select("path", name.alias("_n")).withColumn("_k", F.row_number().over(w) - 1).withColumn("_e", F.regexp_extract("_n", r".(\.[^.]*)$", 1))
    stem = F.expr("substring(_n, 1, length(_n) - length(_e))")
    return p.select("path", F.concat(F.lit(end.rstrip("/") + "/"), F.when(F.col("_k") == 0, F.col("_n")).otherwise(F.concat(stem, F.format_string("_%03d", F.col("_k")), F.col("_e")))).alias("destination"))


def expired_backups(backups: DataFrame, as_of: Column, days: int, need_verified: bool = False) -> DataFrame:
    """Backups named ``backup_<yyyyMMdd_HHmmss>`` from before ``as_of`` less the days (verified ones only, if asked)."""
    made = F.try_to_timestamp(F.regexp_extract("name", r"^backup_(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))
    out = backups.withColumn("made", made).where(F.col("made") < as_of - F.make_interval(days=F.lit(days)))
    return out.where("verified") if need_verified else out
