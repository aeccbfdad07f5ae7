"""Records as JSON, their phases, and the strings that are embedded into files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryglass.functions.texts import NAME_PATTERN, caption, description

PHASES = ("metadata", "content", "ml")


def to_json_records(df: DataFrame, key: str) -> DataFrame:
    """``(key, record)``: each row without its nulls as JSON."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("record"))


def from_json_records(df: DataFrame, key: str, schema: str) -> DataFrame:
    """The fields of ``record``; unknown ones are dropped, missing and broken ones are null."""
    return df.select(key, F.from_json("record", schema).alias("r")).select(key, "r.*")


def phases_done(**present: Column) -> Column:
    """The phases that a record has, in their order."""
    return F.filter(F.array(*[F.when(present[p], p) for p in PHASES]), lambda x: x.isNotNull())


def complete(done: Column) -> Column:
    """Whether all phases are done."""
    return F.size(F.array_except(F.array(*map(F.lit, PHASES)), done)) == 0


def embedding_plan(df: DataFrame, tags: str, objects: Column) -> DataFrame:
    """``(file_id, comment, description, caption)`` of files with tags: what would be written into each."""
    texts = (F.array_join(tags, ", ").alias("comment"), description(F.floor("quality_score"), F.col("sharpness_level")).alias("description"), caption(F.col("primary_scene"), objects, F.col("quality_score"), F.col("datetime_taken"), F.col("gps_coordinates")).alias("caption"))
    return df.where(F.size(tags) > 0).select("file_id", *texts)


def parsed_name(name: Column) -> Column:
    """``(stamp, hex, ext)`` of a generated file name; nulls for another."""
    ok = name.rlike(NAME_PATTERN)
    part = lambda k: F.when(ok, F.lower(F.regexp_extract(name, NAME_PATTERN, k)))
    return F.struct(F.try_to_timestamp(part(1), F.lit("yyyyMMdd_HHmmss")).alias("stamp"), part(2).alias("hex"), part(3).alias("ext"))


def duplicate_lines(files: DataFrame, digest: str) -> DataFrame:
    """``(digest, place, line)``: a report of each set of duplicates, a line per file in the order of paths.

    Lines are numbered by a window per set, so that a set of any size is a table and never one text.
    """
    from pyspark.sql import Window

    sets = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = files.join(sets, digest)
    line = F.concat(F.col("path"), F.lit(" ("), F.floor(F.coalesce("size", F.lit(0)) / 1024).cast("string"), F.lit(" KB)"))
    return rows.select(digest, F.row_number().over(Window.partitionBy(digest).orderBy("path")).alias("place"), line.alias("line"))
