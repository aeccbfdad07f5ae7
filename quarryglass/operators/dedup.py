"""Exact duplicates by digest, survivors and what removing the others frees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def duplicate_sets(files: DataFrame, digest: str) -> DataFrame:
    """``(digest, files, first_path)`` of digests that more than one file has; null digests are nobody's duplicate."""
    return files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")).where("files > 1")


def quick_candidates(files: DataFrame, quick: str) -> DataFrame:
    """The files whose quick hash another file has too; only these need a full digest. A semi-join on counted keys."""
    shared = files.where(F.col(quick).isNotNull()).groupBy(quick).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(quick)
    return files.join(shared, quick, "left_semi")


def survivors_by(files: DataFrame, digest: str, how: str = "highest_quality") -> DataFrame:
    """``(digest, kept_path, files, freed)``: the survivor of each set and the bytes that removing the others frees.

    ``files`` has ``path, size, mtime, width, height``. Ties keep the smallest path. One aggregation per set; nothing is
    collected, however large a set is.
    """
    orders = {
        "oldest": [F.col("mtime").isNull(), F.col("mtime")],
        "newest": [-F.unix_micros("mtime").cast("double")] if dict(files.dtypes)["mtime"].startswith("timestamp") else [-F.coalesce(F.col("mtime").cast("double"), F.lit(float("-inf")))],
        "largest": [-F.coalesce(F.col("size").cast("double"), F.lit(-1.0))],
        "highest_quality": [-(F.coalesce("width", F.lit(0)).cast("double") * F.coalesce("height", F.lit(0)) + F.coalesce("size", F.lit(0)) / 1000)],
    }
    rank = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(orders.get(how, []))], "path")
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    sets = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(F.struct(rank.alias("r"), size.alias("s"))).alias("b"), F.count(F.lit(1)).alias("files"), F.sum(size).alias("_sum"))
    return sets.where("files > 1").select(digest, F.col("b.r.path").alias("kept_path"), "files", (F.col("_sum") - F.col("b.s")).alias("freed"))


def report_totals(files: DataFrame, digest: str) -> DataFrame:
    """``(sets, redundant, wasted)``: sets, files beyond the first of each, and their bytes; the first by path."""
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    sets = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"), F.min(F.struct("path", size.alias("size"))).alias("f")).where("n > 1")
    zero = F.lit(0).cast("bigint")
    return sets.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("redundant"), F.coalesce(F.sum(F.col("s") - F.col("f.size")), zero).alias("wasted"))
