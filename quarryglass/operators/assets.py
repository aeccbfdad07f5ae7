"""One wide record per file from the outputs of the three analysis phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that is last in the order (each column ascending, nulls first); rows without a key are dropped.

    A window with a row number of 1, so that unused columns are never read and all but the first row of a key in each
    input partition are dropped before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(*[o.desc_nulls_last() for o in order])
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_phases(phases: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of the phases on ``key``; where phases share a column, the later phase's value goes first.

    Every phase has one row per key. Files that a phase doesn't know get nulls from it. Rows are matched by key, never by
    position.
    """

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        both = [c for c in b.columns if c in a.columns and c != key]
        a2, b2 = a.withColumnsRenamed({c: f"_old_{c}" for c in both}), b.withColumnsRenamed({c: f"_new_{c}" for c in both})
        j = a2.join(b2, key, "full_outer")
        return j.withColumns({c: F.coalesce(f"_new_{c}", f"_old_{c}") for c in both}).drop(*(f"_old_{c}" for c in both), *(f"_new_{c}" for c in both))

    return reduce(two, phases)


def overlay_cache(requested: DataFrame, fresh: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, error)`` for each requested key: the cached value, else the fresh one, else an error."""
    f, c = fresh.select(key, F.col(value).alias("_fresh")), cached.select(key, F.col(value).alias("_cached"))
    out = requested.select(key).join(f, key, "left").join(c, key, "left").withColumn(value, F.coalesce("_cached", "_fresh"))
    return out.select(key, value, F.when(F.col(value).isNull(), "analysis failed").alias("error"))


def fresh_entries(cache: DataFrame, files: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Cache rows whose file still has the same hash and size and changed within ``tolerance`` seconds of then."""
    now = files.select("file_path", F.col("file_hash").alias("_h"), F.col("file_size").alias("_s"), F.col("file_mtime").alias("_t"))
    same = (F.col("file_hash") == F.col("_h")) & (F.col("file_size") == F.col("_s")) & (F.abs(F.col("file_mtime") - F.col("_t")) < tolerance)
    return cache.join(now, "file_path").where(same).drop("_h", "_s", "_t")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows whose key has no new row, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remaining(requested: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is requested and not yet done."""
    return requested.join(done.select(key).distinct(), key, "left_anti")
