"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, rows_per_task: int = 20_000, counts: DataFrame | None = None) -> DataFrame:
    """Inner equi-join on ``keys`` in which the left rows of a hot key are split over several tasks.

    A key is hot when the left side has more than ``rows_per_task`` rows of it. Its left rows get a salt from the hash
    of ``left_id``, its right rows are repeated once per salt. All rows take part; other keys are joined as usual, and
    without a hot key (found by a pre-aggregated count of the left side, which should be cheap to read again) this is a
    plain join. ``counts``: the keys with the left rows ``_salt_n`` of each, where they are known. Null keys match nothing. The columns of both sides other than the keys must have different names.
    """
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_salt_n"))
    hot = counts.where(F.col("_salt_n") > rows_per_task).select(*keys, F.ceil(F.col("_salt_n") / rows_per_task).cast("int").alias("_salts"))
    if hot.isEmpty():
        return left.join(right, keys)
    salts: Column = F.coalesce(F.col("_salts"), F.lit(1))
    l2 = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(left_id), salts).cast("int")).drop("_salts")
    r2 = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return l2.join(r2, [*keys, "_salt"]).drop("_salt")
