"""Counts, top lists, comparisons of runs and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryglass.plans.cut import Scratch


def top_values(df: DataFrame, value: Column, k: int, name: str = "value") -> DataFrame:
    """``(value, n)`` of the k most frequent values, by count and then value; nulls don't count."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(k)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage; 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), digits)


def error_summary(df: DataFrame, errors: list[str]) -> DataFrame:
    """One row: rows in all, rows with each kind of error, rows without any and their share in percent."""
    none = F.lit(True)
    for e in errors:
        none = none & F.col(e).isNull()
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), *(F.count(e).alias(f"n_{e}") for e in errors), F.count_if(none).alias("clean"), share(F.count_if(none), n).alias("clean_pct"))


def detection_summary(df: DataFrame, objects: str = "objects", error: str = "error") -> DataFrame:
    """One row over valid rows (objects present, no error): rows, rows with any, objects, mean per row, distinct labels."""
    valid = df.where(F.col(objects).isNotNull() & F.col(error).isNull()).select(F.size(objects).alias("n"), F.transform(objects, lambda o: o["object"]).alias("names"))
    labels = valid.select(F.explode("names").alias("o")).agg(F.count_distinct("o").alias("labels"))
    sums = valid.agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col("n") > 0).alias("with_objects"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"), F.round(F.avg("n"), 4).alias("mean_objects"))
    return sums.crossJoin(labels)


def run_comparison(a: DataFrame, b: DataFrame, key: str, count: str) -> DataFrame:
    """``(key, n_a, n_b, change)`` of two aggregated runs, keys of either side."""
    x, y = a.select(key, F.col(count).alias("n_a")), b.select(key, F.col(count).alias("n_b"))
    j = x.join(y, key, "full_outer").select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return j.withColumn("change", F.col("n_b") - F.col("n_a"))


def latency_metrics(log: DataFrame, name: str = "name", ms: str = "duration_ms", images: str = "image_count", rows_per_range: int = 1_000_000) -> DataFrame:
    """Per name: calls, mean, median, the 95th percentile by the rule below, images per second.

    The percentile is the element at place ``int(0.95 n)`` (from 0) of the sorted values, the last at most, and the mean of
    a single value. Elements come from exact counts per value, so that no list of all values is built; the counts are
    summed within ranges of about ``rows_per_range`` and shifted by prefix sums over the ranges, so that a name with very
    many values is no task of its own.
    """
    scratch = Scratch(log.sparkSession, "latency")
    c, distinct = scratch.write_counted(log.where(F.col(ms).isNotNull()).groupBy(name, ms).agg(F.count(F.lit(1)).alias("_c"), F.sum(images).alias("_i")), "counts")
    c = scratch.write(c.repartitionByRange(max(1, -(-distinct // rows_per_range)), name, ms).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = c.groupBy("_p", name).agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(name)
    sums = sums.select("_p", F.col(name).alias("_name"), F.sum("_s").over(w).alias("_n"), F.coalesce(F.sum("_s").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    c = c.join(sums, (c["_p"] == sums["_p"]) & c[name].eqNullSafe(sums["_name"])).drop(sums["_p"])
    inside = Window.partitionBy("_p", name).orderBy(ms).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    at = F.least(F.floor(0.95 * F.col("_n")), F.col("_n") - 1)
    mid = lambda k: F.min(F.when(F.col("_upto") > k, F.col(ms)))
    n = F.col("_n")
    out = c.groupBy(name).agg(
        F.max("_n").alias("calls"), F.sum("_i").alias("images"), F.sum(F.col(ms) * F.col("_c")).alias("_sum"),
        ((mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2).alias("_median"), mid(at).alias("_p95"),
    )
    mean = F.col("_sum") / F.col("calls")
    return out.select(
        name, "calls", "images", F.round(mean, 2).alias("mean_ms"), F.round("_median", 2).alias("median_ms"),
        F.round(F.when(F.col("calls") < 2, mean).otherwise(F.col("_p95")), 2).alias("p95_ms"), F.round(F.try_divide(F.col("images"), F.col("_sum") / 1000), 2).alias("per_second"),
    )


def speedups(runs: DataFrame, name: str, seconds: str, order: str) -> DataFrame:
    """``(name, seconds, speedup, best)`` of every run against the first in the order."""
    base = runs.where(F.col(seconds) > 0).agg(F.min_by(seconds, order).alias("_b"), F.min(seconds).alias("_m"))
    return runs.where(F.col(seconds) > 0).crossJoin(base).select(name, seconds, F.round(F.col("_b") / F.col(seconds), 4).alias("speedup"), (F.col(seconds) == F.col("_m")).alias("best"))


def progress(total: Column, done: Column, elapsed: Column) -> list[Column]:
    """Percent, rate a second and seconds to go."""
    rate = F.try_divide(done.cast("double"), elapsed)
    return [share(done, total).alias("pct"), F.round(rate, 4).alias("rate"), F.round(F.try_divide(total - done, rate), 2).alias("eta_s")]


def trailing_count(log: DataFrame, ts: str, seconds: int, by: str) -> DataFrame:
    """Each row with the number of rows of its group in the ``seconds`` up to it, itself included."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("in_window", F.count(F.lit(1)).over(w))


def batches_of(df: DataFrame, order: str, size: int, rows_per_range: int = 1_000_000) -> DataFrame:
    """Each row with its batch number: consecutive batches of ``size`` in the order of the column.

    Global numbers without one task for all rows: rows are numbered within ranges of about ``rows_per_range``, as many as
    the data need, and the ranges are shifted by prefix sums over their counts. Equal values of the column stay in one range.
    """
    scratch = Scratch(df.sparkSession, "batches")
    rows, n = scratch.write_counted(df, "rows")
    parts = max(1, -(-n // rows_per_range))
    ranged = rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    kept = scratch.write(ranged, "ranged")
    first = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return kept.join(F.broadcast(first), "_p").withColumn("batch", F.floor((F.col("_before") + F.col("_k") - 1) / size)).drop("_p", "_k", "_before")
