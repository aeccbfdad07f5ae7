"""Collision-free renaming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryglass.plans.cut import Scratch


def rename_plan(files: DataFrame, wanted: str = "wanted", order: str = "path", suffix: str = "_%03d") -> DataFrame:
    """``(path, new_name, seq)``: a name of its own for every file that wants one.

    In the order of ``order`` the first file that wants a name gets it, the next ones the name with a suffix before the
    extension. Where a suffixed name is itself wanted by a file, that file keeps its name and the numbers of the group skip
    it. Numbers have no upper bound. ``suffix`` holds one ``%d`` or ``%03d`` with a character other than a digit before it,
    so that names of different groups never agree.
    """
    parts = re.fullmatch(r"([^%]*[^%\d])%(?:0\d+)?d([^%\d][^%]*|)", suffix)
    if not parts:
        raise ValueError("a suffix such as _%03d is needed")
    # written, as the names are read twice
    base = Scratch(files.sparkSession, "names").write(files.where(F.col(wanted).isNotNull()).select(F.col(order).alias("path"), F.col(wanted).alias("w")))
    ext = F.regexp_extract("w", r"[^/\\](\.[^./\\]*)$", 1)

    # the wanted names that a group could generate, as the group's name and the number; the greedy stem leaves the last digits
    numbered = rf"(?s)^(.*){re.escape(parts[1])}([0-9]+){re.escape(parts[2])}$"
    names = base.select("w").distinct().select("w", ext.alias("_ext"))
    names = names.withColumn("_stem", F.expr("substring(w, 1, length(w) - length(_ext))")).where(F.col("_stem").rlike(numbered))
    number = F.regexp_extract("_stem", numbered, 2)
    names = names.select(F.concat(F.regexp_extract("_stem", numbered, 1), F.col("_ext")).alias("w"), number.try_cast("int").alias("_n"), number.alias("_digits"))
    digits = F.format_string("%" + re.search(r"%((?:0\d+)?d)", suffix)[1], F.col("_n"))
    taken = names.where((F.col("_n") > 0) & (digits == F.col("_digits"))).select(F.lit(None).cast(base.schema["path"].dataType).alias("path"), "w", F.lit(1).alias("_taken"), "_n")

    # a taken number t, the j-th of its group, has t - j free ones below it; file k (from 0) is moved on by the taken ones that have fewer than k
    rows = base.select("path", "w", F.lit(0).alias("_taken"), F.lit(None).cast("int").alias("_n")).union(taken).repartition("w")
    first = Window.partitionBy("w").orderBy("_taken", "path", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.row_number().over(Window.partitionBy("w").orderBy("_taken", "path", "_n")) - 1
    rows = rows.withColumn("_k", k).withColumn("_j", F.sum("_taken").over(first))
    rows = rows.withColumn("_at", F.when(F.col("_taken") == 0, F.col("_k")).otherwise(F.col("_n") - F.col("_j")))
    passed = F.sum("_taken").over(Window.partitionBy("w").orderBy("_at", "_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    plan = rows.withColumn("seq", (F.col("_k") + passed).cast("int")).where("_taken = 0").withColumn("_ext", ext)
    stem = F.expr("substring(w, 1, length(w) - length(_ext))")
    new_name = F.when(F.col("seq") == 0, F.col("w")).otherwise(F.concat(stem, F.format_string(suffix, F.col("seq")), F.col("_ext")))
    return plan.select("path", new_name.alias("new_name"), "seq")
