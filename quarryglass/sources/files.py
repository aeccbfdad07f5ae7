"""Scans of directories."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryglass.functions.texts import extension
from quarryglass.functions.vocabulary import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS


def is_image(path: Column) -> Column:
    """Whether the suffix is one of a picture, in any case."""
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_video(path: Column) -> Column:
    """Whether the suffix is one of a video, in any case."""
    return extension(path).isin(*VIDEO_EXTENSIONS)


def scan(spark: SparkSession, roots: list[str], recursive: bool = True, content: bool = False, wanted: Callable[[Column], Column] = is_image) -> DataFrame:
    """``(path, modificationTime, length[, content])`` of the pictures (or what is ``wanted``) below the roots, each path once, in the order of paths.

    The bytes are only read if ``content`` is asked for. Roots that don't exist raise; no roots are an error.
    """
    if not roots:
        raise ValueError("At least one source directory is needed")
    read = lambda r: spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(r)
    cols = ["path", "modificationTime", "length", *["content"] * content]
    found = reduce(DataFrame.unionByName, (read(r).select(*cols) for r in roots)).where(wanted(F.col("path")))
    return found.dropDuplicates(["path"]).orderBy("path")


def read_report(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A report of one JSON array, or of JSON ``lines``; unknown keys are dropped, missing ones are null."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines, CSV or Parquet; replaces what is there."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown kind of report {kind}")
    w = df.write.mode("overwrite")
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)
