"""Tables of a library workflow: previews, manifests, what would be copied or removed, and roll-ups of what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryglass.functions.texts import base_name
from quarryglass.operators.summaries import share


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def check_folders(sources: list[str], end: str, backup: str | None = None) -> None:
    """Raise ``ValueError`` where no source is given, or a target lies in a source or a source in a target."""
    if not sources:
        raise ValueError("At least one source directory is needed")
    inside = lambda a, b: (a.rstrip("/") + "/").startswith(b.rstrip("/") + "/")
    for s in sources:
        for t in filter(None, (end, backup)):
            if inside(s, t) or inside(t, s):
                raise ValueError(f"{t} and {s} overlap")


def preview(files: DataFrame, first: int = 10) -> DataFrame:
    """``(directory, files, total, place, path)``: the files of every directory and of all, and the first ones by path.

    A row per directory with null ``place`` and ``path``, and a row per listed file with a null ``directory``.
    """
    n = files.groupBy(directory(F.col("path")).alias("directory")).agg(F.count(F.lit(1)).alias("files"))
    whole = files.agg(F.count(F.lit(1)).alias("total"))
    none = F.lit(None)
    counts = n.select("directory", "files", none.cast("bigint").alias("total"), none.cast("int").alias("place"), none.cast("string").alias("path"))
    head = files.orderBy("path").limit(first).select("path").withColumn("place", F.row_number().over(Window.orderBy("path")))
    listed = head.select(none.cast("string").alias("directory"), none.cast("bigint").alias("files"), none.cast("bigint").alias("total"), "place", "path")
    return counts.union(whole.select(none.cast("string"), none.cast("bigint"), "total", none.cast("int"), none.cast("string"))).union(listed)


def backup_plan(files: DataFrame, source: str, backup: str, stamp: str) -> DataFrame:
    """``(path, backup_path)``: ``<backup>/backup_<stamp>/<name of the source>/<place below it>``; flat for files elsewhere."""
    root = f"{backup.rstrip('/')}/backup_{stamp}/"
    below = F.substring(F.col("path"), F.lit(len(source.rstrip("/")) + 2), F.lit(2**31 - 1))
    kept = F.concat(F.lit(root + source.rstrip("/").rpartition("/")[2] + "/"), below)
    return files.select("path", F.when(F.startswith("path", F.lit(source.rstrip("/") + "/")), kept).otherwise(F.concat(F.lit(root), base_name(F.col("path")))).alias("backup_path"))


def manifest(files: DataFrame, backups: DataFrame, moved: DataFrame) -> DataFrame:
    """``(directory, path, backup_path, destination)`` of every file: a row each, so that no directory is one row's list."""
    return files.select(directory(F.col("path")).alias("directory"), "path").join(backups, "path", "left").join(moved, "path", "left")


def delete_plan(files: DataFrame, digest: str, kept: DataFrame) -> DataFrame:
    """``(path, digest, kept_path, size)`` of the files that go: those of a set of duplicates other than its survivor."""
    return files.join(kept.select(digest, "kept_path"), digest).where("path <> kept_path").select("path", digest, "kept_path", F.coalesce("size", F.lit(0)).alias("size"))


def embed_stats(plan: DataFrame) -> DataFrame:
    """One row over ``(tags, error)``: processed, skipped (no tags), errors, tags written and their mean per written file."""
    some = F.coalesce(F.size("tags"), F.lit(0)) > 0
    done = some & F.col("error").isNull()
    written = F.coalesce(F.sum(F.when(done, F.size("tags"))), F.lit(0)).cast("bigint")
    return plan.agg(F.count_if(done).alias("processed"), F.count_if(~some).alias("skipped"), F.count_if(some & F.col("error").isNotNull()).alias("errors"), written.alias("tags_written"), F.round(F.coalesce(F.try_divide(written, F.count_if(done)), F.lit(0.0)), 4).alias("mean_tags"))


def batch_rollup(results: DataFrame, batch: str) -> DataFrame:
    """Per batch: files, processed and failed ones, duplicates, kept and deleted ones, and the share that failed in percent."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("error").isNotNull())
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return results.groupBy(batch).agg(n.alias("total_files"), (n - bad).alias("files_processed"), bad.alias("files_failed"), yes("is_duplicate").alias("duplicates_found"), yes("kept").alias("kept"), yes("deleted").alias("deleted"), share(bad, n).alias("failed_pct"))


def face_filter(faces: Column, which: str = "all") -> Column:
    """``all``, ``some`` (more than none) or ``none``; a missing count is 0."""
    n = F.coalesce(faces, F.lit(0))
    return {"all": F.lit(True), "some": n > 0, "none": n == 0}[which]


def face_record(boxes: Column, error: Column) -> Column:
    """``(count, has_faces, boxes, error)`` from detections; a failure has 0 faces and keeps its error."""
    none = F.array().cast("array<struct<object:string,confidence:double>>")
    b = F.when(error.isNotNull(), none).otherwise(F.coalesce(boxes, none))
    return F.struct(F.size(b).alias("count"), (F.size(b) > 0).alias("has_faces"), b.alias("boxes"), error.alias("error"))


def face_stats(df: DataFrame, faces: str) -> DataFrame:
    """One row: files, those with faces and their share in percent, faces, and their mean over files with any."""
    some = F.col(faces) > 0
    n = F.count(F.lit(1))
    return df.agg(n.alias("files"), F.count_if(some).alias("with_faces"), share(F.count_if(some), n).alias("with_faces_pct"), F.coalesce(F.sum(faces), F.lit(0)).cast("bigint").alias("faces"), F.round(F.coalesce(F.avg(F.when(some, F.col(faces))), F.lit(0.0)), 4).alias("mean_faces"))


#: What a processor says of each row: whether it went well; an exception of a row is a null.
Processor = Callable[[DataFrame], Column]


def chained(df: DataFrame, processors: list[Processor], name: str = "ok") -> DataFrame:
    """The rows with the last processor's word. A null (a failure) makes it false, and later processors are not asked."""
    out, broken = F.lit(True), F.lit(False)
    for p in processors:
        said = p(df)
        out = F.when(broken, F.lit(False)).otherwise(F.coalesce(said, F.lit(False)))
        broken = broken | said.isNull()
    return df.withColumn(name, out)
