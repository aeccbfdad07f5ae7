"""The cache of analyses as snapshots of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryglass.operators.assets import upserted

SCHEMA = "file_path string, file_hash string, file_size bigint, file_mtime double, analysis_json string, cached_at string, cache_version int"


class AnalysisCache:
    """Snapshots ``<root>/v=<n>``; the newest is the cache. A write never touches the snapshot it reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = lambda s: fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and done(s))

    def read(self) -> DataFrame:
        """The newest snapshot; empty before the first write."""
        v = self._versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/v={v[-1]}") if v else self.spark.createDataFrame([], SCHEMA)

    def _write(self, df: DataFrame) -> None:
        v = self._versions()
        df.write.parquet(f"{self.root}/v={(v[-1] if v else 0) + 1}")

    def put(self, rows: DataFrame) -> None:
        """Insert or replace by path; of several rows of a path the one with the latest ``cached_at``."""
        last = rows.groupBy("file_path").agg(F.max_by(F.struct(*rows.columns), "cached_at").alias("_r")).select("_r.*")
        self._write(upserted(self.read(), last, "file_path"))

    def invalidate(self, paths: DataFrame) -> None:
        self._write(self.read().join(paths.select("file_path").distinct(), "file_path", "left_anti"))

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))

    def stats(self) -> DataFrame:
        """``(entries, total_size, oldest, newest)``; 0 for an empty cache."""
        return cache_stats(self.read())


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))
