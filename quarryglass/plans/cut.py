"""Durable cuts of lineage.

A cut writes a DataFrame as Parquet under the folder that the cluster names in ``spark.checkpoint.dir`` and reads it
back, so that a lost executor costs a re-read and no recomputation. Only where that setting is absent and Spark runs in
one process (tests, local mode) is a temporary folder of this machine used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder for cuts. Raises on a cluster without ``spark.checkpoint.dir``."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="quarryglass-")
    return f"file://{_LOCAL_ROOT}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator run below :func:`shared_root`.

    ``write`` returns the written table, ``drop`` removes one that nothing reads any more. What is left is removed when
    the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/quarryglass/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str | None = None, mode: str = "errorifexists", partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(name or uuid.uuid4().hex)
        w = df.write.mode(mode)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        return self.read(path, df)

    def write_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Like ``write``, with the number of rows, which is taken while they are written."""
        seen = Observation()
        self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        try:
            n = seen.get["n"]
        except Py4JJavaError:  # a plan that is empty from the outset loses its metrics
            n = 0
        return self.read(self.path(name), df), n

    def read(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def drop(self, df_or_name: DataFrame | str) -> None:
        names = [df_or_name] if isinstance(df_or_name, str) else []
        if not names:
            files = df_or_name.inputFiles()
            names = {f.rpartition("/")[0] for f in files}
        for n in names:
            _delete(self.spark, n)

    def _clean(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
