"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryglass.plans.cut import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node BIGINT, component BIGINT)`` for every node of an edge, the component being its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until a round changes nothing. Each round is cut by
    a written table; only a row count and a checksum come to the driver. Minima are taken by partial aggregation, so a
    node that holds a large part of the edges is no hot task; the join back is left to adaptive skew handling.

    Edges with a null end are dropped, loops give a component of one, repeated edges count once, an empty table gives
    an empty result. Other columns are ignored.
    """
    scratch = Scratch(edges.sparkSession, "components")
    raw = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    raw = scratch.write(raw, "edges")
    loops = raw.where("u = v").select(F.col("u").alias("node"))
    cur = scratch.write(_small_star(raw.where("u <> v")), "round0")
    seen, k = None, 0
    while True:
        sign = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen or sign[0] == 0:
            break
        seen, k = sign, k + 1
        nxt = scratch.write(_small_star(_large_star(cur)), f"round{k}")
        scratch.drop(scratch.path(f"round{k - 1}"))
        cur = nxt
    labels = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).union(loops).distinct().join(labels, "node", "left_anti")
    return labels.union(roots.select("node", F.col("node").alias("component")))
