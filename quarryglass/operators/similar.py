"""Near-duplicates by Hamming distance of 64-bit hashes or cosine distance of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryglass.functions.keys import hamming
from quarryglass.operators.components import connected_components
from quarryglass.operators.hamming_balls import ball_pairs
from quarryglass.plans.cut import Scratch
from quarryglass.plans.salt import salted_join

#: Blocking keys of a value up to which pairs are found by them.
MOST_KEYS = 200


def block_masks(distance: int, bands: int) -> list[int]:
    """Masks of 64 bits such that two values within ``distance`` bits agree under at least one of them.

    The bits are cut into ``bands`` runs; at most ``distance`` runs hold a difference, so some choice of
    ``bands - distance`` runs holds none.
    """
    if not 0 <= distance < bands <= 64:
        raise ValueError("0 <= distance < bands <= 64 is needed")
    at = [64 * k // bands for k in range(bands + 1)]
    runs = [((1 << b) - (1 << a)) for a, b in zip(at, at[1:])]
    masks = [sum(c) for c in combinations(runs, bands - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_keys(values: DataFrame, distance: int, bands: int) -> DataFrame:
    """``(mask_no, key, value)``: the blocking keys of each BIGINT ``value``."""
    # one expression in SQL: built from columns, dozens of calls to the JVM would cost more than the query on small inputs
    masks = ", ".join(f"struct({k} AS mask_no, value & cast({m} AS bigint) AS key)" for k, m in enumerate(block_masks(distance, bands)))
    return values.selectExpr("value", f"explode(array({masks})) AS m").select("m.mask_no", "m.key", "value")


def hamming_value_pairs(values: DataFrame, distance: int, bands: int | None = None, rows_per_task: int = 20_000) -> DataFrame:
    """``(a, b, bits)``, a < b: all pairs of distinct values of the BIGINT column ``value`` within ``distance`` bits.

    Exact, by :func:`block_masks` (``distance + 2`` bands unless given) and a check of each pair that shares a key; of several
    shared keys only the first gives the pair. A key of very many values is split over tasks. A negative distance gives none. Null values match nothing.
    Where a value would have more than ``MOST_KEYS`` keys, these are many and short, and :func:`ball_pairs` finds the pairs.
    """
    spark = values.sparkSession
    if distance < 0:
        return spark.createDataFrame([], "a bigint, b bigint, bits int")
    bands = bands or min(64, distance + 2)
    known = values.where("value IS NOT NULL").select("value").distinct()
    if distance < bands <= 64 and comb(bands, distance) > MOST_KEYS:
        return ball_pairs(known, distance)
    keys = block_keys(known, distance, bands)
    keys = Scratch(spark, "blocks").write(keys)
    met = salted_join(keys.withColumnRenamed("value", "a"), keys.withColumnRenamed("value", "b"), ["mask_no", "key"], "a", rows_per_task)
    bits = hamming(F.col("a"), F.col("b")).cast("int")
    near = met.where((F.col("a") < F.col("b")) & (bits <= distance))
    masks = ", ".join(f"CAST({m} AS BIGINT)" for m in block_masks(distance, bands))
    first = near.where(f"NOT exists(slice(array({masks}), 1, mask_no), m -> ((a ^ b) & m) = 0)")
    return first.select("a", "b", bits.alias("bits"))


def similar_groups(files: DataFrame, distance: int, bands: int | None = None) -> DataFrame:
    """``(file_id, group_id, links)`` of every file in a group of two or more of near-duplicates.

    ``files``: ``(file_id, bits)``. Files with the same hash are one class, linked once; ``group_id`` is the smallest file of
    the component, ``links`` the number of other files within ``distance`` of the file.
    """
    scratch = Scratch(files.sparkSession, "similar")
    f = scratch.write(files.select("file_id", "bits").where("file_id IS NOT NULL AND bits IS NOT NULL").distinct(), "files")
    classes = scratch.write(f.groupBy("bits").agg(F.min("file_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    pairs = scratch.write(hamming_value_pairs(classes.select(F.col("bits").alias("value")), distance, bands), "pairs")
    of = lambda c: classes.select(F.col("bits").alias(c), F.col("rep").alias(f"rep_{c}"))
    edges = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst"))
    alone = classes.where("n > 1").select(F.col("rep").alias("src"), F.col("rep").alias("dst"))
    parts = connected_components(edges.union(alone)).withColumnRenamed("node", "rep")
    near = pairs.select(F.col("a").alias("bits"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = near.join(classes.select(F.col("bits").alias("other"), F.col("n").alias("m")), "other").groupBy("bits").agg(F.sum("m").alias("m"))
    sized = classes.join(parts, "rep").join(near, "bits", "left").select("bits", F.col("component").alias("group_id"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return f.join(sized, "bits").select("file_id", "group_id", "links")


def cosine_pairs(vectors: DataFrame, most: float, block: int = 2_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(a, b, distance)``, a < b: all pairs of vectors at a cosine distance of at most ``most``.

    Exact, block against block: the vectors of each dimension are dealt to blocks of about ``block``, every pair of blocks is
    one task's matrix product, and only pairs within the distance leave it. Null and empty vectors and vectors of length 0
    match nothing, nor do vectors of different dimensions.
    """
    scratch = Scratch(vectors.sparkSession, "cosine")
    v = scratch.write(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0").withColumn("dim", F.size("v")), "vectors")
    dealt = v.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    v = v.join(dealt, "dim").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = v.withColumn("other", F.explode(F.sequence(F.col("blk"), F.col("blocks") - 1))).select("dim", F.col("blk").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "id", "v")
    right = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blk")))).select("dim", F.col("other").alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), "id", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        def unit(side: int) -> tuple[np.ndarray, np.ndarray]:
            p = pdf[pdf["side"] == side]
            m = np.stack(p["v"].to_numpy()) if len(p) else np.zeros((0, 1))
            norm = np.linalg.norm(m, axis=1)
            ok = norm > 0
            return p["id"].to_numpy(np.int64)[ok], m[ok] / norm[ok, None]

        (a, x), (b, y) = unit(0), unit(1)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        d = 1.0 - x @ y.T
        p, q = np.nonzero(d <= most)
        lo, hi = np.minimum(a[p], b[q]), np.maximum(a[p], b[q])
        return pd.DataFrame({"a": lo, "b": hi, "distance": d[p, q]})[lo != hi]

    met = left.union(right).groupBy("dim", "i", "j").applyInPandas(compare, "a bigint, b bigint, distance double")
    return met.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def cosine_clusters(vectors: DataFrame, most: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, cluster)`` of every vector: components of pairs within ``most``, numbered from 0 by their smallest id.

    The same as density clustering in which one point makes a cluster. A vector without a near one is a cluster by itself.
    """
    parts = connected_components(cosine_pairs(vectors, most, id_col=id_col, vec_col=vec_col), "a", "b")
    all_ = vectors.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().join(parts.withColumnRenamed("node", "id"), "id", "left")
    return all_.select("id", F.coalesce("component", "id").alias("cluster"))
