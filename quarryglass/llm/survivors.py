"""The best representative of each group of duplicates.

Groups come from the paths that duplicate records name. :func:`fused_fields` builds one record per group by iterative
truth discovery: the reliability of sources and the weighted votes for field values are estimated in turn until they
settle. :func:`survivors` chooses a file per field by a fixed order of trust (quality, confirmation, recency), for
where such an order is prescribed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryglass.functions.keys import path_key
from quarryglass.operators.components import connected_components
from quarryglass.operators.places import usable
from quarryglass.plans.cut import Scratch
from quarryglass.plans.salt import salted_join
from quarryglass.plans.sizing import broadcast_if_at_most

SOURCES_BROADCAST = 1_000_000
#: Files that name one path, of which a task takes no more.
NAMING_ROWS = 1_000_000
VOTED = ("make", "model", "lens_model", "iso_speed_ratings")


def last_results(results: DataFrame) -> DataFrame:
    """The row of each file with the latest ``checked_at``; of ties the greatest by (path, duplicate_of, score, confirmed).

    Columns ``file_id, path, named, quality_score, confirmed, checked_at`` with normalised paths; rows without file_id
    give nothing.
    """
    cols = [F.col("checked_at"), path_key(F.col("file_path")).alias("path"), path_key(F.col("duplicate_of")).alias("named"), F.col("quality_score"), F.col("confirmed")]
    last = results.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct(*cols)).alias("r"))
    return last.select("file_id", "r.*")


def duplicate_groups(last: DataFrame) -> DataFrame:
    """``(file_id, group_id)`` of every file in a group of two or more; ``group_id`` is the smallest file of the group.

    Files are tied when one names the other's path or both name the same path. A named path stands for the file that has
    it, or else for the smallest file that names it, so that a path named by very many files gives one edge each, never
    pairs. A path of more than one file stands for the smallest of them.
    """
    naming = last.where("named IS NOT NULL AND (path IS NULL OR named <> path)").select("file_id", "named")
    owner = last.where("path IS NOT NULL").groupBy("path").agg(F.min("file_id").alias("_owner"))
    targets = naming.groupBy("named").agg(F.min("file_id").alias("_first"))
    targets = targets.join(owner, F.col("named") == F.col("path"), "left").select("named", F.coalesce("_owner", "_first").alias("dst"))
    edges = salted_join(naming, targets, ["named"], "file_id", NAMING_ROWS).where("file_id <> dst").select(F.col("file_id").alias("src"), "dst")
    return connected_components(edges).select(F.col("node").alias("file_id"), F.col("component").alias("group_id"))


def _last_images(images: DataFrame, columns: list[str]) -> DataFrame:
    rows = images.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("scanned_at", *columns)).alias("i"))
    return rows.select("file_id", *(F.col(f"i.{c}").alias(c) for c in columns))


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(F.regexp_replace(F.col(c).cast("string"), r"\s+", "")) > 0)


def survivors(results: DataFrame, images: DataFrame) -> DataFrame:
    """``(group_id, field, file_id)``: the file kept of each group, and per field the file that supplies the value.

    Files rank by quality score (0 to 100; null, NaN and others last and equal), confirmed ones first, later checked
    first, smaller id first. ``kept_file`` is the first file; ``model``, ``lens_model``, ``iso_speed_ratings`` come from
    the first file whose value is neither null nor blank, ``latitude`` from the first with a usable position. Files without
    image metadata only compete for ``kept_file``; empty tables give an empty result. Minima of rank structs are taken by
    partial aggregation, however large a group is.
    """
    scratch = Scratch(results.sparkSession, "survivors")
    last = scratch.write(last_results(results), "last")
    groups = duplicate_groups(last.select("file_id", "path", "named"))
    fields = ["model", "lens_model", "iso_speed_ratings", "latitude", "longitude"]
    files = groups.join(last.select("file_id", "quality_score", "confirmed", "checked_at"), "file_id").join(_last_images(images, fields), "file_id", "left")
    q = F.col("quality_score")
    score = F.when(q.between(0, 100) & ~F.isnan(q), -q).otherwise(F.lit(1.0))
    rank = F.struct(score.alias("a"), (~F.coalesce("confirmed", F.lit(False))).alias("b"), F.coalesce(-F.unix_micros("checked_at"), F.lit(2**63 - 1)).alias("c"), F.col("file_id").alias("d"))
    have = {"kept_file": F.lit(True), **{f: _filled(f) for f in fields[:3]}, "latitude": F.coalesce(usable(F.col("latitude"), F.col("longitude")), F.lit(False))}
    best = files.groupBy("group_id").agg(*(F.min(F.when(ok, rank)).alias(f) for f, ok in have.items()))
    pairs = ", ".join(f"'{f}', {f}.d" for f in have)
    return best.selectExpr("group_id", f"stack({len(have)}, {pairs}) AS (field, file_id)").where("file_id IS NOT NULL")


def discover_truth(claims: DataFrame, rounds: int = 20, tolerance: float = 0.0) -> DataFrame:
    """``(object, field, value, support, sources, settled)``: the value of each object and field with the highest support.

    ``claims``: ``(object, field, source, value[, weight])``, strings but for ``object`` and the weight, which is 1 where
    the column is missing. A source's reliability starts at 1; a value's support is the sum, over the sources that claim it,
    of their reliability times the greatest weight of their claims. The reliability becomes ``-ln`` of the share of the
    source's claims that lost, smoothed by half a claim on both sides, so that sources which often lose count little. Rounds
    go on until no reliability moves by more than ``tolerance`` of the greatest one, which ``settled`` tells, or ``rounds``
    are done. Equal supports are settled by the smaller value. Claims with a null anywhere are dropped, repeated claims count
    once, an empty table gives an empty result. One number a round comes to the driver.
    """
    scratch = Scratch(claims.sparkSession, "truth")
    c = claims if "weight" in claims.columns else claims.withColumn("weight", F.lit(1.0))
    c = c.select("object", "field", "source", "value", "weight").na.drop().groupBy("object", "field", "source", "value").agg(F.max("weight").alias("weight"))
    c = scratch.write(c, "claims")
    trust = scratch.write(c.select("source").distinct().select("source", F.lit(1.0).alias("trust")), "trust0")
    support, settled = None, False
    for k in range(1, rounds + 1):
        weighed = c.join(broadcast_if_at_most(trust, SOURCES_BROADCAST), "source")
        votes = weighed.groupBy("object", "field", "value").agg(F.round(F.sum(F.col("trust") * F.col("weight")), 9).alias("support"), F.count(F.lit(1)).alias("sources"))
        winner = F.min(F.struct((-F.col("support")).alias("s"), "value", "sources")).alias("w")
        support = votes.groupBy("object", "field").agg(winner).select("object", "field", F.col("w.value").alias("value"), (-F.col("w.s")).alias("support"), F.col("w.sources").alias("sources"))
        support = scratch.write(support, f"support{k}")
        lost = c.join(support.select("object", "field", F.col("value").alias("_won")), ["object", "field"]).groupBy("source").agg(F.sum((F.col("value") != F.col("_won")).cast("int")).alias("lost"), F.count(F.lit(1)).alias("n"))
        new = lost.select("source", (-F.log((F.col("lost") + 0.5) / (F.col("n") + 1.0))).alias("trust"))
        new = scratch.write(new, f"trust{k}")
        moved = new.withColumnRenamed("trust", "_new").join(trust, "source").agg(F.max(F.abs(F.col("_new") - F.col("trust"))) / F.max("_new")).first()[0]
        trust = new
        settled = moved is None or moved <= tolerance
        if settled:
            break
        if k < rounds:
            scratch.drop(scratch.path(f"support{k}"))
    return support.withColumn("settled", F.lit(settled))


def fused_fields(results: DataFrame, images: DataFrame, rounds: int = 20) -> DataFrame:
    """``(group_id, field, value, support, sources, settled)``: for each group of duplicates the record built by truth discovery.

    The sources are the folders that the files lie in, by their whole path; every file of a group with a value that is
    neither null nor blank claims it, white space around aside. A claim weighs ``1 + score / 100`` (scores outside 0 to 100
    count as 0), twice as much if the file is confirmed, and up to twice as much the later it was checked between the first
    and the last check of its group.
    """
    scratch = Scratch(results.sparkSession, "fused")
    last = scratch.write(last_results(results), "last")
    files = scratch.write(duplicate_groups(last.select("file_id", "path", "named")).join(last, "file_id"), "files")
    at = F.unix_micros("checked_at").cast("double")
    span = files.groupBy("group_id").agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    q = F.col("quality_score")
    weight = (1 + F.when(q.between(0, 100) & ~F.isnan(q), q).otherwise(0.0) / 100) * F.when(F.col("confirmed"), 2.0).otherwise(1.0)
    weight = weight * (1 + F.coalesce(F.try_divide(at - F.col("_from"), F.col("_to") - F.col("_from")), F.lit(0.0)))
    claims = files.join(span, "group_id").withColumn("weight", F.round(weight, 9)).join(_last_images(images, list(VOTED)), "file_id")
    pairs = ", ".join(f"'{f}', trim(cast({f} AS string))" for f in VOTED)
    claims = claims.selectExpr("group_id AS object", "regexp_extract(path, '^(.*)/[^/]*$', 1) AS source", "weight", f"stack({len(VOTED)}, {pairs}) AS (field, value)").where("value <> ''")
    return discover_truth(claims, rounds).withColumnRenamed("object", "group_id").withColumn("support", F.round("support", 6))
