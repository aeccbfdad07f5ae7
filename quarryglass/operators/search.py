"""Searches over a library of files and their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryglass.functions.vocabulary import RESOLUTION_TERMS


def search_library(
    library: DataFrame, tags: DataFrame, quality: str | None = None, resolution: str | None = None, scene: str | None = None, activity: str | None = None,
    min_duration: float | None = None, max_duration: float | None = None, limit: int | None = 20,
) -> DataFrame:
    """Library rows that meet all given conditions, by quality and duration descending, then id.

    ``library``: ``id, resolution, duration, quality``; ``tags``: ``id, category, tag``. ``quality`` is the tag of a tier
    (high, good, low; others are ignored), ``scene`` and ``activity`` parts of such a tag in any case, ``resolution`` a part of the
    resolution or one of its short names. Empty and zero conditions are not set. Tag conditions are semi-joins.
    """
    out = library
    if quality in ("high", "good", "low"):
        out = out.join(tags.where((F.col("category") == "quality") & (F.col("tag") == f"{quality}-quality")).select("id").distinct(), "id", "left_semi")
    for category, part in (("scene", scene), ("activity", activity)):
        if part:
            out = out.join(tags.where((F.col("category") == category) & F.contains(F.lower("tag"), F.lit(part.lower()))).select("id").distinct(), "id", "left_semi")
    if resolution:
        out = out.where(F.contains("resolution", F.lit(RESOLUTION_TERMS.get(resolution, resolution))))
    if min_duration:
        out = out.where(F.col("duration") >= min_duration)
    if max_duration:
        out = out.where(F.col("duration") <= max_duration)
    out = out.orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("duration"), "id")
    return out if limit is None else out.limit(limit)


def search(
    library: DataFrame, tags: DataFrame, any_tags: list[str] | None = None, categories: dict[str, list[str]] | None = None, no_tags: list[str] | None = None,
    min_duration: float | None = None, max_duration: float | None = None, min_quality: float | None = None, resolution: str | None = None, limit: int | None = None,
) -> DataFrame:
    """All conditions in one call: any of the tags, in every category one of its tags, none of the tags, and the bounds.

    Conditions that are not set hold for all rows. Ordered as :func:`search_library`; without a limit all rows come out.
    """
    out = search_library(library, tags, resolution=resolution, min_duration=min_duration, max_duration=max_duration, limit=None)
    out = with_any_tag(out, tags, any_tags) if any_tags else out
    out = with_categories(out, tags, categories) if categories else out
    if no_tags:
        out = out.join(tags.where(F.col("tag").isin(no_tags)).select("id").distinct(), "id", "left_anti")
    if min_quality is not None:
        out = out.where(F.col("quality") >= min_quality)
    out = out.orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("duration"), "id")
    return out if limit is None else out.limit(limit)


def with_any_tag(library: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows with at least one of the tags."""
    return library.join(tags.where(F.col("tag").isin(wanted)).select("id").distinct(), "id", "left_semi")


def with_categories(library: DataFrame, tags: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows that have, in every category, at least one of its tags."""
    out = library
    for category, names in wanted.items():
        out = out.join(tags.where((F.col("category") == category) & F.col("tag").isin(names)).select("id").distinct(), "id", "left_semi")
    return out


def has_all(tags: Column, wanted: list[str]) -> Column:
    """Whether an array has all of the tags."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(tags, F.array().cast("array<string>")))) == 0
