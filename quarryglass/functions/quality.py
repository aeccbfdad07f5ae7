"""Scores and levels of picture statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryglass.functions.vocabulary import EXPOSURE, SHARPNESS


def _level(value: Column, steps: tuple, last: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for below, name in steps:
        out = out.when(value < below, name)
    return out.otherwise(last)


def sharpness_level(variance: Column) -> Column:
    """Of the variance of the Laplacian; null for null."""
    return _level(variance, SHARPNESS, "very_sharp")


def exposure_level(brightness: Column) -> Column:
    """Of the mean brightness; null for null."""
    return _level(brightness, EXPOSURE, "overexposed")


def quality_score(noise: Column, spread: Column, brightness: Column, contrast: Column) -> Column:
    """0 to 100 from noise, dynamic range, brightness and contrast; null if any of them is."""
    d = lambda x: x.cast("double")
    parts = (
        0.3 * F.greatest(F.lit(0.0), 100.0 - 2.0 * d(noise))
        + 0.2 * F.least(F.lit(100.0), d(spread) / 255.0 * 100.0)
        + 0.3 * (100.0 - F.abs(127.5 - d(brightness)) / 1.275)
        + 0.2 * F.least(F.lit(100.0), d(contrast) / 70.0 * 100.0)
    )
    known = noise.isNotNull() & spread.isNotNull() & brightness.isNotNull() & contrast.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(100.0), parts)))


def color_temperature(warmth: Column) -> Column:
    """Of (red - blue) / 255; null for null."""
    return F.when(warmth > 0.1, "warm").when(warmth < -0.1, "cool").when(warmth.isNotNull(), "neutral")


def quality_tier(score: Column) -> Column:
    """high from 90, good from 70, else low; null for null."""
    return F.when(score >= 90, "high").when(score >= 70, "good").when(score.isNotNull(), "low")


def quality_band(score: Column) -> Column:
    """excellent from 90, good from 75, fair from 60, else poor; null for null."""
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score.isNotNull(), "poor")
