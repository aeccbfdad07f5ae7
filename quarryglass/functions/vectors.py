"""Vectors, logits and detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    d = lambda x: x.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null where either has no length."""
    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax_label(scores: Column, labels: tuple[str, ...]) -> Column:
    """The label of the greatest score, the first of equals; ``unknown`` for null or none."""
    at = F.array_position(scores, F.array_max(scores))
    return F.coalesce(F.get(F.array(*map(F.lit, labels)), (at - 1).cast("int")), F.lit("unknown"))


def kept_detections(objects: Column, least: float = 0.6) -> Column:
    """Detections of at least that confidence."""
    return F.filter(objects, lambda o: o["confidence"] >= least)


def distinct_labels(objects: Column) -> Column:
    """Labels in the order of their first occurrence."""
    return F.array_distinct(F.transform(objects, lambda o: o["object"]))


def label_counts(objects: Column) -> Column:
    """How often each label occurs, as a map in that order."""
    names = F.transform(objects, lambda o: o["object"])
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.size(F.filter(names, lambda m: m == n)))))


def quick_tags(scene: Column, labels: Column, most: int = 5) -> Column:
    """The scene and the first labels."""
    return F.filter(F.concat(F.array(scene), F.slice(labels, 1, most)), lambda x: x.isNotNull())
