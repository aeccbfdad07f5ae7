"""Rule-based tags in ten categories, as array columns.

Every function takes columns and gives ``ARRAY<STRING>``, never null. Missing inputs count as the rules' defaults: scores
and counts as 0, texts as empty, the brightness of moods as 128.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryglass.functions import vocabulary as V


def tags(*choices: Column) -> Column:
    """The choices that are not null, in order."""
    return F.filter(F.array(*[c.cast("string") for c in choices]), lambda x: x.isNotNull())


def _group_of(name: Column, groups: dict[str, tuple[str, ...]], itself: bool = False) -> Column:
    """The first group with the name among its members (or that is called so)."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for group, members in groups.items():
        out = out.when(name.isin(*members, *([group] if itself else [])), group)
    return out


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def scene_tags(primary: Column, scores: Column) -> Column:
    """The scene, its parent, and other scenes with a score above 0.3 in their order; at most 5."""
    scene = _text(primary)
    known = (scene != "") & (scene != "unknown")
    first = F.array_distinct(tags(F.when(known, scene), F.when(known, _group_of(scene, V.SCENE_PARENTS, itself=True))))
    others = F.transform(F.filter(F.coalesce(F.map_entries(scores), F.array().cast("array<struct<key:string,value:double>>")), lambda e: e["value"] > 0.3), lambda e: F.lower(e["key"]))
    return F.slice(F.concat(first, F.array_except(F.array_distinct(others), first)), 1, 5)


def object_tags(objects: Column) -> Column:
    """The first ten objects, each followed by its group; at most 10, a group as often as it occurs."""
    each = F.transform(F.slice(F.coalesce(objects, F.array().cast("array<string>")), 1, 10), lambda o: tags(F.lower(o), F.concat(F.lit("has_"), _group_of(F.lower(o), V.OBJECT_GROUPS))))
    return F.slice(F.flatten(each), 1, 10)


def quality_tags(score: Column, sharpness: Column, blur: Column) -> Column:
    q, s, b = F.coalesce(score, F.lit(0)), _text(sharpness), F.coalesce(blur, F.lit(0))
    return tags(
        F.when(q >= 90, "excellent_quality").when(q >= 75, "good_quality").when(q >= 60, "fair_quality").otherwise("poor_quality"),
        F.when(F.contains(s, F.lit("very_sharp")) | (s == "sharp"), "sharp").when(F.contains(s, F.lit("very_blurry")), "very_blurry").when(F.contains(s, F.lit("blurry")), "blurry"),
        F.when(b > 500, "crisp").when(b < 100, "soft_focus"),
    )


def color_tags(names: Column, brightness: Column, contrast: Column) -> Column:
    """The first three colour names, each with its tones, then brightness and contrast; at most 6."""
    n = F.filter(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, 3), lambda x: F.coalesce(x, F.lit("")) != "")
    each = F.flatten(F.transform(n, lambda c: tags(F.lower(c), F.concat(_group_of(F.lower(c), V.COLOR_TONES), F.lit("_tones")))))
    b, k = F.coalesce(brightness, F.lit(0)), F.coalesce(contrast, F.lit(0))
    return F.slice(F.concat(each, tags(F.when(b > 180, "bright").when(b < 80, "dark"), F.when(k > 60, "high_contrast").when(k < 30, "low_contrast"))), 1, 6)


def parsed_date(text: Column) -> Column:
    """A date text in one of the three formats as a timestamp, null for others."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in V.DATE_FORMATS))


def temporal_tags(taken: Column) -> Column:
    m, h = F.month(taken), F.hour(taken)
    return tags(
        F.concat(F.lit("year_"), F.year(taken)),
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "fall"),
        F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").when(h.isNotNull(), "night"),
        F.when(F.weekday(taken) >= 5, "weekend"),
    )


def technical_tags(exposure: Column, iso: Column, aperture: Column, flash: Column, camera: Column) -> Column:
    c, brand = _text(camera), F.when(F.lit(False), "")
    for b in V.BRANDS:
        brand = brand.when(F.contains(c, F.lit(b)), b)
    set_ = lambda x, t: F.when(x != 0, t)
    return tags(
        set_(exposure, F.when(exposure < 1 / 500, "fast_shutter").when(exposure > 1, "long_exposure")),
        set_(iso, F.when(iso <= 400, "low_iso").when(iso >= 3200, "high_iso")),
        set_(aperture, F.when(aperture <= 2.8, "wide_aperture").when(aperture >= 11, "narrow_aperture")),
        F.when(F.coalesce(flash, F.lit(False)), "flash_used"),
        brand,
    )


def format_tags(width: Column, height: Column, orientation: Column) -> Column:
    w, h = F.coalesce(width, F.lit(0)).cast("double"), F.coalesce(height, F.lit(0)).cast("double")
    known, ratio = (w > 0) & (h > 0), w / F.nullif(h, F.lit(0.0))
    mp = w * h / 1e6
    return tags(
        F.when(known, F.when(mp >= 20, "high_resolution").when(mp >= 8, "medium_resolution").otherwise("low_resolution")),
        F.when(known, F.when(ratio.between(0.9, 1.1), "square").when(ratio > 1.7, "panoramic").when(ratio > 1.3, "landscape").when(ratio < 0.8, "portrait")),
        F.when(known & ((w >= 3840) | (h >= 2160)), "4k_plus"),
        F.when(orientation.isin(6, 8), "rotated"),
    )


def people_tags(counts: Column, objects: Column, faces: Column) -> Column:
    seen = F.size(F.filter(F.coalesce(objects, F.array().cast("array<string>")), lambda o: o == "person"))
    n = F.coalesce(F.try_element_at(counts, F.lit("person")), seen)
    return tags(
        F.when(n == 0, "no_people").when(n == 1, "single_person").when(n == 2, "couple").when(n <= 5, "small_group").otherwise("crowd"),
        F.when(faces > 0, "has_faces"),
    )


def location_tags(gps: Column, primary: Column) -> Column:
    scene, g = _text(primary), F.coalesce(gps, F.lit(""))
    lat = F.when(F.contains(g, F.lit(",")), F.expr("0.0") + F.coalesce(F.split(g, ",")[0].try_cast("double"), F.lit(0.0))).otherwise(0.0)
    return tags(
        F.when(g != "", "geotagged"),
        F.when(lat > 0, "northern_hemisphere").when(lat < 0, "southern_hemisphere"),
        F.when(scene.isin("indoor", *V.SCENE_PARENTS["indoor"]), "indoor").when(scene.isin("outdoor", *V.SCENE_PARENTS["outdoor"]), "outdoor"),
        F.when(_has_any(scene, V.URBAN), "urban"),
    )


def mood_tags(brightness: Column, names: Column, primary: Column) -> Column:
    b, scene = F.coalesce(brightness, F.lit(128)), _text(primary)
    n = F.transform(F.coalesce(names, F.array().cast("array<string>")), F.lower)
    of = lambda group: F.arrays_overlap(n, F.array(*map(F.lit, group)))
    return tags(
        F.when((b > 150) & of(V.CHEERFUL), "cheerful"),
        F.when((b < 100) & of(V.MOODY), "moody"),
        F.when(_has_any(scene, V.ROMANTIC), "romantic"),
        F.when(_has_any(scene, V.PEACEFUL), "peaceful"),
        F.when(_has_any(scene, V.ENERGETIC), "energetic"),
    )


def within_budget(by_category: dict[str, Column], budget: int = V.MAX_TAGS) -> dict[str, Column]:
    """Cut to ``budget`` tags over all categories, filled in the order of priority, if there are more."""
    total = reduce(lambda a, b: a + b, (F.size(by_category[c]) for c in V.PRIORITY))
    out, used = {}, F.lit(0)
    for c in V.PRIORITY:
        out[c] = F.when(total > budget, F.slice(by_category[c], 1, F.greatest(F.lit(0), budget - used))).otherwise(by_category[c])
        used = used + F.size(by_category[c])
    return out


def flat_tags(by_category: dict[str, Column], budget: int = V.MAX_TAGS) -> Column:
    """The distinct tags in the order of categories, or of priority where the budget cuts."""
    total = reduce(lambda a, b: a + b, (F.size(by_category[c]) for c in V.PRIORITY))
    cut = within_budget(by_category, budget)
    joined = lambda m, order: F.array_distinct(F.flatten(F.array(*(m[c] for c in order))))
    return F.when(total > budget, joined(cut, V.PRIORITY)).otherwise(joined(by_category, V.CATEGORIES))
