"""Captions, names, hashes and readings of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryglass.functions import vocabulary as V


def join_present(separator: str, *parts: Column) -> Column:
    """The parts that are not null, joined."""
    return F.concat_ws(separator, *parts)


def caption(scene: Column, objects: Column, score: Column, taken: Column, gps: Column) -> Column:
    """``Scene. containing a, b. good quality. taken on 2024-03-15. at 1, 2``; ``Photo`` without any part.

    As a sentence: the first letter upper case, all others lower.
    """
    few = F.slice(F.filter(objects, lambda o: o.isNotNull()), 1, 5)
    s = join_present(
        ". ",
        F.nullif(scene, F.lit("")),
        F.when(F.size(few) > 0, F.concat(F.lit("containing "), F.array_join(few, ", "))),
        F.when(score >= 80, "high quality").when(score >= 60, "good quality"),
        F.concat(F.lit("taken on "), F.date_format(taken, "yyyy-MM-dd")),
        F.concat(F.lit("at "), gps),
    )
    return F.when(s == "", "Photo").otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1))))


def description(score: Column, sharpness: Column) -> Column:
    """``Quality: 85/100, Sharpness: sharp`` of what is present."""
    return join_present(", ", F.concat(F.lit("Quality: "), score.cast("string"), F.lit("/100")), F.concat(F.lit("Sharpness: "), sharpness))


def plain_number(x: Column) -> Column:
    """A number as text without an exponent, with at least one and at most twelve decimals."""
    return F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")


def camera_info(f_number: Column, exposure: Column, iso: Column, focal: Column) -> Column:
    """``f/2.8, 0.01s, ISO 400, 50.0mm`` of what is present."""
    return join_present(
        ", ",
        F.concat(F.lit("f/"), plain_number(f_number)),
        F.concat(plain_number(exposure), F.lit("s")),
        F.concat(F.lit("ISO "), iso.cast("string")),
        F.concat(plain_number(focal), F.lit("mm")),
    )


def sanitized(name: Column) -> Column:
    """Without characters that file systems reject; spaces as ``_``, runs of ``_`` once, none at the ends."""
    kept = F.replace(F.translate(name, V.INVALID_IN_NAMES, ""), F.lit(" "), F.lit("_"))
    return F.regexp_replace(F.regexp_replace(kept, "_{2,}", "_"), "^_+|_+$", "")


def extension(path: Column) -> Column:
    """The last suffix of a path in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


#: Directives of strftime and what Spark calls them.
_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "DDD", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh"}


def formatted(ts: Column, pattern: str) -> Column:
    """A timestamp by a strftime pattern; text outside the directives stays as it is."""
    out, k = [], 0
    while k < len(pattern):
        d = pattern[k : k + 2]
        if d in _DIRECTIVES:
            out.append(F.date_format(ts, _DIRECTIVES[d]))
            k += 2
        else:
            out.append(F.lit(pattern[k]))
            k += 1
    return F.concat(*out) if out else F.lit("")


def patterned_name(pattern: str, ts: Column, camera: Column, tags: Column, path: Column, longest: int = 200, date: str = "%Y-%m-%d", time: str = "%H%M%S", stamp: str = "%Y-%m-%d_%H%M%S") -> Column:
    """A file name from a pattern with ``{date} {time} {datetime} {year} {month} {day} {camera} {tags}`` and the old suffix.

    A placeholder whose value is null stays as it is. Too long names lose the end of their stem.
    """
    name = F.lit(pattern)
    values = {
        "datetime": formatted(ts, stamp), "date": formatted(ts, date), "time": formatted(ts, time),
        "year": formatted(ts, "%Y"), "month": formatted(ts, "%m"), "day": formatted(ts, "%d"),
        "camera": F.replace(camera, F.lit(" "), F.lit("-")),
        "tags": sanitized(F.array_join(F.slice(tags, 1, 3), "_")),
    }
    for key, v in values.items():
        if "{" + key + "}" in pattern:
            name = F.replace(name, F.lit("{" + key + "}"), F.coalesce(v, F.lit("{" + key + "}")))
    # one lambda, so that the name is worked out once and not at each place that needs it
    parts = F.struct(sanitized(F.concat(name, extension(path))).alias("full"), extension(path).alias("ext"))

    def cut(p: Column) -> Column:
        full, ext = p["full"], p["ext"]
        stem = F.substring(full, F.lit(1), F.greatest(F.lit(0), F.length(full) - F.length(ext)))
        return F.when(F.length(full) <= longest, full).otherwise(F.concat(F.substring(stem, F.lit(1), F.greatest(F.lit(0), longest - F.length(ext) - 10)), ext))

    return F.get(F.transform(F.array(parts), cut), F.lit(0))


NAME_PATTERN = r"(?i)^img_(\d{8}_\d{6})_([a-f0-9]{8})\.(\w+)$"


def valid_name(name: Column) -> Column:
    """Whether a name is ``img_<timestamp>_<8 hex digits>.<extension>`` with a real date and a known extension."""
    stamp = F.try_to_timestamp(F.regexp_extract(name, NAME_PATTERN, 1), F.lit("yyyyMMdd_HHmmss"))
    ext = F.lower(F.regexp_extract(name, NAME_PATTERN, 3))
    return F.coalesce(name.rlike(NAME_PATTERN) & stamp.isNotNull() & ext.isin(*V.NAME_EXTENSIONS), F.lit(False))


def generated_name(ts: Column, key: Column, ext: Column, prefix: str = "img", digits: int = 8) -> Column:
    """A name as :func:`valid_name` accepts; its hex digits come from a hash of the key, so that runs agree."""
    n = max(4, min(32, digits))
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(key.cast("string")), 1, n), F.lit("."), F.lower(ext))


def fingerprint(name: Column, size: Column, mtime: Column) -> Column:
    """MD5 over a file's name, size and time of change in microseconds."""
    return F.md5(F.concat_ws(":", name, size.cast("string"), F.round(mtime * 1e6).cast("bigint").cast("string")))


def quick_hash(content: Column, sample: int = 8192) -> Column:
    """MD5 over the size, the first ``sample`` bytes, and the last ones of contents longer than twice that."""
    n = F.octet_length(content)
    last = F.when(n > 2 * sample, F.substring(content, n - sample + 1, F.lit(sample))).otherwise(F.to_binary(F.lit(""), F.lit("hex")))
    return F.md5(F.concat(F.encode(n.cast("string"), "utf-8"), F.substring(content, 1, sample), last))


def seconds_text(s: Column) -> Column:
    """``45s``, ``2.5m``, ``1.5h``; null for null. Minutes and hours round the exact binary value, as printf does."""
    d = s.cast("double")
    tenths = lambda x: F.call_function("format_number", x, F.lit("0.0"))
    return F.when(d < 60, F.concat(F.round(d, 0).cast("bigint").cast("string"), F.lit("s"))).when(d < 3600, F.concat(tenths(d / 60), F.lit("m"))).otherwise(F.concat(tenths(d / 3600), F.lit("h")))


def named_objects(answer: Column) -> Column:
    """The items of a comma-separated model answer: trimmed, lower case, without empty ones."""
    return F.filter(F.transform(F.split(answer, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def first_word(answer: Column) -> Column:
    """The first word of a model's answer in lower case; ``unknown`` for null and blank."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(answer, r"^\s*(\S+)", 1)), F.lit("")), F.lit("unknown"))


def status_text(**parts: Column) -> Column:
    """``name: value`` of the parts that are not null, joined by a spaced bar."""
    return join_present(" | ", *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in parts.items()))


def product_names(objects: Column) -> Column:
    """The objects that speak of a product."""
    return F.filter(objects, lambda o: F.exists(F.array(*map(F.lit, V.PRODUCTS)), lambda p: F.contains(o, p)))


def searchable_tags(answer: Column, most: int = 5) -> Column:
    """The first distinct words of more than two letters."""
    words = F.transform(F.split(F.lower(answer), r"[\s,]+"), lambda w: F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+$", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$"))), 1, most)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees, negative for S and W."""
    d = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -d).otherwise(d)


def snake_case(name: Column) -> Column:
    """``DateTimeOriginal`` as ``date_time_original``."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
