"""Texts of dates and times as instants.

Digits of any script and full-width forms are folded to ASCII, then a text is reduced to its *shape mask* (digits become
``9``, letters ``a``, the rest stays). Every distinct mask is turned
into a parser once per worker; as a mask fixes the place of each field, a parser reads all texts of its mask at once,
as columns of a character matrix. Local readings go through tables of zone transitions made from the IANA database.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import metadata
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DAY_US = 86_400_000_000
#: Years for which transitions are tabulated. No zone had a standard time before; the last 28 of them hold every kind of
#: year (its first weekday, leap or not) and stand for all later ones, as by then zones follow yearly rules only.
TABLE_YEARS = (1840, 2140)

_TIME = r"(?P<H>99?)(?::|時)(?P<M>99)(?:(?::|分)(?P<S>99)秒?|分)?(?:[.,](?P<f>9{1,9}))?(?: ?(?P<ap>aa)(?= |$))?"
_ZONE = r"(?: *(?P<off>[+\-−]99(?::?99)?))?(?: *\[?(?P<name>a[a9_/+\-]*)\]?)?"
_SEP = r"(?: *(?P<T>a) *| +|_)"
#: What a mask may look like. With slashes the month stands first, with dots the day, unless a year of four digits does.
SHAPES = tuple(
    re.compile(x)
    for x in (
        rf"(?P<Y>9999)(?P<s>[:\-/.])(?P<m>99?)(?P=s)(?P<d>99?){_SEP}{_TIME}{_ZONE}",
        rf"(?P<Y>9999)年(?P<m>99?)月(?P<d>99?)日 *{_TIME}{_ZONE}",
        rf"(?P<m>99?)/(?P<d>99?)/(?P<Y>9999),?{_SEP}{_TIME}{_ZONE}",
        rf"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999),?{_SEP}{_TIME}{_ZONE}",
        rf"(?:(?P<dow>aaa), *)?(?P<d>99?)(?P<s>[ \-])(?P<mon>aaa)(?P=s)(?P<Y>9999),?{_SEP}{_TIME}{_ZONE}",
        rf"(?P<dow>aaa) (?P<mon>aaa) {{1,2}}(?P<d>99?) {_TIME} (?:(?P<name>aaa) )?(?P<Y>9999)",
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<T>a)|[_ ])(?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9{1,9}))?" + _ZONE,
        r"(?P<n>9{1,19})(?:\.(?P<f>9{1,9}))?",
    )
)


@lru_cache(1)
def _plain_forms() -> tuple[str, str]:
    """Characters and what they fold to: full-width forms, odd spaces, and the decimal digits of all scripts."""
    wide = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
    white = {chr(c): " " for c in (0x3000, 0x00A0, 0x202F, *range(0x2000, 0x200B))}
    digits = {chr(c): str(v) for c in range(0x80, sys.maxunicode + 1) if (v := unicodedata.decimal(chr(c), None)) is not None}
    forms = wide | white | digits
    return "".join(forms), "".join(forms.values())


def folded(text: Column) -> Column:
    """With ASCII for full-width forms, digits of other scripts, and spaces of other widths."""
    return F.translate(text, *_plain_forms())


def mask_of(text: Column) -> Column:
    """The shape mask of a trimmed and folded text."""
    return F.translate(text, DIGITS + LETTERS, "9" * 10 + "a" * 52)


def trimmed(text: Column) -> Column:
    """Without white space, NUL or byte-order marks at the ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\0\u00a0\ufeff"))


@lru_cache(1)
def zone_version() -> str:
    """Of the time zone database in use."""
    for d in TZPATH:
        if (p := Path(d, "tzdata.zi")).exists():
            return p.open().readline().split()[-1]
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "unknown"


@dataclass(frozen=True)
class Transitions:
    """Instants (µs) at which a zone's offset changes, and the offsets (µs) before and after each."""

    at: np.ndarray
    offsets: np.ndarray

    def to_utc(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC of local readings, and which of them occur exactly once. Readings after the table go by a year alike in it."""
        late = local >= _year_start(TABLE_YEARS[1]) - DAY_US
        if late.any():
            moved = _alike(local[late])
            near, once = self.to_utc(np.concatenate([local[~late], local[late] - moved]))
            utc, single = np.empty(len(local), np.int64), np.empty(len(local), bool)
            n = int((~late).sum())
            utc[~late], utc[late], single[~late], single[late] = near[:n], near[n:] + moved, once[:n], once[n:]
            return utc, single
        before, after = self.offsets[:-1], self.offsets[1:]
        starts, ends = self.at + np.minimum(before, after), self.at + np.maximum(before, after)
        i = np.searchsorted(ends, local, side="right")
        once = np.ones(len(local), bool)
        if len(starts):
            inside = i < len(starts)
            once[inside] = local[inside] < starts[i[inside]]
        return local - self.offsets[i], once


def _year_start(year: int) -> int:
    return (datetime(year, 1, 1, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _alike(local: np.ndarray) -> np.ndarray:
    """How far (µs) to move readings back to the year of the same kind among the 28 before the table's last."""
    starts = (local // DAY_US).astype("datetime64[D]").astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
    ends = ((local // DAY_US).astype("datetime64[D]").astype("datetime64[Y]") + 1).astype("datetime64[D]").astype(np.int64)
    kinds = {}
    for y in range(TABLE_YEARS[1] - 29, TABLE_YEARS[1] - 1):
        day = _year_start(y) // DAY_US
        kinds[day % 7, _year_start(y + 1) // DAY_US - day] = day
    target = np.array([kinds[k] for k in zip((starts % 7).tolist(), (ends - starts).tolist())], np.int64)
    return (starts - target) * DAY_US


@lru_cache(None)
def _zone_names() -> dict[str, str]:
    return {x.lower(): x for x in available_timezones()}


@lru_cache(None)
def transitions(name: str) -> Transitions | None:
    """The table of a zone by its IANA name in any case (``Z`` is UTC), or None for an unknown name."""
    key = _zone_names().get({"z": "utc"}.get(name.lower(), name.lower()))
    if key is None:
        return None
    zone, one = ZoneInfo(key), timedelta(microseconds=1)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(us: int) -> int:
        return (epoch + timedelta(microseconds=us)).astimezone(zone).utcoffset() // one

    lo, hi = map(_year_start, TABLE_YEARS)
    at, offsets, step = [], [offset(lo)], 3 * DAY_US
    for t in range(lo, hi, step):
        if offset(t + step) != offsets[-1]:
            a, b = t, t + step
            while b - a > 1_000_000:
                mid = (a + b) // 2_000_000 * 1_000_000
                a, b = (mid, b) if offset(mid) == offsets[-1] else (a, mid)
            at.append(b)
            offsets.append(offset(t + step))
    return Transitions(np.array(at, np.int64), np.array(offsets, np.int64))


@lru_cache(10_000)
def parser_of(mask: str) -> dict[str, slice] | None:
    """The places of the fields in texts of this mask, or None for a mask that denotes no time."""
    for shape in SHAPES:
        if m := shape.fullmatch(mask):
            return {k: slice(*m.span(k)) for k, v in m.groupdict().items() if v and k != "s"}
    return None


def _number(chars: np.ndarray, at: slice) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for c in range(at.start, at.stop):
        out = out * 10 + (chars[:, c].astype(np.int64) - 48)
    return out


def _micros(chars: np.ndarray, at: slice) -> np.ndarray:
    n = at.stop - at.start
    v = _number(chars, at)
    return v * 10 ** (6 - n) if n <= 6 else v // 10 ** (n - 6)


def _words(chars: np.ndarray, at: slice) -> np.ndarray:
    part = np.ascontiguousarray(chars[:, at])
    return np.char.lower(part.view(f"U{at.stop - at.start}").ravel())


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 in the Gregorian calendar, and which of the dates exist."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok = (y >= 1) & (m >= 1) & (m <= 12)
    mm = np.where(ok, m, 1)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[mm] + ((mm == 2) & leap)
    ok &= (d >= 1) & (d <= length)
    yy = y - (mm <= 2)
    era = yy // 400
    yoe = yy - era * 400
    doy = (153 * (mm + np.where(mm > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468, ok


def _offset(chars: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """Of ``+99``, ``+9999`` and ``+99:99``: µs east of UTC, and which are at most 18 hours."""
    sign = np.where(chars[:, at.start] == ord("+"), 1, -1)
    h = _number(chars, slice(at.start + 1, at.start + 3))
    m = _number(chars, slice(at.stop - 2, at.stop)) if at.stop - at.start > 3 else np.zeros(len(chars), np.int64)
    return sign * (h * 3600 + m * 60) * 1_000_000, (m < 60) & (h * 60 + m <= 18 * 60)


def _offset_of(text: object) -> int | None:
    m = re.fullmatch(r"\s*(?:([+\-−])(\d\d)(?::?([0-5]\d))?|([zZ]))\s*", text) if isinstance(text, str) else None
    if not m:
        return None
    us = 0 if m[4] else (int(m[2]) * 60 + int(m[3] or 0)) * 60_000_000 * (1 if m[1] == "+" else -1)
    return us if abs(us) <= 18 * 3_600_000_000 else None


def _by_value(values: np.ndarray):
    codes, distinct = pd.factorize(values)
    order = np.argsort(codes, kind="stable")
    at = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
    for k, v in enumerate(distinct):
        yield v, order[at[k] : at[k + 1]]


def _group(texts: list[str], fields: dict[str, slice], offsets: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants of texts of one mask, and which of them denote exactly one. ``offsets``: µs or NaN; ``zones``: names or None."""
    chars = np.array(texts)
    chars = chars.view(np.uint32).reshape(len(texts), -1)
    get = lambda k, least: _number(chars, fields[k]) if k in fields else np.full(len(chars), least, np.int64)
    if "n" in fields:
        digits = fields["n"].stop
        unit = 1_000_000 if digits <= 11 else 1_000 if digits <= 14 else 1 if digits <= 17 else 0
        n = get("n", 0)
        us = n * unit if unit else n // 1000
        if "f" in fields:
            return us + (_micros(chars, fields["f"]) if unit == 1_000_000 else 0), np.full(len(chars), unit == 1_000_000)
        return us, np.ones(len(chars), bool)
    if "mon" in fields:
        names = _words(chars, fields["mon"])
        month = np.zeros(len(chars), np.int64)
        for k, w in enumerate(MONTHS, 1):
            month[names == w] = k
    else:
        month = get("m", 0)
    days, ok = _days(get("Y", 0), month, get("d", 0))
    if "dow" in fields:
        ok &= np.isin(_words(chars, fields["dow"]), WEEKDAYS)
    if "T" in fields:
        ok &= _words(chars, fields["T"]) == "t"
    h, mi, s = get("H", 0), get("M", 0), get("S", 0)
    if "ap" in fields:
        half = _words(chars, fields["ap"])
        ok &= np.isin(half, ("am", "pm")) & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * (half == "pm")
    ok &= (h < 24) & (mi < 60) & (s < 60)
    local = days * DAY_US + ((h * 60 + mi) * 60 + s) * 1_000_000 + (_micros(chars, fields["f"]) if "f" in fields else 0)
    if "off" in fields:
        east, fine = _offset(chars, fields["off"])
        return local - east, ok & fine
    out = np.zeros(len(chars), np.int64)
    if "name" in fields:
        places = _words(chars, fields["name"]).astype(object)
        given = np.zeros(len(chars), bool)
    else:
        given = ~np.isnan(offsets)
        out[given] = local[given] - offsets[given].astype(np.int64)
        places = np.where(given, None, zones)
    left = np.zeros(len(chars), bool)
    for name, rows in _by_value(places):
        if isinstance(name, str) and (t := transitions(name.strip())):
            out[rows], left[rows] = t.to_utc(local[rows])
    return out, ok & (given | left)


def utc_micros(text: Column, offset: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC of a date text, or null where it doesn't denote exactly one instant.

    A zone in the text goes first (a numeric offset before a name), then ``offset`` (such as ``+02:00``), then ``zone``
    (an IANA name). Bare numbers are seconds (up to 11 digits, perhaps with a fraction), milliseconds (12 to 14),
    microseconds (15 to 17) or nanoseconds since 1970 UTC. Full-width forms and digits of any script count as ASCII. Null: null and blank texts, unknown shapes, dates and times
    that don't exist (second 60 too), no zone to be had, unknown zone names, and readings that the zone skipped or had
    twice. Further digits of a fraction than six are cut off. A malformed ``offset`` counts as absent.
    """
    version = zone_version()

    @F.pandas_udf(T.LongType())
    def convert(texts: pd.Series, masks: pd.Series, offs: pd.Series, zones: pd.Series) -> pd.Series:
        if zone_version() != version:
            raise RuntimeError(f"this worker's time zone database is {zone_version()}, the driver's {version}")
        out, known = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        t, z = texts.to_numpy(object), zones.to_numpy(object)
        codes, distinct = pd.factorize(offs)
        table = np.array([np.nan if (o := _offset_of(x)) is None else float(o) for x in distinct] + [np.nan])
        east = table[codes]
        for mask, rows in _by_value(masks.to_numpy(object)):
            # texts of any length are read; only the masks of usual length are kept by the cache
            if mask is not None and (fields := (parser_of if len(mask) <= 200 else parser_of.__wrapped__)(mask)):
                out[rows], known[rows] = _group(list(t[rows]), fields, east[rows], z[rows])
        return pd.Series(out, dtype="Int64").mask(~known)

    bare = trimmed(folded(text))
    return convert(bare, mask_of(bare), offset, zone)
