"""Normal forms of digests, perceptual hashes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the four leading hex characters and the rest are converted apart, as 64 bits don't fit a signed decimal.
HEX64 = "^[0-9a-f]{16}$"


def _bare(c: Column) -> Column:
    """Lower case, without white space around or one of the prefixes."""
    return F.regexp_replace(F.lower(c), r"^\s*(?:(?:md5:|sha256:|0x)\s*)?|\s+$", "")


def digest(c: Column) -> Column:
    """A file digest in its normal form; null for null, empty and all zeros."""
    x = _bare(c)
    return F.when((x != "") & ~x.rlike("^0+$"), x)


def hash64(c: Column) -> Column:
    """The 64 bits of a perceptual hash as BIGINT; null unless it is 16 hex digits."""
    x = _bare(c)
    ok = x.rlike(HEX64)
    part = lambda a: F.conv(F.when(ok, F.substring(x, a, 8)), 16, 10).cast("bigint")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two BIGINTs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def digest_by_name(content: Column, name: str = "sha256") -> Column:
    """The hex digest of a text or bytes by ``md5``, ``sha1`` or ``sha256``; another name raises ``ValueError``."""
    known = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}
    if name not in known:
        raise ValueError(f"unknown digest {name}")
    return known[name](content)


def look_by_name(hashes: dict[str, Column], name: str = "phash") -> Column:
    """One of the perceptual hashes by its name; an unknown name gives ``phash``."""
    return hashes.get(name, hashes["phash"])


def path_key(c: Column) -> Column:
    """A path without white space around, with single forward separators; null for null and blank."""
    x = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[\\/]+", "/")
    return F.when(x != "", x)
