"""Broadcasts only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast, whatever number of rows is allowed.
BROADCAST_BYTES = 64 << 20


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows and about how many bytes they take in memory: texts and collections by their content, 16 for any other value.

    One aggregate of partial sums; give it a table that was written, as it reads all of it.
    """

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 16
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
        return F.lit(16)

    widths = sum((width(*x) for x in df.dtypes), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.sum(widths)).first()
    return n, size or 0


def at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and takes at most about ``size`` bytes."""
    n, b = size_of(df)
    return n <= rows and b <= size


def broadcast_if_at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if :func:`at_most` holds, else unchanged, so that the join shuffles."""
    return F.broadcast(df) if at_most(df, rows, size) else df
