"""A limit on requests: so many in the trailing seconds, with a wait when it is reached."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def next_wait(times: list[int], now: int, limit: int, window: int) -> tuple[list[int], int]:
    """The kept times after a request at ``now``, and how long it waits (same unit as ``window``).

    Times older than the window are dropped; if ``limit`` are left the request waits until the oldest expires, and all of
    them are forgotten.
    """
    live = [t for t in times if now - t < window]
    wait = window - (now - live[0]) if len(live) >= limit else 0
    return [*([] if wait else live), now], wait


def _columns(by: str, request: str) -> str:
    return f"{request} bigint, {by} bigint, waited_us bigint"


def waits(log: DataFrame, by: str, request: str, ts: str = "ts", limit: int = 100, seconds: int = 60) -> DataFrame:
    """``(request, by, waited_us)`` of every request of a table, in the order of time and then ``request``.

    Each caller's requests are read in order as they stream through a sorted partition; at most ``limit`` times are held.
    Rows without a caller or a time give nothing.
    """
    window = seconds * 1_000_000
    rows = log.select(F.col(by).cast("bigint").alias(by), F.col(request).cast("bigint").alias(request), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).where(f"{by} IS NOT NULL AND _t IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, times = None, []
        for batch in batches:
            out = []
            for b, now in zip(batch[by].tolist(), batch["_t"].tolist()):
                if b != who:
                    who, times = b, []
                times, wait = next_wait(times, now, limit, window)
                out.append(wait)
            yield pd.DataFrame({request: batch[request], by: batch[by], "waited_us": out})

    return rows.repartition(by).sortWithinPartitions(by, "_t", request).mapInPandas(run, _columns(by, request))


def stream_waits(stream: DataFrame, by: str, request: str, ts: str = "ts", limit: int = 100, seconds: int = 60) -> DataFrame:
    """The same on a stream; the state of a caller is at most ``limit`` times. Within a micro-batch requests are put in order."""
    window = seconds * 1_000_000
    rows = stream.select(F.col(by).cast("bigint").alias(by), F.col(request).cast("bigint").alias(request), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).where(f"{by} IS NOT NULL AND _t IS NOT NULL")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for batch in [pd.concat(list(batches)).sort_values(["_t", request])]:
            out = []
            for now in batch["_t"].tolist():
                times, wait = next_wait(times, now, limit, window)
                out.append(wait)
            yield pd.DataFrame({request: batch[request], by: batch[by], "waited_us": out})
        state.update((times,))

    return rows.groupBy(by).applyInPandasWithState(run, _columns(by, request), "times array<bigint>", "append", GroupStateTimeout.NoTimeout)
