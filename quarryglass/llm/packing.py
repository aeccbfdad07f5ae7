"""Filling containers of fixed capacity with documents.

Linear grouping: the large lengths are sorted into groups of equal cardinality and rounded up to the largest of their
group; how few rounded sizes combine in a container is optimised by column generation; the documents then take the places
of their group's size, the last of a container as large as the rounding left room for, and what is small or left over goes
where it fits best. The documents are dealt to shards of bounded size by a hash, each packed by one task, so that one
container a shard may stay poorly filled and none depends on all.
"""

from __future__ import annotations

from base64 import b64decode
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryglass.plans.cut import Scratch

#: How the public tokenizer of 50,256 byte-level ranks cuts texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Pieces that a shard holds on average.
SHARD = 50_000
#: Lengths above this part of the capacity are large; groups of equal cardinality they are sorted into. A smaller part makes
#: patterns of more sizes, whose rounding leaves gaps that the small lengths may be too few to fill.
LARGE, GROUPS = 1 / 6, 32


def token_counts(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, tokens)`` of every row; 0 for null and empty texts. Strings of special tokens count as ordinary text.

    ``tokenizer``: a file of byte-pair ranks for tiktoken. It is read by the driver and sent to the tasks, which needs no
    file on the executors.
    """
    spec = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tiktoken import Encoding

        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, spec.value.splitlines())}
        encode = Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) if isinstance(t, str) else 0 for t in batch["text"]), np.int64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": sizes})

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(count, "doc_id bigint, tokens bigint")


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable choice of sizes that fits, by a knapsack over the number of items."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for i, (s, v) in enumerate(zip(sizes, value)):
            if v > 0:
                gain = best[: capacity + 1 - s] + v
                up = gain > new[s:] + 1e-12
                new[s:][up], pick[s:][up] = gain[up], i
        if (pick < 0).all():
            break
        best = new
        picks.append(pick)
    out, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            out[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of sizes and how often to use each: the linear programme of Gilmore and Gomory, rounded down.

    Patterns enter until none is worth more than a container. Where patterns come and go without fewer containers, as often
    as there are sizes twice over, the programme has stalled at a degenerate corner; its patterns are as good.
    """
    basis = np.array([np.eye(len(sizes), dtype=np.int64)[i] * (capacity // s) for i, s in enumerate(sizes)])
    least, stalled = np.inf, 0
    while stalled <= 2 * len(sizes):
        inverse = np.linalg.inv(basis.T.astype(float))
        x = inverse @ demand
        worth, pattern = _best_pattern(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-7:
            break
        least, stalled = (x.sum(), 0) if x.sum() < least - 1e-9 else (least, stalled + 1)
        along = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(along > 1e-9, x / along, np.inf)
        basis[int(ratio.argmin())] = pattern
    x = np.linalg.solve(basis.T.astype(float), demand.astype(float))
    return [(p, int(n + 1e-6)) for p, n in zip(basis, x) if n >= 1 - 1e-6]


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A container number for each length, all from 1 to ``capacity``; the first containers come from configurations, and how many."""
    place = np.full(len(lengths), -1, np.int64)
    order = np.argsort(lengths, kind="stable")
    large = order[lengths[order] > capacity * LARGE]
    room: list[int] = []
    if len(large):
        groups = np.array_split(large, min(GROUPS, len(large)))
        sizes, of = np.unique([lengths[g[-1]] for g in groups], return_inverse=True)
        demand = np.bincount(of, weights=[len(g) for g in groups]).astype(np.int64)
        waiting: dict[int, list[int]] = {}
        for i in large.tolist():
            waiting.setdefault(int(lengths[i]), []).append(i)
        here = sorted(waiting)
        below = dict(zip(sizes.tolist(), [0, *sizes.tolist()]))
        # the largest sizes first, while there are many others to fit them; a pattern is used as long as its groups last
        for slots, times in sorted(((np.repeat(sizes, p)[::-1].tolist(), n) for p, n in configurations(sizes, demand, capacity)), reverse=True):
            for _ in range(times):
                taken, left = [], capacity
                for k, size in enumerate(slots, 1):
                    # the last one may be as large as the room that the rounding left
                    at = bisect_right(here, left if k == len(slots) else size) - 1
                    if at < 0 or here[at] <= below[size]:
                        break
                    n = here[at]
                    taken.append(waiting[n].pop())
                    left -= n
                    if not waiting[n]:
                        del waiting[n]
                        here.pop(at)
                if len(taken) < len(slots):
                    for i in taken:
                        if int(lengths[i]) not in waiting:
                            waiting[int(lengths[i])] = []
                            insort(here, int(lengths[i]))
                        waiting[int(lengths[i])].append(i)
                    break
                place[taken] = len(room)
                room.append(left)
    return _best_fit(lengths, capacity, place, room), len(room)


def _best_fit(lengths: np.ndarray, capacity: int, place: np.ndarray, room: list[int]) -> np.ndarray:
    """Put what has no place (-1) where it leaves least room, the largest first; ``room``: what is left in each container."""
    by_room: dict[int, list[int]] = {}
    for c, r in enumerate(room):
        by_room.setdefault(r, []).append(c)
    rooms, n = sorted(by_room), len(room)
    for i in np.argsort(-lengths, kind="stable").tolist():
        if place[i] >= 0:
            continue
        need = int(lengths[i])
        k = bisect_left(rooms, need)
        if k < len(rooms):
            r = rooms[k]
            c = by_room[r].pop()
            if not by_room[r]:
                del by_room[r]
                rooms.pop(k)
        else:
            r, c, n = capacity, n, n + 1
        place[i] = c
        if r > need:
            if r - need not in by_room:
                by_room[r - need] = []
                insort(rooms, r - need)
            by_room[r - need].append(c)
    return place


def fill_containers(counts: DataFrame, specs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(spec_id, container_id, doc_id, piece, start_token, tokens, configured)``: for every spec, the place of every document.

    ``counts``: ``(doc_id, tokens)``. A document larger than the capacity is cut into full containers and a rest, which is
    placed like a document; all others are in one piece. Documents of 0 tokens, and specs without a positive capacity,
    need no container: they come out with a null ``container_id``. ``container_id`` is unique within a spec. Documents of
    equal length are taken in the order of ``doc_id``; repeated rows are placed each. ``configured``: whether the container
    comes from a configuration of rounded sizes, and not from best fit or a cut. Of the counts only their number comes to
    the driver, and the specs, a stated list for each of which all documents are packed.
    """
    scratch = Scratch(counts.sparkSession, "packing")
    c, n = scratch.write_counted(counts.select("doc_id", "tokens"), "counts")
    shards = max(1, -(-n // shard))
    kinds = specs.where("spec_id IS NOT NULL").groupBy("spec_id").agg(F.max("capacity_tokens").cast("int").alias("capacity")).orderBy("spec_id").collect()
    listed = [F.struct(F.lit(k.spec_id).cast("bigint").alias("spec_id"), F.lit(k.capacity).cast("int").alias("capacity")) for k in kinds]
    if not listed:
        return counts.sparkSession.createDataFrame([], FILLED)
    each = c.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "tokens", F.lit(7)), F.lit(shards)).cast("int")).select("*", F.inline(F.array(*listed)))
    ok = F.coalesce((F.col("capacity") > 0) & (F.col("tokens") > 0), F.lit(False))
    none = each.where(~ok).selectExpr("spec_id", "CAST(NULL AS BIGINT) AS container_id", "doc_id", "0 AS piece", "0L AS start_token", "coalesce(tokens, 0L) AS tokens", "CAST(NULL AS BOOLEAN) AS configured")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        spec, capacity, no = key
        rows = rows.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        ids, sizes = rows["doc_id"].array, rows["tokens"].to_numpy(np.int64)
        whole, rest = sizes // capacity, sizes % capacity
        full = np.repeat(np.arange(len(sizes)), whole)
        piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        part = np.flatnonzero(rest)
        where, configured = pack(rest[part], capacity)
        base = int(no) << 36
        doc = np.concatenate([full, part])
        k = np.concatenate([piece, whole[part]])
        return pd.DataFrame({
            "spec_id": spec,
            "container_id": base + np.concatenate([np.arange(len(full)), len(full) + where]),
            "doc_id": ids.take(doc),
            "piece": k.astype(np.int32),
            "start_token": k * capacity,
            "tokens": np.concatenate([np.full(len(full), capacity), rest[part]]).astype(np.int64),
            "configured": np.concatenate([np.zeros(len(full), bool), where < configured]),
        })

    return each.where(ok).groupBy("spec_id", "capacity", "_shard").applyInPandas(place, FILLED).unionByName(none)


FILLED = "spec_id bigint, container_id bigint, doc_id bigint, piece int, start_token bigint, tokens bigint, configured boolean"


def fill_report(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, containers, configured_share, least_containers, tokens, unused_share)``: against the bound that no packing can go below."""
    boxes = filled.where("container_id IS NOT NULL").groupBy("spec_id", "container_id").agg(F.max("configured").alias("_by"), F.sum("tokens").alias("_t"))
    per = boxes.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.round(F.count_if("_by") / F.count(F.lit(1)), 4).alias("configured_share"), F.sum("_t").alias("tokens"))
    kinds = specs.groupBy("spec_id").agg(F.max("capacity_tokens").cast("bigint").alias("_c"))
    out = per.join(kinds, "spec_id")
    return out.select("spec_id", "containers", "configured_share", F.ceil(F.col("tokens") / F.col("_c")).alias("least_containers"), "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("_c")), 6).alias("unused_share"))
