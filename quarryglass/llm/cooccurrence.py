"""Items that appear together.

Stripes: per item an associative array of the items it occurs with. Each task combines the stripes of all its baskets
before anything is shuffled, so that an item in a third of all baskets costs one stripe per task. Stripes are shuffled as
arrays, in blocks of neighbours so that the longest ones spread over tasks, and merged by key there. Pairs are judged by
support, lift and the log-likelihood ratio of their contingency table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryglass.operators.summaries import batches_of
from quarryglass.plans.cut import Scratch
from quarryglass.plans.sizing import broadcast_if_at_most

#: Distinct pairs that a task holds before it hands on its stripes.
PAIRS_HELD = 1_000_000
#: Frequent items up to which their numbers are sent to the tasks, if their size allows; beyond, they are joined.
ITEMS_BROADCAST = 2_000_000
#: Neighbours in a block of a stripe, a power of two.
BLOCK = 1024
#: Log-likelihood ratio from which a pair is significant: chi-square with one degree of freedom at 5 %.
SIGNIFICANT = 3.84
STRIPE = "item bigint, block bigint, neighbours array<bigint>, counts array<bigint>"


def item_name(c: Column) -> Column:
    """Lower case, ``_`` and ``-`` as a space, without white space around."""
    return F.regexp_replace(F.lower(F.translate(c, "_-", "  ")), r"^\s+|\s+$", "")


def media_baskets(analyses: DataFrame) -> DataFrame:
    """``(file_id, items ARRAY<STRING>)``: the distinct items of every file, sorted; an empty array for a file without any.

    Items are the tags and the keys of ``object_counts`` with a count above 0, by :func:`item_name`; null and blank ones
    are dropped. The rows of a file delivered repeatedly are united. Rows without ``file_id`` give nothing.
    """
    counted = F.map_keys(F.map_filter("object_counts", lambda _, n: n > 0))
    empty = F.array().cast("array<string>")
    raw = F.concat(F.coalesce("tags", empty), F.coalesce(counted, empty))
    named = F.array_distinct(F.filter(F.transform(raw, item_name), lambda x: x != ""))
    rows = analyses.where("file_id IS NOT NULL").select("file_id", F.array_sort(named).alias("items"))
    return rows.groupBy("file_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    distinct, where = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _as_stripes(codes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """From sorted pair codes the stripes: item, block, neighbours, counts."""
    item, neighbour = codes >> 31, codes & (2**31 - 1)
    block = neighbour // BLOCK
    first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (block[1:] != block[:-1])]) if len(codes) else np.empty(0, int)
    ends = np.r_[first[1:], len(codes)].astype(int)
    return pd.DataFrame({"item": item[first], "block": block[first], "neighbours": [neighbour[i:j] for i, j in zip(first, ends)], "counts": [counts[i:j] for i, j in zip(first, ends)]})


def _stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From ``items``, sorted arrays of item numbers, the combined stripes of the task.

    Baskets of one size are a matrix; its pairs of columns give the pairs of all of them at once.
    """
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        sizes = batch["items"].map(len).to_numpy()
        parts, weights = [codes], [counts]
        for k in np.unique(sizes[sizes > 1]):
            m = np.stack(batch["items"].to_numpy()[sizes == k]).astype(np.int64)
            for i in range(k - 1):
                c, n = np.unique((m[:, i : i + 1] << 31) | m[:, i + 1 :], return_counts=True)
                parts.append(c)
                weights.append(n)
        codes, counts = _summed(parts, weights)
        if len(codes) > PAIRS_HELD:
            yield _as_stripes(codes, counts)
            codes, counts = codes[:0], counts[:0]
    if len(codes):
        yield _as_stripes(codes, counts)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stripes of the same item and block as one, of all that a task receives.

    What is held is bounded by the distinct pairs of the task's blocks, however many stripes arrive.
    """
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        lengths = batch["neighbours"].map(len).to_numpy()
        if len(lengths):
            new = (np.repeat(batch["item"].to_numpy(np.int64), lengths) << 31) | np.concatenate(batch["neighbours"].to_numpy()).astype(np.int64)
            codes, counts = _summed([codes, new], [counts, np.concatenate(batch["counts"].to_numpy())])
    if len(codes):
        yield _as_stripes(codes, counts)


def pairs_together(baskets: DataFrame, least: int, share: float, key: str = "file_id") -> tuple[DataFrame, DataFrame, int]:
    """``(a, b, together)`` of item numbers, the items ``(item, no, files)``, and the number of baskets.

    Pairs that stand together in at least ``max(least, share * baskets)`` baskets. Only items that are in as many baskets
    can form one, which is exact and leaves at most ``items / share`` of them, so their table has a proven bound for a
    share above 0; its numbers are sent to the tasks only after a check of its size. Baskets are united by ``key`` before.
    """
    scratch = Scratch(baskets.sparkSession, "baskets")
    b = scratch.write(baskets.select(F.col(key).alias("_key"), "items"), "all")
    n = b.count()
    floor = max(least, int(-(-n * share // 1)))
    used = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= floor)
    # numbers from 0 in the order of the names, so that a pair's smaller number has the smaller name
    numbered = batches_of(scratch.write(used, "used"), "item", 1).select("item", F.col("batch").cast("int").alias("no"), "files")
    items = scratch.write(numbered, "items")
    known = broadcast_if_at_most(items.select("item", "no"), ITEMS_BROADCAST)
    numbers = b.select("_key", F.explode("items").alias("item")).join(known, "item").groupBy("_key").agg(F.array_sort(F.collect_list("no")).alias("items")).where(F.size("items") > 1)
    stripes = numbers.select("items").mapInPandas(_stripes, STRIPE)
    merged = stripes.repartition("item", "block").mapInPandas(_merged, STRIPE)
    pairs = merged.select(F.col("item").alias("a"), F.explode(F.arrays_zip("neighbours", "counts")).alias("x")).select("a", F.col("x.neighbours").alias("b"), F.col("x.counts").alias("together"))
    return pairs.where(F.col("together") >= floor), items, n


def llr(k11: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair: together, with a, with b, baskets."""
    h = lambda *xs: sum((F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)) for x in xs), F.lit(0.0))
    k12, k21, k22 = a - k11, b - k11, n - a - b + k11
    cells = h(*(x.cast("double") for x in (k11, k12, k21, k22)))
    margins = h(*(x.cast("double") for x in (a, n - a, b, n - b)))
    return 2 * (cells - margins + h(n.cast("double")))


def associations(analyses: DataFrame, least: int = 5, share: float = 0.001, lift: float = 3.0, significant: float = SIGNIFICANT) -> DataFrame:
    """``(item_a, item_b, together, files_a, files_b, lift, llr)`` of pairs of items much more often together than by chance.

    ``item_a < item_b``; together in at least ``least`` files and ``share`` of all files, and at least ``lift`` times as
    often as independent items would be, with a log-likelihood ratio of at least ``significant``. (By Gibbs' inequality the
    ratio is at least 0.86 for each file of a pair with a lift of 3, so that with 5 files 3.84 rejects none; it decides where
    lift or support are set lower.) Files without items count among all files. Ties need no order, as every pair
    that qualifies comes out. Empty tables give an empty result.
    """
    pairs, items, n = pairs_together(media_baskets(analyses), least, share)
    of = lambda s, k: items.select(F.col("no").cast("bigint").alias(s), F.col("item").alias(f"item_{k}"), F.col("files").alias(f"files_{k}"))
    named = pairs.join(of("a", "a"), "a").join(of("b", "b"), "b")
    t, a, b, total = F.col("together"), F.col("files_a"), F.col("files_b"), F.lit(n)
    kept = named.where((t.cast("double") * n >= lift * a * b) & (llr(t, a, b, total) >= significant))
    return kept.select("item_a", "item_b", "together", "files_a", "files_b", F.round(t * total / (a * b), 6).alias("lift"), F.round(llr(t, a, b, total), 4).alias("llr"))
