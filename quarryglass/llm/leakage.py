"""Evaluation passages inside a training corpus.

Texts and passages are folded (NFKC, lower case, only letters, marks and digits). Of the n-grams of every passage the
rarest in the corpus is taken as a seed from each window of places. Seeds join the texts to the passages through a rolling
hash. For shared runs the seeds are long and every window that a run must cover has one, so that no run is missed; runs are
measured exactly along the seeds' diagonals. For edited copies the seeds are short; two of them on near diagonals make a
candidate, and a Smith-Waterman alignment of the passage with the text around them scores it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a shared run that make a leak, and of the seeds. A run holds RUN - SEED + 1 places for a seed.
RUN, SEED = 48, 24
#: Characters of the short seeds of edited copies, places among which the rarest is taken, and how far the diagonals of two
#: seeds of a copy may lie apart (characters inserted or lost between them).
SHORT, SPREAD, DRIFT = 8, 16, 8
#: Short seeds that occur no more often than this, or than once in so many texts, are equally rare: of a passage whose
#: edited copies are in the corpus, those that the edits destroyed would be the rarest.
RARE, RARE_IN = 16, 100_000
#: Characters of passages that one pass over the corpus looks for; more are taken in blocks of passes.
BLOCK_CHARS = 1_000_000
#: Characters hashed at once.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
#: Smith-Waterman: a match, a mismatch, a gap.
MATCH, MISMATCH, GAP = 2, -1, -2


@lru_cache(1)
def _kept() -> np.ndarray:
    """For every code point whether folding keeps it: categories L, M and N. A megabyte, made once per worker."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> np.ndarray:
    """The code points of a text in NFKC and lower case, only letters, marks and digits."""
    codes = _codes(unicodedata.normalize("NFKC", text).lower())
    return codes[_kept()[codes]]


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of ``n`` code points, by doubling."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width = _BASE, 1
        part = codes.astype(np.uint64) + np.uint64(1)
        out, done = None, 0
        while True:
            if n & width:
                out, done = (part, width) if out is None else (part[: len(part) - done] * _pow(done) + out[width:][: len(part) - done], done + width)
            if done == n:
                return out[: len(codes) - n + 1]
            part = part[:-width] * power + part[width:]
            power, width = power * power, width * 2


def _pow(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


@dataclass
class Grams:
    """Sorted hashes with a bitmap before them, and for each hash the places (passage, position) that have it."""

    length: int
    hashes: np.ndarray
    starts: np.ndarray
    passage: np.ndarray
    position: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, length: int, hashes: np.ndarray, passage: np.ndarray, position: np.ndarray) -> Grams:
        order = np.argsort(hashes, kind="stable")
        hashes, passage, position = hashes[order], passage[order], position[order]
        distinct, starts = np.unique(hashes, return_index=True)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(distinct >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return cls(length, distinct, np.append(starts, len(hashes)), passage, position, bitmap)

    def found(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in ``codes`` whose window is one of the grams, with the gram's number; in chunks."""
        if not len(self.hashes):
            return
        for a in range(0, max(0, len(codes) - self.length + 1), CHUNK):
            h = rolling(codes[a : a + CHUNK + self.length - 1], self.length)
            at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            k = np.searchsorted(self.hashes, h[at])
            k[k == len(self.hashes)] = 0
            ok = self.hashes[k] == h[at]
            yield at[ok] + a, k[ok]

    def places(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(passage, diagonal, position)`` of the grams in ``codes``; the diagonal is the place in the text less the position.

        One place of each gram at a time, so that a passage that repeats itself needs no more memory than the text.
        """
        for at, gram in self.found(codes):
            n = self.starts[gram + 1] - self.starts[gram]
            for j in range(int(n.max(initial=0))):
                k = self.starts[gram[n > j]] + j
                yield self.passage[k], at[n > j] - self.position[k], self.position[k]


def all_grams(passages: list[np.ndarray], length: int = SEED) -> Grams:
    """The grams of passages that are long enough to share a run."""
    parts = [(h, np.full(len(h), i), np.arange(len(h))) for i, p in enumerate(passages) if len(p) >= RUN for h in [rolling(p, length)]]
    cat = lambda k, kind: np.concatenate([x[k] for x in parts]).astype(kind) if parts else np.empty(0, kind)
    return Grams.of(length, cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64))


def rare_seeds(passages: list[np.ndarray], grams: Grams, counts: np.ndarray, span: int = RUN - SEED + 1) -> Grams:
    """From every ``span`` neighbouring places of a passage the gram with the fewest occurrences in the corpus.

    With the span given, one in every window of ``RUN`` characters. Of equally rare ones the one with the smaller hash, so
    that neighbouring windows mostly agree on it.
    """
    parts = []
    for i, p in enumerate(passages):
        if len(p) < RUN:
            continue
        h = rolling(p, grams.length)
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, counts[np.searchsorted(grams.hashes, h)]))] = np.arange(len(h))
        windows = np.lib.stride_tricks.sliding_window_view(rank, min(span, len(rank)))
        q = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        parts.append((h[q], np.full(len(q), i), q))
    cat = lambda k, kind: np.concatenate([x[k] for x in parts]).astype(kind) if parts else np.empty(0, kind)
    return Grams.of(grams.length, cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64))


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two code arrays with linear gaps, a row at a time."""
    if not len(a) or not len(b):
        return 0
    ramp = -GAP * np.arange(len(b) + 1, dtype=np.int32)
    gain = {c: np.where(b == c, MATCH, MISMATCH).astype(np.int32) for c in set(a.tolist())}
    row, new, best = np.zeros(len(b) + 1, np.int32), np.zeros(len(b) + 1, np.int32), 0
    for c in a.tolist():
        np.add(row[:-1], gain[c], out=new[1:])
        row += GAP
        np.maximum(new, row, out=new)
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, out=row)
        row -= ramp
        best = max(best, int(row.max()))
        new[0] = 0
    return best


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """The longest stretch in which two code arrays agree at the same places."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(np.diff(apart, prepend=-1, append=n).max()) - 1 if n else 0


def shared_runs(codes: np.ndarray, passages: list[np.ndarray], seeds: Grams) -> dict[int, int]:
    """Per passage with a seed in the text: the longest run that both share on a diagonal of a seed."""
    met: set[tuple[int, int]] = set()
    for passage, diagonal, _ in seeds.places(codes):
        met.update(zip(passage.tolist(), diagonal.tolist()))
    best: dict[int, int] = {}
    for i, d in met:
        run = longest_run(codes[max(d, 0) : max(d + len(passages[i]), 0)], passages[i][max(-d, 0) :])
        if run >= SEED and run > best.get(i, 0):
            best[i] = run
    return best


def near_diagonals(codes: np.ndarray, passages: list[np.ndarray], seeds: Grams) -> Iterator[tuple[int, int, int]]:
    """``(passage, start, end)``: stretches of the text around two different seeds whose diagonals are at most ``DRIFT`` apart.

    As far as the passage goes to both sides and a quarter more; stretches that overlap are one.
    """
    parts = list(seeds.places(codes))
    if not parts:
        return
    passage, diagonal, position = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((position, diagonal, passage))
    passage, diagonal, position = passage[order], diagonal[order], position[order]
    near = np.flatnonzero((passage[1:] == passage[:-1]) & (diagonal[1:] - diagonal[:-1] <= DRIFT) & (position[1:] != position[:-1]))
    open_: tuple[int, int, int] | None = None
    for i, d, e in zip(passage[near].tolist(), diagonal[near].tolist(), diagonal[near + 1].tolist()):
        n = len(passages[i])
        start, end = max(0, d - n // 4), e + n + n // 4
        if open_ and open_[0] == i and start <= open_[2]:
            open_ = (i, open_[1], end)
        else:
            if open_:
                yield open_
            open_ = (i, start, end)
    if open_:
        yield open_


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", edited: bool = False) -> DataFrame:
    """``(doc_id, item_id, longest_run)``: texts and the evaluation items that they share a seed with.

    ``longest_run``: characters of the longest folded run on a diagonal of a seed; every shared run of at least ``RUN``
    characters holds one, so the pairs with ``longest_run >= RUN`` are exactly those that share one. Pairs without a run of
    ``SEED`` characters have 0.

    With ``edited`` also ``aligned``: the Smith-Waterman score of the passage over that of a perfect copy, in the stretches of
    the text around two short seeds on near diagonals; 1 for a whole copy, null where there is no such stretch. A copy is
    found if at least two of its seeds survive; the share that does is measured in the tests.

    Null texts, passages and ids give nothing, passages of fewer than ``RUN`` folded characters can't leak, repeated rows
    give one result each pair. Whole texts are read. The items are a stated query set: they are held by every task in
    blocks of at most ``BLOCK_CHARS`` characters, one pass over the corpus for each block and one for its counts, of which at
    most two a character come to the driver.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = items.select("item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    out = spark.createDataFrame([], FOUND)
    ids: list[int] = []
    own: list[np.ndarray] = []
    size = 0
    for r in rows.orderBy("item_id", "passage").toLocalIterator():
        ids.append(r.item_id)
        own.append(folded(r.passage))
        size += len(own[-1])
        if size >= BLOCK_CHARS:
            out = out.union(_block(docs, ids, own, edited))
            ids, own, size = [], [], 0
    out = out.union(_block(docs, ids, own, edited)) if ids else out
    return out.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), *[F.max("aligned").alias("aligned")] * edited)


FOUND = "doc_id bigint, item_id bigint, longest_run int, aligned double"


def _block(docs: DataFrame, ids: list[int], passages: list[np.ndarray], edited: bool) -> DataFrame:
    spark = docs.sparkSession
    grams = [all_grams(passages)] + [all_grams(passages, SHORT)] * edited
    sent = spark.sparkContext.broadcast(grams)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [np.zeros(len(g.hashes), np.int64) for g in sent.value]
        texts = 0
        for batch in batches:
            texts += len(batch)
            for codes in _joined(batch["text"]):
                for g, n in zip(sent.value, seen):
                    for _, k in g.found(codes):
                        n += np.bincount(k, minlength=len(n))
        for kind, n in enumerate(seen):
            k = np.flatnonzero(n)
            yield pd.DataFrame({"kind": kind, "gram": k, "n": n[k]})
        yield pd.DataFrame({"kind": [-1], "gram": [0], "n": [texts]})

    counted = docs.select("text").mapInPandas(count, "kind int, gram bigint, n bigint").groupBy("kind", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = [np.zeros(len(g.hashes), np.int64) for g in grams]
    for kind, c in counted[counted["kind"] >= 0].groupby("kind"):
        counts[kind][c["gram"]] = c["n"]
    texts = counted["n"][counted["kind"] < 0].sum()
    counts[1:] = [np.maximum(n, max(RARE, texts // RARE_IN)) for n in counts[1:]]
    seeds = [rare_seeds(passages, g, n, span) for g, n, span in zip(grams, counts, (RUN - SEED + 1, SPREAD))]
    known = spark.sparkContext.broadcast((ids, passages, seeds))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, own, (long, *short) = known.value
        for batch in batches:
            out = []
            for doc, t in zip(batch["doc_id"], batch["text"]):
                codes = folded(t)
                runs = shared_runs(codes, own, long)
                # a run over the whole passage is a perfect alignment
                aligned = {i: 1.0 for i, run in runs.items() if run == len(own[i])}
                for s in short:
                    for i, a, b in near_diagonals(codes, own, s):
                        if aligned.get(i) != 1.0:
                            aligned[i] = max(aligned.get(i, 0.0), smith_waterman(own[i], codes[a:b]) / (MATCH * len(own[i])))
                out += [(doc, names[i], runs.get(i, 0), aligned.get(i)) for i in runs.keys() | (aligned.keys() if short else set())]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest_run", "aligned"]).astype({"aligned": float})

    return docs.mapInPandas(find, FOUND)


def _joined(texts: pd.Series) -> Iterator[np.ndarray]:
    """Folded texts as code arrays, short ones joined by a code that no passage has."""
    parts, size, apart = [], 0, np.zeros(1, np.uint32)
    for t in texts:
        parts += [folded(t), apart]
        size += len(parts[-2])
        if size > CHUNK:
            yield np.concatenate(parts)
            parts, size = [], 0
    if parts:
        yield np.concatenate(parts)
