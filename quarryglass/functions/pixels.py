"""Statistics and hashes of pictures given as pixel arrays: Arrow-batched functions on grey or RGB rows.

A picture is ``ARRAY<ARRAY<DOUBLE>>`` (rows of grey values from 0 to 255), or three of them for red, green and blue. Null,
empty and ragged pictures give null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _grey(rows) -> np.ndarray | None:
    if rows is None or len(rows) == 0 or len({len(r) for r in rows}) != 1 or len(rows[0]) == 0:
        return None
    return np.array([np.asarray(r, float) for r in rows])


def _laplacian(a: np.ndarray) -> np.ndarray:
    """The four-neighbour Laplacian; the border is mirrored without its own row."""
    if min(a.shape) < 2:
        return np.zeros_like(a)
    p = np.pad(a, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a


def _shrunk(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a grid of areas."""
    r = np.linspace(0, a.shape[0], rows + 1)
    c = np.linspace(0, a.shape[1], cols + 1)
    pick = lambda lo, hi, n: slice(int(lo), max(int(lo) + 1, min(n, int(np.ceil(hi)))))
    return np.array([[a[pick(r[i], r[i + 1], a.shape[0]), pick(c[j], c[j + 1], a.shape[1])].mean() for j in range(cols)] for i in range(rows)])


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def _dct(n: int) -> np.ndarray:
    k, i = np.mgrid[0:n, 0:n]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


STATISTICS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("sharpness", "noise", "spread", "brightness", "contrast")])
HASHES = T.StructType([T.StructField(c, T.StringType()) for c in ("average", "difference", "perceptual")])
COLORS = T.StructType([T.StructField("rgb", T.ArrayType(T.IntegerType())), T.StructField("percentage", T.DoubleType())])


@F.pandas_udf(STATISTICS)
def pixel_statistics(pictures: pd.Series) -> pd.DataFrame:
    """Variance and deviation of the Laplacian, range, mean and deviation of the grey values; two decimals."""
    out = []
    for rows in pictures:
        a = _grey(rows)
        if a is None:
            out.append((None,) * 5)
        else:
            lap = _laplacian(a)
            out.append(tuple(round(float(x), 2) for x in (lap.var(), lap.std(), a.max() - a.min(), a.mean(), a.std())))
    return pd.DataFrame(out, columns=STATISTICS.names)


@F.pandas_udf(HASHES)
def perceptual_hashes(pictures: pd.Series) -> pd.DataFrame:
    """64-bit hashes as 16 hex digits: against the mean, against the right neighbour, and of the cosine transform's signs."""
    transform = _dct(32)
    out = []
    for rows in pictures:
        a = _grey(rows)
        if a is None:
            out.append((None,) * 3)
            continue
        small, wide, big = _shrunk(a, 8, 8), _shrunk(a, 8, 9), _shrunk(a, 32, 32)
        low = (transform @ big @ transform.T)[:8, :8]
        out.append((_hex(small > small.mean()), _hex(wide[:, 1:] > wide[:, :-1]), _hex(low > np.median(low))))
    return pd.DataFrame(out, columns=HASHES.names)


def dominant_colors(k: int = 5, top: int = 3, rounds: int = 100, seed: int = 42):
    """A function of ``ARRAY<ARRAY<DOUBLE>>``, pixels of red, green and blue: the colours of the largest of k clusters.

    Lloyd's iterations over all pixels from seeded starts; equal sizes in the order of the centres.
    """

    @F.pandas_udf(T.ArrayType(COLORS))
    def colors(pixels: pd.Series) -> pd.Series:
        out = []
        for p in pixels:
            x = None if p is None or len(p) == 0 else np.array([np.asarray(v, float) for v in p])
            if x is None or x.ndim != 2 or x.shape[1] != 3:
                out.append(None)
                continue
            distinct = np.unique(x, axis=0)
            centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[: min(k, len(distinct))]]
            for _ in range(rounds):
                own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                new = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
                if np.allclose(new, centres):
                    break
                centres = new
            n = np.bincount(own, minlength=len(centres))
            order = sorted(range(len(centres)), key=lambda j: (-n[j], tuple(centres[j])))[:top]
            out.append([{"rgb": [int(v) for v in centres[j]], "percentage": round(100.0 * n[j] / len(x), 2)} for j in order])
        return pd.Series(out)

    return colors
