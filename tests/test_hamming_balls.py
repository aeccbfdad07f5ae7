import numpy as np
import pytest

from quarryglass.operators import hamming_balls as balls
from quarryglass.operators import similar


def near_values(seed=1, alike=40):
    """Values with others at 0 to 20 bits, and a crowd that shares its first 52 bits."""
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 2**64, alike, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (k, alike), dtype=np.uint64), axis=0) for k in range(1, 21)]
    return np.unique(np.concatenate([base, *(base ^ f for f in flips), base[0] ^ np.arange(0, 4096, 27, dtype=np.uint64)]))


def by_force(x, y, distance):
    p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y) <= distance)
    a, b, bits = x[p].view(np.int64), y[q].view(np.int64), np.bitwise_count(x[p] ^ y[q])
    return {(min(s, t), max(s, t), n) for s, t, n in zip(a.tolist(), b.tolist(), bits.tolist()) if s != t}


@pytest.mark.parametrize("distance", [0, 5, 12, 30, 63])
@pytest.mark.parametrize("n", [1, 30_000, 300_000, 4_000_000])
def test_bands_miss_no_pair(n, distance):
    bands = balls.bands_for(n, distance)
    assert sum(t + 1 for _, _, t in bands) == distance + 1
    assert all(at + w <= nxt for (at, w, _), (nxt, _, _) in zip(bands, (*bands[1:], (64, 0, 0))))


@pytest.mark.parametrize("bands", [((0, 0, 12),), ((0, 10, 2), (10, 9, 1), (19, 8, 7)), ((0, 6, 6), (6, 16, 5)), balls.bands_for(300_000, 12), balls.bands_for(4_000_000, 12)])
@pytest.mark.parametrize("parts", [1, 3])
def test_each_pair_once(bands, parts):
    x = near_values()
    for left, right, want in ((x, None, by_force(x, x, 12)), (x[::2], x[1::2], by_force(x[::2], x[1::2], 12))):
        got = [r for k in range(len(bands)) for p in range(parts) for d in balls.near_in_band(left, right, 12, bands, k, p, parts) for r in d.itertuples(index=False, name=None)]
        assert len(got) == len(set(got)) and set(got) == want


def test_large_distance_needs_no_blocking_keys(spark, rows, monkeypatch):
    """455 keys of 12 or 13 bits a value: at 1 GB these took more than the time allowed."""
    monkeypatch.setattr(similar, "block_keys", lambda *_: pytest.fail("a large distance by blocking keys"))
    x = near_values()
    df = spark.createDataFrame([(v,) for v in x.view(np.int64).tolist()] + [(None,), (int(x.view(np.int64)[0]),)], "value bigint")
    found = similar.hamming_value_pairs(df, 12, 15)
    assert found.count() == len(want := by_force(x, x, 12)) and rows(found) == want
    assert found.dtypes == [("a", "bigint"), ("b", "bigint"), ("bits", "int")]
    assert similar.hamming_value_pairs(df.where("value IS NULL"), 12, 15).count() == 0


def test_values_in_several_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(balls, "TASK_NS", 1e5)
    x = near_values(2, 10)
    df = spark.createDataFrame([(v,) for v in x.view(np.int64).tolist()], "value bigint")
    found = balls.ball_pairs(df, 12, block=len(x) // 3)
    assert found.count() == len(want := by_force(x, x, 12)) and rows(found) == want
