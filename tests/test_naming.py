"""Renaming: a name of its own for every file, whatever the numbers."""

import random

import pytest

from quarryglass.operators.naming import rename_plan

SCHEMA = "path string, wanted string"


def plain(files, suffix="_%03d"):
    """The definition, one file at a time."""
    wanted, out, last = {w for _, w in files}, set(), {}
    for path, w in sorted(files):
        if w not in last:
            last[w] = 0
            out.add((path, w, 0))
            continue
        stem, dot, ext = w.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (w, "")
        k = last[w] + 1
        while stem + suffix % k + ext in wanted:
            k += 1
        last[w] = k
        out.add((path, stem + suffix % k + ext, k))
    return out


def test_more_repeats_than_9999(spark):
    f = spark.range(10_050).selectExpr("format_string('/%06d', id) AS path", "'x.jpg' AS wanted")
    got = rename_plan(f).collect()
    assert len(got) == len({r.new_name for r in got}) == 10_050 and max(r.seq for r in got) == 10_049
    assert ("/010049", "x_10049.jpg", 10_049) in {tuple(r) for r in got}


def test_a_long_run_of_taken_names(spark, rows):
    files = [("/a", "x.jpg"), ("/b", "x.jpg"), ("/c", "x.jpg"), *((f"/n{k}", f"x_{k:03d}.jpg") for k in range(1, 61))]
    got = rows(rename_plan(spark.createDataFrame(files, SCHEMA)))
    assert {("/b", "x_061.jpg", 61), ("/c", "x_062.jpg", 62)} < got and got == plain(files)


@pytest.mark.parametrize("suffix", ["_%03d", "-%02d", "_%d"])
def test_random_names_as_defined(spark, rows, suffix):
    rnd = random.Random(7)
    names = ["x.jpg", "x", "x_001", "x.y.jpg", "x_0001.jpg", "x_99999999999999999999.jpg", "x_000.jpg", "x_001_001.jpg", *(f"x{suffix % rnd.randrange(1, 40)}.jpg" for _ in range(25))]
    files = [(f"/{k:04d}", rnd.choice(names[:3] * 8 + names)) for k in range(300)]
    got = rows(rename_plan(spark.createDataFrame([*files, ("/z", None)], SCHEMA), suffix=suffix))
    assert got == plain(files, suffix) and len({n for _, n, _ in got}) == 300


def test_suffixes_that_could_make_names_agree(spark):
    with pytest.raises(ValueError):
        rename_plan(spark.createDataFrame([], SCHEMA), suffix="%d")
