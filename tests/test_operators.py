import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarryglass.operators.assets import fresh_entries, latest, merge_phases, overlay_cache, remaining, upserted
from quarryglass.operators.components import connected_components
from quarryglass.operators.dedup import duplicate_sets, quick_candidates, report_totals, survivors_by
from quarryglass.operators.layout import conversion_plan, destinations, expired_backups
from quarryglass.operators.naming import rename_plan
from quarryglass.operators.search import search_library, with_categories
from quarryglass.operators.similar import block_masks, cosine_clusters, cosine_pairs, hamming_value_pairs, similar_groups
from quarryglass.operators.summaries import batches_of, error_summary, latency_metrics, run_comparison
from quarryglass.plans.cut import shared_root
from quarryglass.plans.salt import salted_join


def find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in list(parent)}


EDGES = "src bigint, dst bigint, u int, m string"


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(60)],
    [(0, k) for k in range(1, 80)],
    [(5, 5), (7, 8), (8, 7), (7, 8)],
    [(random.Random(k).randrange(90), random.Random(k + 500).randrange(90)) for k in range(70)],
])
def test_components(spark, rows, edges):
    df = spark.createDataFrame([(*e, 0, "x") for e in edges] + [(None, 1, 0, "x"), (2, None, 0, None)], EDGES)
    assert rows(connected_components(df)) == find(edges)


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], EDGES)).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    class Conf:
        def __init__(self, v):
            self.v = v

        def get(self, key, default=None):
            return self.v

    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"

    Cluster.conf = Conf(None)
    with pytest.raises(ValueError):
        shared_root(Cluster)
    Cluster.conf = Conf("hdfs://x/y/")
    assert shared_root(Cluster) == "hdfs://x/y"


def test_salted_join_is_a_join(spark, rows):
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 99), (None, 5)], "k int, a int")
    right = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (None, 14)], "k int, b int")
    assert rows(salted_join(left, right, ["k"], "a", 7)) == rows(left.join(right, "k"))


@pytest.mark.parametrize("distance,bands", [(0, 2), (4, 6), (8, 11), (4, 5)])
def test_hamming_pairs(spark, rows, distance, bands):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(12)]
    vals = {v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 10))) for v in base for _ in range(10)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in vals)
    want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
    df = spark.createDataFrame([(v,) for v in signed] + [(None,), (signed[0],)], "value bigint")
    assert rows(hamming_value_pairs(df, distance, bands)) == want
    assert rows(hamming_value_pairs(df, distance, bands, rows_per_task=3)) == want


def test_hamming_edges(spark):
    df = spark.createDataFrame([(0,), (-1,)], "value bigint")
    assert hamming_value_pairs(df, -1).count() == 0
    with pytest.raises(ValueError):
        block_masks(4, 4)


def test_a_chain_is_one_group(spark, rows):
    f = spark.createDataFrame([(3, 0), (4, 0b1111), (5, 0b11111111), (9, 1 << 40), (8, 1 << 40), (7, (0x7FFF << 45)), (None, 0), (6, None), (4, 0b1111)], "file_id bigint, bits bigint")
    assert rows(similar_groups(f, 4)) == {(3, 3, 3), (4, 3, 2), (5, 3, 1), (8, 3, 2), (9, 3, 2)}


def test_cosine(spark, rows):
    v = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>")
    assert {(a, b) for a, b, _ in rows(cosine_pairs(df, 0.5, block=2))} == {(1, 2)}
    assert rows(cosine_clusters(df, 0.5)) == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)}
    assert cosine_pairs(df.limit(0), 0.5).count() == 0


FILES = "path string, digest string, size bigint, mtime double, width int, height int"


def test_survivors(spark, rows):
    f = spark.createDataFrame(
        [("/b", "h", 100, 5.0, 50, 50), ("/a", "h", 100, 9.0, 200, 200), ("/c", "h", 300, 1.0, None, None), ("/d", "x", 1, 1.0, 1, 1), ("/e", None, 1, 1.0, 1, 1), ("/f", None, 1, 1.0, 1, 1)],
        FILES,
    )
    kept = lambda how: {r.kept_path for r in survivors_by(f, "digest", how).collect()}
    assert (kept("oldest"), kept("newest"), kept("largest"), kept("highest_quality"), kept("whatever")) == ({"/c"}, {"/a"}, {"/c"}, {"/a"}, {"/a"})
    assert rows(duplicate_sets(f, "digest")) == {("h", 3, "/a")}
    assert rows(report_totals(f, "digest")) == {(1, 2, 400)}
    assert rows(report_totals(f.limit(0), "digest")) == {(0, 0, 0)}
    assert quick_candidates(f, "digest").count() == 3
    assert rows(survivors_by(f, "digest", "oldest")) == {("h", "/c", 3, 200)}


def test_rename_collisions(spark, rows):
    f = spark.createDataFrame([("/1", "x.jpg"), ("/2", "x.jpg"), ("/3", "x.jpg"), ("/4", "y.jpg"), ("/5", None)], "path string, wanted string")
    assert rows(rename_plan(f)) == {("/1", "x.jpg", 0), ("/2", "x_001.jpg", 1), ("/3", "x_002.jpg", 2), ("/4", "y.jpg", 0)}
    natural = spark.createDataFrame([("/1", "x.jpg"), ("/2", "x.jpg"), ("/3", "x_001.jpg"), ("/4", "x.jpg")], "path string, wanted string")
    got = rows(rename_plan(natural))
    assert len({n for _, n, _ in got}) == 4 and ("/3", "x_001.jpg", 0) in got


def test_merge_is_by_key(spark, rows):
    a = spark.createDataFrame([("p1", 1, "a"), ("p2", 2, None), ("p3", 3, "c")], "k string, w int, e string")
    b = spark.createDataFrame([("p3", 9.0, "z"), ("p1", 7.0, None), ("p4", 1.0, "n")], "k string, q double, e string")
    got = {r.k: (r.w, r.q, r.e) for r in merge_phases([a, b], "k").collect()}
    assert got == {"p1": (1, 7.0, "a"), "p2": (2, None, None), "p3": (3, 9.0, "z"), "p4": (None, 1.0, "n")}


def test_cache_operators(spark, rows):
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    fresh = spark.createDataFrame([("a", "new"), ("b", "new")], "k string, v string")
    cached = spark.createDataFrame([("a", "old")], "k string, v string")
    assert rows(overlay_cache(req, fresh, cached, "k", "v")) == {("a", "old", None), ("b", "new", None), ("c", None, "analysis failed")}
    assert rows(upserted(fresh, cached, "k")) == {("a", "old"), ("b", "new")}
    assert rows(remaining(req, cached, "k")) == {("b",), ("c",)}
    entries = spark.createDataFrame([("p", "h", 1, 10.0), ("q", "h", 1, 10.0), ("r", "h", 1, 10.0), ("gone", "h", 1, 1.0)], "file_path string, file_hash string, file_size bigint, file_mtime double")
    now = spark.createDataFrame([("p", "h", 1, 10.9), ("q", "h", 2, 10.0), ("r", "h", 1, 11.0)], "file_path string, file_hash string, file_size bigint, file_mtime double")
    assert {r.file_path for r in fresh_entries(entries, now).collect()} == {"p"}
    assert rows(latest(spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (None, 9, "z")], "k int, o int, v string"), "k", F.col("o"))) == {(1, 3, "y")}


def test_metrics(spark):
    def of(values, images=1):
        df = spark.createDataFrame([("m", float(v), images) for v in values], "name string, duration_ms double, image_count int")
        return latency_metrics(df).first()

    assert of([100, 150, 200]).mean_ms == 150 and of(range(100, 301, 50)).median_ms == 200
    assert of([100, 100, 100], 10).per_second == 100.0 and of(range(1, 101)).p95_ms == 96
    assert of([7]).p95_ms == 7 and of([1, 3]).median_ms == 2


def test_summaries(spark, rows):
    df = spark.createDataFrame([(1, None, "e"), (2, None, None), (3, "x", None)], "id int, a string, b string")
    assert rows(error_summary(df, ["a", "b"])) == {(3, 1, 1, 1, 33.33)}
    assert rows(error_summary(df.limit(0), ["a"])) == {(0, 0, 0, 0.0)}
    a, b = spark.createDataFrame([("s", 2)], "k string, n int"), spark.createDataFrame([("t", 3)], "k string, n int")
    assert rows(run_comparison(a, b, "k", "n")) == {("s", 2, 0, -2), ("t", 0, 3, 3)}
    got = {r.id: r.batch for r in batches_of(spark.range(100).select(F.col("id")), "id", 7, rows_per_range=20).collect()}
    assert got == {k: k // 7 for k in range(100)}


def test_search(spark):
    lib = spark.createDataFrame([(1, "1920x1080", 10.0, 90.0), (2, "3840x2160", 50.0, 95.0), (3, "1920x1080", 20.0, None)], "id int, resolution string, duration double, quality double")
    tags = spark.createDataFrame([(1, "scene", "Outdoor"), (2, "scene", "indoor"), (3, "scene", "outdoor"), (1, "quality", "high-quality"), (1, "object", "dog")], "id int, category string, tag string")
    ids = lambda **k: [r.id for r in search_library(lib, tags, **k).collect()]
    assert ids() == [2, 1, 3] and ids(scene="OUT") == [1, 3] and ids(quality="high") == [1] and ids(quality="odd") == [2, 1, 3]
    assert ids(resolution="4k") == [2] and ids(min_duration=0) == [2, 1, 3] and ids(min_duration=15, max_duration=30) == [3] and ids(limit=1) == [2]
    assert [r.id for r in with_categories(lib, tags, {"scene": ["Outdoor", "outdoor"], "object": ["dog"]}).collect()] == [1]


def test_layout(spark, rows):
    f = spark.createDataFrame([("/a/x.PNG", "RGB", 2000, 2000), ("/a/y.jpg", "RGB", 10, 10), ("/a/z.gif", "P", 10, 10), ("/a/n", "RGBA", 1, 1)], "path string, mode string, width int, height int")
    assert rows(conversion_plan(f)) == {("/a/x.PNG", "png", "jpg", "convert", "/a/x.jpg"), ("/a/y.jpg", "jpg", "jpg", "keep", "/a/y.jpg"), ("/a/z.gif", "gif", "png", "convert", "/a/z.png"), ("/a/n", "", "png", "convert", "/a/n.png")}
    p = spark.createDataFrame([("/s/a/x.jpg",), ("/s/b/x.jpg",), ("/t/x.jpg",)], "path string")
    assert rows(destinations(p, "/end/", "/s")) == {("/s/a/x.jpg", "/end/x.jpg"), ("/s/b/x.jpg", "/end/x_001.jpg")}
    b = spark.createDataFrame([("backup_20240101_000000", True), ("backup_20240124_000000", True), ("backup_2024", True), ("backup_20240101_000000", False), ("other", True)], "name string, verified boolean")
    as_of = F.lit(datetime(2024, 1, 31))
    assert expired_backups(b, as_of, 7).count() == 2 and expired_backups(b, as_of, 7, need_verified=True).count() == 1
