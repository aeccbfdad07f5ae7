import math
import random

import pytest

from quarryglass.operators import places as P

POINT = "file_id bigint, lat double, lon double, id_a int, _row string"


def haversine(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * P.EARTH_M * math.asin(math.sqrt(min(1, h)))


def brute(points, metres):
    return {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and haversine(a, b) <= metres}


@pytest.mark.parametrize("lat,lon", [(0.0, 0.1), (51.5, 179.9999), (-51.5, -179.9999), (89.9995, 12.0), (-89.9995, -170.0)])
def test_near_pairs_agree_with_brute_force(spark, rows, lat, lon):
    rnd = random.Random(3)
    pts = []
    for k in range(160):
        x = lon + rnd.uniform(-0.0012, 0.0012) / max(0.01, math.cos(math.radians(lat)))
        pts.append((k, max(-90.0, min(90.0, lat + rnd.uniform(-0.0012, 0.0012))), (x + 180) % 360 - 180))
    pts += [(1000 + k, p[1], p[2]) for k, p in enumerate(pts[:20])]
    df = spark.createDataFrame([(*p, 0, "r") for p in pts], POINT)
    got = P.near_pairs(df, 50.0)
    assert got.count() == len(rows(got))
    assert rows(got) == brute(pts, 50.0)


def test_crowded_cell_is_split_and_whole(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 10)
    pts = [(k, 10.0 + (k % 60) * 1e-6, 20.0 + (k // 60) * 1e-6) for k in range(180)]
    df = spark.createDataFrame([(*p, 0, "r") for p in pts], POINT)
    assert rows(P.near_pairs(df, 50.0)) == brute(pts, 50.0)


def test_positions(spark, rows):
    from datetime import datetime

    schema = "file_id bigint, scanned_at timestamp, latitude double, longitude double, p string"
    t, u = datetime(2024, 1, 1), datetime(2024, 1, 2)
    data = [
        (1, t, 5.0, 6.0, "a"), (1, t, 5.0, 6.0, "a"), (2, t, 0.0, 0.0, None), (3, t, 91.0, 0.0, ""), (4, t, None, 1.0, ""),
        (5, t, 1.0, 181.0, ""), (6, t, float("nan"), 1.0, ""), (7, t, 1.0, 1.0, ""), (7, u, None, None, ""), (8, None, 0.0, 3.0, ""), (None, t, 1.0, 1.0, ""),
    ]
    assert rows(P.positions(spark.createDataFrame(data, schema))) == {(1, 5.0, 6.0), (8, 0.0, 3.0)}
    assert P.near_pairs(P.positions(spark.createDataFrame([], schema)), 50.0).count() == 0


REGION = "region_id bigint, boundary_wkt string, id int"


def test_regions_with_holes_nesting_and_the_180th_meridian(spark, rows):
    regions = spark.createDataFrame(
        [
            (1, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0),(4 4, 6 4, 6 6, 4 6, 4 4))", 1),
            (2, "POLYGON((2 2, 3 2, 3 3, 2 3, 2 2))", 1),
            (2, "POLYGON((2 2, 3 2, 3 3, 2 3, 2 2))", 1),
            (3, "POLYGON((175 -5, 185 -5, 185 5, 175 5, 175 -5))", 1),
            (4, None, None), (5, "POLYGON EMPTY", None), (None, "POLYGON((0 0, 9 0, 9 9, 0 0))", 0), (6, "nonsense ((", 0),
        ],
        REGION,
    )
    pts = [(1, 5.0, 5.0), (2, 2.5, 2.5), (3, 0.0, 179.0), (4, 0.0, -176.0), (5, 0.0, 170.0), (6, 9.0, 1.0), (7, 50.0, 50.0), (8, 0.0, 180.0)]
    df = spark.createDataFrame([(*p, 0, "r") for p in pts], POINT)
    assert rows(P.containing_regions(df, regions)) == {(2, 1), (2, 2), (3, 3), (4, 3), (6, 1), (8, 3)}
    assert P.containing_regions(df, spark.createDataFrame([], REGION)).count() == 0


def test_star_shaped_region_agrees_with_ray_casting(spark, rows):
    rnd = random.Random(7)
    ring = [(30 + r * math.cos(a), 40 + r * math.sin(a)) for a, r in ((2 * math.pi * k / 60, rnd.uniform(0.4, 3)) for k in range(60))]
    wkt = "POLYGON((" + ", ".join(f"{x:.7f} {y:.7f}" for x, y in [*ring, ring[0]]) + "))"
    ring = P._rings(wkt)[0]
    pts = [(k, rnd.uniform(36, 44), rnd.uniform(26, 34)) for k in range(600)]
    want = set()
    for k, y, x in pts:
        n = sum((x0 > x) != (x1 > x) and y0 + (y1 - y0) * (x - x0) / (x1 - x0) <= y for (x0, y0), (x1, y1) in zip(ring, ring[1:]))
        if n % 2:
            want.add((k, 1))
    df = spark.createDataFrame([(*p, 0, "r") for p in pts], POINT)
    assert rows(P.containing_regions(df, spark.createDataFrame([(1, wkt, 0)], REGION))) == want and want


def test_a_hot_position_and_a_hot_tile_are_split_and_whole(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 5)
    monkeypatch.setattr(P, "TILE_ROWS", 7)
    pts = [(k, 10.0, 20.0) for k in range(40)] + [(100 + k, 10.0002, 20.0) for k in range(20)] + [(200, 10.1, 20.0)]
    df = spark.createDataFrame([(*p, 0, "r") for p in pts], POINT)
    want = brute(pts, 50.0)
    assert rows(P.near_pairs(df, 50.0)) == want
    degree = {k: sum(k in w for w in want) for k, _, _ in pts}
    assert rows(P.near_spots(df, 50.0).counts()) == {(k, 0 if k < 100 else 100 if k < 200 else 200, degree[k]) for k, _, _ in pts}
    region = spark.createDataFrame([(1, "POLYGON((19 9, 21 9, 21 11, 19 11, 19 9))", 0)], REGION)
    assert rows(P.containing_regions(df, region)) == {(k, 1) for k, _, _ in pts}


def test_edges_are_stored_for_the_tiles_they_pass(spark):
    n = 400
    ring = [(10 * math.cos(2 * math.pi * k / n), 10 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    wkt = "POLYGON((" + ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"
    slabs = P.region_slabs(spark.createDataFrame([(1, wkt, 0)], REGION)).collect()
    assert sum(len(e) for r in slabs for e in r.edges) < 3 * n
    assert any(not any(r.edges) and all(b == 1 for b in r.below) for r in slabs)
