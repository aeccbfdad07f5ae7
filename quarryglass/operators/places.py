"""Which points are near one another, and which regions hold a point.

Near points meet through an equi-join on cells of a grid whose columns narrow towards the poles. Regions are cut by
trapezoidal decomposition: the abscissae of a boundary's vertices split it into slabs in which no two edges cross, the
edges of a slab are ordered from south to north, and a point is located by one binary search among the slabs and one
among the edges of its slab. Slabs are distributed by square tiles of degrees.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryglass.plans.cut import Scratch
from quarryglass.plans.salt import salted_join

EARTH_M = 6_371_008.8
#: Degrees by which rounding may move an edge.
SLACK = 1e-9
#: Side of a grid cell over the search radius. At 4, the disc around a point touches 2.25 cells on average.
CELL = 4.0
#: Left rows of one cell or position that a task takes, and points of one tile.
CELL_ROWS, TILE_ROWS = 2_000, 1_000_000


def usable(lat: Column, lon: Column) -> Column:
    """Both present and in range, not both zero."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon)


def positions(images: DataFrame) -> DataFrame:
    """``(file_id, lat, lon)``: the usable position of each file, of its delivery with the latest ``scanned_at``.

    Among rows that tie, the one with the greatest (latitude, longitude). Rows without a ``file_id`` give nothing.
    """
    at = F.struct("scanned_at", "latitude", "longitude")
    rows = images.select("file_id", "scanned_at", "latitude", "longitude").where("file_id IS NOT NULL")
    last = rows.groupBy("file_id").agg(F.max(at).alias("p"))
    return last.select("file_id", F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon")).where(usable(F.col("lat"), F.col("lon")))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres of positions in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _columns_of(row: Column, step: float) -> Column:
    """Cells around the globe in a row of the grid, so that a cell is at least ``step`` degrees of a great circle wide."""
    edge = F.greatest(F.abs(row * step), F.abs((row + 1) * step))
    return F.greatest(F.lit(1), F.floor(360.0 / step * F.cos(F.radians(F.least(F.lit(90.0), edge))))).cast("bigint")


@dataclass
class NearSpots:
    """Distinct positions near one another, and the points at each.

    ``points``: ``(_id, _lat, _lon)``. ``spots``: ``(_lat, _lon, _spot, n)``, the smallest id and the number of points of a
    position. ``pairs``: ``(_a, _b, _lat_a, _lon_a, _lat_b, _lon_b)`` of positions, each pair once.
    """

    points: DataFrame
    spots: DataFrame
    pairs: DataFrame

    def counts(self) -> DataFrame:
        """``(id, spot, neighbours)`` of every point: its position's smallest id and how many other points are near."""
        ends = self.pairs.select(F.col("_a").alias("_spot"), F.col("_b").alias("_other")).union(self.pairs.select("_b", "_a"))
        near = ends.join(self.spots.select(F.col("_spot").alias("_other"), "n"), "_other").groupBy("_spot").agg(F.sum("n").alias("_near"))
        sized = self.spots.join(near, "_spot", "left").select("_lat", "_lon", "_spot", (F.col("n") - 1 + F.coalesce("_near", F.lit(0))).alias("neighbours"))
        return salted_join(self.points, sized, ["_lat", "_lon"], "_id", TILE_ROWS, self._held()).select(F.col("_id").alias("id"), F.col("_spot").alias("spot"), "neighbours")

    def expanded(self) -> DataFrame:
        """``(id_a, id_b)``, smaller first: all pairs of points. A crowded position is split over several tasks."""
        at = lambda s: self.points.select(F.col("_id").alias(f"_id_{s}"), F.col("_lat").alias(f"_lat_{s}"), F.col("_lon").alias(f"_lon_{s}"))
        crowd = lambda s: self._held().withColumnsRenamed({"_lat": f"_lat_{s}", "_lon": f"_lon_{s}"})
        half = salted_join(at("a"), self.pairs, ["_lat_a", "_lon_a"], "_id_a", CELL_ROWS, crowd("a")).select("_id_a", "_lat_b", "_lon_b")
        apart = salted_join(at("b"), half, ["_lat_b", "_lon_b"], "_id_b", CELL_ROWS, crowd("b")).select("_id_a", "_id_b")
        mate = at("b").select("_id_b", F.col("_lat_b").alias("_lat_a"), F.col("_lon_b").alias("_lon_a"))
        same = salted_join(at("a"), mate, ["_lat_a", "_lon_a"], "_id_a", CELL_ROWS, crowd("a")).where("_id_a < _id_b").select("_id_a", "_id_b")
        return apart.union(same).select(F.least("_id_a", "_id_b").alias("id_a"), F.greatest("_id_a", "_id_b").alias("id_b"))

    def _held(self) -> DataFrame:
        return self.spots.select("_lat", "_lon", F.col("n").alias("_salt_n"))


def near_pairs(points: DataFrame, metres: float, id_col: str = "file_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``(id_a, id_b)``, smaller first: all pairs of different ids at most ``metres`` apart on the sphere; see :func:`near_spots`."""
    return near_spots(points, metres, id_col, lat, lon).expanded()


def near_spots(points: DataFrame, metres: float, id_col: str = "file_id", lat: str = "lat", lon: str = "lon") -> NearSpots:
    """The positions at most ``metres`` apart on the sphere, and the points at each.

    ``points`` has one row per id with usable degrees. Points of the same position are one class, so that the search runs
    over distinct positions. A crowded cell is split over several tasks by ``salted_join``; nothing is capped. Poles and the
    180th meridian need no care by the caller. Null ids or positions match nothing; an empty table gives an empty result.
    """
    p = points.select(F.col(id_col).alias("_id"), (F.col(lat) + 0.0).alias("_lat"), (F.col(lon) + 0.0).alias("_lon")).where("_id IS NOT NULL AND _lat IS NOT NULL AND _lon IS NOT NULL")
    scratch = Scratch(points.sparkSession, "near")
    p = scratch.write(p, "points")
    spot = scratch.write(p.groupBy("_lat", "_lon").agg(F.min("_id").alias("_spot"), F.count(F.lit(1)).alias("n")), "spots")
    reach = math.degrees(metres / EARTH_M) * (1 + 1e-9)
    step = reach * CELL
    row = F.floor(F.col("_lat") / step)
    col = lambda r, x: F.floor(F.pmod(x + 180.0, F.lit(360.0)) / 360.0 * _columns_of(r, step)).cast("bigint")
    base = spot.select("_spot", "_lat", "_lon")
    held = base.select(F.col("_spot").alias("_a"), F.col("_lat").alias("_lat_a"), F.col("_lon").alias("_lon_a"), row.alias("_row"), col(row, F.col("_lon")).alias("_col"))
    # how far the disc reaches east and west; near a pole it goes all the way round
    width = F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(F.col("_lat")))
    far = F.when(F.abs("_lat") + reach >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), width))) * (1 + 1e-9))
    rows = base.withColumn("_far", far).withColumn("_row", F.explode(F.sequence(F.floor((F.col("_lat") - reach) / step), F.floor((F.col("_lat") + reach) / step))))
    n = _columns_of(F.col("_row"), step)
    west, east = (F.floor((F.col("_lon") + s * F.col("_far") + 180.0) / 360.0 * n).cast("bigint") for s in (-1, 1))
    cols = F.when(east - west >= n - 1, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(F.sequence(west, east), lambda c: F.pmod(c, n)))
    seeking = rows.select(F.col("_spot").alias("_b"), F.col("_lat").alias("_lat_b"), F.col("_lon").alias("_lon_b"), "_row", F.explode(F.array_distinct(cols)).alias("_col"))
    met = salted_join(held, seeking, ["_row", "_col"], "_a", CELL_ROWS)
    spots = met.where("_a < _b").where(great_circle_m(F.col("_lat_a"), F.col("_lon_a"), F.col("_lat_b"), F.col("_lon_b")) <= metres).select("_a", "_b", "_lat_a", "_lon_a", "_lat_b", "_lon_b")
    return NearSpots(p, spot, scratch.write(spots, "pairs"))


def _rings(wkt: str | None) -> list[list[tuple[float, float]]]:
    """All rings of a POLYGON or MULTIPOLYGON; holes need no mark under the even-odd rule."""
    out = []
    for body in re.findall(r"\(([^()]*)\)", wkt or ""):
        try:
            ring = [tuple(map(float, x.split()[:2])) for x in body.split(",")]
        except ValueError:
            continue
        if len(ring) >= 3 and all(len(v) == 2 and all(map(math.isfinite, v)) for v in ring):
            out.append(ring)
    return out


def _slabs(rings: list[list[tuple[float, float]]]) -> Iterator[tuple[float, float, list[tuple[float, float]]]]:
    """``(west, east, edges)``; an edge as its latitudes at both sides of the slab, from south to north."""
    edges = []
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if x0 != x1:
                edges.append((x0, y0, x1, y1) if x0 < x1 else (x1, y1, x0, y0))
    cuts = {x for e in edges for x in (e[0], e[2])}
    low, high = min(cuts, default=0.0), max(cuts, default=0.0)
    cuts |= {x for k in range(math.floor(low / 360) - 1, math.ceil(high / 360) + 2) if low < (x := 360.0 * k + 180) < high}
    edges.sort()
    live: list[tuple[float, float, float, float]] = []
    k = 0
    ordered = sorted(cuts)
    for west, east in zip(ordered, ordered[1:]):
        while k < len(edges) and edges[k][0] <= west:
            live.append(edges[k])
            k += 1
        live = [e for e in live if e[2] > west]
        at = lambda e, x: e[1] + (e[3] - e[1]) * ((x - e[0]) / (e[2] - e[0]))
        inside = sorted(((at(e, west), at(e, east)) for e in live), key=lambda y: y[0] + y[1])
        if inside:
            yield west, east, inside


def region_slabs(regions: DataFrame, tile: float = 1.0) -> DataFrame:
    """``(tile_x, tile_y, region_id, wests, easts, below, edges)``: for each tile of ``tile`` degrees, the slabs of each region there.

    ``wests`` ascends; ``edges[k]`` holds the latitudes ``(w, e)`` of those edges of slab k that may pass through the tile, from
    south to north, and ``below[k]`` is 1 where an odd number of edges lies south of it, so that a boundary's edges are stored
    about once for each tile they pass. Longitudes
    past 180 are turned back by whole rounds, slabs are cut at the 180th meridian. A boundary that is null or has no ring
    of three vertices gives nothing.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: dict[tuple[int, int, int], list] = {}
            for region, wkt in zip(b["region_id"], b["boundary_wkt"]):
                if pd.isna(region):
                    continue
                for west, east, edges in _slabs(_rings(wkt)):
                    turn = 360.0 * math.floor((west + 180) / 360)
                    w, e = west - turn, east - turn
                    for tx in range(math.floor(w / tile), math.ceil(e / tile)):
                        a, b = ((min(max(x, w), e) - w) / (e - w) for x in (tx * tile, (tx + 1) * tile))
                        spans = [tuple(sorted((y[0] + (y[1] - y[0]) * a, y[0] + (y[1] - y[0]) * b))) for y in edges]
                        for ty in range(math.floor(min(lo for lo, _ in spans) / tile), math.floor(max(hi for _, hi in spans) / tile) + 1):
                            # edges south of the tile count for all of its points, those north of it for none
                            south = sum(hi < ty * tile - SLACK for _, hi in spans)
                            near = [y for y, (lo, hi) in zip(edges, spans) if hi >= ty * tile - SLACK and lo <= (ty + 1) * tile + SLACK]
                            if near or south % 2:
                                rows.setdefault((tx, ty, int(region)), []).append((w, e, south % 2, near))
            out = []
            for (tx, ty, region), slabs in rows.items():
                slabs.sort(key=lambda s: s[0])
                out.append((tx, ty, region, [s[0] for s in slabs], [s[1] for s in slabs], [s[2] for s in slabs], [[{"w": y[0], "e": y[1]} for y in s[3]] for s in slabs]))
            if out:
                yield pd.DataFrame(out, columns=["tile_x", "tile_y", "region_id", "wests", "easts", "below", "edges"])

    schema = "tile_x int, tile_y int, region_id bigint, wests array<double>, easts array<double>, below array<int>, edges array<array<struct<w:double,e:double>>>"
    return regions.select("region_id", "boundary_wkt").dropDuplicates().mapInPandas(cut, schema)


def _last_at_most(n: Column, fits) -> Column:
    """The count of leading elements for which ``fits(k)`` (k from 1) holds, by binary search; it holds for a prefix."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    state = F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        going, ok = s["lo"] < s["hi"], fits(F.greatest(F.lit(1), mid))
        return F.struct(F.when(going & ok, mid).otherwise(s["lo"]).alias("lo"), F.when(going & ~ok, mid - 1).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(steps, state, halve, lambda s: s["lo"])


def containing_regions(points: DataFrame, regions: DataFrame, id_col: str = "file_id", lat: str = "lat", lon: str = "lon", tile: float = 1.0) -> DataFrame:
    """``(id, region_id)``: every region that holds each point, by the even-odd rule with straight edges in degrees.

    Overlapping and nested regions all count; of a boundary's points, those on its southern and western sides count as
    held. Points need usable degrees; null ones match nothing. Regions given twice count once. Points join the slabs on
    the tile; where one tile holds very many points, ``salted_join`` splits them.
    """
    turned = F.when(F.col(lon) >= 180, F.col(lon) - 360.0).otherwise(F.col(lon))
    p = points.select(F.col(id_col).alias("id"), F.col(lat).alias("_y"), turned.alias("_x"))
    p = p.withColumns({"tile_x": F.floor(F.col("_x") / tile).cast("int"), "tile_y": F.floor(F.col("_y") / tile).cast("int")})
    met = salted_join(p, region_slabs(regions, tile), ["tile_x", "tile_y"], "id", TILE_ROWS)
    met = met.withColumn("_k", _last_at_most(F.size("wests"), lambda k: F.get("wests", k - 1) <= F.col("_x"))).where("_k > 0")
    met = met.withColumns({"_w": F.get("wests", F.col("_k") - 1), "_e": F.get("easts", F.col("_k") - 1), "_below": F.get("below", F.col("_k") - 1), "_edges": F.get("edges", F.col("_k") - 1)}).where("_x < _e")
    met = met.withColumn("_t", (F.col("_x") - F.col("_w")) / (F.col("_e") - F.col("_w"))).select("id", "region_id", "_y", "_t", "_below", "_edges")

    def below(k: Column) -> Column:
        edge = F.get("_edges", k - 1)
        return edge["w"] + (edge["e"] - edge["w"]) * F.col("_t") <= F.col("_y")

    return met.where((F.col("_below") + _last_at_most(F.size("_edges"), below)) % 2 == 1).select("id", "region_id").distinct()
