"""Queries on positions."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.operators.places import containing_regions, near_pairs, near_spots, positions
from quarryglass.plans.cut import Scratch
from quarryglass.sources.tables import table

NEAR_M = 50.0

POSITIONS_SQL = """
pos AS (
  SELECT file_id, latitude AS lat, longitude AS lon FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST, latitude DESC NULLS LAST, longitude DESC NULLS LAST) AS n
    FROM image_metadata WHERE file_id IS NOT NULL)
  WHERE n = 1 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))"""

NEAR_SQL = """
near AS (
  SELECT a.file_id AS id_a, b.file_id AS id_b FROM pos a JOIN pos b ON a.file_id < b.file_id AND abs(a.lat - b.lat) < 0.001
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 50)"""

HELD_SQL = """
rings AS (SELECT region_id, unnest(regexp_extract_all(boundary_wkt, '\\(([^()]*)\\)', 1)) AS ring FROM geo_region),
vertices AS (SELECT region_id, ring, generate_subscripts(list, 1) AS k, unnest(list) AS v FROM (SELECT region_id, ring, string_split(ring, ',') AS list FROM rings)),
xy AS (SELECT region_id, ring, k, string_split(trim(v), ' ')[1]::DOUBLE AS x, string_split(trim(v), ' ')[2]::DOUBLE AS y FROM vertices),
edges AS (SELECT a.region_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM xy a JOIN xy b ON a.region_id = b.region_id AND a.ring = b.ring AND b.k = a.k + 1),
turned AS (SELECT file_id, lat, lon + t AS lon FROM pos, (VALUES (0.0), (360.0)) AS turns(t)),
held AS (
  SELECT DISTINCT file_id, region_id FROM (
    SELECT p.file_id, p.lon, e.region_id, count(*) AS n FROM turned p JOIN edges e ON (e.x0 > p.lon) <> (e.x1 > p.lon)
     AND e.y0 + (e.y1 - e.y0) * ((p.lon - e.x0) / (e.x1 - e.x0)) <= p.lat GROUP BY ALL)
  WHERE n % 2 = 1)"""

FOUND_SQL = f"""WITH {POSITIONS_SQL.strip()}, {NEAR_SQL.strip()}, {HELD_SQL.strip()}
SELECT 'photo' AS kind, id_a, id_b FROM near UNION ALL SELECT 'region', file_id, region_id FROM held"""

PER_REGION_SQL = f"""WITH {POSITIONS_SQL.strip()}, {HELD_SQL.strip()}
SELECT region_id, count(*) AS files FROM held GROUP BY region_id"""


def register(c: Catalog) -> None:
    @c.query("p2_found", FOUND_SQL)
    def found(spark, d):
        where = Scratch(spark, "positions").write(positions(table(spark, d, "image_metadata")))
        near = near_pairs(where, NEAR_M).select(F.lit("photo").alias("kind"), "id_a", "id_b")
        held = containing_regions(where, table(spark, d, "geo_region"))
        return near.union(held.select(F.lit("region"), "id", "region_id"))

    @c.query("p2_files_per_region", PER_REGION_SQL)
    def per_region(spark, d):
        held = containing_regions(positions(table(spark, d, "image_metadata")), table(spark, d, "geo_region"))
        return held.groupBy("region_id").agg(F.count(F.lit(1)).alias("files"))

    @c.query("p2_neighbour_counts", f"""WITH {POSITIONS_SQL.strip()}, {NEAR_SQL.strip()}, ends AS (SELECT id_a AS id FROM near UNION ALL SELECT id_b FROM near)
        SELECT file_id AS id, min(file_id) OVER (PARTITION BY lat, lon) AS spot, (SELECT count(*) FROM ends WHERE id = file_id) AS neighbours FROM pos""")
    def neighbour_counts(spark, d):
        return near_spots(positions(table(spark, d, "image_metadata")), NEAR_M).counts()
