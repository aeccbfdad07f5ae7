"""Queries on duplicates of new batches."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.llm.linkage import LEVELS, batch_records, cached_records, clusters_of_batches, duplicates_of_batches, levels_of, link_history, weighed
from quarryglass.sources.tables import table

_BARE = "regexp_replace(regexp_replace(lower({0}), '^\\s*((md5:|sha256:|0x)\\s*)?', ''), '\\s+$', '')"

FOUND_SQL = f"""
WITH digests AS (
  SELECT file_id, 0 AS batch, {_BARE.format("file_hash")} AS h FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cached_at DESC) AS n FROM file_cache) WHERE n = 1
  UNION ALL
  SELECT file_id, batch_id, {_BARE.format("file_hash")} FROM (SELECT *, row_number() OVER (PARTITION BY file_id, batch_id ORDER BY checked_at DESC) AS n FROM duplication_result) WHERE n = 1),
looks AS (
  SELECT file_id, max(CASE WHEN regexp_full_match(x, '[0-9a-f]{{16}}') THEN ('0x' || x)::UBIGINT END) AS bits
  FROM (SELECT file_id, {_BARE.format("phash")} AS x FROM content_analysis) GROUP BY file_id),
files AS (SELECT file_id, batch, CASE WHEN h <> '' AND NOT regexp_full_match(h, '0+') THEN h END AS h, bits FROM digests LEFT JOIN looks USING (file_id)),
links AS (
  SELECT a.file_id AS x, b.file_id AS y FROM files a JOIN files b ON a.h = b.h WHERE a.batch < b.batch AND a.file_id <> b.file_id
  UNION ALL
  SELECT a.file_id, b.file_id FROM files a JOIN files b ON a.batch < b.batch AND bit_count(xor(a.bits, b.bits)) <= 4 WHERE a.file_id <> b.file_id)"""

CLUSTER_SQL = f"""WITH RECURSIVE {FOUND_SQL.strip()[5:]},
pairs AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM links),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(n, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.n WHERE r.root < e.b),
roots AS (SELECT n, min(root) AS root FROM reach GROUP BY n)
SELECT n AS file_id, root AS cluster_id, (SELECT count(*) FROM both_ways WHERE a = n) AS links FROM roots"""


LEVELS_SQL = FOUND_SQL.replace("max(CASE WHEN regexp_full_match(x,", "max(CASE WHEN regexp_full_match(y, '[0-9a-f]{16}') THEN ('0x' || y)::UBIGINT END) AS look, max(CASE WHEN regexp_full_match(x,").replace(
    " AS x FROM content_analysis", f" AS x, {_BARE.format('average_hash')} AS y FROM content_analysis").replace(" END AS h, bits FROM", " END AS h, bits, look FROM").split("links AS (")[0] + """
met AS (SELECT a.h AS ha, b.h AS hb, a.bits AS ba, b.bits AS bb, a.look AS la, b.look AS lb FROM files a JOIN files b ON a.h = b.h WHERE a.batch < b.batch AND a.file_id <> b.file_id
  UNION ALL SELECT a.h, b.h, a.bits, b.bits, a.look, b.look FROM files a JOIN files b ON a.batch < b.batch AND bit_count(xor(a.bits, b.bits)) <= 4 WHERE a.file_id <> b.file_id AND (a.h = b.h) IS NOT TRUE),
apart AS (SELECT coalesce(ha = hb, false) AS same, bit_count(xor(ba, bb)) AS b, bit_count(xor(la, lb)) AS k FROM met)
SELECT CASE WHEN same THEN 'same' ELSE 'differs' END AS digest, CASE WHEN b IS NULL THEN 'none' WHEN b = 0 THEN '0' WHEN b <= 2 THEN '1-2' WHEN b <= 4 THEN '3-4' ELSE 'far' END AS bits,
  CASE WHEN k IS NULL THEN 'none' WHEN k <= 4 THEN '0-4' WHEN k <= 12 THEN '5-12' ELSE 'far' END AS look, count(*) AS links FROM apart GROUP BY ALL"""


def _records(spark, d):
    content = table(spark, d, "content_analysis", "file_id", "phash", "average_hash")
    cache = table(spark, d, "file_cache", "file_id", "file_hash", "cached_at")
    results = table(spark, d, "duplication_result", "file_id", "file_hash", "batch_id", "checked_at")
    return cached_records(cache, content), batch_records(results, content)


def register(c: Catalog) -> None:
    @c.query("p1_found", FOUND_SQL + "\nSELECT DISTINCT least(x, y) AS file_id_a, greatest(x, y) AS file_id_b FROM links")
    def found(spark, d):
        return duplicates_of_batches(*_records(spark, d))

    @c.query("p1_clusters", CLUSTER_SQL)
    def clusters(spark, d):
        return clusters_of_batches(*_records(spark, d))

    @c.query("p1_levels", LEVELS_SQL)
    def levels(spark, d):
        links = link_history(*_records(spark, d), clusters=False).links
        return links.select(*levels_of()).groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("links"))

    @c.query("p1_scored")
    def scored(spark, d):
        linker = link_history(*_records(spark, d), clusters=False)
        return weighed(linker.links, linker.weights()).groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("links"), F.max("weight").alias("weight"))
