"""Queries on the best representative of each group."""

from quarryglass.catalog import Catalog
from quarryglass.llm.survivors import VOTED, fused_fields, survivors
from quarryglass.sources.tables import table

_PATH = "nullif(regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '[\\\\/]+', '/', 'g'), '')"

FOUND_SQL = f"""
WITH RECURSIVE last AS (
  SELECT file_id, {_PATH.format("file_path")} AS path, {_PATH.format("duplicate_of")} AS named, quality_score AS q, confirmed, checked_at
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY checked_at DESC NULLS LAST) AS n FROM duplication_result) WHERE n = 1),
ties AS (SELECT path AS a, named AS b FROM last WHERE named <> path),
both_ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach(n, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.n),
parts AS (SELECT n, min(root) AS root FROM reach GROUP BY n),
files AS (SELECT l.*, p.root FROM last l JOIN parts p ON l.path = p.n),
groups AS (SELECT root, min(file_id) AS group_id FROM files GROUP BY root HAVING count(*) > 1),
images AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) AS n FROM image_metadata) WHERE n = 1),
ranked AS (
  SELECT group_id, f.file_id, i.model, i.lens_model, i.iso_speed_ratings, i.latitude, i.longitude,
    row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN isnan(q) OR q IS NULL OR q < 0 OR q > 100 THEN 1 ELSE -q END, coalesce(confirmed, false) DESC, checked_at DESC NULLS LAST, f.file_id) AS r
  FROM files f JOIN groups USING (root) LEFT JOIN images i ON i.file_id = f.file_id),
offers AS (
  SELECT group_id, 'kept_file' AS field, file_id, r FROM ranked
  UNION ALL SELECT group_id, 'model', file_id, r FROM ranked WHERE trim(model) <> ''
  UNION ALL SELECT group_id, 'lens_model', file_id, r FROM ranked WHERE trim(lens_model) <> ''
  UNION ALL SELECT group_id, 'iso_speed_ratings', file_id, r FROM ranked WHERE iso_speed_ratings IS NOT NULL
  UNION ALL SELECT group_id, 'latitude', file_id, r FROM ranked
    WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))
SELECT group_id, field, arg_min(file_id, r) AS file_id FROM offers GROUP BY group_id, field"""


ROUNDS = 20


def _truth_sql() -> str:
    """The rounds written out; once nothing moves, further rounds repeat the last."""
    fields = " UNION ALL ".join(f"SELECT group_id, path, w, '{f}' AS field, trim(i.{f}::VARCHAR) AS value FROM weighed f JOIN images i ON i.file_id = f.file_id" for f in VOTED)
    sql = FOUND_SQL.split("ranked AS (")[0] + f"""
spans AS (SELECT group_id, min(epoch_us(checked_at))::DOUBLE AS a, max(epoch_us(checked_at))::DOUBLE AS b FROM files JOIN groups USING (root) GROUP BY group_id),
weighed AS (SELECT group_id, f.file_id, path, round((1 + CASE WHEN q BETWEEN 0 AND 100 AND NOT isnan(q) THEN q ELSE 0 END / 100) * CASE WHEN confirmed THEN 2.0::DOUBLE ELSE 1 END
  * (1 + CASE WHEN b > a THEN coalesce((epoch_us(checked_at) - a) / (b - a), 0) ELSE 0 END), 9) AS w FROM files f JOIN groups USING (root) JOIN spans USING (group_id)),
claims AS MATERIALIZED (SELECT group_id AS object, field, regexp_extract(path, '^(.*)/[^/]*$', 1) AS source, value, max(w) AS w FROM ({fields}) WHERE value <> '' AND path IS NOT NULL GROUP BY ALL),
trust0 AS (SELECT DISTINCT source, 1.0::DOUBLE AS trust FROM claims)"""
    for k in range(1, ROUNDS + 1):
        sql += f""",
votes{k} AS MATERIALIZED (SELECT object, field, value, round(sum(trust * w), 9) AS support, count(*) AS sources FROM claims JOIN trust{k - 1} USING (source) GROUP BY ALL),
won{k} AS MATERIALIZED (SELECT object, field, value, support, sources FROM (SELECT *, row_number() OVER (PARTITION BY object, field ORDER BY support DESC, value) AS r FROM votes{k}) WHERE r = 1),
trust{k} AS MATERIALIZED (SELECT source, -ln((count(*) FILTER (WHERE c.value <> v.value) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS trust FROM claims c JOIN won{k} v USING (object, field) GROUP BY source)"""
    return sql + f"\nSELECT object AS group_id, field, value, round(support, 6) AS support, sources FROM won{ROUNDS}"


def register(c: Catalog) -> None:
    @c.query("p3_found", FOUND_SQL)
    def found(spark, d):
        return survivors(table(spark, d, "duplication_result"), table(spark, d, "image_metadata"))

    @c.query("p3_truth", _truth_sql())
    def truth(spark, d):
        return fused_fields(table(spark, d, "duplication_result"), table(spark, d, "image_metadata"), ROUNDS).drop("settled")
