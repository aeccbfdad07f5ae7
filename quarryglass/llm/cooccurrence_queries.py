"""Queries on items that appear together."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.llm.cooccurrence import associations
from quarryglass.sources.tables import table

PAIRS_SQL = """
WITH raw AS (
  SELECT file_id, unnest(tags) AS item FROM ml_analysis
  UNION ALL SELECT file_id, unnest(list_filter(map_keys(object_counts), lambda k: object_counts[k] > 0)) FROM ml_analysis),
items AS (SELECT DISTINCT file_id, trim(translate(lower(item), '_-', '  ')) AS item FROM raw WHERE trim(translate(item, '_-', '  ')) <> ''),
total AS (SELECT count(DISTINCT file_id) AS n FROM ml_analysis),
used AS (SELECT item, count(*) AS files FROM items GROUP BY item HAVING count(*) >= greatest(5, (SELECT n FROM total) / 1000.0)),
kept AS (SELECT i.* FROM items i SEMI JOIN used u ON i.item = u.item),
pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS together FROM kept a JOIN kept b ON a.file_id = b.file_id AND a.item < b.item GROUP BY ALL),
judged AS (SELECT p.*, ua.files AS files_a, ub.files AS files_b, n FROM pairs p JOIN used ua ON ua.item = item_a JOIN used ub ON ub.item = item_b, total
  WHERE together >= 5 AND together * 1000 >= n AND together * n >= 3 * ua.files * ub.files)"""

H = "(CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END)"
_CELLS = " + ".join(H.format(x) for x in ("(together)::DOUBLE", "(files_a - together)::DOUBLE", "(files_b - together)::DOUBLE", "(n - files_a - files_b + together)::DOUBLE"))
_MARGINS = " + ".join(H.format(x) for x in ("(files_a)::DOUBLE", "(n - files_a)::DOUBLE", "(files_b)::DOUBLE", "(n - files_b)::DOUBLE"))


def register(c: Catalog) -> None:
    @c.query("p4_found", PAIRS_SQL + "\nSELECT item_a, item_b FROM judged")
    def found(spark, d):
        return associations(table(spark, d, "ml_analysis")).select("item_a", "item_b")

    @c.query("p4_significance", PAIRS_SQL + f"\nSELECT item_a, item_b, together, files_a, files_b, floor(2 * (({_CELLS}) - ({_MARGINS}) + n * ln(n)))::BIGINT AS llr FROM judged")
    def significance(spark, d):
        return associations(table(spark, d, "ml_analysis")).select("item_a", "item_b", "together", "files_a", "files_b", F.floor("llr").alias("llr"))
