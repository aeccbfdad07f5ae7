"""Queries on records, phases, embedded strings and reports."""

from pyspark.sql import functions as F

from quarryglass.catalog import Catalog
from quarryglass.functions.texts import generated_name
from quarryglass.functions.vectors import distinct_labels
from quarryglass.operators.records import complete, duplicate_lines, embedding_plan, from_json_records, parsed_name, phases_done, to_json_records
from quarryglass.queries.common import ASSET, FILES, IMG, assets, hashed_files, images
from quarryglass.sources.tables import table


def register(c: Catalog) -> None:
    # integers as doubles, which keep their nulls in every reader
    @c.query("record_round_trip", f"WITH {IMG} SELECT file_id, width::DOUBLE AS width, model, gps_coordinates, scanned_at FROM img")
    def round_trip(spark, d):
        j = to_json_records(images(spark, d).select("file_id", "width", "model", "gps_coordinates", F.col("scanned_at").cast("timestamp").alias("scanned_at")), "file_id")
        back = from_json_records(j, "file_id", "width int, model string, gps_coordinates string, scanned_at timestamp, unknown double")
        return back.select("file_id", F.col("width").cast("double").alias("width"), "model", "gps_coordinates", F.col("scanned_at").cast("timestamp_ntz").alias("scanned_at"))

    _done = "list_filter([CASE WHEN width IS NOT NULL THEN 'metadata' END, CASE WHEN quality_score IS NOT NULL THEN 'content' END, CASE WHEN primary_scene IS NOT NULL THEN 'ml' END], lambda x: x IS NOT NULL)"

    @c.query("phases_complete", f"WITH {ASSET} SELECT file_id, array_to_string({_done}, ',') AS done, len({_done}) = 3 AS complete FROM asset")
    def phases(spark, d):
        done = phases_done(metadata=F.col("width").isNotNull(), content=F.col("quality_score").isNotNull(), ml=F.col("primary_scene").isNotNull())
        return assets(spark, d).select("file_id", done.alias("d")).select("file_id", F.array_join("d", ",").alias("done"), complete(F.col("d")).alias("complete"))

    @c.query("embed_plan", f"WITH {ASSET} SELECT file_id, array_to_string(tags, ', ') AS comment, concat_ws(', ', 'Quality: ' || floor(quality_score)::BIGINT || '/100', 'Sharpness: ' || sharpness_level) AS description FROM asset WHERE len(tags) > 0")
    def embed(spark, d):
        return embedding_plan(assets(spark, d), "tags", distinct_labels(F.col("objects"))).select("file_id", "comment", "description")

    @c.query("filename_parse", "SELECT event_id, date_trunc('second', ts) AS stamp, substr(md5(event_id::VARCHAR), 1, 8) AS hex, 'png' AS ext FROM events")
    def parse(spark, d):
        n = generated_name(F.col("ts"), F.col("event_id"), F.lit("PNG"))
        return table(spark, d, "events").select("event_id", parsed_name(n).alias("p")).select("event_id", F.col("p.stamp").cast("timestamp_ntz").alias("stamp"), "p.hex", "p.ext")

    @c.query("duplicate_report", f"WITH {FILES}, n AS (SELECT *, count(*) OVER (PARTITION BY digest) AS n FROM files WHERE digest IS NOT NULL) SELECT digest, (row_number() OVER (PARTITION BY digest ORDER BY path))::INT AS place, path || ' (' || floor(coalesce(size, 0) / 1024)::BIGINT || ' KB)' AS line FROM n WHERE n > 1")
    def report(spark, d):
        return duplicate_lines(hashed_files(spark, d), "digest")
