"""Queries over all rows of their tables."""

import pytest
from pyspark.sql import functions as F

from quarryglass.functions.texts import seconds_text
from quarryglass.queries import CATALOG
from quarryglass.sources.tables import table


def test_every_event_has_a_duration_text(spark, data):
    texts = CATALOG.runs["duration_text"](spark, data)
    assert texts.count() == table(spark, data, "events").count() and texts.where("text IS NULL").count() == 0
    assert {r.unit for r in texts.select(F.substring("text", -1, 1).alias("unit")).distinct().collect()} == {"s", "m", "h"}


@pytest.mark.parametrize("seconds,text", [(None, None), (59.4, "59s"), (60.0, "1.0m"), (69.0, "1.1m"), (560.21, "9.3m"), (3599.0, "60.0m"), (3600.0, "1.0h"), (5400.0, "1.5h"), (3.6e7, "10000.0h")])
def test_seconds_text(spark, seconds, text):
    assert spark.createDataFrame([(seconds,)], "s double").select(seconds_text(F.col("s"))).first()[0] == text


def test_files_that_a_phase_does_not_know_stay(spark, data):
    ids = {r.file_id for t in ("image_metadata", "content_analysis", "ml_analysis") for r in table(spark, data, t, "file_id").where("file_id IS NOT NULL").distinct().collect()}
    merged = CATALOG.runs["phase_merge"](spark, data).collect()
    assert sorted(r.file_id for r in merged) == sorted(ids)
    assert any(r.width is None for r in merged) and any(r.quality_score is None for r in merged)


def test_null_fields_make_the_round_trip(spark, data):
    assert CATALOG.runs["record_round_trip"](spark, data).where("width IS NULL OR model IS NULL").count() > 0


@pytest.mark.parametrize("name", ["search_tags_any", "search_categories"])
def test_searches_keep_files_without_quality_or_duration(spark, rows, name):
    assert any(None in r[2:] for r in rows(CATALOG.runs[name](spark, "/root/testdata/sf0.01")))


def test_every_file_gets_a_name(spark, data):
    plan = CATALOG.runs["rename_plan"](spark, data).collect()
    paths = [r.file_path for r in CATALOG.runs["phase_merge"](spark, data).where("file_path IS NOT NULL").collect()]
    assert sorted(r.path for r in plan) == sorted(paths) and len({r.new_name for r in plan}) == len(plan)
    assert any(r.new_name.startswith("{year}-{month}_") for r in plan) and any("_{camera}" in r.new_name for r in plan)
