"""Date texts that are long only by what stands around or between their fields."""

import pytest
from pyspark.sql import functions as F

from quarryglass.functions.instants import trimmed, utc_micros

NOON = 1710504000_000000
PADS = (" ", "\0", "\t", "\n", "\r", "\x0b", "\f", "\u00a0", "\ufeff")


@pytest.mark.parametrize("pad", PADS)
def test_padding_of_any_length(spark, pad):
    texts = [pad * 300 + "2024-03-15 12:00:00", "2024-03-15 12:00:00" + pad * 5_000, pad * 90 + "2024-03-15 12:00:00" + pad * 92]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(utc_micros(F.col("t"), F.lit(None).cast("string"), F.lit("UTC"))).collect()] == [NOON] * 3


def test_long_texts_between_fields_and_without_a_date(spark):
    texts = ["2024-03-15" + " " * 400 + "12:00:00", "x" * 100_000, "2024-03-15 12:00:00" + "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(utc_micros(F.col("t"), F.lit(None).cast("string"), F.lit("UTC"))).collect()] == [NOON, None, None]


def test_trimmed_ends_only(spark):
    every = "".join(PADS)
    assert spark.createDataFrame([(every + "a" + every + "b" + every,), (every,), (None,)], "t string").select(trimmed(F.col("t"))).collect() == [("a" + every + "b",), ("",), (None,)]
