"""Date texts in full-width forms and other digits, and readings before and after the tabulated years."""

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryglass.functions.instants import transitions, utc_micros

EPOCH = datetime(1970, 1, 1)
NOON = 1710504000_000000
WIDE = {c: chr(c + 0xFEE0) for c in range(0x21, 0x7F)} | {0x20: "　"}


def test_forms_of_one_instant(spark):
    plain = ["2024:03:15 12:00:00", "2024-03-15T14:00:00+02:00", "Fri, 15 Mar 2024 12:00:00 GMT", "03/15/2024 12:00:00 PM", "15.03.2024 12:00", "2024年03月15日 12時00分00秒", "1710504000"]
    texts = [t.translate(WIDE) for t in plain] + ["　" * 300 + "2024:03:15　　12:00:00" + "　" * 300]
    for zero in (0x660, 0x966, 0xE50, 0x1D7D8):
        texts.append("2024-03-15 12:00:00".translate({0x30 + k: chr(zero + k) for k in range(10)}))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(utc_micros(F.col("t"), F.lit(None).cast("string"), F.lit("UTC"))).collect()] == [NOON] * len(texts)


def test_full_width_texts_that_denote_nothing(spark):
    df = spark.createDataFrame([("９９９９－９９－９９",), ("　",), ("２０２４：０２：３０　１０：００：００",), ("①②③④:03:15 12:00:00",)], "t string")
    assert [r[0] for r in df.select(utc_micros(F.col("t"), F.lit(None).cast("string"), F.lit("UTC"))).collect()] == [None] * 4


def test_summer_after_the_table(spark):
    df = spark.createDataFrame([("2150-07-01 12:00:00",), ("2150-01-15 12:00:00",), ("2801-07-01 12:00:00",)], "t string")
    got = [r[0] for r in df.select(utc_micros(F.col("t"), F.lit(None).cast("string"), F.lit("Europe/Berlin"))).collect()]
    assert got == [(datetime(y, m, d, h) - EPOCH) // timedelta(microseconds=1) for y, m, d, h in ((2150, 7, 1, 10), (2150, 1, 15, 11), (2801, 7, 1, 10))]


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "America/Santiago"]), st.lists(st.datetimes(datetime(1500, 1, 1), datetime(9990, 1, 1)), min_size=1, max_size=50))
def test_any_year_agrees_with_the_standard_library(name, local):
    us = np.array([(d - EPOCH) // timedelta(microseconds=1) for d in local])
    utc, once = transitions(name).to_utc(us)
    for d, a, b, k in zip(local, us.tolist(), utc.tolist(), once.tolist()):
        early, late = (d.replace(tzinfo=ZoneInfo(name), fold=f).utcoffset() for f in (0, 1))
        assert k == (early == late)
        if k:
            assert a - b == early // timedelta(microseconds=1)
