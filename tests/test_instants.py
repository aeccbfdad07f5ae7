from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryglass.functions.instants import parser_of, transitions, utc_micros
from quarryglass.operators.capture_time import normalise_times


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1e6 + 0.5)


CASES = [
    ("2024:03:15 14:30:45", None, "UTC", us(2024, 3, 15, 14, 30, 45)),
    ("2024-03-15T14:30:45+0200", "+05:00", None, us(2024, 3, 15, 12, 30, 45)),
    ("2024-03-15 14:30:45", "-03:30", "UTC", us(2024, 3, 15, 18, 0, 45)),
    ("03/15/2024 2:30:45 PM", None, "UTC", us(2024, 3, 15, 14, 30, 45)),
    ("03/15/2024 12:00:00 AM", None, "UTC", us(2024, 3, 15)),
    ("15.03.2024 14:30", None, "UTC", us(2024, 3, 15, 14, 30)),
    ("15-Mar-2024 14:30:45", None, "UTC", us(2024, 3, 15, 14, 30, 45)),
    ("2024年03月15日 14時30分45秒", None, "Asia/Tokyo", us(2024, 3, 15, 5, 30, 45)),
    ("Fri Mar 15 14:30:45 2024", None, "UTC", us(2024, 3, 15, 14, 30, 45)),
    ("Fri, 15 Mar 2024 14:30:45 GMT", None, None, us(2024, 3, 15, 14, 30, 45)),
    ("20240315_143045-01", None, None, us(2024, 3, 15, 15, 30, 45)),
    ("2024-03-15T14:30:45.123456Z", None, None, us(2024, 3, 15, 14, 30, 45) + 123456),
    ("2024-03-15 14:30:45,5", None, "UTC", us(2024, 3, 15, 14, 30, 45) + 500000),
    ("2024-03-15T14:30:45+01:00[Europe/Berlin]", None, None, us(2024, 3, 15, 13, 30, 45)),
    ("2024-03-15 14:30:45 Europe/Berlin", "+09:00", None, us(2024, 3, 15, 13, 30, 45)),
    ("1710513045", None, None, 1710513045_000000),
    ("1710513045.25", None, None, 1710513045_250000),
    ("1710513045123", None, None, 1710513045_123000),
    ("1710513045123456", None, None, 1710513045_123456),
    (" 2024:03:15 14:30:45\u0000", None, "UTC", us(2024, 3, 15, 14, 30, 45)),
    ("2024-03-31 02:30:00", None, "Europe/Berlin", None),  # skipped
    ("2024-10-27 02:30:00", None, "Europe/Berlin", None),  # twice
    ("2024-10-27 02:30:00", "+01:00", "Europe/Berlin", us(2024, 10, 27, 1, 30)),
    ("2024-02-30 10:00:00", None, "UTC", None),
    ("2023-02-29 10:00:00", None, "UTC", None),
    ("2024-13-04T08:00:00", None, "UTC", None),
    ("2024-03-15 24:00:00", None, "UTC", None),
    ("03/15/2024 13:00:00 PM", None, "UTC", None),
    ("0000:00:00 00:00:00", None, "UTC", None),
    ("2024-03-15 14:30:45", None, None, None),
    ("2024-03-15 14:30:45 Mars/Phobos", None, "UTC", None),
    ("2024-03-15", None, "UTC", None),
    ("2024-03-15 14:30:45", "junk", "UTC", us(2024, 3, 15, 14, 30, 45)),
    ("", None, "UTC", None),
    ("x" * 5000, None, "UTC", None),
    (None, None, "UTC", None),
]


def test_texts(spark):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, t string, o string, z string")
    got = dict(map(tuple, df.select("k", utc_micros(F.col("t"), F.col("o"), F.col("z"))).collect()))
    assert {k: (CASES[k][0], v) for k, v in got.items()} == {k: (c[0], c[3]) for k, c in enumerate(CASES)}


def test_transitions_agree_with_the_database():
    from zoneinfo import ZoneInfo

    for name in ("America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "America/St_Johns"):
        t, zone = transitions(name), ZoneInfo(name)
        for s in range(1_200_000_000, 1_700_000_000, 7_654_321):
            naive = datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
            a, b = (naive.replace(tzinfo=zone, fold=f) for f in (0, 1))
            valid = a.utcoffset() == b.utcoffset()
            got, once = t.to_utc(np.array([s * 1_000_000]))
            assert bool(once[0]) == valid
            if valid:
                assert got[0] == int(a.timestamp()) * 1_000_000


def test_unknown_masks_have_no_parser():
    assert parser_of("aaa") is None and parser_of("9999-99-99") is None and parser_of("9999:99:99 99:99:99")


IMAGE = "file_id bigint, datetime_original string, offset_time_original string, datetime_modified string, offset_time string, body_serial_number string, scanned_at timestamp, _zone string, utc_us int"
CAMERA = "body_serial_number string, clock_zone string, file_id bigint"


def test_camera_zone_and_repeats(spark, rows):
    t = datetime(2024, 1, 1)
    images = spark.createDataFrame(
        [
            (1, "2024:01:02 03:04:05", None, None, None, " ab1 ", t, "x", 1),
            (1, "2024:01:02 03:04:05", None, None, None, " ab1 ", t, "x", 1),
            (1, "2024:01:02 05:00:00", None, "1700000000", None, "AB1", datetime(2024, 2, 1), "x", 1),
            (2, "2024:01:02 03:04:05", None, None, None, None, None, None, None),
            (None, "2024:01:02 03:04:05", "+00:00", None, None, "AB1", t, None, None),
        ],
        IMAGE,
    )
    cameras = spark.createDataFrame([("Ab1", "Asia/Tokyo", 9), (None, "UTC", None), ("zz", None, 1)], CAMERA)
    want = {(1, "datetime_original", us(2024, 1, 1, 20)), (1, "datetime_modified", 1700000000_000000)}
    assert rows(normalise_times(images, cameras)) == want


def test_empty_tables(spark):
    assert normalise_times(spark.createDataFrame([], IMAGE), spark.createDataFrame([], CAMERA)).count() == 0


@pytest.mark.parametrize("zone", ["Z", "utc", "europe/berlin"])
def test_zone_names_in_any_case(zone):
    assert transitions(zone) is not None
