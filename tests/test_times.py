import datetime

import pytest
from pyspark.sql import functions as F

from tramline.functions import times


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, secs",
    [
        ("8:00:00", 28800),
        ("08:00:00", 28800),
        ("25:10:00", 90600),
        (" 07:05:09 ", 25509),
        ("", None),
        ("  ", None),
        ("8:00", None),
        ("1234:00:59", 4442459),
        ("99999999999999999999:00:00", None),
        ("10:75:99", None),
        ("10:5:09", None),
        ("ab:cd:ef", None),
        (None, None),
    ],
)
def test_time_to_secs(spark, text, secs):
    assert one(spark, times.time_to_secs(F.lit(text).cast("string"))) == secs


@pytest.mark.parametrize(
    "text, normal",
    [
        ("8", "29:00:00"),
        ("8:00:00", "29:00:00"),
        ("08:00:00", "08:00:00"),
        ("27:00:00", "27:00:00"),
        ("99:99:99", "29:59:59"),
        ("", "00:00:00"),
        ("12345678", "29:56:59"),
        ("０８:３０", "08:30:00"),
        ("1a2b3c", "12:30:00"),
    ],
)
def test_normalize_time(spark, text, normal):
    assert one(spark, times.normalize_time(F.lit(text))) == normal


def test_digits_and_dates(spark):
    assert one(spark, times.time_digits(F.lit("27:00:00"))) == "270000"
    day = F.lit(datetime.date(2021, 3, 4))
    assert one(spark, times.date_compact(day)) == "20210304"
    assert one(spark, times.date_dashed(day)) == "2021-03-04"


def test_option_texts():
    assert times.parse_day("") is None
    assert times.parse_day("20210304") == datetime.date(2021, 3, 4)
    assert times.parse_bound("") is None
    assert times.parse_bound("270000") == 97200
    assert times.parse_bound("27:00:00") == 97200
    with pytest.raises(ValueError):
        times.parse_bound("8:00")


@pytest.mark.parametrize("text, secs", [("08:00:00\n", 28800), ("08:00:00\n\n", None), ("08:00:000", None), ("8:00:00\u0085", None)])
def test_time_to_secs_at_the_end_of_the_text(spark, text, secs):
    assert one(spark, times.time_to_secs(F.lit(text))) == secs


def test_seconds_are_parsed_once_before_they_are_filtered(spark):
    from tramline.plans.checks import QUERIES

    plan = QUERIES["stop_times_in_window"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "departure_secs" in plan and "RLIKE" not in plan
