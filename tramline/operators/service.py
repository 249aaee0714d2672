"""Which services, trips and departures count."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.schemas import WEEKDAYS
from tramline.session import durable


def active_services(calendar: DataFrame, calendar_dates: DataFrame, day: datetime.date) -> DataFrame:
    """(feed_id, service_id) running on `day`: weekly calendar plus added minus removed dates."""
    on_day = F.lit(day)
    weekly = calendar.where(
        (F.col("start_date") <= on_day) & (F.col("end_date") >= on_day) & (F.col(WEEKDAYS[day.weekday()]) == 1)
    ).select("feed_id", "service_id", F.lit(1).alias("runs"), F.lit(0).alias("removed"))
    special = calendar_dates.where((F.col("date") == on_day) & F.col("exception_type").isin(1, 2)).select(
        "feed_id",
        "service_id",
        (F.col("exception_type") == 1).cast("int").alias("runs"),
        (F.col("exception_type") == 2).cast("int").alias("removed"),
    )
    # one aggregation decides addition and removal together
    return (
        weekly.unionByName(special)
        .groupBy("feed_id", "service_id")
        .agg(F.max("runs").alias("runs"), F.max("removed").alias("removed"))
        .where((F.col("runs") == 1) & (F.col("removed") == 0))
        .select("feed_id", "service_id")
    )


def trips_on_date(
    trips: DataFrame, calendar: DataFrame, calendar_dates: DataFrame, day: datetime.date | None
) -> DataFrame:
    """Trips whose service runs on `day`; every trip when `day` is None."""
    if day is None:
        return trips
    # A feed has a handful of services, so this join must not shuffle the trips by them: a written table has a
    # known size and is broadcast if it is small.
    active = durable(active_services(calendar, calendar_dates, day), "active-services")
    return trips.join(active, ["feed_id", "service_id"], "left_semi")


def of_trips(rows: DataFrame, trips: DataFrame) -> DataFrame:
    """Rows that belong to one of `trips`."""
    return rows.join(trips.select("feed_id", "trip_id"), ["feed_id", "trip_id"], "left_semi")


def in_window(secs: Column, begin: int | None, end: int | None) -> Column | None:
    """Condition begin <= secs < end with either side optional; None when there is nothing to test.

    A null time fails the condition, so it drops out exactly when a bound is set.
    """
    tests = []
    if begin is not None:
        tests.append(secs >= begin)
    if end is not None:
        tests.append(secs < end)
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def departing_between(rows: DataFrame, begin: int | None, end: int | None) -> DataFrame:
    condition = in_window(F.col("departure_secs"), begin, end)
    return rows if condition is None else rows.where(condition)
