import datetime

from tramline.operators import service
from tramline.schemas import WEEKDAYS

DAY = datetime.date(2024, 5, 6)  # a Monday
LONG_AGO, FAR_AHEAD = datetime.date(2024, 1, 1), datetime.date(2024, 12, 31)


def calendar(spark, rows):
    """rows: (feed, service, days that run, start, end)"""
    schema = "feed_id string, service_id string, " + ", ".join(f"{d} int" for d in WEEKDAYS) + ", start_date date, end_date date"
    return spark.createDataFrame(
        [(f, s, *[int(d in days) for d in WEEKDAYS], start, end) for f, s, days, start, end in rows], schema
    )


def dates(spark, rows):
    return spark.createDataFrame(rows, "feed_id string, service_id string, date date, exception_type int")


def test_active_services(spark):
    weekly = calendar(
        spark,
        [
            ("a", "mon", ["monday"], LONG_AGO, FAR_AHEAD),
            ("a", "tue", ["tuesday"], LONG_AGO, FAR_AHEAD),
            ("a", "off_but_added", ["tuesday"], LONG_AGO, FAR_AHEAD),
            ("a", "on_but_removed", ["monday"], LONG_AGO, FAR_AHEAD),
            ("a", "over", ["monday"], LONG_AGO, datetime.date(2024, 5, 5)),
            ("a", "last_day", ["monday"], LONG_AGO, DAY),
            ("b", "on_but_removed", ["monday"], LONG_AGO, FAR_AHEAD),
        ],
    )
    special = dates(
        spark,
        [
            ("a", "off_but_added", DAY, 1),
            ("a", "only_special", DAY, 1),
            ("a", "on_but_removed", DAY, 2),
            ("a", "added_and_removed", DAY, 1),
            ("a", "added_and_removed", DAY, 2),
            ("a", "other_day", datetime.date(2024, 5, 7), 1),
        ],
    )
    got = {tuple(r) for r in service.active_services(weekly, special, DAY).collect()}
    assert got == {
        ("a", "mon"),
        ("a", "off_but_added"),
        ("a", "only_special"),
        ("a", "last_day"),
        ("b", "on_but_removed"),
    }


def test_trips_on_date(spark):
    trips = spark.createDataFrame(
        [("a", "mon", "t1"), ("a", "tue", "t2"), ("b", "mon", "t1")], "feed_id string, service_id string, trip_id string"
    )
    weekly = calendar(spark, [("a", "mon", ["monday"], LONG_AGO, FAR_AHEAD)])
    none = dates(spark, [])
    assert [tuple(r) for r in service.trips_on_date(trips, weekly, none, DAY).select("feed_id", "trip_id").collect()] == [
        ("a", "t1")
    ]
    assert service.trips_on_date(trips, weekly, none, None).count() == 3


def test_window_is_half_open_and_drops_blanks_only_when_set(spark):
    rows = spark.createDataFrame([(1, 99), (2, 100), (3, 199), (4, 200), (5, None)], "id int, departure_secs int")

    def ids(begin, end):
        return [r.id for r in service.departing_between(rows, begin, end).orderBy("id").collect()]

    assert ids(100, 200) == [2, 3]
    assert ids(100, None) == [2, 3, 4]
    assert ids(None, 200) == [1, 2, 3]
    assert ids(None, None) == [1, 2, 3, 4, 5]
