"""Column layouts of the feed tables and of the outputs."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# Columns read from each feed file, in the order the archive scan emits them.
# Public GTFS Schedule column names and types.
FEED_COLUMNS: dict[str, tuple[tuple[str, str], ...]] = {
    "agency": (("agency_id", "string"), ("agency_name", "string")),
    "stops": (
        ("stop_id", "string"),
        ("stop_name", "string"),
        ("stop_lat", "double"),
        ("stop_lon", "double"),
        ("location_type", "int"),
        ("parent_station", "string"),
    ),
    "routes": (
        ("route_id", "string"),
        ("agency_id", "string"),
        ("route_short_name", "string"),
        ("route_long_name", "string"),
        ("route_type", "int"),
    ),
    "trips": (
        ("route_id", "string"),
        ("service_id", "string"),
        ("trip_id", "string"),
        ("shape_id", "string"),
    ),
    "stop_times": (
        ("trip_id", "string"),
        ("stop_id", "string"),
        ("stop_sequence", "int"),
        ("arrival_time", "string"),
        ("departure_time", "string"),
    ),
    "calendar": (
        ("service_id", "string"),
        *((day, "int") for day in WEEKDAYS),
        ("start_date", "date"),
        ("end_date", "date"),
    ),
    "calendar_dates": (("service_id", "string"), ("date", "date"), ("exception_type", "int")),
    "shapes": (
        ("shape_id", "string"),
        ("shape_pt_lat", "double"),
        ("shape_pt_lon", "double"),
        ("shape_pt_sequence", "int"),
    ),
}

# A usable feed has all of these and at least one of the calendar tables.
REQUIRED_TABLES = ("agency", "stops", "routes", "trips", "stop_times")
CALENDAR_TABLES = ("calendar", "calendar_dates")


@dataclass
class FeedTables:
    """One DataFrame per feed table; every table carries `feed_id`, so any number of feeds
    is one input. `stop_times` also carries `departure_secs`."""

    agency: DataFrame
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    shapes: DataFrame

    def items(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


PRESET_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("country", "region", "name", "url")])

# GeoJSON as read back: coordinates stay JSON text, since their depth depends on the type.
FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "geometry",
            T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
        ),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
# A text is a feature by itself or a collection of features.
GEOJSON_READ_SCHEMA = T.StructType([*FEATURE_SCHEMA.fields, T.StructField("features", T.ArrayType(FEATURE_SCHEMA))])

RELATION_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("feed_id", "stop_id", "stop_name", "similar_stop_id", "similar_stop_name", "rule")
    ]
)
