"""Route lines and stop points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.frequency import TRIP, path_frequency
from tramline.operators.service import of_trips
from tramline.operators.spans import sequences
from tramline.session import durable

SHAPE = ["feed_id", "shape_id"]
ROUTE = ["feed_id", "route_id"]


def route_name(short: Column, long: Column, route_id: Column) -> Column:
    """First text that is not empty: short name, long name, id."""
    return F.coalesce(F.nullif(F.trim(short), F.lit("")), F.nullif(F.trim(long), F.lit("")), route_id)


def named_routes(routes: DataFrame) -> DataFrame:
    name = route_name(F.col("route_short_name"), F.col("route_long_name"), F.col("route_id"))
    return routes.select(*ROUTE, name.alias("route_name"))


def _points(items: str) -> Column:
    return F.transform(items, lambda p: F.array(p["lon"], p["lat"]))


def shape_lines(shapes: DataFrame) -> DataFrame:
    """The line of each shape of two or more points: feed_id, shape_id, line."""
    placed = shapes.where(F.col("shape_pt_lon").isNotNull() & F.col("shape_pt_lat").isNotNull()).select(
        *SHAPE, "shape_pt_sequence", F.col("shape_pt_lon").alias("lon"), F.col("shape_pt_lat").alias("lat")
    )
    whole = sequences(placed, SHAPE, "shape_pt_sequence", ["lon", "lat"])
    return whole.where(F.size("items") > 1).select(*SHAPE, _points("items").alias("line"))


def stop_patterns(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct orders of stops per route: feed_id, route_id, pattern (array of stop ids)."""
    calls = stop_times.where(F.col("stop_id").isNotNull())
    whole = sequences(calls, TRIP, "stop_sequence", ["stop_id"])
    return (
        whole.where(F.size("items") > 1)
        .select(*TRIP, F.col("items.stop_id").alias("pattern"))
        .join(trips.select(*TRIP, "route_id"), TRIP)
        .select(*ROUTE, "pattern")
        .distinct()
    )


def pattern_lines(patterns: DataFrame, stops: DataFrame) -> DataFrame:
    """Each stop pattern as a line through its stops: feed_id, route_id, line.

    Positions are looked up for the distinct patterns only, not for every stop time.
    """
    numbered = durable(patterns.withColumn("pattern_no", F.monotonically_increasing_id()), "patterns")
    places = stops.where(F.col("stop_lon").isNotNull() & F.col("stop_lat").isNotNull()).select(
        "feed_id", "stop_id", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat")
    )
    lines = (
        numbered.select("feed_id", "pattern_no", F.posexplode("pattern").alias("position", "stop_id"))
        .join(places, ["feed_id", "stop_id"])
        .groupBy("pattern_no")
        .agg(F.sort_array(F.collect_list(F.struct("position", "lon", "lat"))).alias("items"))
        .where(F.size("items") > 1)
    )
    return numbered.join(lines, "pattern_no").select(*ROUTE, _points("items").alias("line"))


def _route_features(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """One feature per route and line: feed_id, route_id, route_name, coordinates."""
    return lines.join(named_routes(routes), ROUTE).select(*ROUTE, "route_name", F.col("line").alias("coordinates"))


def routes_from_stops(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Route features through the stops of the trips, shapes ignored."""
    return _route_features(pattern_lines(stop_patterns(stop_times, trips), stops), routes)


def routes_from_shapes(
    shapes: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame
) -> DataFrame:
    """Route features along the shapes; trips without a drawn shape go through their stops."""
    drawn = durable(shape_lines(shapes), "shape-lines")
    used = durable(trips.select(*ROUTE, "shape_id").distinct(), "route-shapes")
    wanted = used.where(F.col("shape_id").isNotNull())
    along = wanted.join(drawn, SHAPE).select(*ROUTE, "line")
    # null shapes are set apart first: as join keys they would all meet in one task
    missing = wanted.join(drawn.select(*SHAPE), SHAPE, "left_anti")
    # usually every trip has a drawn shape, and then neither trips nor stop times need be read again
    if not used.where(F.col("shape_id").isNull()).isEmpty() or not missing.isEmpty():
        shapeless = durable(
            trips.where(F.col("shape_id").isNull())
            .unionByName(trips.where(F.col("shape_id").isNotNull()).join(missing, [*ROUTE, "shape_id"], "left_semi"))
            .select(*TRIP, "route_id"),
            "shapeless",
        )
        calls = durable(of_trips(stop_times, shapeless), "shapeless-calls")
        along = along.unionByName(pattern_lines(stop_patterns(calls, shapeless), stops))
    return _route_features(along, routes)


def read_routes(
    shapes: DataFrame,
    stop_times: DataFrame,
    trips: DataFrame,
    routes: DataFrame,
    stops: DataFrame,
    ignore_shapes: bool = False,
) -> DataFrame:
    if ignore_shapes:
        return routes_from_stops(stop_times, trips, routes, stops)
    return routes_from_shapes(shapes, stop_times, trips, routes, stops)


def stops_with_route(stops: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stops that some trip calls at. Stop ids are reduced before the join, on the map side."""
    served = stop_times.select("feed_id", "stop_id").distinct()
    return stops.join(served, ["feed_id", "stop_id"], "left_semi")


def read_stops(stops: DataFrame, stop_times: DataFrame, ignore_no_route: bool = False) -> DataFrame:
    """Stop features: feed_id, stop_id, stop_name, lon, lat."""
    kept = stops_with_route(stops, stop_times) if ignore_no_route else stops
    return kept.select(
        "feed_id", "stop_id", "stop_name", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat")
    )


def path_features(segments: DataFrame, relation: DataFrame, unified: DataFrame) -> DataFrame:
    """Paths with the names and positions of both ends.

    The stops are given both before the paths are made of them: stops are few, paths many.
    """
    described = ["similar_stop_name", "lon", "lat"]
    named = relation.join(unified.select("feed_id", "similar_stop_id", *described), ["feed_id", "similar_stop_id"], "left")
    return path_frequency(segments, durable(named.select("feed_id", "stop_id", "similar_stop_id", *described), "ends"), described)


def unified_stop_features(counts: DataFrame, unified: DataFrame) -> DataFrame:
    """Unified stops that are called at, with the number of calls (1 or more)."""
    return counts.join(unified, ["feed_id", "similar_stop_id"], "left")
