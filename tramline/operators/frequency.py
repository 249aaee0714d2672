"""How often each path between two stops is used and each stop is served."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.service import of_trips
from tramline.operators.spans import successors

TRIP = ["feed_id", "trip_id"]


def trip_segments(stop_times: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """One row per pair of consecutive calls of a trip, with the departure at the first.

    `trips` limits the result to some trips. A trip with very many calls meets that join as a few
    pieces.
    """
    calls = stop_times.where(F.col("stop_id").isNotNull())
    among = (lambda rows: rows) if trips is None else (lambda rows: of_trips(rows, trips))
    return successors(calls, TRIP, "stop_sequence", ["stop_id", "departure_secs"], among).select(
        *TRIP,
        F.col("origin.stop_sequence").alias("stop_sequence"),
        F.col("origin.stop_id").alias("from_stop_id"),
        F.col("target.stop_id").alias("to_stop_id"),
        F.col("origin.departure_secs").alias("departure_secs"),
    )


def trip_stop_times(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """The time-table with the route and the position of every call."""
    served = trips.select("feed_id", "trip_id", "route_id", "service_id").join(
        routes.select("feed_id", "route_id"), ["feed_id", "route_id"]
    )
    placed = stops.select("feed_id", "stop_id", "stop_name", "stop_lon", "stop_lat")
    return (
        stop_times.join(served, TRIP)
        .join(placed, ["feed_id", "stop_id"])
        .select(
            *TRIP,
            "route_id",
            "service_id",
            "stop_sequence",
            "stop_id",
            "stop_name",
            "stop_lon",
            "stop_lat",
            "departure_secs",
        )
    )


def path_frequency(segments: DataFrame, relation: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Uses of each directed path between two unified stops.

    Raw pairs are counted first: a timetable repeats the same pair for every trip, so the
    joins to the relation see one row per distinct pair instead of one per departure.

    `carried` names columns of the relation that are the same for all stops of a unified stop; they come along
    for both ends, so paths need not be joined to the unified stops again.
    """
    raw = segments.groupBy("feed_id", "from_stop_id", "to_stop_id").agg(F.count("*").alias("uses"))

    def to_unified(pairs: DataFrame, side: str) -> DataFrame:
        ends = relation.select(
            "feed_id",
            F.col("stop_id").alias(f"{side}_stop_id"),
            *[F.col(c).alias(f"{side}_{c}") for c in ("similar_stop_id", *carried)],
        )
        stop = ["feed_id", f"{side}_stop_id"]
        # a sort looks at eight bytes first: ids begin alike, hashes of them do not
        hashed = F.xxhash64(*stop).alias("hash")
        return pairs.select("*", hashed).join(ends.select("*", hashed), ["hash", *stop]).drop("hash")

    return (
        to_unified(to_unified(raw, "from"), "to")
        .where(F.col("from_similar_stop_id") != F.col("to_similar_stop_id"))
        .groupBy("feed_id", *[f"{side}_{c}" for c in ("similar_stop_id", *carried) for side in ("from", "to")])
        .agg(F.sum("uses").alias("frequency"))
    )


def unified_stop_counts(stop_times: DataFrame, relation: DataFrame) -> DataFrame:
    """Stop times at each unified stop: feed_id, similar_stop_id, count."""
    raw = stop_times.groupBy("feed_id", "stop_id").agg(F.count("*").alias("calls"))
    return (
        raw.join(relation.select("feed_id", "stop_id", "similar_stop_id"), ["feed_id", "stop_id"])
        .groupBy("feed_id", "similar_stop_id")
        .agg(F.sum("calls").alias("count"))
    )
