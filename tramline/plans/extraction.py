"""The two jobs on feeds: simple routes and stops, and the frequency aggregation."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.fixed_values import OUTPUTS
from tramline.functions.times import normalize_time, parse_bound, parse_day, time_digits
from tramline.operators import frequency, geometry, service, styling, unify
from tramline.schemas import FeedTables
from tramline.session import durable, passing, remove, shuffles_removed
from tramline.sinks import geojson, publishing
from tramline.sinks.relations_csv import write_relations_csv

MANIFEST = "manifest"


@dataclass(frozen=True)
class Options:
    """What to extract. The values here are the defaults of the options form: the date filter is on, with the
    current day where none is given."""

    simple: bool = True
    aggregate: bool = False
    ignore_shapes: bool = False
    ignore_no_route: bool = False
    unify: bool = True
    use_delimiter: bool = False
    delimiter: str = "_"
    filter_by_date: bool = True
    day: datetime.date | None = None
    filter_by_time: bool = False
    begin_time: str = "00:00:00"
    end_time: str = "27:00:00"
    scale_stop_size: bool = False
    as_collections: bool = False  # one feature collection per feed instead of one feature per line

    def __post_init__(self) -> None:
        if not (self.simple or self.aggregate):
            raise ValueError("nothing to do: neither simple nor aggregate is chosen")

    def delimiter_text(self) -> str:
        """Empty unless stops are unified and the delimiter is switched on."""
        return self.delimiter if self.unify and self.use_delimiter else ""

    def yyyymmdd(self) -> str:
        """Empty unless the date filter is on; the current day when none is given."""
        if not self.filter_by_date:
            return ""
        return (self.day or datetime.date.today()).strftime("%Y%m%d")

    def time_texts(self, spark: SparkSession) -> tuple[str, str]:
        """Begin and end as HHMMSS, both empty unless the time filter is on."""
        if not self.filter_by_time:
            return "", ""
        bounds = [time_digits(normalize_time(F.lit(text))) for text in (self.begin_time, self.end_time)]
        return tuple(spark.range(1).select(bounds[0].alias("begin"), bounds[1].alias("end")).first())


class Aggregator:
    """Paths, unified stops and stop relations of feeds, sharing one relation and one set of filters."""

    def __init__(
        self,
        tables: FeedTables,
        no_unify_stops: bool = False,
        delimiter: str = "",
        yyyymmdd: str = "",
        begin_time: str = "",
        end_time: str = "",
    ):
        # stops, relation and unified stops are small next to the stop times, and read many times
        self.stops = durable(unify.one_row_per_stop(tables.stops), "stops")
        with passing() as keep:
            self.relation = keep(durable(unify.unify_stops(self.stops, not no_unify_stops, delimiter), "relation"))
        self.stop_times = tables.stop_times
        self.begin, self.end = parse_bound(begin_time), parse_bound(end_time)
        day = parse_day(yyyymmdd)
        self.trips = (
            None
            if day is None
            else service.trips_on_date(tables.trips, tables.calendar, tables.calendar_dates, day)
        )

    @cached_property
    def unified(self) -> DataFrame:
        """Names and positions, made when an output asks for them."""
        return durable(unify.unified_stops(self.relation, self.stops), "unified")

    def _segments(self) -> DataFrame:
        segments = frequency.trip_segments(self.stop_times, self.trips)
        # pairs are made first, then those departing in the window are kept
        return service.departing_between(segments, self.begin, self.end)

    def path_counts(self) -> DataFrame:
        return frequency.path_frequency(self._segments(), self.relation)

    def stop_counts(self) -> DataFrame:
        served = service.departing_between(self.stop_times, self.begin, self.end)
        if self.trips is not None:
            served = service.of_trips(served, self.trips)
        return frequency.unified_stop_counts(served, self.relation)

    def read_route_frequency(self) -> DataFrame:
        return geometry.path_features(self._segments(), self.relation, self.unified)

    def read_interpolated_stops(self) -> DataFrame:
        return geometry.unified_stop_features(self.stop_counts(), self.unified)

    def read_stop_relations(self) -> DataFrame:
        return unify.stop_relations(self.relation, self.stops)


def extract(tables: FeedTables, feeds: DataFrame, output_dir: str, options: Options = Options()) -> DataFrame:
    """Write the chosen outputs of `feeds(feed_id, dir)` and return the manifest.

    Each output is one folder below `output_dir` with a folder per feed. The manifest has a row per feed and output; its
    path is the folder as it is written, or '' with 0 rows where the output was not asked for or has nothing. It is
    also written to `output_dir`/manifest.

    Everything is written aside and put in place at the end, so a run that fails leaves the earlier outputs whole.
    Folders of other feeds, and outputs not asked for, stay.
    """
    spark = feeds.sparkSession
    publishing.finish(spark, output_dir)
    run = uuid.uuid4().hex
    staged = publishing.staging_folder(output_dir, run)
    with passing() as keep:
        feeds = durable(feeds.select("feed_id", F.col("dir").alias("feed_dir")).distinct(), "feeds")
        try:
            counts = _write_outputs(tables, feeds, staged, options)
            manifest = keep(durable(output_manifest(feeds, counts, output_dir, options), "manifest"))
            manifest.write.parquet(f"{staged}/{MANIFEST}")
            publishing.publish(_places(feeds, manifest, options), output_dir, run)
        except BaseException:
            if not publishing.is_ready(spark, staged):
                remove(spark, staged)
            raise
    return manifest


def _places(feeds: DataFrame, manifest: DataFrame, options: Options) -> DataFrame:
    """What the run puts in place of earlier folders: the outputs it was asked for, then the manifest."""
    asked = [n for n in OUTPUTS if (options.simple if n in ("routes", "stops") else options.aggregate)]
    files = F.create_map(*[F.lit(x) for n in asked for x in (n, OUTPUTS[n])])
    folder = F.concat(F.lit("/feed_dir="), geojson.folder_name(F.col("feed_dir")))
    outputs = manifest.where(F.col("output").isin(asked)).join(feeds, "feed_id").select(
        F.concat(files[F.col("output")], folder).alias("place"), F.lit(0).alias("step"), (F.col("path") != "").alias("keep")
    )
    last = feeds.sparkSession.range(1).select(F.lit(MANIFEST).alias("place"), F.lit(1).alias("step"), F.lit(True).alias("keep"))
    return outputs.groupBy("place", "step").agg(F.max("keep").alias("keep")).unionByName(last)


def _write_outputs(tables: FeedTables, feeds: DataFrame, folder: str, options: Options) -> DataFrame:
    """Write the chosen outputs below `folder`; (feed_id, n_rows, output) of those that have rows.

    Those that need most room besides what they leave come first, and tables are removed as soon as nothing reads them.
    """
    spark = feeds.sparkSession
    counts = []

    def put(output: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]) -> None:
        with passing() as keep:
            with passing() as keep_rows:
                rows = keep_rows(durable(make(), output))
            with shuffles_removed(spark):
                write(rows, f"{folder}/{OUTPUTS[output]}")
            counted = rows.groupBy("feed_id").agg(F.count("*").alias("n_rows")).withColumn("output", F.lit(output))
            counts.append(keep(durable(counted, "counts")))

    def write_features(features: DataFrame, path: str) -> None:
        (geojson.write_collections if options.as_collections else geojson.write_features)(features, feeds, path)

    if options.aggregate:
        with passing() as keep:
            begin, end = options.time_texts(spark)
            aggregator = Aggregator(tables, not options.unify, options.delimiter_text(), options.yyyymmdd(), begin, end)
            _ = aggregator.unified  # for two outputs
            put(
                "aggregated_routes",
                lambda: geojson.path_feature_rows(styling.path_style(aggregator.read_route_frequency())),
                write_features,
            )
            put(
                "aggregated_csv", aggregator.read_stop_relations,
                lambda relations, path: write_relations_csv(relations.join(feeds, "feed_id"), path),
            )
            put(
                "aggregated_stops",
                lambda: geojson.unified_stop_feature_rows(
                    styling.stop_style(aggregator.read_interpolated_stops(), scale=options.scale_stop_size)
                ),
                write_features,
            )
            for counted in counts:
                keep(counted)

    if options.simple:
        put(
            "stops",
            lambda: geojson.stop_feature_rows(geometry.read_stops(tables.stops, tables.stop_times, options.ignore_no_route)),
            write_features,
        )
        put(
            "routes",
            lambda: geojson.route_feature_rows(
                geometry.read_routes(tables.shapes, tables.stop_times, tables.trips, tables.routes, tables.stops, options.ignore_shapes)
            ),
            write_features,
        )

    return reduce(DataFrame.unionByName, counts)


def output_manifest(feeds: DataFrame, counts: DataFrame, output_dir: str, options: Options) -> DataFrame:
    """(feed_id, output, path, n_rows) for all five outputs of every feed."""
    empty_too = F.lit(options.as_collections) & F.col("output").isin([n for n in OUTPUTS if n != "aggregated_csv"])
    done = {name: options.simple if name in ("routes", "stops") else options.aggregate for name in OUTPUTS}
    slots = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("output"), F.lit(f"{output_dir}/{file}" if done[name] else "").alias("base"))
                for name, file in OUTPUTS.items()
            ]
        )
    )
    return (
        feeds.withColumn("slot", slots)
        .select("feed_id", "feed_dir", "slot.output", "slot.base")
        .join(counts, ["feed_id", "output"], "left")
        .select(
            "feed_id",
            "output",
            F.when((F.col("base") == "") | (F.coalesce("n_rows", F.lit(0)) == 0) & ~empty_too, F.lit(""))
            .otherwise(F.concat("base", F.lit("/feed_dir="), geojson.folder_name(F.col("feed_dir"))))
            .alias("path"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        )
    )
