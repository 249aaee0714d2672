"""The registered queries: every operator run over the given tables.

Each takes (spark, sf_dir) and returns columns that compare exactly with the SQL of the same
name in check_sql.py; geometry is shown as text with six decimals.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.fixed_values import OUTPUTS
from tramline.functions import times
from tramline.functions.text import extent_numbers
from tramline.operators import catalog, frequency, geometry, near, service, styling, unify
from tramline.operators.components import connected_components
from tramline.plans import catalogue_search, testdata
from tramline.plans.extraction import Aggregator, Options, extract
from tramline.plans.testdata import feed_table, feed_tables, staged_stop_times
from tramline.schemas import GEOJSON_READ_SCHEMA
from tramline.session import durable, fresh_path
from tramline.sinks import geojson
from tramline.sinks.documents import write_documents
from tramline.sinks.relations_csv import write_relations_csv
from tramline.sources import archives, catalog_files, outputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = datetime.date(1997, 6, 3)
BEGIN, END = 8 * 3600, 25 * 3600
MIXED_DELIMITER = "2_"
TARGET_DATE = datetime.date(1995, 12, 1)
EXTENT = "139.0,35.0 : 139.0006,35.0006"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _six_text(number: Column) -> Column:
    """A number as text with six decimals, whatever its size: positions made from part numbers pass 1,000."""
    return number.cast("decimal(38,6)").cast("string")


def _position(point: Column) -> Column:
    return F.concat_ws(" ", _six_text(point[0]), _six_text(point[1]))


def _line_text(coordinates: str | Column) -> Column:
    return F.array_join(F.transform(coordinates, _position), ",")


def _six(name: str) -> Column:
    return _six_text(F.col(name)).alias(name)


# --- sources -----------------------------------------------------------------------------


def _scanned(spark, sf):
    """Records of archives that lie in a folder as files."""
    folder = fresh_path(spark, "feeds")
    fetched = testdata.archive_files(spark, sf, folder)
    # the folder itself: a pattern would make every archive a path to be listed by itself
    return fetched, archives.scan_archives(archives.list_archives(spark, folder))


@query
def feed_scan(spark, sf):
    records = durable(_scanned(spark, sf)[1], "records", partition_by="gtfs_table")
    return (
        archives.usable_records(records)
        .where(F.col("report").isNull())
        .select("feed_id", "gtfs_table", F.array_join("fields", "|", "").alias("record"))
    )


@query
def feed_required_tables(spark, sf):
    records = durable(_scanned(spark, sf)[1], "records", partition_by="gtfs_table")
    return archives.required_tables(archives.usable_records(records)).select(
        "feed_id", F.array_join("missing", ",").alias("missing"), F.col("complete").cast("int").alias("complete")
    )


@query
def feed_ingest_report(spark, sf):
    fetched, records = _scanned(spark, sf)
    return archives.ingest_report(records, fetched.select("feed_id", "status"))


def _document(spark, rows, groups, name, head, tail):
    """Write (place, value) as one JSON document per place, as the files are that lists and responses come in."""
    path = fresh_path(spark, name)
    folder = F.concat(F.lit("place="), F.col("place"))
    write_documents(rows.withColumn("place", F.col("place").cast("string")), groups, path, "place", head, tail, f"{name}.json", folder)
    return f"{path}/*/{name}.json"


@query
def preset_feeds(spark, sf):
    rows = testdata.given(spark, sf, testdata.PRESET_SQL)
    texts = rows.select(F.lit("0").alias("place"), F.to_json(F.struct(*rows.columns)).alias("value"))
    path = _document(spark, texts, texts.select("place").distinct(), "presets", "[", "]")
    return catalog_files.with_label(catalog_files.read_presets(spark, path))


@query
def feed_manifest(spark, sf):
    presets = testdata.given(spark, sf, testdata.PRESET_SQL)
    local = testdata.given(spark, sf, testdata.LOCAL_PATHS_SQL)
    infos = catalog.preset_feed_infos(presets).unionByName(catalog.local_feed_infos(local))
    return catalog.feed_manifest(infos)


# --- catalogue ---------------------------------------------------------------------------


def _entries(spark, sf):
    """Catalogue entries as read from staged responses, one response per 20 suppliers."""
    rows = testdata.given(spark, sf, testdata.CATALOG_SQL)
    page = F.floor(F.substring("feed_id", 2, 20).cast("bigint") / 20).cast("string")
    texts = durable(rows.select(page.alias("place"), F.to_json(F.struct(*rows.columns)).alias("value")), "entries")
    path = _document(spark, texts, texts.select("place").distinct(), "response", '{"status": [200], "body": [', "]}")
    return catalog_files.read_catalog(spark, path)


def _table(spark, sf):
    return catalog.catalog_table(catalog.add_pref_name(_entries(spark, sf)))


@query
def catalog_scan(spark, sf):
    return _entries(spark, sf)


@query
def catalog_pref_name(spark, sf):
    return catalog.add_pref_name(_entries(spark, sf)).select(*catalog.FILE_KEY, "feed_pref_id", "feed_pref")


@query
def catalog_pref_code(spark, sf):
    return catalog.add_pref_code(testdata.given(spark, sf, testdata.PREF_NAMES_SQL)).select(
        "c_custkey", "feed_pref", "feed_pref_id"
    )


@query
def catalog_table(spark, sf):
    return _table(spark, sf)


@query
def catalog_visible(spark, sf):
    return catalog.catalog_visible(_table(spark, sf))


@query
def catalog_search(spark, sf):
    return catalogue_search.search(_entries(spark, sf), TARGET_DATE, pref_name="東京都")


@query
def catalog_search_extent(spark, sf):
    stops = testdata.given(spark, sf, testdata.CATALOG_STOPS_SQL)
    found = catalog.catalog_search(_entries(spark, sf), TARGET_DATE, extent=EXTENT, stops=stops)
    box = extent_numbers(F.lit(EXTENT))
    return found.select(*catalog.FILE_KEY, box["xmax"].alias("xmax"), box["ymax"].alias("ymax"))


@query
def catalog_sorted(spark, sf):
    """The order is shown as numbers of the rows as they come out."""
    rows = durable(catalog.catalog_sorted(_table(spark, sf), "feed", ascending=False).withColumn(
        "written", F.monotonically_increasing_id()), "sorted")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("written")).cast("bigint")).drop("written")


@query
def catalog_feed_infos(spark, sf):
    chosen = testdata.given(spark, sf, testdata.SELECTION_SQL)
    return catalog.catalog_feed_infos(catalog.catalog_selected(_table(spark, sf), chosen))


# --- times and filters -------------------------------------------------------------------


@query
def normalize_time(spark, sf):
    rows = testdata.given(spark, sf, testdata.TIME_TEXTS_SQL)
    normal = times.normalize_time(F.col("text"))
    return rows.withColumn("normal", normal).withColumn("digits", times.time_digits(F.col("normal")))


@query
def departure_secs(spark, sf):
    return feed_table(spark, sf, "stop_times").select(
        "trip_id",
        "stop_sequence",
        "departure_time",
        "departure_secs",
        times.secs_to_time(F.col("departure_secs")).alias("rebuilt"),
    )


@query
def date_text(spark, sf):
    days = feed_table(spark, sf, "calendar_dates")
    return days.select(
        "service_id",
        "date",
        times.date_compact(F.col("date")).alias("compact"),
        times.date_dashed(F.col("date")).alias("dashed"),
    )


@query
def active_services(spark, sf):
    return service.active_services(feed_table(spark, sf, "calendar"), feed_table(spark, sf, "calendar_dates"), DAY)


def _trips_of_day(spark, sf):
    return service.trips_on_date(
        feed_table(spark, sf, "trips"), feed_table(spark, sf, "calendar"), feed_table(spark, sf, "calendar_dates"), DAY
    )


@query
def trips_on_date(spark, sf):
    return _trips_of_day(spark, sf)


@query
def stop_times_in_window(spark, sf):
    # of a table: a filter on seconds that are still to be parsed parses each text many times
    return service.departing_between(staged_stop_times(spark, sf), BEGIN, END).select(
        "trip_id", "stop_sequence", "stop_id", "departure_secs"
    )


@query
def trip_stop_times(spark, sf):
    stop_times, trips, routes, stops = (feed_table(spark, sf, t) for t in ("stop_times", "trips", "routes", "stops"))
    return frequency.trip_stop_times(stop_times, trips, routes, stops)


@query
def trip_segments(spark, sf):
    return frequency.trip_segments(staged_stop_times(spark, sf))


# --- unification -------------------------------------------------------------------------


@query
def unify_parent(spark, sf):
    return unify.parent_matches(feed_table(spark, sf, "stops"))


def _without_parents(spark, sf):
    stops = feed_table(spark, sf, "stops")
    return stops.join(unify.parent_matches(stops), unify.STOP, "left_anti")


@query
def unify_prefix(spark, sf):
    return unify.prefix_matches(_without_parents(spark, sf), "_")


@query
def near_group_links(spark, sf):
    """What the links say: the groups they connect, and how many links of a group are no near pair (none)."""
    stops = durable(_without_parents(spark, sf), "stops-left")
    links = durable(near.near_group_links(stops), "near-links")
    places = stops.select("stop_id", "stop_lon", "stop_lat")
    ends = links.join(places.selectExpr("stop_id as stop_id_a", "stop_lon as ax", "stop_lat as ay"), "stop_id_a").join(
        places.selectExpr("stop_id as stop_id_b", "stop_lon as bx", "stop_lat as by"), "stop_id_b"
    )
    far = F.expr(f"(ax - bx) * (ax - bx) + (ay - by) * (ay - by) > {near.LIMIT}").cast("bigint")
    of_link = ends.select(F.col("stop_id_a").alias("stop_id"), far.alias("far"))
    # components by number: stops are numbered in the order of their ids
    numbered = durable(
        links.selectExpr("explode(array(stop_id_a, stop_id_b)) as stop_id").distinct().orderBy("stop_id")
        .withColumn("no", F.monotonically_increasing_id()), "near-numbers",
    )
    edges = links.join(numbered.selectExpr("stop_id as stop_id_a", "no as a"), "stop_id_a").join(
        numbered.selectExpr("stop_id as stop_id_b", "no as b"), "stop_id_b"
    )
    group = connected_components(edges.select("a", "b")).join(numbered.selectExpr("no as node", "stop_id"), "node")
    named = group.join(numbered.selectExpr("no as component", "stop_id as similar_stop_id"), "component")
    return (
        named.join(of_link, "stop_id", "left")
        .groupBy("similar_stop_id", "stop_id")
        .agg(F.coalesce(F.sum("far"), F.lit(0)).alias("far_links"))
    )


@query
def unify_near(spark, sf):
    return unify.near_matches(durable(_without_parents(spark, sf), "stops-left"))


@query
def unify_no_delimiter(spark, sf):
    options = Options(use_delimiter=False)
    return unify.unify_stops(feed_table(spark, sf, "stops"), options.unify, options.delimiter_text())


@query
def relations_identity(spark, sf):
    options = Options(unify=False, use_delimiter=True)
    return unify.unify_stops(feed_table(spark, sf, "stops"), options.unify, options.delimiter_text())


@query
def stop_relations(spark, sf):
    stops = unify.one_row_per_stop(feed_table(spark, sf, "stops"))
    return unify.stop_relations(unify.unify_stops(stops, delimiter=MIXED_DELIMITER), stops)


@query
def unified_stops(spark, sf):
    stops = unify.one_row_per_stop(feed_table(spark, sf, "stops"))
    relation = durable(unify.unify_stops(stops, delimiter=MIXED_DELIMITER), "relation")
    return unify.unified_stops(relation, stops).select(
        "feed_id", "similar_stop_id", "similar_stop_name", _six("lon"), _six("lat")
    )


# --- frequency ---------------------------------------------------------------------------


@query
def path_frequency(spark, sf):
    relation = durable(unify.unify_stops(feed_table(spark, sf, "stops")), "relation")
    return frequency.path_frequency(frequency.trip_segments(staged_stop_times(spark, sf)), relation)


def _windowed(spark, sf):
    return Aggregator(
        feed_tables(spark, sf),
        delimiter=MIXED_DELIMITER,
        yyyymmdd=DAY.strftime("%Y%m%d"),
        begin_time="080000",
        end_time="250000",
    )


@query
def path_frequency_windowed(spark, sf):
    return _windowed(spark, sf).path_counts()


@query
def unified_stop_counts(spark, sf):
    return _windowed(spark, sf).stop_counts()


@query
def path_style(spark, sf):
    return styling.path_style(path_frequency(spark, sf)).select(
        "from_similar_stop_id", "to_similar_stop_id", F.round("line_width", 6).alias("line_width")
    )


@query
def stop_style(spark, sf):
    relation = unify.unify_stops(feed_table(spark, sf, "stops"))
    counts = frequency.unified_stop_counts(feed_table(spark, sf, "stop_times"), relation)
    scaled = styling.stop_style(counts, scale=True).withColumnRenamed("symbol_size", "scaled_size")
    return styling.stop_style(scaled).select(
        "similar_stop_id", F.round("scaled_size", 6).alias("scaled_size"), "symbol_size"
    )


# --- simple outputs ----------------------------------------------------------------------


@query
def stops_with_route(spark, sf):
    kept = geometry.read_stops(feed_table(spark, sf, "stops"), feed_table(spark, sf, "stop_times"), True)
    return kept.select("feed_id", "stop_id", "stop_name", _six("lon"), _six("lat"))


def _routes(spark, sf, ignore_shapes, tables=None):
    t = tables or feed_tables(spark, sf)
    return geometry.read_routes(t.shapes, t.stop_times, t.trips, t.routes, t.stops, ignore_shapes)


def _route_columns(routes):
    return routes.select("feed_id", "route_id", "route_name", _line_text("coordinates").alias("line"))


@query
def routes_from_shapes(spark, sf):
    return _route_columns(_routes(spark, sf, ignore_shapes=False))


@query
def routes_from_stops(spark, sf):
    return _route_columns(_routes(spark, sf, ignore_shapes=True))


@query
def route_categories(spark, sf):
    return styling.route_categories(geometry.named_routes(feed_table(spark, sf, "routes")))


# --- sinks -------------------------------------------------------------------------------


def _read_back(rows, *properties):
    """Feature rows through their texts and back to columns."""
    texts = rows.select(F.from_json("feature", GEOJSON_READ_SCHEMA, {"mode": "FAILFAST"}).alias("parsed"))
    return _feature_columns(outputs.features_of(texts.select("parsed.*")), *properties)


def _feature_columns(features, *properties):
    return features.select(
        *[F.col("properties")[name].alias(name) for name in properties], "geometry_type", "coordinates"
    )


def _lon_lat(features):
    position = F.from_json("coordinates", "array<double>")
    return features.withColumns({"lon": position[0], "lat": position[1]}).drop("coordinates").withColumns(
        {name: _six_text(F.col(name)) for name in ("lon", "lat")}
    )


@query
def geojson_routes(spark, sf):
    features = _read_back(
        geojson.route_feature_rows(_routes(spark, sf, ignore_shapes=False)), "feed_id", "route_id", "route_name"
    )
    line = F.from_json("coordinates", "array<array<double>>")
    return features.withColumn("line", _line_text(line)).drop("coordinates")


@query
def geojson_stops(spark, sf):
    stops = geometry.read_stops(feed_table(spark, sf, "stops"), feed_table(spark, sf, "stop_times"))
    return _lon_lat(_read_back(geojson.stop_feature_rows(stops), "feed_id", "stop_id", "stop_name"))


@query
def geojson_aggregated_routes(spark, sf):
    paths = Aggregator(feed_tables(spark, sf), delimiter=MIXED_DELIMITER).read_route_frequency()
    features = _read_back(
        geojson.path_feature_rows(paths),
        "from_similar_stop_id",
        "from_similar_stop_name",
        "to_similar_stop_id",
        "to_similar_stop_name",
        "frequency",
    )
    line = F.from_json("coordinates", "array<array<double>>")
    return (
        features.withColumn("line", _line_text(line))
        .withColumn("frequency", F.col("frequency").cast("bigint"))
        .drop("coordinates")
    )


@query
def geojson_aggregated_stops(spark, sf):
    stops = Aggregator(feed_tables(spark, sf), delimiter=MIXED_DELIMITER).read_interpolated_stops()
    features = _read_back(
        geojson.unified_stop_feature_rows(stops), "similar_stop_id", "similar_stop_name", "count"
    )
    return _lon_lat(features).withColumn("count", F.col("count").cast("bigint"))


@query
def geojson_roundtrip(spark, sf):
    path = fresh_path(spark, "stops.geojson")
    stops = geometry.read_stops(feed_table(spark, sf, "stops"), feed_table(spark, sf, "stop_times"))
    feeds = stops.select("feed_id", F.concat(F.lit("dir:"), "feed_id").alias("feed_dir")).distinct()
    geojson.write_features(geojson.stop_feature_rows(stops), feeds, path)
    features = outputs.read_geojson(spark, path).withColumn(
        "properties", F.map_concat("properties", F.create_map(F.lit("feed_dir"), F.col("feed_dir")))
    )
    return _lon_lat(_feature_columns(features, "stop_id", "stop_name", "feed_dir"))


@query
def relations_csv_roundtrip(spark, sf):
    path = fresh_path(spark, "result.csv")
    write_relations_csv(stop_relations(spark, sf).withColumn("feed_dir", F.concat(F.lit("dir-"), "feed_id")), path)
    return outputs.read_relations_csv(spark, path)


@query
def geojson_collections(spark, sf):
    """Stops by the tens of suppliers as feeds of one collection each, and as many feeds without stops; read back from files."""
    path = fresh_path(spark, "collections")
    stops = geometry.read_stops(feed_table(spark, sf, "stops"), feed_table(spark, sf, "stop_times"))
    number = F.length("stop_name") % 20
    stops = durable(stops.withColumn("feed_id", F.concat(F.lit("C"), number.cast("string"))), "collection-stops")
    feeds = spark.range(40).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("feed_id"))
    feeds = durable(feeds.withColumn("feed_dir", F.col("feed_id")), "collection-feeds")
    geojson.write_collections(geojson.stop_feature_rows(stops), feeds, path)
    read = outputs.read_collections(spark, path).groupBy("feed_dir").agg(F.count(F.col("properties")["stop_id"]).alias("n_read"))
    files = spark.read.format("binaryFile").load(path).groupBy("feed_dir").agg(F.count("*").alias("n_files"))
    counts = stops.groupBy("feed_id").agg(F.count("*").alias("n_features"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return feeds.join(files.where("n_files = 1"), "feed_dir").join(read, "feed_dir", "left").join(counts, "feed_id", "left").select(
        "feed_id", zero("n_features"), zero("n_read")
    )


@query
def output_manifest(spark, sf):
    """Many feeds of very different size: trip numbers are split by their leading digits, and some feeds are empty."""
    path = fresh_path(spark, "out")
    tables = testdata.many_feeds(spark, sf)
    feeds = testdata.given(spark, sf, testdata.MANY_FEEDS_SQL).selectExpr("feed_id", "'dir:' || feed_id as dir")
    options = Options(
        aggregate=True, ignore_no_route=True, use_delimiter=True, delimiter=MIXED_DELIMITER, filter_by_date=False
    )
    manifest = extract(tables, feeds, path, options)
    return manifest.withColumn("path", F.replace("path", F.lit(path), F.lit("out")))


@query
def archives_to_outputs(spark, sf):
    """From archive files to collections and tables, all read back: feeds with every required table, by id prefix and name."""
    base = fresh_path(spark, "run")
    fetched = testdata.archive_files(spark, sf, f"{base}/feeds")
    listed = archives.list_archives(spark, f"{base}/feeds", fetched.where("path is not null").select("feed_id", "path"))
    tables = archives.stage_feeds(listed, f"{base}/staged")
    feeds = tables.agency.select("feed_id", F.col("feed_id").alias("dir")).distinct()
    options = Options(
        aggregate=True, ignore_shapes=True, ignore_no_route=True, use_delimiter=True, filter_by_date=False, as_collections=True
    )
    manifest = extract(tables, feeds, f"{base}/out", options)
    table = outputs.read_relations_csv(spark, f"{base}/out/{OUTPUTS['aggregated_csv']}")
    read = table.select("feed_id", F.lit("aggregated_csv").alias("output"))
    for output in OUTPUTS:
        if output != "aggregated_csv":
            features = outputs.read_collections(spark, f"{base}/out/{OUTPUTS[output]}")
            read = read.unionByName(features.select(F.col("feed_dir").alias("feed_id"), F.lit(output).alias("output")))
    read = read.groupBy("feed_id", "output").agg(F.count("*").alias("n_read"))
    return manifest.join(read, ["feed_id", "output"], "left").select(
        "feed_id", "output", "n_rows", F.coalesce("n_read", F.lit(0)).alias("n_read")
    )


@query
def geojson_properties(spark, sf):
    """Names of the properties that the features of each output have, in their order."""
    tables = feed_tables(spark, sf)
    work = Aggregator(tables, no_unify_stops=True)
    rows = {
        "routes": geojson.route_feature_rows(_routes(spark, sf, False, tables)),
        "stops": geojson.stop_feature_rows(geometry.read_stops(tables.stops, tables.stop_times)),
        "aggregated_routes": geojson.path_feature_rows(styling.path_style(work.read_route_frequency())),
        "aggregated_stops": geojson.unified_stop_feature_rows(styling.stop_style(work.read_interpolated_stops())),
    }
    found = None
    for output, features in rows.items():
        keys = F.array_join(F.json_object_keys(F.get_json_object("feature", "$.properties")), ",")
        one = features.groupBy(F.lit(output).alias("output"), keys.alias("properties")).agg(F.count("*").alias("n_features"))
        found = one if found is None else found.unionByName(one)
    return found
