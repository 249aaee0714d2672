"""The given star-schema tables seen as one transit feed.

Each feed table is a SELECT that both Spark and DuckDB accept, so the registered queries
and their check SQL start from the same rows. `{name}` stands for a given table.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.times import time_to_secs
from tramline.schemas import FeedTables
from tramline.session import durable
from tramline.sources.files import write_file

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

PLATFORM_LON = "139 + floor(p_partkey / 2000) + (p_partkey * 31 % 61) * cast(0.0007 as double)"
PLATFORM_LAT = "35 + (p_partkey * 17 % 59) * cast(0.0007 as double)"

FEED_SQL: dict[str, str] = {
    "agency": """
        select 'F' as feed_id, 'A' || r_regionkey as agency_id, r_name as agency_name from {region}""",
    "stops": f"""
        select 'F' as feed_id, p_brand || '_' || p_partkey as stop_id, p_name as stop_name,
               cast({PLATFORM_LAT} as double) as stop_lat,
               cast({PLATFORM_LON} as double) as stop_lon,
               0 as location_type,
               case when p_partkey % 5 = 0 then 'ST' || (p_partkey % 10) end as parent_station
        from {{part}}
        union all
        select 'F', 'ST' || s_suppkey, s_name,
               cast(35 + (s_suppkey * 29 % 59) * cast(0.0007 as double) as double),
               cast(139 + (s_suppkey * 13 % 61) * cast(0.0007 as double) as double),
               1, cast(null as string)
        from {{supplier}}""",
    "routes": """
        select 'F' as feed_id, 'R' || n_nationkey as route_id, 'A' || n_regionkey as agency_id,
               case when n_nationkey % 2 = 0 then n_name else '' end as route_short_name,
               'Line ' || n_name as route_long_name, 3 as route_type
        from {nation}""",
    "trips": """
        select 'F' as feed_id, 'R' || c_nationkey as route_id, o_orderpriority as service_id,
               cast(o_orderkey as string) as trip_id, 'SH' || c_nationkey as shape_id
        from {orders} join {customer} on o_custkey = c_custkey""",
    "stop_times": """
        select 'F' as feed_id, cast(l_orderkey as string) as trip_id,
               p_brand || '_' || p_partkey as stop_id, stop_sequence,
               lpad(cast(cast(floor(secs / 3600) as int) as string), 2, '0') || ':'
                 || lpad(cast(cast(floor(secs % 3600 / 60) as int) as string), 2, '0') || ':'
                 || lpad(cast(secs % 60 as string), 2, '0') as departure_time
        from (select l_orderkey, l_partkey, stop_sequence,
                     18000 + cast(l_orderkey % 22 as int) * 3600 + stop_sequence * 420 as secs
              from (select l_orderkey, l_partkey,
                           cast(row_number() over (partition by l_orderkey
                             order by l_linenumber, l_partkey, l_suppkey, l_shipdate,
                                      l_extendedprice, l_quantity) as int) as stop_sequence
                    from {lineitem}) numbered) timed
        join {part} on p_partkey = l_partkey""",
    "calendar": """
        select distinct 'F' as feed_id, o_orderpriority as service_id,
               case when substring(o_orderpriority, 1, 1) in ('1', '2', '3', '4') then 1 else 0 end as monday,
               case when substring(o_orderpriority, 1, 1) in ('1', '2', '3', '4') then 1 else 0 end as tuesday,
               case when substring(o_orderpriority, 1, 1) in ('1', '2', '3', '4') then 1 else 0 end as wednesday,
               case when substring(o_orderpriority, 1, 1) in ('1', '2', '3', '4') then 1 else 0 end as thursday,
               case when substring(o_orderpriority, 1, 1) in ('1', '2', '3', '4') then 1 else 0 end as friday,
               case when substring(o_orderpriority, 1, 1) in ('1', '5') then 1 else 0 end as saturday,
               case when substring(o_orderpriority, 1, 1) in ('1', '5') then 1 else 0 end as sunday,
               date '1995-01-01' as start_date, date '2001-12-31' as end_date
        from {orders}""",
    "calendar_dates": """
        select 'F' as feed_id, o_orderpriority as service_id, cast(o_orderdate as date) as date,
               cast(1 + min(o_custkey) % 2 as int) as exception_type
        from {orders} group by o_orderpriority, cast(o_orderdate as date)""",
    "shapes": f"""
        select 'F' as feed_id, 'SH' || (p_partkey % 25) as shape_id,
               cast({PLATFORM_LAT} as double) as shape_pt_lat,
               cast({PLATFORM_LON} as double) as shape_pt_lon,
               cast(p_partkey as int) as shape_pt_sequence
        from {{part}}""",
}

# Catalogue entries under their response keys, plus the date columns as texts.
CATALOG_SQL = """
    select 'O' || s_nationkey as organization_id, n_name as organization_name,
           'https://example.org/o/' || s_nationkey as organization_web_url,
           'info' || s_nationkey || '@example.org' as organization_email,
           'F' || s_suppkey as feed_id, s_name as feed_name,
           cast(1 + s_suppkey % 47 as int) as feed_pref_id,
           'CC' || (s_suppkey % 3) as feed_license_id,
           'U' || s_suppkey as file_uid,
           cast(cast(date '1995-01-01' + cast(s_suppkey % 365 as int) as date) as string) as file_from_date,
           cast(cast(date '1995-01-01' + cast(s_suppkey % 365 + 365 as int) as date) as string) as file_to_date,
           'https://example.org/' || s_suppkey || '.zip' as file_url
    from {supplier} join {nation} on s_nationkey = n_nationkey"""


# Entries of a preset list.
PRESET_SQL = """
    select r_name as country, n_name as region, s_name as name,
           case when s_suppkey % 4 = 3 then '/data/' else 'https://example.org/feeds/' end
             || s_suppkey || '.zip' as url
    from {supplier} join {nation} on s_nationkey = n_nationkey
    join {region} on n_regionkey = r_regionkey"""

# Local archives, with further dots in the name.
LOCAL_PATHS_SQL = "select '/data/feeds/bus-' || c_custkey || '.v' || c_nationkey || '.zip' as path from {customer}"

# Prefecture names, some of them unknown.
PREF_NAMES_SQL = """
    select c_custkey, case c_custkey % 4 when 0 then '東京都' when 1 then '沖縄県' when 2 then '北海道'
                      else '不明' || c_nationkey end as feed_pref
    from {customer}"""

# Stops of the catalogue's feeds: a feed has the stops its supplier delivers to.
CATALOG_STOPS_SQL = f"""
    select 'F' || l_suppkey as feed_id,
           cast({PLATFORM_LON} as double) as stop_lon, cast({PLATFORM_LAT} as double) as stop_lat
    from {{lineitem}} join {{part}} on p_partkey = l_partkey"""

# Table rows the user picked.
SELECTION_SQL = """
    select 'O' || s_nationkey as organization_id, 'F' || s_suppkey as feed_id, 'U' || s_suppkey as file_uid
    from {supplier} where s_acctbal > 0"""

# Texts as typed into a time field.
TIME_TEXTS_SQL = """
    select o_orderkey,
           case o_orderkey % 7 when 0 then cast(o_orderkey % 30 as string)
                when 1 then (o_orderkey % 10) || ':00:00'
                when 2 then (o_orderkey % 40) || ':' || (o_orderkey % 77) || ':05'
                when 3 then 'at ' || o_orderkey
                when 4 then '12' || o_orderkey || '0059'
                when 5 then ''
                else '2' || (o_orderkey % 9) || '7199' end as text
    from {orders}"""


def given(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run `sql` on the given tables in `sf_dir`."""
    used = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if "{" + name + "}" in sql}
    return spark.sql(sql, **used)


def feed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = given(spark, sf_dir, FEED_SQL[name])
    if name == "stop_times":
        table = table.withColumn("departure_secs", time_to_secs(F.col("departure_time")))
    return table


def staged_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times written as a table first, as feeds are before an analysis (sources/archives.py)."""
    return durable(feed_table(spark, sf_dir, "stop_times"), "stop-times")


def feed_tables(spark: SparkSession, sf_dir: str) -> FeedTables:
    tables = {name: feed_table(spark, sf_dir, name) for name in FEED_SQL if name != "stop_times"}
    return FeedTables(stop_times=staged_stop_times(spark, sf_dir), **tables)


def for_duckdb(sql: str) -> str:
    """The same text for an engine that finds the given tables by name."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


# The trips as 30 feeds of very different size, by the last digits of their number; all have the same routes and
# shapes, and of the last five, which have no trips, two have no stops either.
_MANY = "'M' || least(greatest(cast(trip_id as bigint) % 100 - 75, 0), 24)"
MANY_FEEDS_SQL = "select distinct 'M' || (n_nationkey % 25) as feed_id from {nation} union all select 'M' || (25 + r_regionkey) from {region}"
MANY_SQL = {
    "many_feeds": MANY_FEEDS_SQL,
    "stocked_feeds": f"select feed_id from ({MANY_FEEDS_SQL}) f where feed_id not in ('M28', 'M29')",
    "many_trips": f"select {_MANY} as feed_id, trip_id, route_id, service_id, shape_id from trips",
    "many_calls": f"select {_MANY} as feed_id, trip_id, stop_id, stop_sequence, departure_time from stop_times",
}


def many_feeds(spark: SparkSession, sf_dir: str) -> FeedTables:
    """The tables of the feeds of MANY_SQL."""
    one = feed_tables(spark, sf_dir)
    number = F.concat(F.lit("M"), F.least(F.greatest(F.col("trip_id").cast("bigint") % 100 - 75, F.lit(0)), F.lit(24)).cast("string"))
    feeds = given(spark, sf_dir, MANY_FEEDS_SQL)
    stocked = feeds.where("feed_id not in ('M28', 'M29')")

    def in_every(table: DataFrame, of: DataFrame) -> DataFrame:
        return table.drop("feed_id").crossJoin(F.broadcast(of))  # 30 feeds

    return FeedTables(
        agency=in_every(one.agency, feeds), stops=in_every(one.stops, stocked), routes=in_every(one.routes, feeds),
        trips=one.trips.withColumn("feed_id", number), stop_times=one.stop_times.withColumn("feed_id", number),
        calendar=in_every(one.calendar, feeds), calendar_dates=in_every(one.calendar_dates, feeds),
        shapes=in_every(one.shapes, feeds),
    )


# The same feed cut into many zipped feeds of 250 trips, one text line per table row.
_NO = "cast(floor(cast(trip_id as bigint) / 250) as int)"
_TRIPS = f"(select {_NO} as feed_no, t.* from ({FEED_SQL['trips']}) t)"
_CALLS = f"(select {_NO} as feed_no, t.* from ({FEED_SQL['stop_times']}) t)"

ARCHIVE_SQL: dict[str, str] = {
    "agency": f"""
        select distinct feed_no, a.agency_id, a.agency_name
        from {_TRIPS} t join ({FEED_SQL['routes']}) r on r.route_id = t.route_id
        join ({FEED_SQL['agency']}) a on a.agency_id = r.agency_id""",
    "stops": f"""
        select feed_no, p_brand || '_' || p_partkey as stop_id, p_name as stop_name,
               cast(cast({PLATFORM_LAT} as decimal(9, 4)) as string) as stop_lat,
               cast(cast({PLATFORM_LON} as decimal(9, 4)) as string) as stop_lon
        from (select distinct cast(floor(l_orderkey / 250) as int) as feed_no, l_partkey from {{lineitem}}) used
        join {{part}} on p_partkey = l_partkey""",
    "routes": f"""
        select distinct feed_no, r.route_id, r.agency_id, r.route_short_name, r.route_long_name,
               case when r.route_id like '%7' then 'bus' else cast(r.route_type as string) end as route_type
        from {_TRIPS} t join ({FEED_SQL['routes']}) r on r.route_id = t.route_id""",
    "trips": f"select feed_no, trip_id, service_id, route_id from {_TRIPS} t",
    "stop_times": f"""
        select feed_no, trip_id, cast(stop_sequence as string) as stop_sequence, stop_id, departure_time
        from {_CALLS} c""",
    "calendar": f"""
        select distinct feed_no, service_id, '1' as monday, '0' as sunday,
               '19950101' as start_date, '20011231' as end_date
        from {_TRIPS} t""",
}

# What is wrong with some of the archives, by feed_no % 5.
NO_TRIPS, DAMAGED, NO_CALENDAR, NOT_FETCHED = 1, 2, 3, 4


def feed_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_id, status, content): zipped feeds built from the given tables, some of them faulty."""
    lines, headers = None, {}
    for table, sql in ARCHIVE_SQL.items():
        rows = given(spark, sf_dir, sql)
        one = rows.select("feed_no", F.lit(table).alias("gtfs_table"), F.concat_ws(",", *rows.columns[1:]).alias("line"))
        lines = one if lines is None else lines.unionByName(one)
        headers[table] = ",".join(rows.columns[1:])

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _zip_feeds(batches, headers)

    # lines lie in their order, and a feed, of 250 trips, is held while its lines come in
    in_order = lines.repartition("feed_no").sortWithinPartitions("feed_no", "gtfs_table", "line")
    return in_order.mapInArrow(zipped, "feed_id string, status int, content binary")


def archive_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The fetched archives of `feed_archives` as files `folder`/<feed>.zip: (feed_id, status, path), path null for others."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for feed_id, content in zip(batch.column("feed_id").to_pylist(), batch.column("content"), strict=True):
                paths.append(f"{folder}/{feed_id}.zip" if content.is_valid else None)
                if content.is_valid:
                    write_file(paths[-1], lambda out, content=content: out.write(content.as_buffer()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("feed_id"), batch.column("status"), pa.array(paths, pa.string())], ["feed_id", "status", "path"]
            )

    return durable(feed_archives(spark, sf_dir).mapInArrow(write, "feed_id string, status int, path string"), "archive-files")


def _zip_feeds(batches: Iterator[pa.RecordBatch], headers: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """One archive for each feed of lines that come in by feed and table."""
    number: int | None = None
    tables: dict[str, list[str]] = {}  # texts of lines, one for each batch that has some
    for batch in batches:
        feeds, names = batch.column("feed_no"), batch.column("gtfs_table").dictionary_encode()
        ids, codes = feeds.to_numpy(zero_copy_only=False), names.indices.to_numpy(zero_copy_only=False)
        begins = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist()] if len(ids) else []
        runs = pa.ListArray.from_arrays(pa.array([*begins, len(ids)], pa.int32()), batch.column("line"))
        for begin, lines in zip(begins, pc.binary_join(runs, "\r\n").to_pylist()) if begins else ():
            if number is not None and ids[begin] != number:
                yield _zip_feed(number, tables, headers)
                tables = {}
            number = int(ids[begin])
            tables.setdefault(names.dictionary[codes[begin]].as_py(), []).append(lines)
    if number is not None:
        yield _zip_feed(number, tables, headers)


def _zip_feed(number: int, tables: dict[str, list[str]], headers: dict[str, str]) -> pa.RecordBatch:
    fault = number % 5
    left_out = {NO_TRIPS: "trips", NO_CALENDAR: "calendar"}.get(fault)
    fetched = fault != NOT_FETCHED
    content = None
    if fetched:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
            for table, lines in tables.items():
                if table != left_out:
                    archive.writestr(f"{table}.txt", "\ufeff" + "\r\n".join([headers[table], *lines]) + "\r\n")
        content = buffer.getvalue()
    if fault == DAMAGED:
        content = content[: len(content) // 2]
    return pa.RecordBatch.from_arrays(
        [pa.array([f"Z{number}"]), pa.array([200 if fetched else 404], pa.int32()), pa.array([content], pa.binary())],
        ["feed_id", "status", "content"],
    )
