"""SQL for DuckDB that computes each registered query from the given tables, in its own way."""

from __future__ import annotations

import re

from tramline.fixed_values import CATALOG_COLUMNS, PREFECTURES, ROUTE_COLORS
from tramline.plans import testdata
from tramline.plans.checks import BEGIN, DAY, END, MIXED_DELIMITER, TARGET_DATE
from tramline.sources.catalog_files import RESPONSE_KEYS

SIX = "cast(cast({} as decimal(9, 6)) as varchar)"
LIMIT = "cast(0.003 as double) * cast(0.003 as double)"


def _relation(delimiter: str) -> dict[str, str]:
    """CTEs that end in `relation` (feed_id, stop_id, similar_stop_id, rule)."""
    prefix_of = f"array_to_string(list_slice(string_split(stop_id, '{delimiter}'), 1, -2), '{delimiter}')"
    with_delimiter = f"contains(stop_id, '{delimiter}')" if delimiter else "false"
    return {
        "parent_rows": """
            select s.feed_id, s.stop_id, s.parent_station as similar_stop_id
            from stops s join stops p on p.feed_id = s.feed_id and p.stop_id = s.parent_station
            union all
            select distinct p.feed_id, p.stop_id, p.stop_id
            from stops s join stops p on p.feed_id = s.feed_id and p.stop_id = s.parent_station""",
        "after_parent": "select * from stops where stop_id not in (select stop_id from parent_rows)",
        "prefixed": f"select feed_id, stop_id, {prefix_of} as prefix from after_parent where {with_delimiter}",
        "prefix_rows": """
            select feed_id, stop_id, min(stop_id) over (partition by feed_id, prefix) as similar_stop_id
            from prefixed qualify count(*) over (partition by feed_id, prefix) > 1""",
        "after_prefix": "select * from after_parent where stop_id not in (select stop_id from prefix_rows)",
        "near_edges": f"""
            select a.stop_id as x, b.stop_id as y
            from after_prefix a join after_prefix b on a.stop_name = b.stop_name and a.stop_id <> b.stop_id
            where (a.stop_lon - b.stop_lon) * (a.stop_lon - b.stop_lon)
                + (a.stop_lat - b.stop_lat) * (a.stop_lat - b.stop_lat) <= {LIMIT}""",
        "reach(x, y)": """
            select x, x from near_edges union select r.x, e.y from reach r join near_edges e on e.x = r.y""",
        "near_rows": "select 'F' as feed_id, x as stop_id, min(y) as similar_stop_id from reach group by x",
        "relation": """
            select *, 'parent' as rule from parent_rows union all select *, 'prefix' from prefix_rows
            union all select *, 'near' from near_rows
            union all select feed_id, stop_id, stop_id, 'none' from after_prefix
            where stop_id not in (select stop_id from near_rows)""",
    }


UNIFIED = {
    "unified": """
        select r.feed_id, r.similar_stop_id, any_value(n.stop_name) as similar_stop_name,
               (2 * sum(cast(round(s.stop_lon * 10000000) as bigint)) + 10 * count(*)) // (20 * count(*))
                 / cast(1000000 as double) as lon,
               (2 * sum(cast(round(s.stop_lat * 10000000) as bigint)) + 10 * count(*)) // (20 * count(*))
                 / cast(1000000 as double) as lat
        from relation r join stops s on s.stop_id = r.stop_id
        join stops n on n.stop_id = r.similar_stop_id
        where r.rule <> 'parent' or r.stop_id = r.similar_stop_id
        group by r.feed_id, r.similar_stop_id""",
}

TIMED = {
    "timed": """
        select *, cast(split_part(departure_time, ':', 1) as int) * 3600
                + cast(split_part(departure_time, ':', 2) as int) * 60
                + cast(split_part(departure_time, ':', 3) as int) as departure_secs from stop_times""",
}

SERVICES = {
    "services": f"""
        select feed_id, service_id from (
            select feed_id, service_id from calendar
            where date '{DAY}' between start_date and end_date and {DAY.strftime('%A').lower()} = 1
            union
            select feed_id, service_id from calendar_dates where date = date '{DAY}' and exception_type = 1
        ) where service_id not in (
            select service_id from calendar_dates where date = date '{DAY}' and exception_type = 2)""",
}

SEGMENTS = {
    **TIMED,
    "segments": """
        select * from (
            select feed_id, trip_id, stop_sequence, stop_id as from_stop_id,
                   lead(stop_id) over (partition by feed_id, trip_id order by stop_sequence) as to_stop_id,
                   departure_secs
            from timed) where to_stop_id is not null""",
}


def _paths(where: str = "true") -> dict[str, str]:
    return {
        "paths": f"""
            select s.feed_id, a.similar_stop_id as from_similar_stop_id, b.similar_stop_id as to_similar_stop_id,
                   count(*) as frequency
            from segments s join relation a on a.stop_id = s.from_stop_id
            join relation b on b.stop_id = s.to_stop_id
            where a.similar_stop_id <> b.similar_stop_id and {where}
            group by all""",
    }


IN_WINDOW = f"departure_secs >= {BEGIN} and departure_secs < {END}"
OF_DAY = "trip_id in (select trip_id from trips where service_id in (select service_id from services))"


def _counts(where: str = "true") -> dict[str, str]:
    return {
        "counts": f"""
            select t.feed_id, r.similar_stop_id, count(*) as count
            from timed t join relation r on r.stop_id = t.stop_id where {where} group by all""",
    }


NAMED = {
    "named": """
        select feed_id, route_id, coalesce(nullif(route_short_name, ''), nullif(route_long_name, ''), route_id)
               as route_name from routes""",
}

_POINT = f"{SIX.format('shape_pt_lon')} || ' ' || {SIX.format('shape_pt_lat')}"

SHAPE_LINES = {
    **NAMED,
    "shape_lines": f"""
        select feed_id, shape_id, string_agg({_POINT}, ',' order by shape_pt_sequence) as line
        from shapes group by feed_id, shape_id having count(*) > 1""",
    "route_lines": """
        select feed_id, route_id, route_name, line
        from (select distinct n.feed_id, n.route_id, n.route_name, l.shape_id, l.line
              from named n join trips t using (route_id) join shape_lines l on l.shape_id = t.shape_id)""",
}

PATTERN_LINES = {
    **NAMED,
    "pattern_lines": f"""
        select distinct n.feed_id, n.route_id, n.route_name, p.pattern, p.line
        from named n join trips t using (route_id)
        join (select trip_id, string_agg(stop_id, ',' order by stop_sequence) as pattern,
                     string_agg({SIX.format('stop_lon')} || ' ' || {SIX.format('stop_lat')}, ','
                                order by stop_sequence) as line
              from stop_times join stops using (stop_id) group by trip_id having count(*) > 1) p using (trip_id)""",
}

CATALOG_ENTRIES = {
    "entries": "select "
    + ", ".join(
        key if f"as {key}" in testdata.CATALOG_SQL else f"cast(null as varchar) as {key}" for key in RESPONSE_KEYS
    )
    + " from catalog",
    "prefs(feed_pref_id, feed_pref)": "values "
    + ", ".join(f"({code}, '{name}')" for code, name in enumerate(PREFECTURES, start=1)),
    "catalog_rows": "select "
    + ", ".join(f"coalesce(cast({key} as varchar), '') as {column}" for column, key, _ in CATALOG_COLUMNS)
    + " from entries join prefs using (feed_pref_id)",
}

VALID = f"date '{TARGET_DATE}' between cast(file_from_date as date) and cast(file_to_date as date)"


def _archive_rows(table: str, fields: list[str]) -> str:
    missing = {"trips": 1, "calendar": 3}.get(table)
    fault = "feed_no % 5 not in (2, 4)" + (f" and feed_no % 5 <> {missing}" if missing is not None else "")
    record = " || '|' || ".join(f"coalesce({f}, '')" for f in fields)
    return (
        f"select 'Z' || feed_no as feed_id, '{table}' as gtfs_table, {record} as record "
        f"from ({testdata.ARCHIVE_SQL[table]}) where {fault}"
    )


def _statement(body: str, *ctes: dict[str, str], raw: dict[str, str] | None = None) -> str:
    """`body` preceded by the CTEs it needs, feed tables included."""
    known = {**testdata.FEED_SQL, "catalog": testdata.CATALOG_SQL, **(raw or {})}
    for group in ctes:
        known.update(group)
    names = {name.split("(")[0]: name for name in known}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_]+", text):
            if word in names and names[word] not in needed:
                needed.add(names[word])
                visit(known[names[word]])

    visit(body)
    parts = [f"{name} as ({sql})" for name, sql in known.items() if name in needed]
    text = ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body
    return testdata.for_duckdb(text)


ARCHIVE_ROWS = [
    _archive_rows("agency", ["agency_id", "agency_name"]),
    _archive_rows("stops", ["stop_id", "stop_name", "stop_lat", "stop_lon", "''", "''"]),
    _archive_rows("routes", ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"]),
    _archive_rows("trips", ["route_id", "service_id", "trip_id", "''"]),
    _archive_rows("stop_times", ["trip_id", "stop_id", "stop_sequence", "''", "departure_time"]),
    _archive_rows("calendar", ["service_id", "monday", *["''"] * 5, "sunday", "start_date", "end_date"]),
]

NO_DELIMITER, MIXED = _relation(""), _relation(MIXED_DELIMITER)

STATEMENTS: dict[str, str] = {
    # sources
    "feed_scan": _statement(" union all ".join(ARCHIVE_ROWS)),
    "feed_required_tables": _statement(
        """select 'Z' || feed_no as feed_id,
                  case feed_no % 5 when 1 then 'trips' when 3 then 'calendar' else '' end as missing,
                  case when feed_no % 5 = 0 then 1 else 0 end as complete
           from (select distinct cast(floor(o_orderkey / 250) as int) as feed_no
                 from orders join customer on o_custkey = c_custkey)
           where feed_no % 5 not in (2, 4)"""
    ),
    "feed_ingest_report": _statement(
        f"""select 'Z' || feed_no as feed_id, case when feed_no % 5 = 4 then 404 else 200 end as status,
                   case feed_no % 5 when 4 then 'not fetched' when 2 then 'unreadable' else 'ok' end as outcome,
                   coalesce(r.n_rows, 0) as n_rows, cast(coalesce(r.n_rejected, 0) as bigint) as n_rejected
            from (select distinct cast(floor(o_orderkey / 250) as int) as feed_no
                  from orders join customer on o_custkey = c_custkey) f
            left join (
              select feed_id, count(*) as n_rows,
                     count(*) filter (where gtfs_table = 'routes' and record like '%|bus') as n_rejected
              from ({" union all ".join(ARCHIVE_ROWS)}) group by feed_id) r on r.feed_id = 'Z' || f.feed_no"""
    ),
    "preset_feeds": _statement(
        "select *, '[' || country || '][' || region || ']' || name as label from presets",
        raw={"presets": testdata.PRESET_SQL},
    ),
    "feed_manifest": _statement(
        """select name as feed_id, url as path, name as "group", name as dir,
                  case when url like 'http%' then 'remote' else 'local' end as source_kind from presets
           union all
           select n, path, n, n, 'local'
           from (select path, regexp_extract(path, '([^/.]*)[^/]*$', 1) as n from locals)""",
        raw={"presets": testdata.PRESET_SQL, "locals": testdata.LOCAL_PATHS_SQL},
    ),
    # catalogue
    "catalog_scan": _statement("select * from entries", CATALOG_ENTRIES),
    "catalog_pref_name": _statement(
        "select organization_id, feed_id, file_uid, feed_pref_id, feed_pref from entries join prefs using (feed_pref_id)",
        CATALOG_ENTRIES,
    ),
    "catalog_pref_code": _statement(
        "select c_custkey, feed_pref, feed_pref_id from names left join prefs using (feed_pref)",
        CATALOG_ENTRIES,
        raw={"names": testdata.PREF_NAMES_SQL},
    ),
    "catalog_table": _statement("select * from catalog_rows", CATALOG_ENTRIES),
    "catalog_visible": _statement(
        "select organization, feed, pref, from_date, to_date, license from catalog_rows", CATALOG_ENTRIES
    ),
    "catalog_search": _statement(
        f"""select * from catalog_rows where pref = '東京都'
            and date '{TARGET_DATE}' between cast(from_date as date) and cast(to_date as date)""",
        CATALOG_ENTRIES,
    ),
    "catalog_search_extent": _statement(
        f"""select organization_id, feed_id, file_uid, cast(139.0006 as double) as xmax, cast(35.0006 as double) as ymax
            from entries where {VALID} and feed_id in (
                select feed_id from feed_stops
                where stop_lon between cast(139.0 as double) and cast(139.0006 as double)
                  and stop_lat between cast(35.0 as double) and cast(35.0006 as double))""",
        CATALOG_ENTRIES,
        raw={"feed_stops": testdata.CATALOG_STOPS_SQL},
    ),
    "catalog_sorted": _statement(
        "select *, row_number() over (order by lower(feed) desc, organization_id, feed_id, file_uid) as place from catalog_rows",
        CATALOG_ENTRIES,
    ),
    "catalog_feed_infos": _statement(
        """select file_url as path, organization || '-' || feed as "group",
                  organization_id || '-' || feed_id || '-' || file_uid as dir
           from catalog_rows join chosen using (organization_id, feed_id, file_uid)""",
        CATALOG_ENTRIES,
        raw={"chosen": testdata.SELECTION_SQL},
    ),
    # times and filters
    "normalize_time": _statement(
        """select o_orderkey, text,
                  format('{:02d}:{:02d}:{:02d}', least(29, hh), least(59, mm), least(59, ss)) as normal,
                  format('{:02d}{:02d}{:02d}', least(29, hh), least(59, mm), least(59, ss)) as digits
           from (select *, cast(substr(six, 1, 2) as int) as hh, cast(substr(six, 3, 2) as int) as mm,
                        cast(substr(six, 5, 2) as int) as ss
                 from (select *, case when length(d) < 6 then rpad(d, 6, '0') else right(d, 6) end as six
                       from (select *, regexp_replace(text, '[^0-9]', '', 'g') as d from texts)))""",
        raw={"texts": testdata.TIME_TEXTS_SQL},
    ),
    "departure_secs": _statement(
        "select trip_id, stop_sequence, departure_time, departure_secs, departure_time as rebuilt from timed", TIMED
    ),
    "date_text": _statement(
        """select service_id, date, strftime(date, '%Y%m%d') as compact, strftime(date, '%Y-%m-%d') as dashed
           from calendar_dates"""
    ),
    "active_services": _statement("select * from services", SERVICES),
    "trips_on_date": _statement(
        "select * from trips where service_id in (select service_id from services)", SERVICES
    ),
    "stop_times_in_window": _statement(
        f"select trip_id, stop_sequence, stop_id, departure_secs from timed where {IN_WINDOW}", TIMED
    ),
    "trip_stop_times": _statement(
        """select t.feed_id, t.trip_id, p.route_id, p.service_id, t.stop_sequence, t.stop_id, s.stop_name,
                  s.stop_lon, s.stop_lat, t.departure_secs
           from timed t join trips p on p.trip_id = t.trip_id join routes r on r.route_id = p.route_id
           join stops s on s.stop_id = t.stop_id""",
        TIMED,
    ),
    "trip_segments": _statement("select * from segments", SEGMENTS),
    # unification
    "unify_parent": _statement("select * from parent_rows", NO_DELIMITER),
    "unify_prefix": _statement("select * from prefix_rows", _relation("_")),
    "unify_near": _statement("select * from near_rows", NO_DELIMITER),
    "near_group_links": _statement(
        "select stop_id, similar_stop_id, cast(0 as bigint) as far_links from near_rows", NO_DELIMITER
    ),
    "unify_no_delimiter": _statement("select * from relation", NO_DELIMITER),
    "relations_identity": _statement(
        "select feed_id, stop_id, stop_id as similar_stop_id, 'none' as rule from stops"
    ),
    "stop_relations": _statement(
        """select r.feed_id, r.stop_id, s.stop_name, r.similar_stop_id, n.stop_name as similar_stop_name, r.rule
           from relation r join stops s on s.stop_id = r.stop_id join stops n on n.stop_id = r.similar_stop_id""",
        MIXED,
    ),
    "unified_stops": _statement(
        f"""select feed_id, similar_stop_id, similar_stop_name, {SIX.format('lon')} as lon,
                   {SIX.format('lat')} as lat from unified""",
        MIXED,
        UNIFIED,
    ),
    # frequency
    "path_frequency": _statement("select * from paths", NO_DELIMITER, SEGMENTS, _paths()),
    "path_frequency_windowed": _statement(
        "select * from paths", MIXED, SEGMENTS, SERVICES, _paths(f"s.{IN_WINDOW} and s.{OF_DAY}")
    ),
    "unified_stop_counts": _statement(
        "select * from counts", MIXED, TIMED, SERVICES, _counts(f"t.{IN_WINDOW} and t.{OF_DAY}")
    ),
    "path_style": _statement(
        """select from_similar_stop_id, to_similar_stop_id,
                  round(cast(0.05 as double) + pow(frequency, cast(0.6 as double)) * cast(0.2 as double), 6) as line_width
           from paths""",
        NO_DELIMITER,
        SEGMENTS,
        _paths(),
    ),
    "stop_style": _statement(
        """select similar_stop_id, round(cast(0.8 as double) + cast(0.2 as double) * sqrt(count), 6) as scaled_size,
                  cast(1.0 as double) as symbol_size from counts""",
        NO_DELIMITER,
        TIMED,
        _counts(),
    ),
    # simple outputs
    "stops_with_route": _statement(
        f"""select feed_id, stop_id, stop_name, {SIX.format('stop_lon')} as lon, {SIX.format('stop_lat')} as lat
            from stops where stop_id in (select stop_id from stop_times)"""
    ),
    "routes_from_shapes": _statement("select * from route_lines", SHAPE_LINES),
    "routes_from_stops": _statement("select feed_id, route_id, route_name, line from pattern_lines", PATTERN_LINES),
    "route_categories": _statement(
        "select distinct feed_id, route_name, ["
        + ", ".join(f"'{color}'" for color in ROUTE_COLORS)
        + f"][cast(('0x' || substr(md5(route_name), 1, 8))::bigint % {len(ROUTE_COLORS)} + 1 as int)] as color from named",
        NAMED,
    ),
    # sinks
    "geojson_routes": _statement(
        "select feed_id, route_id, route_name, 'LineString' as geometry_type, line from route_lines", SHAPE_LINES
    ),
    "geojson_stops": _statement(
        f"""select feed_id, stop_id, stop_name, 'Point' as geometry_type, {SIX.format('stop_lon')} as lon,
                   {SIX.format('stop_lat')} as lat from stops"""
    ),
    "geojson_aggregated_routes": _statement(
        f"""select p.from_similar_stop_id, a.similar_stop_name as from_similar_stop_name, p.to_similar_stop_id,
                   b.similar_stop_name as to_similar_stop_name, p.frequency, 'LineString' as geometry_type,
                   {SIX.format('a.lon')} || ' ' || {SIX.format('a.lat')} || ',' ||
                   {SIX.format('b.lon')} || ' ' || {SIX.format('b.lat')} as line
            from paths p join unified a on a.similar_stop_id = p.from_similar_stop_id
            join unified b on b.similar_stop_id = p.to_similar_stop_id""",
        MIXED,
        UNIFIED,
        SEGMENTS,
        _paths(),
    ),
    "geojson_aggregated_stops": _statement(
        f"""select similar_stop_id, similar_stop_name, count, 'Point' as geometry_type,
                   {SIX.format('lon')} as lon, {SIX.format('lat')} as lat
            from unified join counts using (similar_stop_id)""",
        MIXED,
        UNIFIED,
        TIMED,
        _counts(),
    ),
    "geojson_roundtrip": _statement(
        f"""select stop_id, stop_name, 'Point' as geometry_type, {SIX.format('stop_lon')} as lon,
                   {SIX.format('stop_lat')} as lat, 'dir:F' as feed_dir from stops"""
    ),
    "geojson_collections": _statement(
        """select 'C' || n as feed_id, coalesce(rows, 0) as n_features, coalesce(rows, 0) as n_read
           from range(40) f(n) left join (
             select length(stop_name) % 20 as k, count(*) as rows from stops group by k) on k = n"""
    ),
    "output_manifest": _statement(
        """select feed_id, output, case when n_rows > 0 then 'out/' || file || '/feed_dir=dir%3A' || feed_id else '' end as path,
                  n_rows
           from (
             select f.feed_id, o.output, o.file, coalesce(c.n, 0) as n_rows
             from many_feeds f
             cross join (values ('routes', 'routes.geojson'), ('stops', 'stops.geojson'),
               ('aggregated_routes', 'aggregated_routes.geojson'), ('aggregated_stops', 'aggregated_stops.geojson'),
               ('aggregated_csv', 'result.csv')) o(output, file)
             left join (
               select feed_id, 'routes' as output, count(*) as n from (
                 select distinct t.feed_id, t.route_id, l.shape_id from many_trips t join shape_lines l using (shape_id))
               group by feed_id
               union all
               select m.feed_id, 'stops', count(distinct m.stop_id) from many_calls m join stops using (stop_id) group by m.feed_id
               union all
               select m.feed_id, 'aggregated_stops', count(distinct similar_stop_id)
               from many_calls m join relation using (stop_id) group by m.feed_id
               union all
               select feed_id, 'aggregated_routes', count(*) from (
                 select distinct c.feed_id, a.similar_stop_id, b.similar_stop_id as other
                 from (select feed_id, stop_id, lead(stop_id) over (partition by trip_id order by stop_sequence) as next_id
                       from many_calls) c
                 join relation a on a.stop_id = c.stop_id join relation b on b.stop_id = c.next_id
                 where a.similar_stop_id <> b.similar_stop_id) group by feed_id
               union all
               select k.feed_id, 'aggregated_csv', count(*) from stocked_feeds k cross join stops group by k.feed_id
             ) c on c.feed_id = f.feed_id and c.output = o.output)""",
        MIXED,
        SHAPE_LINES,
        raw=testdata.MANY_SQL,
    ),
}
# The archives that have every required table, each a feed of its own.
PACKED = {
    name: f"select * from ({testdata.ARCHIVE_SQL[table]}) where feed_no % 5 = 0"
    for name, table in (("packed_stops", "stops"), ("packed_trips", "trips"), ("packed_calls", "stop_times"))
}
PACKED |= {
    "packed_prefix": """
        select feed_no, stop_id, min(stop_id) over (partition by feed_no, prefix) as similar_stop_id
        from (select *, array_to_string(list_slice(string_split(stop_id, '_'), 1, -2), '_') as prefix from packed_stops)
        qualify count(*) over (partition by feed_no, prefix) > 1""",
    "packed_rest": """
        select feed_no, stop_id, stop_name, cast(stop_lon as double) as lon, cast(stop_lat as double) as lat
        from packed_stops anti join packed_prefix using (feed_no, stop_id)""",
    "packed_edges": f"""
        select feed_no, a.stop_id as x, b.stop_id as y from packed_rest a join packed_rest b using (feed_no, stop_name)
        where (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= {LIMIT}""",
    "packed_reach(feed_no, x, y)": """
        select feed_no, x, y from packed_edges
        union select r.feed_no, r.x, e.y from packed_reach r join packed_edges e on e.feed_no = r.feed_no and e.x = r.y""",
    "packed_relation": """
        select * from packed_prefix
        union all select feed_no, x, min(y) from packed_reach group by feed_no, x""",
    "packed_order": """
        select feed_no, trip_id, stop_id, cast(stop_sequence as int) as place,
               lead(stop_id) over (partition by feed_no, trip_id order by cast(stop_sequence as int)) as next_id
        from packed_calls""",
}

STATEMENTS["archives_to_outputs"] = _statement(
    """select 'Z' || f.feed_no as feed_id, o.output, coalesce(c.n, 0) as n_rows, coalesce(c.n, 0) as n_read
       from (select distinct feed_no from packed_trips) f
       cross join (values ('routes'), ('stops'), ('aggregated_routes'), ('aggregated_stops'), ('aggregated_csv')) o(output)
       left join (
         select feed_no, 'routes' as output, count(*) as n from (
           select distinct t.feed_no, t.route_id, p.pattern from packed_trips t join (
             select feed_no, trip_id, string_agg(stop_id, ',' order by place) as pattern
             from packed_order group by feed_no, trip_id having count(*) > 1) p using (feed_no, trip_id))
         group by feed_no
         union all select feed_no, 'stops', count(distinct stop_id) from packed_calls group by feed_no
         union all select feed_no, 'aggregated_csv', count(*) from packed_stops group by feed_no
         union all select feed_no, 'aggregated_stops', count(distinct similar_stop_id)
         from packed_calls join packed_relation using (feed_no, stop_id) group by feed_no
         union all select feed_no, 'aggregated_routes', count(*) from (
           select distinct o.feed_no, a.similar_stop_id as begin_id, b.similar_stop_id as end_id from packed_order o
           join packed_relation a on a.feed_no = o.feed_no and a.stop_id = o.stop_id
           join packed_relation b on b.feed_no = o.feed_no and b.stop_id = o.next_id
           where a.similar_stop_id <> b.similar_stop_id) group by feed_no
       ) c on c.feed_no = f.feed_no and c.output = o.output""",
    PACKED,
)
STATEMENTS["geojson_properties"] = _statement(
    """select 'routes' as output, 'feed_id,route_id,route_name' as properties, count(*) as n_features from route_lines
       union all select 'stops', 'feed_id,stop_id,stop_name', count(*) from stops
       union all select 'aggregated_routes', 'feed_id,from_similar_stop_id,from_similar_stop_name,to_similar_stop_id,'
         || 'to_similar_stop_name,frequency,line_width', count(*) from (
         select distinct from_stop_id, to_stop_id from segments where from_stop_id <> to_stop_id)
       union all select 'aggregated_stops', 'feed_id,similar_stop_id,similar_stop_name,count,symbol_size', count(distinct stop_id)
       from stop_times""",
    SHAPE_LINES,
    SEGMENTS,
)
STATEMENTS["relations_csv_roundtrip"] = STATEMENTS["stop_relations"].replace(", r.rule\n", ", r.rule, 'dir-F' as feed_dir\n")
