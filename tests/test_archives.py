import csv
import io
import random
import zipfile

import pytest

from tramline.sources import archives
from tramline.sources.files import open_file, write_file

WAYS = pytest.mark.parametrize("way", [archives.list_archives, archives.read_archives])

FULL = {
    "agency": "agency_id,agency_name\n1,A\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,extra\n01,駅,35.5,139.5,x\n02,\"a, b\",bad,,y\n03,\"two\nlines\",1,2,z\n",
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nr,1,,Long,3\n",
    "trips": "trip_id,route_id,service_id\nt,r,s\n",
    "stop_times": "﻿trip_id, stop_sequence ,stop_id,departure_time\r\nt,1,01,8:00:00\r\nt,2,02\r\n\r\nt,3,03,25:10:00\r\n",
    "calendar_dates": "service_id,date,exception_type\ns,20240506,1\n",
}


def zipped(tables):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in tables.items():
            archive.writestr(f"{name}.txt", text)
    return buffer.getvalue()


@pytest.fixture
def folder(tmp_path):
    feeds = tmp_path / "feeds"
    feeds.mkdir()
    (feeds / "full.v2.zip").write_bytes(zipped(FULL))
    (feeds / "other.zip").write_bytes(zipped({**FULL, "trips": FULL["trips"].replace("t,", "u,")}))
    (feeds / "partial.zip").write_bytes(zipped({k: v for k, v in FULL.items() if k not in ("trips", "calendar_dates")}))
    (feeds / "broken.zip").write_bytes(zipped(FULL)[:-60])
    (feeds / "empty.zip").write_bytes(b"")
    (feeds / "latin.zip").write_bytes(zipped({**FULL, "stops": "stop_id,stop_name\n1,caf\xe9\n".encode("latin-1")}))
    return feeds


@WAYS
def test_scan_types_and_texts(spark, folder, way):
    records = archives.scan_archives(way(spark, str(folder / "full.v2.zip")))
    stops = {r.stop_id: r for r in archives.table_from_records(records, "stops").collect()}
    assert stops["01"].stop_name == "駅" and stops["01"].stop_lat == 35.5 and stops["01"].feed_id == "full"
    assert stops["02"].stop_name == "a, b" and stops["02"].stop_lat is None and stops["02"].stop_lon is None
    assert stops["03"].stop_name == "two\nlines" and stops["03"].parent_station is None
    times = archives.table_from_records(records, "stop_times").orderBy("stop_sequence").collect()
    assert [(r.trip_id, r.stop_id, r.stop_sequence, r.departure_secs) for r in times] == [
        ("t", "01", 1, 28800),
        ("t", "02", 2, None),
        ("t", "03", 3, 90600),
    ]
    routes = archives.table_from_records(records, "routes").first()
    assert routes.route_short_name is None and routes.route_type == 3
    assert str(archives.table_from_records(records, "calendar_dates").first().date) == "2024-05-06"
    assert archives.table_from_records(records, "shapes").count() == 0


@WAYS
def test_report_and_required_tables(spark, folder, way):
    packed = way(spark, str(folder))
    records = archives.scan_archives(packed)
    fetched = packed.selectExpr("feed_id", "200 as status").unionByName(
        spark.createDataFrame([("gone", 404), ("empty", 200)], "feed_id string, status int")
    ).distinct()
    found = {r.feed_id: r for r in archives.ingest_report(records, fetched).collect()}
    report = {k: r.outcome for k, r in found.items()}
    assert (found["full"].n_rows, found["full"].n_rejected, found["broken"].n_rows, found["gone"].n_rejected) == (10, 1, 0, 0)
    assert report == {
        "full": "ok",
        "other": "ok",
        "partial": "ok",
        "broken": "unreadable",
        "empty": "unreadable",
        "latin": "unreadable",
        "gone": "not fetched",
    }
    usable = archives.usable_records(records)
    missing = {r.feed_id: (r.missing, r.complete) for r in archives.required_tables(usable).collect()}
    assert missing == {"full": ([], True), "other": ([], True), "partial": (["calendar", "trips"], False)}


@WAYS
def test_staged_tables(spark, folder, tmp_path, way):
    packed = way(spark, str(folder))
    tables = archives.stage_feeds(packed, str(tmp_path / "complete"))
    assert {r.feed_id for r in tables.stop_times.select("feed_id").distinct().collect()} == {"full", "other"}
    tables = archives.stage_feeds(packed, str(tmp_path / "staged"), only_complete=False)
    assert {r.feed_id for r in tables.stop_times.select("feed_id").distinct().collect()} == {"full", "other", "partial"}
    assert tables.trips.count() == 2 and tables.stop_times.count() == 9
    again = archives.staged_feeds(spark, str(tmp_path / "staged"))
    assert again.stop_times.schema == tables.stop_times.schema
    assert again.calendar.count() == 0 and "monday" in again.calendar.columns
    rejected = spark.read.parquet(str(tmp_path / "staged" / "rejected")).collect()
    assert {(r.feed_id, r.gtfs_table, r.column, r.n_rejected) for r in rejected} == {
        (f, "stops", "stop_lat", 1) for f in ("full", "other", "partial")}
    complete = spark.read.parquet(str(tmp_path / "complete" / "rejected"))
    assert {r.feed_id for r in complete.collect()} == {"full", "other"}


def test_an_archive_larger_than_a_chunk(spark, monkeypatch):
    rows = "".join(f"t{i % 7},{i},s,10:00:00\n" for i in range(archives.CHUNK_ROWS + 5))
    content = zipped({"stop_times": "trip_id,stop_sequence,stop_id,departure_time\n" + rows})
    one = spark.createDataFrame([("f", content)], "feed_id string, content binary")
    assert archives.table_from_records(archives.scan_archives(one), "stop_times").count() == archives.CHUNK_ROWS + 5


def test_a_very_long_text_is_kept_whole(spark):
    content = zipped({"stops": "stop_id,stop_name\n1," + "x" * 300_000 + "\n"})
    one = spark.createDataFrame([("f", content)], "feed_id string, content binary")
    row = archives.table_from_records(archives.scan_archives(one), "stops").selectExpr("length(stop_name) as n").first()
    assert row.n == 300_000


@WAYS
def test_archives_of_one_name_stay_apart(spark, folder, way):
    other = folder.parent / "more"
    other.mkdir()
    for place in (folder, other):
        (place / "gtfs.zip").write_bytes(zipped(FULL))
    both = [str(folder / "gtfs.zip"), str(other / "gtfs.zip"), str(folder / "other.zip")]
    ids = {r.feed_id for r in way(spark, both).select("feed_id").collect()}
    assert ids == {both[0], both[1], "other"}
    manifest = spark.createDataFrame([("x", both[0]), ("y", f"file://{both[1]}")], "feed_id string, path string")
    assert {r.feed_id for r in way(spark, both, manifest).collect()} == {"x", "y"}
    with pytest.raises(ValueError, match="several archives"):
        way(spark, both, manifest.withColumn("feed_id", manifest.feed_id.substr(2, 1)))


def rows_of(text):
    wanted = ["a", "b", "c"]
    return [row for columns in archives._parsed(io.BufferedReader(io.BytesIO(text.encode())), wanted)
            for row in zip(*(c.to_pylist() for c in columns), strict=True)]


def row_by_row(text):
    """The same with the plain reader of the standard library."""
    reader = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
    header = [n.strip() for n in next(reader, [])]
    places = [header.index(n) if n in header else -1 for n in "abc"]
    return [tuple(row[p] if 0 <= p < len(row) else None for p in places) for row in reader if row]


def test_rows_of_any_shape_are_kept(monkeypatch):
    monkeypatch.setattr(archives, "BLOCK_BYTES", 400)
    draw = random.Random(2)
    pieces = ["x", "1", '"q, ""r"""', '"two\nlines"', "", "駅", " pad ", '"', "a\"b"]
    headers = ["a,b,c", "c,a", "\ufeffb, a ,z,c", '"a",b', "z", "a,b,c,a", ""]
    for k in range(200):
        end = draw.choice(["\n", "\r\n", "\r"])
        plain = [p for p in pieces if p != '"']
        lines = [draw.choice(headers)] + [",".join(draw.choice(plain) for _ in range(draw.choice([3, 3, 3, 1, 2, 5]))) for _ in range(draw.randrange(0, 60))]
        text = end.join(lines) + draw.choice(["", end, end * 2])
        assert sorted(map(str, rows_of(text))) == sorted(map(str, row_by_row(text))), (k, text)


def test_large_tables_stream_and_entries_are_dealt(spark, tmp_path):
    calls = "trip_id,stop_sequence,stop_id,departure_time\n" + "".join(f"t{i // 50},{i % 50},s{i % 9},10:00:00\n" for i in range(300_000))
    (tmp_path / "big.zip").write_bytes(zipped({**FULL, "stop_times": calls}))
    listed = archives.list_archives(spark, str(tmp_path / "*.zip"))
    assert listed.columns == ["feed_id", "path", "length"]
    entries = {r.gtfs_table: r.size for r in archives.archive_entries(listed).collect()}
    assert entries["stop_times"] == len(calls) and set(entries) == set(FULL)
    records = archives.scan_archives(listed)
    assert records.rdd.getNumPartitions() > 1
    assert archives.table_from_records(records, "stop_times").count() == 300_000


def test_files_are_there_as_a_whole_or_not_at_all(tmp_path):
    target = str(tmp_path / "sub" / "x.bin")
    write_file(f"file://{target}", lambda out: out.write(b"abc"))

    def fails(out):
        out.write(b"zz")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        write_file(target, fails)
    with open_file(f"file:{target}") as file:
        assert file.read() == b"abc"
    assert [f.name for f in (tmp_path / "sub").iterdir()] == ["x.bin"]


def test_a_search_in_a_box_skips_stops_along_the_curve(spark, tmp_path):
    from pyspark.sql import functions as F

    stops = spark.range(200_000).select(
        F.concat(F.lit("f"), F.col("id") % 50).alias("feed_id"), F.col("id").cast("string").alias("stop_id"),
        (F.lit(130.0) + (F.col("id") * 7919 % 100_003) / 10_000.0).alias("stop_lon"),
        (F.lit(30.0) + (F.col("id") * 104_729 % 99_991) / 10_000.0).alias("stop_lat"),
    )
    small = archives.STOP_GROUP_BYTES // 16
    stops.repartitionByRange("feed_id", "stop_id").sortWithinPartitions("feed_id", "stop_id").write.option(
        "parquet.block.size", small).parquet(str(tmp_path / "by_feed"))
    archives.in_staged_order(stops, "stops").write.option("parquet.block.size", small).parquet(str(tmp_path / "by_place"))
    read, found = {}, {}
    for name in ("by_feed", "by_place"):
        box = spark.read.parquet(str(tmp_path / name)).where("stop_lon between 133 and 133.2 and stop_lat between 35 and 35.2")
        found[name] = {r.stop_id for r in box.select("stop_id").collect()}
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = box.select("stop_id")
        plan.collect()
        scan = plan._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read[name] = scan.metrics().apply("numOutputRows").value()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found["by_feed"] == found["by_place"] and found["by_feed"]
    print(read)
    assert read["by_place"] * 5 < read["by_feed"]


def test_places_on_the_curve(spark):
    from pyspark.sql import functions as F

    from tramline.functions.curve import place_on_curve

    rows = [(-180.0, -90.0), (180.0, 90.0), (139.7, 35.6), (139.7001, 35.6001), (None, 1.0), (float("nan"), 1.0), (500.0, -500.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, y double").select(place_on_curve(F.col("x"), F.col("y"))).collect()]

    def plainly(lon, lat):
        x, y = (min(65535, max(0, int((v + h) / (2 * h) * 65536 // 1))) for v, h in ((lon, 180), (lat, 90)))
        return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(16))

    assert got == [None if x is None or x != x else plainly(x, y) for x, y in rows]


def test_trips_in_buckets_are_joined_and_followed_without_a_shuffle(spark, folder, tmp_path):
    from tramline.operators import frequency

    places = {way: archives.stage_feeds(archives.list_archives(spark, str(folder)), str(tmp_path / way), buckets=n)
              for way, n in (("ranges", None), ("buckets", 8))}
    for name in ("trips", "stop_times"):
        a, b = (sorted(map(str, getattr(t, name).collect())) for t in places.values())
        assert a == b
    again = archives.staged_feeds(spark, str(tmp_path / "buckets"))
    spark.sql(f"drop table {archives._table_name(str(tmp_path / 'buckets'), 'trips')}")
    again = archives.staged_feeds(spark, str(tmp_path / "buckets"))
    found = {}
    for way, tables in (("ranges", places["ranges"]), ("buckets", again)):
        segments = frequency.trip_segments(tables.stop_times)
        timetable = frequency.trip_stop_times(tables.stop_times, tables.trips, tables.routes, tables.stops)
        joined = tables.stop_times.hint("merge").join(tables.trips, ["feed_id", "trip_id"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (segments, joined)]
        found[way] = [sorted(map(str, df.collect())) for df in (segments, timetable, joined.select("trip_id", "stop_id"))], [
            "Exchange hashpartitioning(feed_id" in p for p in plans]
    assert found["ranges"][0] == found["buckets"][0]
    assert found["ranges"][1] == [True, True] and found["buckets"][1] == [False, False]


def test_a_folder_of_archives_is_one_path_to_list(spark):
    """A pattern would be as many paths as there are archives."""
    from tramline.plans import checks, testdata

    seen = []
    listed = archives.list_archives
    try:
        archives.list_archives = lambda spark, path, *more: seen.append(path) or listed(spark, path, *more)
        fetched, records = checks._scanned(spark, "/root/testdata/sf0.001")
    finally:
        archives.list_archives = listed
    files = spark.read.format("binaryFile").load(seen[0])
    assert "InMemoryFileIndex(1 paths)" in files._jdf.queryExecution().executedPlan().toString()
    assert files.count() == fetched.where("path is not null").count() > 0


def test_archives_are_zipped_from_lines_in_order_across_batches():
    import zipfile as z
    import pyarrow as pa
    from tramline.plans import testdata

    rows = [(n, t, f"{n},{t},{i:02}") for n in (5, 6, 9) for t in ("agency", "trips") for i in range(7)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("feed_no", "gtfs_table", "line"), r)) for r in rows[i : i + 5]]) for i in range(0, 42, 5)]
    made = [r for b in testdata._zip_feeds(iter(batches), {"agency": "a", "trips": "t"}) for r in b.to_pylist()]
    assert [(r["feed_id"], r["status"]) for r in made] == [("Z5", 200), ("Z6", 200), ("Z9", 404)]
    with z.ZipFile(io.BytesIO(made[0]["content"])) as archive:
        assert archive.namelist() == ["agency.txt", "trips.txt"]
        want = "\ufefft\r\n" + "".join(f"5,trips,{i:02}\r\n" for i in range(7))
        assert archive.read("trips.txt").decode() == want
    with z.ZipFile(io.BytesIO(made[1]["content"])) as archive:
        assert archive.namelist() == ["agency.txt"]
    assert made[2]["content"] is None
