import csv
import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tramline.operators import styling
from tramline.plans.extraction import Aggregator, Options, extract
from tramline.schemas import FeedTables
from tramline.session import durable
from tramline.sinks import geojson
from tramline.sinks.relations_csv import write_relations_csv
from tramline.sources import archives, outputs
from tests.test_archives import zipped

FEED = {
    "agency": "agency_id,agency_name\n1,A\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon,parent_station\n"
    "S,中央駅,35.0,139.0,\nS1,中央駅1番,35.001,139.0,S\n"
    "b1,\"Quote \"\"x\"\", comma\",35.1,139.1,\nb2,\"Quote \"\"x\"\", comma\",35.1001,139.1001,\nlone,Lone,36,140,\n",
    "routes": "route_id,route_short_name,route_long_name\nr,7,\n",
    "trips": "trip_id,route_id,service_id\nt1,r,wk\nt2,r,wk\nt3,r,sun\n",
    "stop_times": "trip_id,stop_sequence,stop_id,departure_time\n"
    "t1,1,S1,8:00:00\nt1,2,b1,8:10:00\nt2,1,S1,26:00:00\nt2,2,b2,26:10:00\nt3,1,b1,9:00:00\nt3,2,S,9:05:00\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
    "wk,1,1,1,1,1,0,0,20240101,20241231\nsun,0,0,0,0,0,0,1,20240101,20241231\n",
}


@pytest.fixture
def tables(spark) -> FeedTables:
    quiet = {**FEED, "stop_times": "trip_id,stop_sequence,stop_id,departure_time\n"}
    packed = spark.createDataFrame([("f", zipped(FEED)), ("quiet", zipped(quiet))], "feed_id string, content binary")
    records = archives.usable_records(archives.scan_archives(packed))
    return FeedTables(**{name: archives.table_from_records(records, name).cache() for name in archives.STAGED_ORDER})


def features(folder: str, feed_dir: str) -> list[dict]:
    files = Path(folder, f"feed_dir={feed_dir}").glob("*.txt")
    found = [json.loads(line) for f in files for line in f.read_text(encoding="utf-8").splitlines()]
    assert all(f["type"] == "Feature" for f in found)
    return found


def test_both_jobs_from_archives_to_files(spark, tables, tmp_path):
    feeds = spark.createDataFrame([("f", "都バス"), ("quiet", "quiet")], "feed_id string, dir string")
    out = str(tmp_path / "out")
    options = Options(aggregate=True, filter_by_date=True, day=datetime.date(2024, 5, 6))
    manifest = {(r.feed_id, r.output): (r.path, r.n_rows) for r in extract(tables, feeds, out, options).collect()}
    assert manifest["f", "routes"] == (f"{out}/routes.geojson/feed_dir=都バス", 3)
    assert {k[1]: v[1] for k, v in manifest.items() if k[0] == "f"} == {
        "routes": 3,
        "stops": 5,
        "aggregated_routes": 1,
        "aggregated_stops": 2,
        "aggregated_csv": 5,
    }
    assert manifest["quiet", "aggregated_routes"] == ("", 0)
    assert all(path == "" or Path(path).is_dir() for path, _ in manifest.values())

    routes = features(f"{out}/routes.geojson", "都バス")
    assert routes[0]["properties"]["route_name"] == "7"
    assert {f["geometry"]["type"] for f in routes} == {"LineString"} and len(routes) == 3
    names = {f["properties"]["stop_name"] for f in features(f"{out}/stops.geojson", "都バス")}
    assert names == {"中央駅", "中央駅1番", 'Quote "x", comma', "Lone"}
    assert "中央駅" in next(Path(out, "stops.geojson", "feed_dir=都バス").glob("*.txt")).read_text(encoding="utf-8")

    (path,) = features(f"{out}/aggregated_routes.geojson", "都バス")
    assert path["properties"] == {
        "feed_id": "f",
        "from_similar_stop_id": "S",
        "from_similar_stop_name": "中央駅",
        "to_similar_stop_id": "b1",
        "to_similar_stop_name": 'Quote "x", comma',
        "frequency": 2,
        "line_width": pytest.approx(0.05 + 2**0.6 * 0.2),
    }
    assert path["geometry"] == {"type": "LineString", "coordinates": [[139.0, 35.0], [139.10005, 35.10005]]}
    stops = {f["properties"]["similar_stop_id"]: f for f in features(f"{out}/aggregated_stops.geojson", "都バス")}
    assert {k: f["properties"]["count"] for k, f in stops.items()} == {"S": 2, "b1": 2}
    assert features(f"{out}/aggregated_routes.geojson", "quiet") == []

    (table,) = Path(out, "result.csv", "feed_dir=都バス").glob("*.csv")
    with open(table, encoding="utf-8", newline="") as file:
        rows = {r["stop_id"]: r for r in csv.DictReader(file)}
    assert rows["S1"]["similar_stop_id"] == "S" and rows["b2"]["similar_stop_name"] == 'Quote "x", comma'
    back = outputs.read_relations_csv(spark, f"{out}/result.csv")
    assert back.where("feed_id = 'f' and rule = 'near'").count() == 2

    # again, simple outputs only: the folders are replaced and the others stay
    again = extract(tables, feeds, out, Options(ignore_no_route=True)).collect()
    assert {(r.feed_id, r.output): r.n_rows for r in again}["f", "stops"] == 4
    assert {r.output for r in again if r.path == "" and r.feed_id == "f"} == {"aggregated_routes", "aggregated_stops", "aggregated_csv"}
    assert len(features(f"{out}/stops.geojson", "都バス")) == 4


def test_filters_of_the_aggregation(tables):
    def paths(**options):
        rows = Aggregator(tables, **options).read_route_frequency().where("feed_id = 'f'").collect()
        return {(r.from_similar_stop_id, r.to_similar_stop_id): r.frequency for r in rows}

    assert paths() == {("S", "b1"): 2, ("b1", "S"): 1}
    assert paths(no_unify_stops=True) == {("S1", "b1"): 1, ("S1", "b2"): 1, ("b1", "S"): 1}
    assert paths(yyyymmdd="20240505") == {("b1", "S"): 1}
    assert paths(begin_time="000000", end_time="260000") == {("S", "b1"): 1, ("b1", "S"): 1}
    assert paths(begin_time="260000", end_time="270000") == {("S", "b1"): 1}


def test_options(spark):
    assert Options(use_delimiter=True).delimiter_text() == "_"
    assert Options(use_delimiter=True, unify=False).delimiter_text() == ""
    assert Options().delimiter_text() == ""
    assert Options(filter_by_date=True, day=datetime.date(2024, 5, 6)).yyyymmdd() == "20240506"
    assert Options(filter_by_date=False, day=datetime.date(2024, 5, 6)).yyyymmdd() == ""
    assert Options().yyyymmdd() == datetime.date.today().strftime("%Y%m%d")
    assert Options().time_texts(spark) == ("", "")
    assert Options(filter_by_time=True).time_texts(spark) == ("000000", "270000")
    assert Options(filter_by_time=True, begin_time="8", end_time="99:99:99").time_texts(spark) == ("290000", "295959")
    with pytest.raises(ValueError):
        Options(simple=False)


def stops_of(spark, rows):
    return spark.createDataFrame(rows, "feed_id string, stop_id string, stop_name string, lon double, lat double")


def test_files_follow_volume(spark, tmp_path):
    """A thousand feeds from fifty tasks, one of them with most of the rows."""
    stops = spark.range(0, 30_000, 1, 50).selectExpr(
        "if(id < 20000, 'big', 'f' || id % 1000) as feed_id", "cast(id as string) as stop_id", "'n' as stop_name",
        "if(id = 3, null, double(id)) as lon", "double(1) as lat",
    )
    feeds = durable(stops.selectExpr("feed_id", "if(feed_id = 'f1', 'd:1', feed_id) as feed_dir").distinct(), "feeds")
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "50",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        geojson.write_features(geojson.stop_feature_rows(stops), feeds, str(tmp_path / "o"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [len(list(f.glob("*.txt"))) for f in (tmp_path / "o").iterdir() if f.is_dir()]
    assert len(files) == 1001 and sum(files) < 1100
    assert len(list((tmp_path / "o" / "feed_dir=big").glob("*.txt"))) > 3
    back = outputs.read_geojson(spark, str(tmp_path / "o"))
    assert back.select(F.col("properties")["stop_id"]).distinct().count() == 30_000
    assert {"big", "d:1"} <= {r.feed_dir for r in back.select("feed_dir").distinct().collect()}
    assert back.where("coordinates is null").select(F.col("properties")["stop_id"].alias("s")).first().s == "3"


def test_collections_of_any_size(spark, tmp_path, monkeypatch):
    from tramline.sinks import documents
    from tramline.sources import files, json_arrays

    monkeypatch.setattr(documents, "by_volume", lambda rows, by: rows.repartition(7))  # many parts of each feed
    monkeypatch.setattr(json_arrays, "BLOCK_BYTES", 100)
    monkeypatch.setattr(files, "COPIED", 50)
    feeds = spark.createDataFrame([("a", "a:1"), ("one", "one"), ("none", "都 x")], "feed_id string, feed_dir string")
    names = ['say "hi"', "back\\slash\\", "[{,}]", "駅"]
    rows = stops_of(spark, [("a", str(i), names[i % 4], 1.0, None if i == 5 else 2.0) for i in range(900)] + [("one", "x", "n", 1.0, 2.0)])
    geojson.write_collections(geojson.stop_feature_rows(rows), feeds, str(tmp_path / "o"))
    read = {f.parent.name: json.loads(f.read_text(encoding="utf-8")) for f in (tmp_path / "o").glob("*/*")}
    assert {k: len(v["features"]) for k, v in read.items()} == {"feed_dir=a%3A1": 900, "feed_dir=one": 1, "feed_dir=都 x": 0}
    assert all(v["type"] == "FeatureCollection" for v in read.values())
    back = outputs.read_collections(spark, str(tmp_path / "o")).select("feed_dir", F.col("properties")["stop_name"].alias("n")).collect()
    assert len(back) == 901 and {r.n for r in back} == {*names, "n"} and {r.feed_dir for r in back} == {"a%3A1", "one"}


def test_a_run_that_fails_leaves_the_earlier_outputs(spark, tables, tmp_path, monkeypatch):
    from tramline.plans import extraction
    from tramline.sinks import publishing

    feeds = spark.createDataFrame([("f", "f"), ("quiet", "quiet")], "feed_id string, dir string")
    out, options = tmp_path / "out", Options(aggregate=True, filter_by_date=False)

    def state():
        return {str(f.relative_to(out)): f.read_bytes() for f in out.rglob("*") if f.is_file() and not f.name.endswith(".crc")}

    extract(tables, feeds, str(out), options)
    before = state()
    smaller = FeedTables(**{**vars(tables), "stops": tables.stops.where("stop_id <> 'lone'")})
    with monkeypatch.context() as patch:  # while the last output is written
        patch.setattr(extraction, "write_relations_csv", lambda *_: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            extract(smaller, feeds, str(out), options)
    assert state() == before and not list(out.glob(".staging*"))

    with monkeypatch.context() as patch:  # while folders are put in place
        real, calls = publishing.file_system, []

        class Failing:
            def __init__(self, system):
                self.system = system

            def __getattr__(self, name):
                return getattr(self.system, name)

            def rename(self, source, target):
                calls.append(source)
                return len(calls) < 3 and self.system.rename(source, target)

        patch.setattr(publishing, "file_system", lambda *a: (Failing(real(*a)[0]), real(*a)[1]))
        patch.setattr(publishing, "THREADS", 1)
        with pytest.raises(OSError):
            extract(smaller, feeds, str(out), options)
    assert list(out.glob(".staging*"))
    publishing.finish(spark, str(out))
    assert not list(out.glob(".staging*"))
    assert len(features(f"{out}/stops.geojson", "f")) == 4 and len(features(f"{out}/aggregated_routes.geojson", "f")) == 2
    kept = {(r.feed_id, r.output): r.n_rows for r in spark.read.parquet(f"{out}/manifest").collect()}
    assert kept["f", "stops"] == 4 and kept["f", "aggregated_csv"] == 4
    publishing.finish(spark, str(out))  # nothing left to do


def test_a_feed_that_lost_its_rows_leaves_no_old_files(spark, tables, tmp_path):
    feeds = spark.createDataFrame([("f", "d:1")], "feed_id string, dir string")
    out, options = str(tmp_path / "out"), Options(aggregate=True, filter_by_date=False)
    first = {r.output: r for r in extract(tables, feeds, out, options).collect()}
    assert first["aggregated_csv"].path.endswith("feed_dir=d%3A1") and Path(first["aggregated_csv"].path).is_dir()
    nothing = FeedTables(**{**vars(tables), "stops": tables.stops.limit(0)})
    again = {r.output: r for r in extract(nothing, feeds, out, options).collect()}
    assert (again["aggregated_csv"].path, again["aggregated_csv"].n_rows) == ("", 0)
    assert not Path(first["aggregated_csv"].path).exists() and not Path(first["stops"].path).exists()


def test_stops_without_a_position_stay(spark, tables):
    lost = FeedTables(**{**vars(tables), "stops": tables.stops.withColumn(
        "stop_lat", F.when(F.col("stop_id").isin("b1", "b2"), None).otherwise(F.col("stop_lat")))})
    work = Aggregator(lost)
    assert work.read_route_frequency().where("feed_id = 'f'").count() == 3
    features = [json.loads(r.feature) for r in geojson.path_feature_rows(work.read_route_frequency()).collect()]
    assert all(f["geometry"] is None for f in features)
    assert {r.similar_stop_id for r in work.read_interpolated_stops().where("feed_id = 'f'").collect()} == {"S", "b1", "b2"}


def test_an_empty_relation_table_is_no_error(spark, tmp_path):
    empty = spark.createDataFrame([], "feed_dir string, " + outputs.RELATION_SCHEMA.simpleString()[7:-1].replace(":", " "))
    write_relations_csv(empty, str(tmp_path / "r"))
    assert not list((tmp_path / "r").glob("**/*.csv"))


def test_styles(spark):
    paths = spark.createDataFrame([(1,), (32,)], "frequency long")
    widths = [r.line_width for r in styling.path_style(paths).orderBy("frequency").collect()]
    assert widths == pytest.approx([0.25, 0.05 + 32**0.6 * 0.2])
    stops = spark.createDataFrame([(1,), (16,)], "count long")
    assert [r.symbol_size for r in styling.stop_style(stops, scale=True).orderBy("count").collect()] == pytest.approx(
        [1.0, 1.6]
    )
    assert {r.symbol_size for r in styling.stop_style(stops).collect()} == {1.0}
    names = spark.createDataFrame([("a", f"route {i % 40}") for i in range(200)], "feed_id string, route_name string")
    colors = styling.route_categories(names).collect()
    assert len(colors) == 40 and len({c.color for c in colors}) > 5
    assert {(c.route_name, c.color) for c in colors} == {
        (c.route_name, c.color) for c in styling.route_categories(names.repartition(7)).collect()
    }
