"""How often the large tables are gone through."""

import re

from pyspark.sql import functions as F

from tramline.operators import geometry
from tramline.plans import checks, testdata
from tramline.plans.extraction import Aggregator

SMALLEST = "/root/testdata/sf0.001"


def noted(monkeypatch, module):
    """Names of the tables that `module` writes."""
    names, durable = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df, name, *rest: names.append(name) or durable(df, name, *rest))
    return names


def test_properties_of_all_outputs_come_from_one_staged_table(spark, monkeypatch):
    names = noted(monkeypatch, testdata)
    found = {r.output: r for r in checks.geojson_properties(spark, SMALLEST).collect()}
    assert names.count("stop-times") == 1
    assert sorted(found) == ["aggregated_routes", "aggregated_stops", "routes", "stops"]
    assert found["stops"].properties == "feed_id,stop_id,stop_name" and found["stops"].n_features == 210


def test_paths_meet_the_stops_in_two_joins(spark, capsys):
    tables = testdata.feed_tables(spark, SMALLEST)
    paths = Aggregator(tables, delimiter=checks.MIXED_DELIMITER).read_route_frequency()
    capsys.readouterr()
    paths.explain()
    assert len(re.findall(r"- \*?(?:\(\d+\) )?\w+Join ", capsys.readouterr().out)) == 2
    assert set(paths.columns) == {
        "feed_id", "frequency", *[f"{s}_{c}" for s in ("from", "to") for c in ("similar_stop_id", "similar_stop_name", "lon", "lat")]
    }


def test_trips_are_read_again_only_for_missing_shapes(spark, monkeypatch):
    names = noted(monkeypatch, geometry)
    trips = spark.createDataFrame([("f", "r", "t", "s"), ("f", "r", "u", "s")], "feed_id string, route_id string, trip_id string, shape_id string")
    routes = spark.createDataFrame([("f", "r", "1", "one")], "feed_id string, route_id string, route_short_name string, route_long_name string")
    shapes = spark.createDataFrame(
        [("f", "s", 1, 1.0, 2.0), ("f", "s", 2, 3.0, 4.0)],
        "feed_id string, shape_id string, shape_pt_sequence int, shape_pt_lon double, shape_pt_lat double",
    )
    stops = spark.createDataFrame([("f", x, float(i), 0.0) for i, x in enumerate("ab")], "feed_id string, stop_id string, stop_lon double, stop_lat double")
    calls = spark.createDataFrame(
        [("f", t, x, i) for t in "tuv" for i, x in enumerate("ab")], "feed_id string, trip_id string, stop_id string, stop_sequence int"
    )

    def lines(trips):
        found = geometry.routes_from_shapes(shapes, calls, trips, routes, stops)
        return sorted(str(r.coordinates) for r in found.collect())

    along, through = str([[1.0, 2.0], [3.0, 4.0]]), str([[0.0, 0.0], [1.0, 0.0]])
    assert lines(trips) == [along] and "shapeless" not in names
    # a shape that is not drawn, and none
    for shape in ("'x'", "cast(null as string)"):
        assert lines(trips.unionByName(trips.selectExpr("feed_id", "route_id", "'v' as trip_id", f"{shape} as shape_id"))) == sorted([along, through])
    assert "shapeless" in names


def test_ends_without_name_or_position_stay_apart(spark):
    schema = "feed_id string, similar_stop_id string, similar_stop_name string, lon double, lat double"
    unified = spark.createDataFrame([("f", "A", None, None, None), ("f", "B", "b", 1.0, None)], schema)
    relation = spark.createDataFrame(
        [("f", "a1", "A"), ("f", "a2", "A"), ("f", "b", "B"), ("f", "c", "C"), ("g", "a1", "B")], "feed_id string, stop_id string, similar_stop_id string"
    )
    segments = spark.createDataFrame(
        [("f", "a1", "b"), ("f", "a2", "b"), ("f", "a1", "a2"), ("f", "b", "c"), ("f", "b", "c"), ("f", "b", "gone"), ("g", "a1", "b")],
        "feed_id string, from_stop_id string, to_stop_id string",
    )
    paths = geometry.path_features(segments, relation, unified)
    got = {
        (r.from_similar_stop_id, r.from_similar_stop_name, r.from_lon, r.to_similar_stop_id, r.to_similar_stop_name, r.to_lon): r.frequency
        for r in paths.orderBy(F.col("frequency")).collect()
    }
    assert got == {("A", None, None, "B", "b", 1.0): 2, ("B", "b", 1.0, "C", None, None): 2}
