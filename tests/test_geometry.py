import random

from pyspark.sql import functions as F

from tramline.operators import geometry, spans

CALLS = "feed_id string, trip_id string, stop_id string, stop_sequence int, departure_secs int"


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def feed(spark):
    stops = frame(
        spark,
        "feed_id string, stop_id string, stop_name string, stop_lon double, stop_lat double",
        [("a", s, f"stop {s}", float(i), float(-i)) for i, s in enumerate("ABCD")] + [("a", "nowhere", "x", None, None)],
    )
    routes = frame(
        spark,
        "feed_id string, route_id string, route_short_name string, route_long_name string",
        [("a", "r1", "Short", "Long"), ("a", "r2", "", "Long 2"), ("a", "r3", None, " ")],
    )
    trips = frame(
        spark,
        "feed_id string, trip_id string, route_id string, shape_id string",
        [
            ("a", "t1", "r1", "s1"),
            ("a", "t2", "r1", "s1"),
            ("a", "t3", "r1", None),
            ("a", "t4", "r2", "gone"),
            ("a", "t5", "r3", "s2"),
        ],
    )
    calls = {"t1": "ABC", "t2": "ABC", "t3": "CB", "t4": ["A", "nowhere", "D"], "t5": "A"}
    stop_times = frame(
        spark, CALLS, [("a", t, s, i + 1, 0) for t, stops_ in calls.items() for i, s in enumerate(stops_)]
    )
    shapes = frame(
        spark,
        "feed_id string, shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
        [("a", "s1", 1.0, 9.0, 20), ("a", "s1", 0.0, 8.0, 3), ("a", "s2", 5.0, 5.0, 1)],
    )
    return shapes, stop_times, trips, routes, stops


def drawn(df):
    lines = {}
    for r in df.collect():
        lines.setdefault(r.route_name, []).append([list(p) for p in r.coordinates])
    return {name: sorted(many) for name, many in lines.items()}


def test_routes_from_stops(spark):
    _, stop_times, trips, routes, stops = feed(spark)
    assert drawn(geometry.routes_from_stops(stop_times, trips, routes, stops)) == {
        "Short": [[[0, 0], [1, -1], [2, -2]], [[2, -2], [1, -1]]],
        "Long 2": [[[0, 0], [3, -3]]],
    }


def test_routes_from_shapes_fall_back_to_stops(spark):
    shapes, stop_times, trips, routes, stops = feed(spark)
    assert drawn(geometry.read_routes(shapes, stop_times, trips, routes, stops)) == {
        "Short": [[[2, -2], [1, -1]], [[8, 0], [9, 1]]],
        "Long 2": [[[0, 0], [3, -3]]],
    }
    only_shaped = trips.where("trip_id in ('t1', 't2')")
    assert drawn(geometry.read_routes(shapes, stop_times, only_shaped, routes, stops)) == {"Short": [[[8, 0], [9, 1]]]}
    assert drawn(geometry.read_routes(shapes, stop_times, only_shaped, routes, stops, ignore_shapes=True)) == {
        "Short": [[[0, 0], [1, -1], [2, -2]]]
    }


SHAPES = "feed_id string, shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int"


def test_a_shape_is_one_line_whatever_its_numbers(spark, monkeypatch):
    sparse = [("a", "s", float(i), 0.0, i * 100_000) for i in range(5)]
    assert [len(r.line) for r in geometry.shape_lines(frame(spark, SHAPES, sparse)).collect()] == [5]
    rng = random.Random(4)
    numbers = sorted(rng.sample(range(3_000_000), 200))
    rows = [("a", "s", float(n), float(-n), n) for n in numbers] * 2 + [("a", "t", float(k), 1.0, 0) for k in range(150)]
    rng.shuffle(rows)
    for long in (65_536, 20):
        monkeypatch.setattr(spans, "LONG", long)
        lines = {r.shape_id: [p[1] for p in r.line] for r in geometry.shape_lines(frame(spark, SHAPES, rows)).collect()}
        assert lines == {"s": list(map(float, numbers)), "t": list(map(float, range(150)))}


def test_different_rows_of_one_number_spread_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "LONG", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # rows this few would share a task
    rows = frame(spark, SHAPES, [("a", "s", float(k), 1.0, 0) for k in range(4000)] + [("a", "t", 1.0, 1.0, 1)])
    pieces = spans.in_pieces(rows, ["feed_id", "shape_id"], "shape_pt_sequence", ["shape_pt_lat"]).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [len(p["items"]) for p in pieces if p.shape_id == "s"]
    assert sum(sizes) == 4000 and len(sizes) >= 3 and max(sizes) < 3000


def test_patterns_are_whole_whatever_their_numbers(spark, monkeypatch):
    stops = [f"s{i % 13}" for i in range(90)]
    rows = [("a", "t", s, i * 70_000, 0) for i, s in enumerate(stops)] + [("a", "u", s, i, 0) for i, s in enumerate(stops)]
    trips = frame(spark, "feed_id string, trip_id string, route_id string", [("a", "t", "r"), ("a", "u", "r")])
    for long in (65_536, 20):
        monkeypatch.setattr(spans, "LONG", long)
        patterns = geometry.stop_patterns(frame(spark, CALLS, rows), trips).collect()
        assert [r.pattern for r in patterns] == [stops]


def test_isolated_stops(spark):
    _, stop_times, _, _, stops = feed(spark)
    unserved = stops.unionByName(stops.limit(1).withColumn("stop_id", F.lit("Z")))
    every = {r.stop_id for r in geometry.read_stops(unserved, stop_times).collect()}
    served = {r.stop_id for r in geometry.read_stops(unserved, stop_times, ignore_no_route=True).collect()}
    assert every - served == {"Z"} and len(every) == 6
