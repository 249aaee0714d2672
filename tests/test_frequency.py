import random
from collections import Counter

from pyspark.sql import functions as F

from tramline.operators import frequency, spans
from tramline.operators.unify import identity_relation

SCHEMA = "feed_id string, trip_id string, stop_id string, stop_sequence int, departure_secs int"


def stop_times(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def segments(df, **kwargs):
    return sorted(
        (r.feed_id, r.trip_id, r.stop_sequence, r.from_stop_id, r.to_stop_id, r.departure_secs)
        for r in frequency.trip_segments(df, **kwargs).collect()
    )


def test_order_comes_from_the_sequence_and_feeds_are_apart(spark):
    df = stop_times(
        spark,
        [
            ("a", "t", "C", 30, 300),
            ("a", "t", "A", 5, 100),
            ("a", "t", "B", 10, None),
            ("b", "t", "X", 1, 1),
            ("b", "t", "Y", 2, 2),
            ("a", "single", "A", 1, 1),
        ],
    )
    assert segments(df) == [
        ("a", "t", 5, "A", "B", 100),
        ("a", "t", 10, "B", "C", None),
        ("b", "t", 1, "X", "Y", 1),
    ]


def test_copies_of_a_call_make_no_segment_and_ties_have_a_fixed_order(spark):
    rows = [("a", "t", "A", 1, 1)] * 50 + [("a", "t", "B", 2, 2)] * 3 + [("a", "t", "C", 3, 3), ("a", "t", "D", 3, 3)]
    random.Random(1).shuffle(rows)
    assert [s[3:5] for s in segments(stop_times(spark, rows))] == [("A", "B"), ("B", "C"), ("C", "D")]


def test_rows_without_trip_stop_or_sequence_are_no_calls(spark):
    df = stop_times(
        spark,
        [
            ("a", "t", "A", 1, 1),
            ("a", "t", None, 2, 2),
            ("a", "t", "B", None, 3),
            ("a", None, "C", 4, 4),
            ("a", "t", "D", 5, 5),
        ],
    )
    assert segments(df) == [("a", "t", 1, "A", "D", 1)]


def test_long_trips_cut_into_pieces_lose_nothing(spark, monkeypatch):
    """One trip with most of the rows, gaps and negative numbers, against a plain loop."""
    rng = random.Random(7)
    rows = []
    for trip, count, reach in (("hot", 900, 5000), ("far", 3, 10**6), ("one", 1, 10), ("low", 6, 9)):
        for number in rng.sample(range(-reach, reach), count):
            rows.append(("a", trip, f"s{rng.randrange(20)}", number, number))
    want = []
    for trip in {r[1] for r in rows}:
        calls = sorted((r[3], r[2]) for r in rows if r[1] == trip)
        want += [("a", trip, p[0], p[1], q[1], p[0]) for p, q in zip(calls, calls[1:])]
    df = stop_times(spark, rows)
    for long in (4, 64, 65_536):
        monkeypatch.setattr(spans, "LONG", long)
        assert segments(df) == sorted(want)


def test_path_frequency_is_directed_and_drops_paths_within_a_unified_stop(spark):
    df = stop_times(
        spark,
        [
            ("a", trip, stop, i, i)
            for trip, stops in {"1": "ABC", "2": "ABC", "3": "CBA", "4": "AB"}.items()
            for i, stop in enumerate(stops)
        ],
    )
    relation = spark.createDataFrame(
        [("a", "A", "A"), ("a", "B", "B"), ("a", "C", "B")], "feed_id string, stop_id string, similar_stop_id string"
    )
    got = {tuple(r)[1:] for r in frequency.path_frequency(frequency.trip_segments(df), relation).collect()}
    assert got == {("A", "B", 3), ("B", "A", 1)}


def test_total_frequency_is_the_number_of_steps(spark):
    rng = random.Random(3)
    trips = {str(t): [rng.choice("ABCDEFG") for _ in range(rng.randrange(1, 9))] for t in range(60)}
    df = stop_times(spark, [("a", t, s, i, i) for t, stops in trips.items() for i, s in enumerate(stops)])
    relation = identity_relation(spark.createDataFrame([("a", s) for s in "ABCDEFG"], "feed_id string, stop_id string"))
    paths = frequency.path_frequency(frequency.trip_segments(df), relation)
    want = Counter((p, q) for stops in trips.values() for p, q in zip(stops, stops[1:]) if p != q)
    assert {(r.from_similar_stop_id, r.to_similar_stop_id): r.frequency for r in paths.collect()} == want
    assert paths.agg(F.sum("frequency")).first()[0] == sum(want.values())


def test_windows_side_by_side_add_up(spark):
    from tramline.operators.service import departing_between

    rng = random.Random(5)
    df = stop_times(
        spark, [("a", str(t), rng.choice("ABCD"), i, rng.randrange(0, 100)) for t in range(40) for i in range(5)]
    )
    steps = frequency.trip_segments(df)
    whole = departing_between(steps, 0, 100).count()
    assert whole == departing_between(steps, 0, 37).count() + departing_between(steps, 37, 100).count()


def test_stop_counts(spark):
    df = stop_times(spark, [("a", "1", s, i, i) for i, s in enumerate("AABCCZ")])
    relation = spark.createDataFrame(
        [("a", "A", "A"), ("a", "B", "A"), ("a", "C", "C")], "feed_id string, stop_id string, similar_stop_id string"
    )
    got = {r.similar_stop_id: r["count"] for r in frequency.unified_stop_counts(df, relation).collect()}
    assert got == {"A": 3, "C": 2}


def test_copies_of_calls_and_ties_make_the_segments_of_their_sets(spark):
    """Copies anywhere, equal numbers, null times: as sorted sets of calls give."""
    rng = random.Random(11)
    rows = [("a", str(rng.randrange(6)), rng.choice("ABC"), rng.randrange(4), rng.choice([None, 1, 2])) for _ in range(150)]
    key = lambda r: (r[3], r[2], r[4] is not None, r[4] or 0)
    want = []
    for trip in {r[1] for r in rows}:
        calls = sorted({r for r in rows if r[1] == trip}, key=key)
        want += [("a", trip, p[2], p[3], q[2], p[4]) for p, q in zip(calls, calls[1:])]
    order = lambda s: sorted(s, key=str)
    df = stop_times(spark, rows).repartition(4)
    got = frequency.trip_segments(df).select("feed_id", "trip_id", "from_stop_id", "stop_sequence", "to_stop_id", "departure_secs")
    assert order(tuple(r) for r in got.collect()) == order(want)


def test_segments_need_no_sets_and_one_shuffle(spark, tmp_path):
    stop_times(spark, [("a", "1", s, i, i) for i, s in enumerate("ABC")]).write.parquet(str(tmp_path / "calls"))
    plan = frequency.trip_segments(spark.read.parquet(str(tmp_path / "calls")))._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and plan.count("Exchange") == 1


def test_long_trips_are_found_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(spans, "LONG", 10)
    for buckets in (1, 3, 65_536):
        monkeypatch.setattr(spans, "BUCKETS", buckets)
        df = spark.range(400).selectExpr("cast(id % 100 as string) as trip_id").unionByName(spark.range(11).selectExpr("'long' as trip_id"))
        found = spans._long_ones(df, ["trip_id"])
        assert [r.trip_id for r in found.collect()] == ["long"]
