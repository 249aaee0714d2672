import math
import random

import pytest

from pyspark.sql import functions as F

from tramline.operators import near, unify
from tramline.operators.components import connected_components

SCHEMA = (
    "feed_id string, stop_id string, stop_name string, stop_lon double, stop_lat double, parent_station string"
)


def stops_of(spark, rows):
    """rows: (stop_id, name, lon, lat, parent), feed 'a'; or with the feed in front"""
    return spark.createDataFrame([r if len(r) == 6 else ("a", *r) for r in rows], SCHEMA)


def relation_of(df, **options):
    rows = unify.unify_stops(df, **options).collect()
    found = {(r.feed_id, r.stop_id): (r.similar_stop_id, r.rule) for r in rows}
    assert len(found) == len(rows) == df.count()
    for (feed, _), (similar, _) in found.items():
        assert found[feed, similar][0] == similar, "a representative stands for itself"
    return {stop if feed == "a" else (feed, stop): value for (feed, stop), value in found.items()}


def test_parent_rule(spark):
    df = stops_of(
        spark,
        [
            ("P", "Station", 0.0, 0.0, None),
            ("p1", "Platform 1", 0.0, 0.0, "P"),
            ("p2", "Platform 2", 0.0, 0.0, "P"),
            ("area", "Boarding area", 0.0, 0.0, "p1"),
            ("lost", "Lost", 5.0, 5.0, "gone"),
            ("empty", "Empty", 6.0, 6.0, ""),
            ("b", "p1", "Other feed", 0.0, 0.0, None),
        ],
    )
    assert relation_of(df) == {
        "P": ("P", "parent"),
        "p1": ("P", "parent"),
        "p2": ("P", "parent"),
        "area": ("P", "parent"),
        "lost": ("lost", "none"),
        "empty": ("empty", "none"),
        ("b", "p1"): ("p1", "none"),
    }


def test_prefix_rule(spark):
    df = stops_of(
        spark,
        [
            ("9_2", "n", 0.0, 0.0, None),
            ("9_10", "m", 1.0, 0.0, None),
            ("9_10_1", "o", 2.0, 0.0, None),
            ("9_10_2", "o", 3.0, 0.0, None),
            ("8_1", "q", 4.0, 0.0, None),
            ("plain", "r", 5.0, 0.0, None),
            ("_x", "s", 6.0, 0.0, None),
            ("_y", "t", 7.0, 0.0, None),
        ],
    )
    assert relation_of(df, delimiter="_") == {
        "9_2": ("9_10", "prefix"),
        "9_10": ("9_10", "prefix"),
        "9_10_1": ("9_10_1", "prefix"),
        "9_10_2": ("9_10_1", "prefix"),
        "8_1": ("8_1", "none"),
        "plain": ("plain", "none"),
        "_x": ("_x", "none"),
        "_y": ("_y", "none"),
    }
    assert {rule for _, rule in relation_of(df).values()} == {"none"}


@pytest.mark.parametrize(
    "stop_id, delimiter, prefix",
    [("a_b_c", "_", "a_b"), ("a::b", "::", "a"), ("ab", "_", None), ("_b", "_", None), ("a.b", ".", "a"), ("a_", "_", "a")],
)
def test_id_prefix(spark, stop_id, delimiter, prefix):
    from pyspark.sql import functions as F

    assert spark.range(1).select(unify.id_prefix(F.lit(stop_id), delimiter).alias("p")).first().p == prefix


def test_near_rule(spark):
    df = stops_of(
        spark,
        [
            ("c2", "Chain", 0.0020, 0.0, None),
            ("c1", "Chain", 0.0, 0.0, None),
            ("c3", "Chain", 0.0045, 0.0, None),
            ("far", "Chain", 0.1, 0.0, None),
            ("other", "Other", 0.0, 0.0, None),
            ("no_name_1", None, 0.0, 0.0, None),
            ("no_name_2", None, 0.0, 0.0, None),
            ("no_place", "Chain", None, None, None),
            ("b", "c0", "Chain", 0.0, 0.0, None),
        ],
    )
    got = relation_of(df)
    assert got["c1"] == got["c2"] == got["c3"] == ("c1", "near")
    for alone in ("far", "other", "no_name_1", "no_name_2", "no_place"):
        assert got[alone] == (alone, "none")
    assert got["b", "c0"] == ("c0", "none")


def test_smaller_rule_wins(spark):
    df = stops_of(
        spark,
        [
            ("S", "Name", 0.0, 0.0, None),
            ("x_1", "Name", 0.0, 0.0, "S"),
            ("x_2", "Name", 0.0, 0.0, None),
            ("x_3", "Name", 0.0, 0.0, None),
            ("y1", "Name", 0.0, 0.0, None),
            ("y2", "Name", 0.0, 0.0, None),
        ],
    )
    assert relation_of(df, delimiter="_") == {
        "S": ("S", "parent"),
        "x_1": ("S", "parent"),
        "x_2": ("x_2", "prefix"),
        "x_3": ("x_2", "prefix"),
        "y1": ("y1", "near"),
        "y2": ("y1", "near"),
    }


def test_unify_off(spark):
    df = stops_of(spark, [("P", "n", 0.0, 0.0, None), ("p", "n", 0.0, 0.0, "P")])
    assert relation_of(df, unify=False) == {"P": ("P", "none"), "p": ("p", "none")}


def brute_force_groups(points):
    """points: {id: (name, x, y)} -> {id: smallest id of its group} for groups of two or more"""
    group = {i: i for i in points}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (name, x, y) in points.items():
        for j, (other, u, v) in points.items():
            if i < j and name == other and (x - u) * (x - u) + (y - v) * (y - v) <= near.RADIUS * near.RADIUS:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    roots = {i: root(i) for i in points}
    return {i: r for i, r in roots.items() if list(roots.values()).count(r) > 1}


@pytest.mark.parametrize("seed", range(3))
def test_near_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    points = {}
    for name, count, spread in (("busy", 150, 0.03), ("thin", 60, 0.05), ("pair", 2, 0.002)):
        for _ in range(count):
            points[f"s{len(points):04d}"] = (name, 139 + rng.random() * spread, 35 - rng.random() * spread)
    df = stops_of(spark, [(i, n, x, y, None) for i, (n, x, y) in points.items()])
    got = {r.stop_id: r.similar_stop_id for r in near.near_groups(df).collect()}
    assert got == brute_force_groups(points)


@pytest.mark.parametrize("gap", [0.0030001, 0.0029999])
def test_crowded_cells_are_decided_by_halving(spark, gap):
    """Two dense arcs whose distance is just above or below the radius: boxes alone cannot tell."""
    rng = random.Random(11)
    points = {}
    for k in range(120):
        angle = math.radians(rng.uniform(-20, 20))
        points[f"l{k:03d}"] = ("crowd", 0.0005 * math.cos(angle), 0.001 + 0.0005 * math.sin(angle))
        points[f"r{k:03d}"] = ("crowd", 0.0005 + gap + 0.0004 * (1 - math.cos(angle)), 0.001 + 0.0004 * math.sin(angle))
    points["l999"] = ("crowd", 0.0005, 0.001)
    points["r999"] = ("crowd", 0.0005 + gap, 0.001)
    df = stops_of(spark, [(i, n, x, y, None) for i, (n, x, y) in points.items()])
    got = {r.stop_id: r.similar_stop_id for r in near.near_groups(df).collect()}
    want = brute_force_groups(points)
    assert got == want
    assert len(set(want.values())) == (2 if gap > near.RADIUS else 1)


def test_a_thousand_copies_of_a_place_give_no_pairs_beyond_one_per_stop(spark):
    rows = [(f"s{i:04d}", "same", 0.0, 0.0, None) for i in range(1000)]
    pairs = near.near_group_links(stops_of(spark, rows))
    assert pairs.count() == 999
    assert pairs.where("stop_id_a = 's0000' and link = 'same_cell'").count() == 999


def test_every_link_is_a_near_pair(spark):
    rng = random.Random(11)
    points = {f"p{i:03d}": (rng.uniform(0, 0.02), rng.uniform(0, 0.02)) for i in range(150)}
    links = near.near_group_links(stops_of(spark, [(i, "n", x, y, None) for i, (x, y) in points.items()])).collect()
    assert any(r.link == "linked_cells" for r in links)
    for r in links:
        (ax, ay), (bx, by) = points[r.stop_id_a], points[r.stop_id_b]
        assert (ax - bx) ** 2 + (ay - by) ** 2 <= near.RADIUS**2


def test_nested_parents_and_circles(spark):
    rows = [("a", "n", 0.0, 0.0, "b"), ("b", "n", 0.0, 0.0, "c"), ("c", "n", 0.0, 0.0, "d"), ("d", "n", 0.0, 0.0, "e"),
            ("e", "n", 0.0, 0.0, None), ("x", "n", 0.0, 0.0, "y"), ("y", "n", 0.0, 0.0, "x"), ("z", "n", 0.0, 0.0, "gone")]
    got = {r.stop_id: r.similar_stop_id for r in unify.parent_matches(stops_of(spark, rows)).collect()}
    assert got == {s: "e" for s in "abcde"}


def test_circles_end_the_search_for_tops_at_once(spark, monkeypatch):
    written, real = [], unify.durable_counted
    monkeypatch.setattr(unify, "durable_counted", lambda *a, **k: written.append(1) or real(*a, **k))
    circle = [(f"c{i}", "n", 0.0, 0.0, f"c{(i + 1) % 4}") for i in range(4)] + [("tail", "n", 0.0, 0.0, "c0")]
    assert unify.parent_matches(stops_of(spark, circle)).collect() == [] and len(written) <= 2
    written.clear()
    chain = [(f"k{i}", "n", 0.0, 0.0, f"k{i + 1}" if i < 100 else None) for i in range(101)]
    got = {r.stop_id: r.similar_stop_id for r in unify.parent_matches(stops_of(spark, circle + chain)).collect()}
    assert got == {f"k{i}": "k100" for i in range(101)} and len(written) <= 9


def test_edges_of_a_hub_stay_in_many_tasks(spark, monkeypatch):
    from tramline.operators import components

    monkeypatch.setattr(components, "HUB", 1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.range(1, 40_001, 1, 8).selectExpr("id as a", "cast(0 as long) as b")
        around = edges.groupBy("b").agg(F.min("a").alias("smallest"), F.count("*").alias("n")).withColumnRenamed("b", "a")
        turned = edges.selectExpr("b as a", "a as other")
        met = components._with_smallest(turned, around, 40_000)
        rows = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 40_000 and max(rows) <= 2 * 40_000 / 8
        more = edges.unionByName(spark.createDataFrame([(50_001, 50_000), (50_002, 50_001), (40_000, 50_002)], "a long, b long"))
        found = connected_components(more)
        assert found.where("component = 0").count() == found.count() == 40_004
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_components_of_no_edges_and_loops(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    tangle = [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(50)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in chain + star + tangle]
    rng.shuffle(edges)
    group = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows)
    loops_only = {n for n in group if n not in got}
    assert all(all(n not in e or e[0] == e[1] for e in edges) for n in loops_only)
    assert got == {n: c for n, c in group.items() if n not in loops_only}


def test_unified_positions_and_names(spark):
    df = stops_of(
        spark,
        [
            ("P", "Station", 1.5, -1.5, None),
            ("p1", "Platform", 9.0, 9.0, "P"),
            ("n1", "Near", 0.0, -0.001, None),
            ("n2", "Near", 0.001, -0.002, None),
            ("n3", "Near", 0.001, -0.002, None),
            ("solo", "Solo", -7.1234567, 3.0, None),
        ],
    )
    relation = unify.unify_stops(df)
    got = {r.similar_stop_id: (r.similar_stop_name, r.lon, r.lat) for r in unify.unified_stops(relation, df).collect()}
    assert got == {
        "P": ("Station", 1.5, -1.5),
        "n1": ("Near", 0.000667, -0.001667),
        "solo": ("Solo", -7.123457, 3.0),
    }
    rows = unify.stop_relations(relation, df).collect()
    assert {(r.stop_id, r.stop_name, r.similar_stop_id, r.similar_stop_name) for r in rows} >= {
        ("p1", "Platform", "P", "Station"),
        ("n3", "Near", "n1", "Near"),
    }


def test_repeated_stop_rows_count_once(spark):
    df = stops_of(spark, [("x", "n", 0.0, 0.0, None)] * 5 + [("x", "m", 0.0, 0.0, None)])
    assert [tuple(r)[1:3] for r in unify.one_row_per_stop(df).collect()] == [("x", "m")]


def test_cells_meet_across_tiles_in_few_rows(spark, monkeypatch):
    """Crowded cells around zero and tile borders, against all pairs; no cell is dealt to as many keys as it has neighbours."""
    rng = random.Random(9)
    points = [(rng.uniform(-0.04, 0.04), rng.uniform(-0.04, 0.04)) for _ in range(400)]
    points += [(0.0, 0.0), (0.002, 0.0), (0.016, 0.016), (0.0159, 0.0175), (-0.0001, -0.0001)]
    rows = [(f"s{i:03}", rng.choice("nm"), x, y, None) for i, (x, y) in enumerate(points)]
    kept = []
    monkeypatch.setattr(near, "durable", lambda df, name, f=near.durable: kept.append((name, df)) or f(df, name))
    got = {r.stop_id: r.similar_stop_id for r in near.near_groups(stops_of(spark, rows)).collect()}
    leader = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= near.RADIUS**2 and leader[a[0]] > leader[b[0]]:
                    leader[a[0]], changed = leader[b[0]], True
    members = [s for s in leader if list(leader.values()).count(leader[s]) > 1]
    assert got == {s: leader[s] for s in members}
    plan = next(df for name, df in kept if name == "cell-pairs")._jdf.queryExecution().optimizedPlan().toString()
    assert "tile_x" in plan and plan.count("struct(dx") == 0
