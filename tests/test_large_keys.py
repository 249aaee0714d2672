"""Registered queries over tables whose keys are those of much larger ones."""

import datetime

import pytest

from tramline.plans.checks import QUERIES

FIRST = 7_200_000  # a part of this number lies at longitude 139 + 3,600


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("large-keys"))
    day = datetime.datetime(1997, 6, 3)
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "AFRICA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0)]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(0, "S0", 0)]),
        "part": ("p_partkey long, p_name string, p_brand string", [(FIRST + k, f"p{k}", "Brand#1") for k in (1, 2)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string", [(7, 1, day, "1-URGENT")]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp",
            [(7, FIRST + k, 0, k, 1.0, 1.0, day) for k in (1, 2)],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


# part 7,200,001: 139 + 3600 + 7200001 * 31 % 61 * 0.0007 and 35 + 7200001 * 17 % 59 * 0.0007; the other one alike
ONE, TWO = "3739.038500 35.023100", "3739.017500 35.035000"


def test_paths_between_positions_beyond_a_thousand(spark, large_keys):
    rows = QUERIES["geojson_aggregated_routes"](spark, large_keys).collect()
    assert [(r.from_similar_stop_id, r.to_similar_stop_id, r.frequency, r.line) for r in rows] == [
        (f"Brand#1_{FIRST + 1}", f"Brand#1_{FIRST + 2}", 1, f"{ONE},{TWO}")
    ]


@pytest.mark.parametrize("name", ["geojson_stops", "geojson_aggregated_stops", "stops_with_route", "unified_stops"])
def test_positions_beyond_a_thousand(spark, large_keys, name):
    found = {f"{r.lon} {r.lat}" for r in QUERIES[name](spark, large_keys).collect()}
    assert {ONE, TWO} <= found
