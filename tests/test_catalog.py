import datetime
import json

import pytest
from pyspark.sql import functions as F

from tramline.fixed_values import CATALOG_COLUMNS, PREFECTURES, PRESET_FEEDS, ROUTE_COLORS
from tramline.functions.text import base_name, extent_numbers
from tramline.operators import catalog
from tramline.plans import catalogue_search
from tramline.sources import catalog_files


def entry(n, **more):
    return {
        "organization_id": f"o{n}",
        "organization_name": f"Org {n}",
        "feed_id": f"f{n}",
        "feed_name": ["beta", "Alpha", "alpha2", "GAMMA"][n % 4],
        "feed_pref_id": 1 + n,
        "file_uid": f"u{n}",
        "file_from_date": "2024-01-01",
        "file_to_date": "2024-06-30" if n % 2 else "2024-12-31",
        "file_url": f"https://example.org/{n}.zip",
        **more,
    }


@pytest.fixture
def entries(spark, tmp_path):
    responses = [{"body": [entry(0), entry(1)]}, {"message": "no body"}, {"body": []}, {"body": [entry(2), entry(12)]}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in responses), encoding="utf-8")
    return catalog_files.read_catalog(spark, str(tmp_path))


def test_sizes_of_the_fixed_tables():
    assert len(PREFECTURES) == len(set(PREFECTURES)) == 47
    assert (PREFECTURES[0], PREFECTURES[12], PREFECTURES[46]) == ("北海道", "東京都", "沖縄県")
    assert len(PRESET_FEEDS) == 17
    assert len(CATALOG_COLUMNS) == 21
    assert [shown for _, _, shown in CATALOG_COLUMNS].count(False) == 15
    assert len(ROUTE_COLORS) == 13


def test_scan_and_table(entries):
    table = catalog.catalog_table(catalog.add_pref_name(entries))
    assert table.columns == [column for column, _, _ in CATALOG_COLUMNS]
    rows = {r.feed_id: r for r in table.collect()}
    assert set(rows) == {"f0", "f1", "f2", "f12"}
    assert rows["f12"].pref == "東京都" and rows["f12"].feed_pref_id == "13"
    assert rows["f0"].organization == "Org 0" and rows["f0"].feed_url == ""
    assert catalog.catalog_visible(table).columns == ["organization", "feed", "pref", "from_date", "to_date", "license"]


def test_one_response_per_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"body": [entry(3)]}, indent=2), encoding="utf-8")
    assert catalog_files.read_catalog(spark, str(tmp_path), multi_line=True).first().feed_pref_id == 4


def test_a_text_that_is_no_json_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text("<html>", encoding="utf-8")
    with pytest.raises(Exception):
        catalog_files.read_catalog(spark, str(tmp_path)).collect()


def test_search(spark, entries):
    def found(*args, **kwargs):
        return {r.feed_id for r in catalog.catalog_search(entries, *args, **kwargs).collect()}

    assert found(datetime.date(2024, 6, 30)) == {"f0", "f1", "f2", "f12"}
    assert found(datetime.date(2024, 7, 1)) == {"f0", "f2", "f12"}
    assert found(datetime.date(2023, 12, 31)) == set()
    assert found(datetime.date(2024, 7, 1), pref=13) == {"f12"}
    stops = spark.createDataFrame(
        [("f0", 139.0, 35.0), ("f0", 100.0, 0.0), ("f2", 139.5, 35.5), ("f12", 139.51, 35.5)],
        "feed_id string, stop_lon double, stop_lat double",
    )
    box = "139.0,35.0 : 139.5,35.5"
    assert found(datetime.date(2024, 7, 1), extent=box, stops=stops) == {"f0", "f2"}
    assert found(datetime.date(2024, 7, 1), extent="", stops=stops) == {"f0", "f2", "f12"}
    with pytest.raises(ValueError):
        found(datetime.date(2024, 7, 1), extent=box)
    with pytest.raises(ValueError):
        found(datetime.date(2024, 7, 1), extent="1,2,3", stops=stops)


def test_prefecture_lookups(spark):
    codes = spark.createDataFrame([(1,), (48,), (None,)], "feed_pref_id int")
    lenient = {r.feed_pref_id: r.feed_pref for r in catalog.add_pref_name(codes, strict=False).collect()}
    assert lenient == {1: "北海道", 48: None, None: None}
    with pytest.raises(Exception, match="unknown prefecture code: 48"):
        catalog.add_pref_name(codes.where("feed_pref_id is not null")).collect()
    names = spark.createDataFrame([("沖縄県",), ("nowhere",)], "feed_pref string")
    assert {r.feed_pref: r.feed_pref_id for r in catalog.add_pref_code(names).collect()} == {"沖縄県": 47, "nowhere": None}
    assert (catalog.pref_code("北海道"), catalog.pref_code(None), catalog.pref_code("x")) == (1, None, None)


def test_sorting_ignores_case(entries):
    table = catalog.catalog_table(catalog.add_pref_name(entries))
    assert [r.feed for r in catalog.catalog_sorted(table, "feed").collect()] == ["Alpha", "alpha2", "beta", "beta"]
    assert [r.feed for r in catalog.catalog_sorted(table, "feed", ascending=False).collect()][0] == "beta"
    assert [r.feed_pref_id for r in catalog.catalog_sorted(table, "feed_pref_id").collect()] == ["1", "2", "3", "13"]
    assert catalog.catalog_sorted(table).count() == 4


def test_selection_to_manifest(spark, entries):
    table = catalogue_search.search(entries, datetime.date(2024, 7, 1))
    chosen = spark.createDataFrame(
        [("o0", "f0", "u0"), ("o2", "f2", "other")], "organization_id string, feed_id string, file_uid string"
    )
    rows = catalogue_search.feeds_to_process(table, chosen).collect()
    assert [tuple(r) for r in rows] == [
        ("o0-f0-u0", "https://example.org/0.zip", "Org 0-beta", "o0-f0-u0", "remote")
    ]


def test_presets(spark, tmp_path):
    built_in = catalog_files.with_label(catalog_files.builtin_presets(spark))
    assert built_in.where("label = '[USA][New York]Subway'").count() == 1
    rows = [dict(zip(("country", "region", "name", "url"), p)) for p in PRESET_FEEDS]
    (tmp_path / "presets.json").write_text(json.dumps(rows, ensure_ascii=False, indent=4), encoding="utf-8")
    read = catalog_files.read_presets(spark, str(tmp_path))
    assert sorted(map(tuple, read.collect())) == sorted(PRESET_FEEDS)
    infos = catalog.feed_manifest(catalog.preset_feed_infos(read))
    assert infos.where("source_kind = 'remote' and feed_id = group and group = dir").count() == 17


@pytest.mark.parametrize(
    "path, name", [("/data/bus.v1.zip", "bus"), ("plain", "plain"), ("/a.b/feed.zip", "feed"), ("/a/.zip", "")]
)
def test_base_name(spark, path, name):
    assert spark.range(1).select(base_name(F.lit(path)).alias("n")).first().n == name


def test_extent_numbers(spark):
    def box(text):
        return spark.range(1).select(extent_numbers(F.lit(text)).alias("b")).first().b

    assert tuple(box("1.5,-2 : 3,4")) == (1.5, -2.0, 3.0, 4.0)
    assert tuple(box("1,2,3,4")) == (1.0, 2.0, 3.0, 4.0)
    assert box("1,2,x,4") is None and box("1,2") is None
