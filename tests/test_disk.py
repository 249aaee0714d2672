"""What a run leaves on disk besides its outputs."""

import os

import pytest
from pyspark.sql import functions as F

from tramline.plans import testdata
from tramline.plans.extraction import Options, extract
from tramline.session import durable, fresh_path, passing

SMALLEST = "/root/testdata/sf0.001"


def tables_of(spark):
    folder = os.path.dirname(fresh_path(spark, "x"))
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {name for name in files if "/shuffle_" in name and name.endswith(".data")}


@pytest.mark.parametrize("as_collections", [False, True])
def test_a_run_leaves_its_outputs_and_its_manifest(spark, tmp_path, as_collections):
    tables = testdata.feed_tables(spark, SMALLEST)
    feeds = spark.createDataFrame([("F", "one"), ("G", "none")], "feed_id string, dir string")
    before = tables_of(spark)
    options = Options(aggregate=True, use_delimiter=True, ignore_shapes=True, filter_by_date=False, as_collections=as_collections)
    manifest = extract(tables, feeds, str(tmp_path / "out"), options)
    assert [name.rpartition("-")[0] for name in tables_of(spark) - before] == ["manifest"]
    rows = {(r.feed_id, r.output): r.n_rows for r in manifest.collect()}
    assert len(rows) == 10 and all((n > 0) == (feed == "F") for (feed, _), n in rows.items())


def test_tables_inside_a_scope_are_removed_but_for_those_kept(spark):
    before = tables_of(spark)
    with passing() as keep:
        with passing() as keep_inner:
            durable(spark.range(3), "gone")
            two = keep_inner(durable(spark.range(3), "two"))
        assert {n[:3] for n in tables_of(spark) - before} == {"two"} and two.count() == 3
        three = keep(durable(two.select(F.col("id") + 1), "three"))
    assert {n[:5] for n in tables_of(spark) - before} == {"three"} and three.count() == 3
    with pytest.raises(ZeroDivisionError), passing():
        durable(spark.range(3), "failed")
        1 / 0
    assert {n[:5] for n in tables_of(spark) - before} == {"three"}


def test_a_written_table_leaves_no_shuffle_files(spark):
    dealt = spark.range(1000).repartition(3)
    before = shuffle_files(spark)
    assert durable(dealt, "dealt").count() == 1000
    assert not {name for name in shuffle_files(spark) - before if os.path.getsize(name) > 1000}  # those of the count are small
    dealt.write.format("noop").mode("overwrite").save()  # the setting holds for the write alone
    assert {name for name in shuffle_files(spark) - before if os.path.getsize(name) > 1000}


def documents_of(folder):
    return {f.parent.name: f.read_text() for f in folder.glob("*/*") if not f.name.startswith(".")}


def test_documents_of_many_groups_in_one_task(spark, tmp_path):
    from tramline.sinks import documents

    rows = spark.range(300).selectExpr("'g' || id % 100 as place", "'{\"n\": ' || id || '}' as value")
    groups = spark.range(101).selectExpr("'g' || id as place")
    folder = F.concat(F.lit("place="), F.col("place"))
    documents.write_documents(rows, groups, str(tmp_path / "o"), "place", "[", "]", "x.json", folder)
    found = documents_of(tmp_path / "o")
    assert len(found) == 101 and found["place=g100"] == "[]"
    assert sorted(eval(found["place=g7"].replace("\n", "")), key=lambda r: r["n"]) == [{"n": 7}, {"n": 107}, {"n": 207}]
    assert not [f for f in (tmp_path / "o").iterdir() if f.name.startswith(".")]


def test_an_attempt_that_comes_after_the_rename_is_done(tmp_path):
    from tramline.sources.files import put_file

    (tmp_path / "part").write_text("whole")
    for _ in range(2):
        put_file(str(tmp_path / "part"), str(tmp_path / "a" / "x.json"))
    assert (tmp_path / "a" / "x.json").read_text() == "whole"
    with pytest.raises(FileNotFoundError):
        put_file(str(tmp_path / "part"), str(tmp_path / "b" / "x.json"))


def test_parts_of_a_task_are_whole_documents_across_batches(tmp_path, monkeypatch):
    import pyarrow as pa

    from tramline.sinks import documents

    class Task:
        get = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})())

    monkeypatch.setattr(documents, "TaskContext", Task)
    rows = [("a", ",1\n"), ("a", ",2\n"), ("b", ",3\n"), ("b", ",4\n"), ("c", ",5\n")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 3])], ["folder", "line"]).slice(0) for i in (0, 3)]
    [found] = documents._write_parts(batches, str(tmp_path), b"[", b"]")
    assert {r["folder"]: open(r["part"]).read() for r in found.to_pylist()} == {"a": "[1\n,2\n]", "b": "[3\n,4\n]", "c": "[5\n]"}
    documents._join(str(tmp_path / "all.json"), [r["part"] for r in found.to_pylist()], "[", "]")
    assert (tmp_path / "all.json").read_text() == "[1\n,2\n,3\n,4\n,5\n]"
