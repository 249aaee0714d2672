"""Every operator and pipeline stage on hard rows and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import (
    archives, decontamination, fingerprints, langid, licences, minhash, mixing, quality, sharding, toxicity,
)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


LABELS = [(1, 1, 0), (4, 0, 1), (5, 1, 0), (6, 0, 1), (9, None, None), (None, 1, 1), (4, 1, 0)]


def test_language(spark, hard, empty):
    got = langid.identify(hard, langid.train(hard)).collect()
    assert len(got) == hard.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, r)
    for doc_id in (1, 2, 3, 8, 12):
        assert (of[doc_id].lang_pred, of[doc_id].score, of[doc_id].rejected) == ("und", 0.0, True)
    assert of[4].lang_pred in {"en", "fr", "de", "ja"} and 0 <= of[4].score <= 1
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(hard, nothing).collect()} == {"und"}
    assert langid.identify(empty, nothing).count() == 0


def test_toxicity(spark, hard, empty):
    model = toxicity.train(hard, labels(spark, LABELS))
    assert toxicity.grade(hard, model).count() == hard.count()
    none = toxicity.train(empty, labels(spark))
    assert {r.toxic for r in toxicity.grade(hard, none).collect()} == {False}
    assert toxicity.grade(empty, none).count() == 0


def test_licences(spark, hard, empty):
    assert licences.scan(hard).count() == 0
    assert licences.scan(empty).count() == 0


def test_near_duplicates(hard, empty):
    got = minhash.near_duplicates(hard).collect()
    assert len(got) == hard.count()
    of = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert of[1] == of[1][:1] + (1, True) and of[1][0] == 0
    assert of[3] == (0, 3, True) and of[11] == (1, 4, False) and of[4] == (1, 4, True)
    assert of[6][1:] == (5, False) and of[7][1:] == (5, False)
    assert minhash.near_duplicates(empty).count() == 0


def test_quality(spark, hard, empty):
    model = quality.train(hard, labels(spark, LABELS))
    got = quality.score(hard, model).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.train(empty, labels(spark))
    assert {r.score for r in quality.score(hard, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0


def test_archives(spark):
    kind = "page_id long, url string, html string, payload string"
    rows = [(3, "http://a b", "x" * 100, "p"), (1, None, "x" * 100, "p"), (2, "u", "é" * 40, None), (4, "u", "é" * 40, None),
            (5, "", None, None), (6, "u", "", None), (None, "u", "x" * 100, None), (1, "u", "x" * 100, None),
            (7, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 10, None)]
    got = archives.convert_pages(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == len(rows) and not any(r.problem for r in got)
    found = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert found == sorted([(3, "revisit", 1, 100), (1, "response", None, 100), (1, "response", None, 100), (0, "revisit", 1, 100),
                            (2, "response", None, 80), (4, "response", None, 80), (5, "response", None, 0), (6, "response", None, 0),
                            (7, "response", None, 370)], key=lambda x: (x[0], x[1])) or found[0] == (0, "revisit", 1, 100)
    ids = {r.record_id for r in got if r.record_type == "response"}
    assert all(r.refers_to_id in ids for r in got if r.record_type == "revisit")
    assert archives.convert_pages(spark.createDataFrame([], kind)).count() == 0


def test_damaged_archives():
    block = b"1 0 x\nURL\n"
    whole = b"filedesc://x 0.0.0.0 20000101000000 text/plain %d\n%s\n" % (len(block), block)
    record = b"http://u 1.1.1.1 20000101000000 text/html 6\nh\r\n\r\np\n"
    got = list(archives.iter_arc(whole + record + record[:-4]))
    assert got[0]["payload"] == b"p" and got[1] == {"problem": "shorter than declared"}
    assert list(archives.iter_arc(record)) == [{"problem": "no version block"}]
    assert list(archives.iter_warc(b"HTTP/1.1 200")) == [{"problem": "header not understood"}]


def test_mixing(hard, empty):
    got = mixing.mix(hard).collect()
    assert len(got) == hard.count() and all(0 <= r.copies <= 2 for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).columns == empty.columns
    assert mixing.mixed_rows(hard).columns == hard.columns


def test_sharding(hard, empty):
    got = sharding.shard(hard, shards=4).collect()
    assert len(got) == hard.count()
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert sharding.shard(empty).count() == 0


def test_decontamination(spark, hard, empty):
    bench = spark.createDataFrame([(1, "one two", 1), (2, None, 1), (3, "", 1), (None, "one two", 1), (4, "ONE two", 1)],
                                  "item_id long, text string, doc_id int")
    got = decontamination.leaks(hard, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 1), (4, 4), (11, 1), (11, 4)}
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(hard, bench.limit(0)).count() == 0
    assert decontamination.keep_clean(hard, bench).count() == hard.count() - 2


def test_fingerprints(hard, empty):
    got = fingerprints.compare_with_next(hard).collect()
    assert len(got) == hard.where("doc_id is not null").count()
    of = {r.doc_id: r for r in got}
    assert of[5].fingerprint == of[6].fingerprint and of[1].fingerprint == "" and of[1].near_next == 1.0
    assert fingerprints.compare_with_next(empty).count() == 0
    assert fingerprints.near_groups(empty).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, sf, hard, empty, name, stage):
    hard = hard.withColumn("word_start", F.lit(1)).withColumn("copies", F.lit(2))
    for docs in (hard, empty):
        got = stage(spark, docs, sf)
        assert got.columns[: len(docs.columns)] == docs.columns
        if name != "sharding":
            assert got.columns == docs.columns
        ids = {r.doc_id for r in got.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
