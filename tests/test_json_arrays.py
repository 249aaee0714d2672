import json
import random

import pytest

from tramline.schemas import PRESET_SCHEMA
from tramline.sources import catalog_files, json_arrays
from tramline.sources.json_arrays import ArrayCutter


def elements(text, key, size):
    cutter, data, out = ArrayCutter(key), text.encode(), []
    for at in range(0, len(data), size):
        out += cutter.feed(data[at : at + size])
    cutter.check()
    return [json.loads(e) for e in out]


def value(draw, depth):
    kind = draw.randrange(8 if depth else 5)
    texts = ["", 'a"b', "\\", "\\\\\"", "[{,}]", "body", '"body": [', "駅🙂", "\n\t", "x" * 50]
    if kind < 3:
        return draw.choice(texts)
    if kind < 5:
        return draw.choice([None, True, -1.5e3, 7])
    if kind < 7:
        return {draw.choice([*texts, "features"]): value(draw, depth - 1) for _ in range(draw.randrange(4))}
    return [value(draw, depth - 1) for _ in range(draw.randrange(4))]


def test_elements_of_random_documents_in_blocks_of_any_size():
    draw = random.Random(3)
    for _ in range(300):
        want = [value(draw, 3) for _ in range(draw.randrange(6))]
        style = draw.choice([{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
        size = draw.choice([1, 2, 3, 7, 64, 10_000])
        assert elements(json.dumps(want, **style), None, size) == want
        around = {"status": value(draw, 2), "meta": {"body": [1, 2]}, "body": want, "rest": [value(draw, 2)]}
        assert elements(json.dumps(around, **style), "body", size) == want
        assert elements(json.dumps({"rest": 1}), "body", size) == []


@pytest.mark.parametrize("text", ["oops", '{"body": [1, 2', '{"body": [{"a": "]}', "", "[1"])
def test_texts_that_are_no_whole_document(text):
    with pytest.raises(ValueError):
        elements(text, "body" if "{" in text else None, 5)


def test_lists_and_responses_in_their_own_form(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_arrays, "BLOCK_BYTES", 64)
    presets = [{"country": "c", "region": "r", "name": f"n{i}", "url": "u"} for i in range(50)]
    (tmp_path / "list.json").write_text("﻿" + json.dumps(presets, indent=4), encoding="utf-8")
    got = catalog_files.read_presets(spark, str(tmp_path / "list.json"))
    assert got.columns == PRESET_SCHEMA.fieldNames() and {r.name for r in got.collect()} == {p["name"] for p in presets}
    for i, body in enumerate(([{"feed_id": "f", "feed_pref_id": "13"}], [], None)):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"status": 200} if body is None else {"body": body}))
    (row,) = catalog_files.read_catalog(spark, [str(tmp_path / f"r{i}.json") for i in range(3)]).collect()
    assert (row.feed_id, row.feed_pref_id, row.file_uid) == ("f", 13, None)
    (tmp_path / "bad.json").write_text("<html>")
    with pytest.raises(Exception, match="not a whole JSON document"):
        catalog_files.read_catalog(spark, str(tmp_path / "bad.json")).collect()


def test_every_document_of_a_file_is_cut():
    from tramline.sources.json_arrays import ArrayCutter

    text = b'{"body": [{"n": 1}, {"n": 2}]}\n{"message": "no body"}\n{"body": []}\n{"a": [[9]], "body": [{"n": 3}], "b": [8]}\n'
    for size in (1, 7, len(text)):
        cutter = ArrayCutter("body")
        found = [e for i in range(0, len(text), size) for e in cutter.feed(text[i : i + size])]
        cutter.check()
        assert found == [b'{"n": 1}', b'{"n": 2}', b'{"n": 3}']
