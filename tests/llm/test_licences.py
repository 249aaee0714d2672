"""Licence statements: forms in which they are met, every family, hard rows, and agreement with a plain scorer."""

import textwrap

import pytest

from tramline.llm import licences

MIT = licences.STATEMENTS["MIT"][-1]


@pytest.fixture(scope="module")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


def found(spark, prose, texts):
    rows = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {}
    for r in licences.scan(prose.unionByName(rows)).where("doc_id >= 1000000").collect():
        out.setdefault(r.doc_id - 10**6, []).append((r.paragraph, r.family, r.confirmed))
    return out


def test_forms_in_which_licences_are_met(spark, prose):
    none = "not lower(text) rlike 'licen|rights reserved|cc by|general public'"
    some = prose.where("length(text) between 300 and 900").where(none).orderBy("doc_id").limit(3)
    words = [r.text for r in some.collect()]
    texts = {
        "Available under CC-BY-SA 4.0.": "CC-BY-SA", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "BSD 3-Clause": "BSD",
        "CC-BY-NC 4.0": "CC-BY-NC", "\n".join(textwrap.wrap(MIT, 80)): "MIT", "\n".join(textwrap.wrap(MIT, 40)): "MIT",
        words[0] + "\nLicensed under the Apache License, Version 2.0.\n" + words[1]: "Apache-2.0",
        words[2] + "\n\nAll rights reserved.": "proprietary",
    }
    got = found(spark, prose, list(texts))
    for i, family in enumerate(texts.values()):
        assert [(f, c) for _, f, c in got.get(i, [])] == [(family, True)], (i, family, got.get(i))


def test_every_statement_and_other_sentences(spark, prose):
    texts = [(f, t) for f, many in licences.STATEMENTS.items() for t in (*many, *(f"Released under {n}." for n in licences.NAMES[f]))]
    got = found(spark, prose, [t for _, t in texts] + list(licences.OTHERS) + ["Er kommt mit dem Rad.", "The GPL of numbers", ""])
    right = [i for i, (f, _) in enumerate(texts) if (0, f, True) in got.get(i, [])]
    assert {texts[i][0] for i in right} == set(licences.STATEMENTS) and len(right) >= 0.95 * len(texts)
    assert not any(c for i in range(len(texts), len(texts) + len(licences.OTHERS) + 1) for _, _, c in got.get(i, []))


def test_repeated_null_and_long_rows(spark, prose):
    long = "word " * 20_000 + "\n\n" + "Licensed under the MIT license."
    rows = spark.createDataFrame(
        [(1, long, 5), (1, long, 5), (2, None, 5), (None, "Licensed under the MIT license.", 5), (3, "", 5), (4, "\n\n \n", 5)],
        "doc_id long, text string, paragraph int",
    )
    got = licences.scan(rows).collect()
    assert sorted((r.doc_id or 0, r.paragraph, r.family) for r in got) == [(0, 0, "MIT"), (1, 1, "MIT"), (1, 1, "MIT")]


def test_words_are_the_same_on_both_sides(spark):
    texts = ["CC-BY-SA 4.0, v. 2.0...", "(the \"License\");", "", "a.b .c. -d-", "Ünï-Code 3.0"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    from pyspark.sql import functions as F
    assert [r[0] for r in rows.select(licences._words(F.col("text"))).collect()] == [licences.words_of(t) for t in texts]
