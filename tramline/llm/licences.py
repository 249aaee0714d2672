"""Licence statements in texts, paragraph by paragraph.

A paragraph is a block of lines up to the next blank one, so a statement may be wrapped. It is described by its word 1- to
3-grams; a multinomial logistic regression on sparse vectors, with a class per licence family and one for everything else,
is trained on variants of known statements and names, alone and inside paragraphs of the corpus, and on such paragraphs
by themselves. Only n-grams of the statements are features, so any other paragraph has
none. A probability below the family's threshold, set on its wordings that took no part in training, makes the
paragraph `unknown`; a prediction is confirmed if enough of the longest n-grams of one of the
family's statements or names occur in the paragraph.

Everything on the executors is DataFrame functions; coefficients come from Spark's own ML estimator.
A paragraph is scored if it has a telling word: one that speaks for some family by its learned weight, or is the word
of a statement or name that does so most.

Null and empty texts have no paragraphs. Rows that repeat are reported each. Without
documents the result is empty. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.sampling import bounded_sample
from tramline.session import durable

# Statements by which works are put under a licence, by family.
STATEMENTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Distributed under the Apache 2.0 license.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL version 2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL version 3.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under the CC0 1.0 Universal license.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part may be reproduced without written permission.",
    ),
}
# Names of the licences of a family, as they stand alone or in phrases.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache 2.0 license"),
    "MIT": ("MIT License", "Expat license"),
    "GPL": ("GPL-3.0", "GPL-2.0", "GPLv2", "GPLv3", "GNU GPL", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1", "LGPL-3.0", "LGPLv3", "GNU LGPL"),
    "AGPL": ("AGPL-3.0", "AGPLv3", "GNU AGPL"),
    "BSD": ("BSD 3-Clause", "BSD-2-Clause", "BSD license"),
    "MPL": ("MPL-2.0", "Mozilla Public License 2.0"),
    "CC-BY": ("CC BY 4.0", "CC-BY-3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons BY-SA"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC-BY-NC-3.0", "Creative Commons BY-NC"),
    "public-domain": ("CC0 1.0", "CC0-1.0", "The Unlicense"),
    "proprietary": (),
}
CARRIERS = ("{}", "Available under {}.", "SPDX-License-Identifier: {}", "Distributed under {}", "License: {}", "Released under the {}.",
            "Licensed under {}.", "Use is governed by the {}.")
# Sentences that speak of such things without putting a work under a licence.
OTHERS = (
    "The driver showed his license to the officer.",
    "Ask for permission before you enter the garden.",
    "The software license agreement was discussed for hours.",
    "A licence fee is due every year for each television.",
    "Copyright law protects authors in most countries.",
    "We may redistribute the chairs in the hall.",
    "The library holds works in the public domain and others.",
    "He lost his fishing licence last summer.",
    "Under the law they have the right to appeal.",
    "Version 2.0 of the program was released in spring.",
)
NONE, UNKNOWN = "none", "unknown"
GRAMS = 3
TRAIN_PARAGRAPHS = 1000  # of the corpus at most, as examples of `none`: the bound of the sample
AROUND = 40  # of them, in which variants are put
CONFIRMED = 0.6
CALIBRATION_QUANTILE, MARGIN = 0.02, 0.9
TELLING = 1.0  # weight for a family, less that for `none`, from which a word gets its paragraph scored


def _words(text: Column) -> Column:
    """Lower-case words; hyphens part them, dots inside stay."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}.]+")
    return F.filter(F.transform(found, lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def words_of(text: str) -> list[str]:
    """The same for the statements, on the driver."""
    return [w for w in (x.strip(".") for x in re.split(r"[^\w.]+", text.lower())) if w]


def _grams(words: Column, n: int) -> Column:
    """n-grams in order, as texts."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def _all_grams(words: Column) -> Column:
    return F.array_distinct(F.concat(*[_grams(words, n) for n in range(1, GRAMS + 1)]))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, words) of the blocks of lines of each text; blank lines part them."""
    blocks = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n[ \t\r]*\n\s*")).alias("paragraph", "block"))
    return blocks.select("doc_id", "paragraph", _words(F.col("block")).alias("words"))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows made in the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def variants() -> list[tuple[str, list[str], bool]]:
    """(family, words, held): statements whole, cut and without single words, and names in phrases.

    Every fourth change of a statement and every fourth phrase are held out from training.
    """
    made = []
    for family, statements in STATEMENTS.items():
        for text in statements:
            words = words_of(text)
            changed = [words, *[words[:i] + words[i + 1 :] for i in range(len(words))], words[1:], words[:-1],
                       ["note", *words], [*words, "2024", "authors"]]
            made += [(family, w, i % 4 == 3) for i, w in enumerate(changed) if len(w) > 1]
        for name in NAMES[family]:
            made += [(family, words_of(c.format(name)), i % 4 == 3) for i, c in enumerate(CARRIERS)]
    return made + [(NONE, words_of(text), False) for text in OTHERS]


def templates() -> list[tuple[str, int, list[str]]]:
    """(family, number, n-grams) of each statement and name: all its 3-grams, or itself if it is shorter."""
    out = []
    for family, statements in STATEMENTS.items():
        for number, text in enumerate([*statements, *NAMES[family]]):
            words = words_of(text)
            n = min(GRAMS, len(words))
            out.append((family, number, sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})))
    return out


def vocabulary() -> list[str]:
    """Word n-grams of all statements and names."""
    texts = [words_of(t) for many in (STATEMENTS, NAMES) for family in many.values() for t in family]
    return sorted({" ".join(w[i : i + n]) for w in texts for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)})


def train(docs: DataFrame) -> tuple[DataFrame, list[str], list[str], list[float], list[float]]:
    """Weights (gram, w: one per class), telling words, the classes, their intercepts and the thresholds below which each is `unknown`."""
    spark = docs.sparkSession
    made = _table(spark, [{"family": f, "words": w, "held": h} for f, w, h in variants()], "family string, words array<string>, held boolean")
    # First paragraphs of a bounded sample of documents, those that name no licence.
    sample = bounded_sample(
        docs.where("text is not null").select(F.lit(NONE).alias("family"), "doc_id", "text"), "family", F.col("doc_id"), TRAIN_PARAGRAPHS
    )
    names = _table(spark, [{"names": sorted({g for _, _, grams in templates() for g in grams} | {"licen"})}], "names array<string>")
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    plain = (
        sample.select("family", _words(F.element_at(F.split("text", r"\n[ \t\r]*\n\s*", 2), 1)).alias("words"))
        .crossJoin(F.broadcast(names))  # one row
        .where(~F.exists("names", lambda n: F.contains(text, F.concat(F.lit(" "), n))))
        .select("family", F.slice("words", 1, 400).alias("words"), F.lit(False).alias("held"), F.xxhash64("words").alias("order"))
    )
    plain = durable(plain.where("size(words) > 0"), "licences-plain")
    around = plain.orderBy("order", "words").limit(AROUND).select(
        F.pmod(F.xxhash64("order"), F.lit(AROUND)).alias("slot"), F.col("words").alias("prose")).dropDuplicates(["slot"])
    inside = (
        made.where(F.col("family") != NONE).withColumn("slot", F.pmod(F.xxhash64("words"), F.lit(AROUND))).join(F.broadcast(around), "slot")
        .select("family", F.concat("prose", "words").alias("words"), "held")
    )
    grams, classes = vocabulary(), [NONE, *STATEMENTS]
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double") - 1
    examples = made.unionByName(inside).unionByName(plain.drop("order")).distinct()
    counted = CountVectorizerModel.from_vocabulary(grams, "grams", "features").setBinary(True)
    table = durable(
        counted.transform(examples.select("held", label.alias("label"), _all_grams(F.col("words")).alias("grams"))).drop("grams"), "licences-examples"
    )
    model = LogisticRegression(regParam=0.0005, family="multinomial", maxIter=60).fit(table.where("not held"))
    weights = model.coefficientMatrix.toArray()
    held = model.transform(table.where("held")).where("prediction = label").select("label", F.array_max(vector_to_array("probability")).alias("p"))
    low = F.percentile_approx("p", CALIBRATION_QUANTILE).alias("low")
    found = {int(r.label): r.low for r in held.groupBy("label").agg(low).collect()}  # a row per family
    rows = [{"gram": g, "w": weights[:, i].tolist()} for i, g in enumerate(grams)]
    gain = (weights[1:] - weights[0]).max(axis=0)
    of_word = {g: float(gain[i]) for i, g in enumerate(grams) if " " not in g}
    texts = [words_of(t) for many in (STATEMENTS, NAMES) for family in many.values() for t in family]
    telling = sorted({w for w, g in of_word.items() if g >= TELLING} | {max(t, key=lambda w: (of_word[w], w)) for t in texts})
    known = _table(spark, rows, "gram string, w array<double>")
    return known, telling, classes, model.interceptVector.toArray().tolist(), [MARGIN * found.get(i, 1.0) for i in range(len(classes))]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of every licence paragraph.

    `family` is `unknown` for a paragraph that is about a licence but of none of the families.
    """
    spark = docs.sparkSession
    weights, telling, classes, bias, thresholds = train(docs)
    lists: dict[str, list] = {}
    for family, number, grams in templates():
        for gram in grams:
            lists.setdefault(gram, []).append({"family": family, "number": number, "n_template": len(grams)})
    kind = "array<struct<family:string,number:int,n_template:int>>"
    of_gram = _table(spark, [{"gram": g, "templates": t} for g, t in lists.items()], f"gram string, templates {kind}")
    known = F.broadcast(durable(weights.join(of_gram, "gram", "left"), "licences-grams"))  # as many rows as the statements have n-grams
    about = paragraphs(docs).where(F.arrays_overlap("words", F.lit(telling))) if telling else paragraphs(docs).limit(0)
    rows = about.withColumn("row", F.monotonically_increasing_id())
    hits = rows.select("row", "doc_id", "paragraph", F.explode(_all_grams(F.col("words"))).alias("gram")).join(known, "gram")
    logits = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(classes))]
    none_of = F.array().cast(kind)
    scored = hits.groupBy("row", "doc_id", "paragraph").agg(
        *logits, F.flatten(F.collect_list(F.coalesce("templates", none_of))).alias("seen"))
    z = F.array(*[F.col(f"z{i}") + bias[i] for i in range(len(classes))])
    peak = F.array_max("z")
    e = F.transform("z", lambda x: F.exp(x - peak))
    p = F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    best = F.array_max(F.slice("p", 2, len(classes)))
    named = F.element_at(F.lit(classes), F.array_position("p", F.col("best")).cast("int"))
    return (
        scored.select("doc_id", "paragraph", "seen", z.alias("z"))
        .withColumn("e", e).withColumn("p", p).withColumn("best", best).withColumn("named", named)
        .withColumn("own", F.filter("seen", lambda t: t["family"] == F.col("named")))
        .withColumn("similarity", F.coalesce(F.array_max(F.transform(F.array_distinct("own"), lambda t:
            F.size(F.filter("own", lambda u: u == t)) / t["n_template"])), F.lit(0.0)))
        .withColumn("confirmed", (F.col("best") >= F.element_at(F.lit(thresholds), F.array_position("p", F.col("best")).cast("int"))) & (F.col("similarity") >= CONFIRMED))
        .where((F.col("best") + 0.0 >= 0.5) | (1 - F.col("p")[0] >= 0.5) | (F.col("similarity") >= CONFIRMED))
        .select("doc_id", "paragraph",
                F.when(F.col("confirmed"), F.col("named")).otherwise(UNKNOWN).alias("family"),
                F.col("best").alias("probability"), "similarity", "confirmed")
    )
