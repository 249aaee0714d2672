"""Rows that the stages keep: repeated ids, clashing names, results written to disk, and naive versions of each stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import decontamination, minhash
from tramline.session import durable

STAGES = dict(corpus_pipeline.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "law", "SLOT", "slot_", "text_crc32", "shard", "kept_id", "leaking_id", "leaking_text", "row", "id", "key", "full",
            "unnamed", "same", "node", "component", "copies", "copy", "text_key", "passage", "rejected", "first", "draw", "salt")


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], KIND)


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def near(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)


def one_of_each_group(rows):
    """First row of each component of rows (id, text) by comparing all pairs; rows without words all stay."""
    full = sorted({r for r in rows if shingles(r[1])}, key=lambda r: (r[0] is None, r[0] or 0))
    parent = list(range(len(full)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(full)):
        for j in range(i):
            if near(full[i][1], full[j][1]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = {}
    for i in range(len(full)):
        groups.setdefault(root(i), []).append(full[i])
    return groups, [r for r in rows if not shingles(r[1])]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    texts = [(1, "a b c d e f g"), (1, "z y x w v u t"), (1, "z y x w v u t"), (2, "a b c d e f g"), (None, "z y x w v u t"),
             (None, "p q r s t u v"), (None, ""), (None, ""), (3, ""), (3, ""), (None, "p q r s t u v")]
    got = sorted((r.doc_id or 0, r.text) for r in durable(minhash.keep_one(rows_of(spark, texts)), "t").collect())
    assert got == sorted([(1, "a b c d e f g"), (1, "z y x w v u t"), (0, "p q r s t u v"), (0, ""), (0, ""), (3, ""), (3, "")])
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    kept = durable(decontamination.keep_clean(rows_of(spark, texts), bench), "t").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in texts if t != "a b c d e f g")


def test_groups_of_random_edits_with_repeated_ids(spark):
    draw = random.Random(8)
    base = [[f"w{draw.randrange(300)}" for _ in range(draw.randrange(4, 60))] for _ in range(12)]
    texts = []
    for k in range(150):
        own = list(draw.choice(base))
        for _ in range(draw.randrange(0, 4)):
            own[draw.randrange(len(own))] = f"e{k}"
        texts.append((draw.choice([None, *range(60)]), " ".join(own)))
    groups, empty = one_of_each_group(texts)
    got = [(r.doc_id, r.text) for r in minhash.keep_one(rows_of(spark, texts)).collect()]
    assert len(got) == len(groups)
    for members in groups.values():  # one of each group, with the least id in it
        chosen = [r for r in got if r in members]
        assert len(chosen) == 1 and chosen[0][0] == members[0][0]
    assert not empty


@pytest.mark.parametrize("name", STAGES)
def test_clashing_names_written_out(spark, sf, documents, name):
    docs = documents.limit(40).select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASHING)])
    docs = durable(docs, "clash")
    got = durable(STAGES[name](spark, docs, sf), "clash-out")
    assert got.columns[: len(docs.columns)] == docs.columns
    if name != "sharding":
        assert got.columns == docs.columns
    before = {tuple(r) for r in docs.collect()}
    assert {tuple(r)[: len(docs.columns)] for r in got.collect()} <= before


def test_stages_against_naive_versions(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    groups, empty = one_of_each_group(rows)
    want = sorted([g[0] for g in groups.values()] + empty, key=lambda r: r[0])
    kept = sorted(((r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, documents, sf).collect()), key=lambda r: r[0])
    assert kept == want
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = []
    for doc_id, text in rows:
        found = (text or "").encode().split()
        leaks = False
        for item in items:
            n = len(item.split())
            lines = [b" ".join(found[i : i + n]).decode() for i in range(max(1, len(found) - n + 1))] if found else []
            head = shingles(item)
            leaks = leaks or any(
                decontamination.similarity(w, item) >= 0.75 for w in lines if len(shingles(w) & head) * 4 >= 3 * len(head) * 0.9
            )
        if not leaks:
            clean.append(doc_id)
    got = sorted(r.doc_id for r in STAGES["decontamination"](spark, documents, sf).collect())
    assert got == sorted(clean)
