"""Documents that are shorter than a benchmark item, against brute force."""

import random
from collections import Counter

from tramline.llm import decontamination


def brute_force(docs, items):
    want = {}
    for doc_id, text in docs:
        found = text.encode().lower().split()
        for item, item_text in items:
            own, size = decontamination.shingles_of(item_text), len(item_text.split())
            # Every window of the item's size, or the whole document if that is shorter.
            for at in range(max(1, len(found) - size + 1)):
                window = decontamination.shingles_of(b" ".join(found[at : at + size]).decode())
                s = (own & window).total() / ((own | window).total() or 1)
                if s >= 0.75 and s > want.get((doc_id, item), (0,))[0]:
                    want[doc_id, item] = (s, at, min(size, len(found)))
    return want


def test_documents_shorter_than_an_item(spark):
    draw = random.Random(7)
    prose = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    items = [(k, prose(n)) for k, n in enumerate([1, 3, 4, 5, 6, 7, 8, 8, 9, 12, 20, 40, 40, 59])]
    docs = []
    for _, own in items:
        for cut in {1, 2, 3, len(own) // 8, len(own) // 5, len(own) // 4, len(own) // 3}:
            docs += [own[cut:], own[: len(own) - cut], own[cut // 2 : len(own) - (cut - cut // 2)]]
        docs += [own, prose(3) + own, own[:-1] + ["x"], prose(len(own))]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    items = [(k, " ".join(own)) for k, own in items]
    got = decontamination.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r.doc_id, r.item_id): (r.similarity, r.word_start, r.n_words) for r in got}
    assert found == brute_force(docs, items)
    sizes = {k: len(t.split()) for k, t in items}
    assert sum(r.n_words < sizes[r.item_id] for r in got) > 30


def test_similar_windows_outside_the_radius(spark):
    """Windows of distinct words shifted as far as the similarity allows, some with distances over the radius."""
    draw = random.Random(3)
    docs, items = [], []
    for k in range(400):
        own = [f"v{k}x{j}x{draw.randrange(10**6)}" for j in range(60)]
        items.append((k, " ".join(own)))
        new = [f"n{k}x{j}x{draw.randrange(10**6)}" for j in range(8)]
        docs.append((k, " ".join(own[8:] + new)))
        docs.append((k + 1000, " ".join(own[8:])))
    got = decontamination.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(400)} | {(k + 1000, k) for k in range(400)}
    assert any(r.distance > decontamination.RADIUS for r in got)


def test_documents_without_id_are_searched(spark):
    item = " ".join(f"b{j}" for j in range(20))
    rows = [(None, f"x y {item} z", 1), (None, item, 2), (None, "x y z", 3), (None, None, 4), (1, item, 5), (2, "x y z", 6), (None, item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.n for r in decontamination.keep_clean(docs, bench).collect()) == [3, 4, 6]
    got = decontamination.leaks(docs, bench)
    assert got.columns == ["doc_id", "item_id", "word_start", "n_words", "similarity", "distance"]
    assert sorted((r.doc_id or 0, r.word_start) for r in got.collect()) == [(0, 0), (0, 2), (1, 0)]
