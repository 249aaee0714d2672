"""Near duplicates among many short texts, against brute force."""

import random
from collections import defaultdict

from tramline.llm import minhash


def test_short_texts_with_one_word_more(spark):
    draw = random.Random(11)
    texts = []
    for k in range(4000):
        own = [f"q{draw.randrange(10**9)}" for _ in range(7 + k % 6 if k % 2 else 7)]
        texts += [" ".join(own), " ".join([*own, "more"]), " ".join(["so", *own])]
    found = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in found]
    having = defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            having[s].append(i)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        for j in {j for s in own for j in having[s] if j < i}:
            if 100 * len(own & sets[j]) >= 75 * len(own | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    want = {i: root(i) for i in range(len(texts))}
    assert got == want and sum(i != c for i, c in want.items()) > 4000
