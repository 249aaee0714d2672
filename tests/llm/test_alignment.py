import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tramline.llm import alignment


FIRST = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.FIRST_FILE}")
FIRST.encode_special_tokens = True


@pytest.fixture(scope="module")
def tokens(spark):
    return alignment.Tokens(alignment.read_files(spark))


def naive(rows, tokens):
    """Whole texts encoded at once, groups by common ends, counts in a dictionary."""
    seen, counts = [], Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        a = FIRST.encode(whole.decode(), add_special_tokens=False).ids
        b = tokens.second.encode(text or "")
        bytes_a, bytes_b = [tokens.first_bytes[i] for i in a], [tokens.second_bytes[i] for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            seen.append((doc_id, 0, 0, [], Counter(), ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links, x, y, i, j = [], Counter(), [], [], 0, 0
        for end in sorted(set(ends_a) | set(ends_b)):
            if i < len(a) and ends_a[i] == end:
                x.append(a[i])
                i += 1
                if j < len(b) and ends_b[j] == end:
                    y.append(b[j])
                    j += 1
                    groups.append((x, y))
                    x, y = [], []
            elif ends_b[j] == end:
                y.append(b[j])
                j += 1
        for x, y in groups:
            links.update((p, q) for p in x for q in y)
        counts.update(links.keys())
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        seen.append((doc_id, len(a), len(b), groups, links, hashlib.sha256(text_of.encode()).hexdigest()))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    return [
        (i, n_a, n_b, len(groups), sum(links.values()), sum(m for k, m in links.items() if counts[k] == best[k[0]]),
         sum(m * counts[k] for k, m in links.items()), digest)
        for i, n_a, n_b, groups, links, digest in seen
    ]


def compare(docs, tokens):
    order = lambda r: tuple((v is not None, v) for v in r)
    got = alignment.alignments(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = naive([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokens)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    return want


def test_whole_table(documents, tokens):
    assert sum(r[4] > 0 for r in compare(documents, tokens)) > 150


def test_hard_rows(hard, empty, tokens):
    compare(hard, tokens)
    assert alignment.alignments(empty).collect() == []


def test_spaces_scripts_and_marks(spark, tokens):
    draw = random.Random(5)
    pieces = [" ", "  ", "\n", "\t", " ", "　", " ", "\u0085", "\x1c", "\x00", "▁", "é", "é", "日本語", "🙂", "don't",
              "'s", "<s>", "<0x0A>", "<|endoftext|>", "hello", "world", "12345", "...", "a", "ﬁ", "Ünïcode", "слово", "　", "﻿"]
    rows = [(i, "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 25)))) for i in range(1500)]
    rows += [(9000, "x" * 20_000), (9001, " " * 3000), (9002, "日本語テキスト" * 2000), (9003, "a" + " " * 50 + "b"), (9004, " a"), (9005, " ")]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), tokens)


def test_rare_pairs_meet_their_counts(documents, tokens, monkeypatch):
    monkeypatch.setattr(alignment, "FREQUENT", 50)
    compare(documents.limit(60), tokens)


def test_clashing_names(spark, tokens):
    names = ("n_a", "pairs", "times", "row_key", "n_best", "best")
    docs = spark.createDataFrame([(1, "two words", *range(6))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    compare(docs, tokens)


def test_pointers_reach_the_last_token_of_long_components():
    n = 10_000  # the ends never meet before the last
    first, second = np.arange(1, n + 1) * 2, np.append(np.arange(n) * 2 + 1, 2 * n)
    a, b = alignment.terminals(first, second)
    assert set(a.tolist()) == set(b.tolist()) == {2 * n}
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(np.append(rng.integers(1, 60, rng.integers(1, 40)), 60)) for _ in range(2))
        a, b = alignment.terminals(x, y)
        common = np.intersect1d(x, y)
        for ends, labels in ((x, a), (y, b)):
            assert len(np.unique(labels)) == len(common)
            assert (np.unique(labels, return_inverse=True)[1] == np.unique(np.searchsorted(common, ends), return_inverse=True)[1]).all()


def test_memory_of_a_process_is_bounded(tokens):
    """Texts of ever new words, aligned in slices, take less than 250 MB on top of the vocabularies and the first texts."""
    import subprocess
    import sys

    code = """
import random, resource, pyarrow as pa
from tramline.llm import alignment as A, words
read = lambda name: open(f"{A.TOKENIZERS}/{name}", "rb").read()
known = A.Known(A.Tokens(A.TokenizerFiles(read(A.FIRST_FILE), read(A.SECOND_FILE))))
draw, peak = random.Random(1), lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
for _ in range(2):
    texts = [" ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(1000)) for _ in range(430)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(430)), pa.array(texts)], ["doc_id", "text"])
    begun = peak() if _ == 0 else begun
    for part in words.slices(batch, most=getattr(A, "TEXTS_AT_ONCE", words.SLICE_BYTES)):
        A._rows(part, known)
print(peak() - begun)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=".")
    print(done.stdout)
    assert int(done.stdout) < 250
