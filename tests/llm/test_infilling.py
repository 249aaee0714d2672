import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tramline.llm import infilling

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """The form, the parts and the output, with the tokens in a list."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    x, y = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def compare(docs):
    rows = docs.select("doc_id", "text").collect()
    made = infilling.transform(docs)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                      infilling.restore(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    want = [(r.doc_id, *plainly(r.doc_id, r.text), r.text or "") for r in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    return got


def test_whole_table(documents):
    got = compare(documents)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_hard_rows(hard, empty):
    compare(hard)
    assert infilling.digests(empty).collect() == []


def test_texts_of_spaces_markers_and_marker_pieces(spark):
    draw = random.Random(1)
    pieces = ["<", "P>", "S>", "<S", "M", ">", " ", "\n", "\t ", "é", "日本", "🙂", "\x0b", " ", "a", "word", "<P", ""]
    rows = [(i, "".join(draw.choice(pieces) for _ in range(draw.randrange(0, 40)))) for i in range(3000)]
    rows += [(5000 + i, t) for i, t in enumerate(["<P>", "a <M> b", "<S>" * 9, " ", "\n\n", "x", "x ", " x"])]
    compare(spark.createDataFrame(rows, "doc_id long, text string"))


def test_chunks_follow_content_and_are_checked_by_it():
    draw = random.Random(2)
    shared = " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(20_000)).encode()
    summaries = infilling.Summaries(1 << 30)
    infilling.Located(shared, summaries)
    known = len(summaries.new)
    infilling.Located(b"another beginning " + shared + b" and end", summaries)
    assert known > 50 and len(summaries.new) <= known + 4
    bounds = infilling.chunk_ends(__import__("numpy").zeros(100_000, "uint8"))
    assert bounds[-1] == 100_000 and max(b - a for a, b in zip([0, *bounds], bounds, strict=False)) <= infilling.LONGEST_CHUNK


def test_the_cache_forgets_and_results_stay(monkeypatch):
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abc ", k=5)) for _ in range(400)) for _ in range(40)]
    small, large = infilling.Summaries(4000), infilling.Summaries(1 << 30)
    for text in texts * 2:
        a, b = infilling.Located(text.encode(), small), infilling.Located(text.encode(), large)
        ends = [m.end() for m in TOKEN.finditer(text)]
        assert a.n == b.n == len(ends)
        assert [a.end(k)[0] for k in range(1, a.n + 1)] == ends == [b.end(k)[1] for k in range(1, b.n + 1)]
    assert small.held < 6000


@pytest.mark.parametrize("name", ["n", "form", "output"])
def test_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "a b c", 7), (1, "a b c", 7)], f"doc_id long, text string, {name} long")
    assert len(compare(docs)) == 2
