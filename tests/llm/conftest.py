import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns of clashing names."""
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("n", "st", "ra", "lo", "mi")]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    long = prose(20_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "One two", "en", None),
        (5, long, "en", "a"), (6, long, "fr", "b"), (6, long, "fr", "b"), (7, long.upper(), None, "b"),
        (8, "12 34 !!", "de", "b"), (9, prose(40), "de", ""), (10, "é" * 3000, "fr", "b"), (11, "one TWO", "en", "a"),
        (None, prose(30), "en", "a"), (12, None, None, None), (13, "日本語 テキスト 🙂", "ja", "c"),
    ]
    full = [(i, t, g, s, None if t is None else len(t), 1, 2, "x", "y", 0, 0.5) for i, t, g, s in rows]
    extra = "size int, target int, bucket string, component_id string, shard int, score double"
    return spark.createDataFrame(full, f"{DOCUMENTS}, {extra}".replace("size int, target int,", "size int, `row` int,"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
