import math

import numpy as np
import pytest

from tramline.llm import permutations


def exact(rows):
    """Ten nearest of each query row by comparing with every row."""
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    lengths = [len(v) for _, v in rows]
    usual = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    rows = sorted(r for r in rows if len(r[1]) == usual)
    points = np.array([v for _, v in rows], np.float64).reshape(len(rows), usual)
    out = {}
    for at, (i, v) in enumerate(rows):
        if i % 100 == 0:
            score = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
            out[(i, v)] = sorted((s, j) for s, (j, _) in zip(score.tolist(), rows, strict=True) if j != i)[:10]
    return out


def found(spark, rows, kind="float"):
    return permutations.neighbours(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_on_whole_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = {i: set(j for _, j in near) for (i, _), near in exact(rows).items()}
    got = {}
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for r in permutations.neighbours(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        assert math.isclose(r.score, np.linalg.norm(vectors[r.query_id] - vectors[r.vec_id]), rel_tol=1e-12, abs_tol=1e-12)
    assert got.keys() == want.keys()
    for near in got.values():
        near.sort()
        assert [k for k, _, _ in near] == list(range(1, 11))
        assert [x[1:] for x in near] == sorted(x[1:] for x in near)
    assert np.mean([len(want[i] & {j for _, _, j in got[i]}) for i in want]) / 10 >= 0.95


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf, 1.0]),
        (None, [1.0, 1.0]), (700, [1.0, 2.0, 3.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0, 0.0]),
        (800, [2.0, 0.0]), (800, [2.0, 0.0]), (800, [0.0, 2.0]),
    ]
    for kind in ("float", "double"):
        got = found(spark, rows, kind)
        want = [(i, k + 1, j, s) for (i, _), near in exact(rows).items() for k, (s, j) in enumerate(near)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert found(spark, []) == [] and found(spark, [(100, [1.0])]) == [] and found(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_copies_go_by_id_and_clashing_names(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=8)
    rows = [(i, base.tolist()) for i in range(1500)] + [(i, draw.normal(size=8).tolist()) for i in range(1500, 3000)]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, vector int, pivots int, `rank` int")
    got = {}
    for r in permutations.neighbours(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for query in range(0, 1500, 100):
        assert [j for _, j in sorted(got[query])] == [i for i in range(12) if i != query][:10]
    assert set(got) == set(range(0, 3000, 100)) and all(len(x) == 10 for x in got.values())


def test_agreement_is_the_footrule():
    draw = np.random.default_rng(1)
    index = permutations.Index(draw.normal(size=(30, 5)), 8, 1.0)
    orders = index.orders(draw.normal(size=(200, 5)))
    files = permutations.InvertedFiles(orders, 30)
    place = lambda order: [list(order).index(p) if p in order else 8 for p in range(30)]
    query = orders[0]
    footrule = np.abs(np.array([place(o) for o in orders]) - np.array(place(query))).sum(axis=1)
    agreement = files.agreement(query)
    assert ((footrule + 2 * agreement) == footrule[0] + 2 * agreement[0]).all()
