"""Quality of whole texts by a generalised additive model with pairwise interactions.

Texts become a few shape figures (lengths, shares of letter kinds, repetition). Boosting goes round the
features in turn and adds a shallow tree on one feature to that feature's look-up table (Lou et al.,
"Intelligible Models for Classification and Regression", KDD 2012); then the pairs of features that
explain most of what is left get two-dimensional tables in the same way (GA2M, KDD 2013). A score is
the logistic of a sum of table entries, looked up for a whole batch at once.

Labels come from a sample of bounded size per label, weighted back to the labels' real shares. Null
and empty texts have figures like any other (all zero). Labels of one document that differ count as
the higher. Without labels every score is 0.5; with one label only, near that label. Repeated rows are scored each by itself; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm import words
from tramline.llm.sampling import bounded_sample

TRAIN_PER_LABEL = 3000  # documents at most, the bound of the sample
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "stops", "breaks", "accents",
    "distinct", "distinct_runs", "commonest", "longest_word",
)
_KINDS = np.zeros((6, 256), np.uint8)
_KINDS[0, ord("A") : ord("Z") + 1] = 1
_KINDS[1, ord("0") : ord("9") + 1] = 1
_KINDS[2, [ord(c) for c in "!#$%&*+/<=>?@[\\]^_`{|}~"]] = 1
_KINDS[3, [ord(c) for c in ".,;:'\"()-"]] = 1
_KINDS[4, [ord("\n")]] = 1
_KINDS[5, 0xC2:] = 1  # first bytes of characters beyond ASCII


def figures(array: pa.Array) -> np.ndarray:
    """One row of figures per text."""
    data, bounds = words.utf8(array)
    starts, ends, first = words.word_spans(data, bounds)
    hashes = words.word_hashes(data, starts, ends)
    runs = words.shingle_hashes(hashes, 3)
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    count = np.diff(first).astype(float)
    per_byte = 1 / np.maximum(size, 1)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    out[:, 2] = (lengths[first[1:]] - lengths[first[:-1]]) / np.maximum(count, 1)
    for k, table in enumerate(_KINDS):
        hit = np.flatnonzero(table[data])
        out[:, 3 + k] = np.diff(np.searchsorted(hit, bounds)) * per_byte
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            _, often = np.unique(hashes[a:b], return_counts=True)
            out[i, 9], out[i, 11] = len(often) / (b - a), often.max() / (b - a)
            out[i, 10] = len(np.unique(runs[a : b - 2])) / (b - a - 2) if b - a > 2 else 1
            out[i, 12] = np.log1p((ends[a:b] - starts[a:b]).max())
    return out


@dataclass
class Model:
    """Edges of the bins and the tables added up by a score."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], cuts)) for j in range(x.shape[1])]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(gains.argmax())
    return float(gains[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree of this depth, per bin."""
    gain, cut = _best_cut(g, h)
    if depth == 0 or gain <= 1e-6:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _corner_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both axes once."""
    sum_g, sum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = sum_g[-1, -1], sum_h[-1, -1]
    a_g, a_h = sum_g[:-1, :-1], sum_h[:-1, :-1]
    b_g, b_h = sum_g[:-1, -1:] - a_g, sum_h[:-1, -1:] - a_h
    c_g, c_h = sum_g[-1:, :-1] - a_g, sum_h[-1:, :-1] - a_h
    d_g, d_h = tg - a_g - b_g - c_g, th - a_h - b_h - c_h
    if not a_g.size:
        return 0.0, np.zeros_like(g)
    gains = _gain(a_g, a_h) + _gain(b_g, b_h) + _gain(c_g, c_h) + _gain(d_g, d_h) - _gain(tg, th)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    values = np.empty_like(g)
    for rows, cols, sg, sh in (
        (slice(i + 1), slice(j + 1), a_g, a_h), (slice(i + 1), slice(j + 1, None), b_g, b_h),
        (slice(i + 1, None), slice(j + 1), c_g, c_h), (slice(i + 1, None), slice(j + 1, None), d_g, d_h),
    ):
        values[rows, cols] = sg[i, j] / (sh[i, j] + 1.0)
    return float(gains[i, j]), values


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Boost main tables in turn, then tables of the pairs with the largest gain on what is left."""
    if not len(y):
        return Model()
    base = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    edges, pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(pair_edges)]
    model = Model(float(np.log(base / (1 - base))), edges, [np.zeros(len(e) + 1) for e in edges], pair_edges)
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, place in enumerate(fine):
            g, h = slopes()
            n = len(edges[j]) + 1
            step = RATE * _tree(np.bincount(place, g, n), np.bincount(place, h, n))
            model.tables[j] += step
            z += step[place]

    def square(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        n, m = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        place = coarse[i] * m + coarse[j]
        return place, np.bincount(place, g, n * m).reshape(n, m), np.bincount(place, h, n * m).reshape(n, m)

    ranked = sorted(
        ((_corner_tree(*square(i, j)[1:])[0], i, j) for i in range(len(edges)) for j in range(i)), reverse=True
    )
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            place, g, h = square(i, j)
            step = RATE * _corner_tree(g, h)[1]
            model.pair_tables[k] += step
            z += step.ravel()[place]
    return model


def _figures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = figures(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> Model:
    """Fit to `labels(doc_id, quality)` of the documents that `allowed`, a condition on doc_id, admits."""
    marks = labels.where("quality in (0, 1) and doc_id is not null")
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("label"))
    shares = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = bounded_sample(marks, "label", F.col("doc_id"), TRAIN_PER_LABEL)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    rows = texts.mapInArrow(_figures_of, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.x))
    y = np.array([r.label for r in rows], float)
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    of = {label: (y == label).sum() for label in shares}
    weight = np.array([shares[r.label] / of[r.label] for r in rows], float)
    return fit(x, y, weight / weight.mean() if len(rows) else weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of `docs(doc_id, text, ...)`."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(figures(batch.column("text"))))], ["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scores, f"doc_id {kind}, score double")
