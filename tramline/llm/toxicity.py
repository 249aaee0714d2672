"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text and the beginnings of its words (4 to 7 characters), lower
case. Those that clearly go with toxic labels in a bounded sample are the vocabulary; features that speak against
toxicity are not in it. Labels say toxic or not; the grade of a toxic document is 1, 2 or 3 by how many distinct
features of the vocabulary it shows, cut at the terciles of the toxic documents. The proportional-odds model
P(grade <= k) = logistic(threshold_k - w.x) shares its weights over the ordered thresholds
(McCullagh, "Regression Models for Ordinal Data", 1980). The expected severity is the sum of
P(grade > k); a document counts as toxic where P(grade > 0) reaches a threshold set on documents that took no
part in training, 0.3 at least.

Null and empty texts have no features and get the model's least severity. Without labels of both kinds nothing is toxic.
Labels of one document that differ count as toxic. Repeated rows are graded each by itself; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.sampling import bounded_sample, fold
from tramline.session import durable

TRAIN_PER_LABEL = 2000  # documents at most, the bound of the sample
GRADES = 4
STARTS = (4, 5, 6, 7)
VOCABULARY = 4000
LEAST_DOCUMENTS = 4
LEAST_RATIO = 8.0  # of the shares of toxic and other documents that show a feature
EDGES = re.compile(r"[^\w]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, and word beginnings marked by a tilde."""
    found = set(EDGES.split((text or "").lower()))
    found.discard("")
    out = set(found)
    for n in STARTS:
        out.update({w[:n] + "~" for w in found if len(w) > n})
    return out


@dataclass(frozen=True)
class Model:
    """Weight of each feature, ordered thresholds, and the probability from which a text is toxic."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    toxic_from: float

    def grade(self, text: str | None) -> tuple[float, float, int]:
        """P(grade > 0), expected severity and the most likely grade."""
        if not self.weights:
            return 0.0, 0.0, 0
        found = set(EDGES.split((text or "").lower()))
        hit = found & self.weights.keys()
        for n in STARTS:
            hit |= {w[:n] + "~" for w in found if len(w) > n} & self.weights.keys()
        z = sum(self.weights[f] for f in sorted(hit))
        above = [1 / (1 + np.exp(min(60.0, max(-60.0, t - z)))) for t in self.thresholds]
        exact = -np.diff([1.0, *above, 0.0])
        return float(above[0]), float(sum(above)), int(exact.argmax())


def vocabulary(sample: DataFrame) -> dict[str, float]:
    """Features of the sample (label, found) that go with toxic labels, with the logarithm of their ratio."""
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return {}
    counts = (
        sample.select("label", F.explode("found").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .where(F.col("bad") >= LEAST_DOCUMENTS)
    )
    ratio = (F.col("bad") / sizes[1]) / ((F.col("good") + 0.5) / (sizes[0] + 1))
    chosen = (
        counts.withColumn("ratio", ratio)
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy((F.col("ratio") * F.sqrt("bad")).desc(), "feature")
        .limit(VOCABULARY)
    )
    return {r.feature: float(np.log(r.ratio)) for r in chosen.collect()}


def fit_ordinal(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, n_features: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient steps (Adam) on the likelihood with a ridge."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    size = n_features + GRADES - 1
    value = np.zeros(size)
    value[n_features:] = [1.0] + [np.log(0.7)] * (GRADES - 2)  # first threshold, logarithms of the steps
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        theta = value[n_features] + np.concatenate([[0], np.cumsum(np.exp(value[n_features + 1 :]))])
        low, high = np.concatenate([[-60], theta]), np.concatenate([theta, [60]])
        z = np.bincount(at, value[col], len(rows))
        s = lambda t: 1 / (1 + np.exp(-np.clip(t, -60, 60)))
        up, down = s(high[y] - z), s(low[y] - z)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = weight * up * (1 - up) / p, weight * down * (1 - down) / p
        grad = np.zeros(size)
        grad[:n_features] = np.bincount(col, (d_down - d_up)[at], n_features)
        g_theta = np.bincount(y, d_up, GRADES)[:-1] - np.bincount(y, d_down, GRADES)[1:]
        grad[n_features] = g_theta.sum()
        for k in range(1, GRADES - 1):
            grad[n_features + k] = np.exp(value[n_features + k]) * g_theta[k:].sum()
        grad = grad / weight.sum()
        grad[:n_features] -= 1e-4 * value[:n_features]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        value += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = value[n_features] + np.concatenate([[0], np.cumsum(np.exp(value[n_features + 1 :]))])
    return value[:n_features], theta


def fit(rows: list, names: list[str], shares: dict[int, int]) -> Model:
    """Train on rows (label, found: places in `names`, holds); rows with `holds` set the threshold of `toxic`."""
    clean = [r.found for r in rows if r.label == 0 and not r.holds]
    toxic = [r.found for r in rows if r.label == 1 and not r.holds]
    if not toxic or not clean or not names:
        return Model({}, (0.0,) * (GRADES - 1), 1.0)
    shown = np.array([len(f) for f in toxic])
    cuts = np.quantile(shown, [1 / 3, 2 / 3])
    y = np.concatenate([np.zeros(len(clean), np.int64), 1 + np.searchsorted(cuts, shown, "left")])
    weight = np.concatenate([np.full(len(clean), shares[0] / len(clean)), np.full(len(toxic), shares[1] / len(toxic))])
    w, theta = fit_ordinal(clean + toxic, y, weight / weight.mean(), len(names))
    held = [(1 / (1 + np.exp(theta[0] - w[r.found].sum())), r.label) for r in rows if r.holds]
    least = 0.5
    if len({k for _, k in held}) == 2:
        # The best balance of misses and false alarms, in the middle of its range; doubtful texts are left alone.
        of = {k: shares[k] / sum(m == k for _, m in held) for k in (0, 1)}
        grid = np.linspace(0.3, 0.9, 25)
        cost = np.array([sum(of[k] for p, k in held if (p >= t) != bool(k)) for t in grid])
        least = float(np.median(grid[cost <= cost.min() + 1e-9]))
    return Model(dict(zip(names, w.tolist(), strict=True)), tuple(map(float, theta)), least)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> Model:
    """Fit to `labels(doc_id, toxic)` of the documents that `allowed`, a condition on doc_id, admits."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null")
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    shares = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = bounded_sample(marks, "label", F.col("doc_id"), TRAIN_PER_LABEL)

    def all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.string()))],
                ["doc_id", "label", "found"],
            )

    sample = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(all_features, "doc_id long, label int, found array<string>")
        .withColumn("holds", fold(F.col("doc_id"), 16) % 5 == 0),
        "toxicity-sample",
    )
    names = sorted(vocabulary(sample.where("not holds")))
    place = F.map_from_arrays(F.lit(names), F.lit(list(range(len(names))))) if names else None
    if place is None:
        return fit([], [], shares)
    known = F.array_sort(F.transform(F.array_intersect("found", F.lit(names)), lambda f: F.element_at(place, f)))
    rows = sample.select("doc_id", "label", "holds", known.alias("found")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.found))
    return fit(rows, names, shares)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_toxic, expected_severity, severity, toxic) of each row of `docs(doc_id, text, ...)`."""

    def grades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.grade(t.as_py()) for t in batch.column("text")]
            p = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([x[1] for x in out], pa.float64()),
                    pa.array([x[2] for x in out], pa.int32()), pa.array([x >= model.toxic_from for x in p], pa.bool_()),
                ],
                ["doc_id", "p_toxic", "expected_severity", "severity", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        grades, f"doc_id {kind}, p_toxic double, expected_severity double, severity int, toxic boolean"
    )
