"""Language of whole texts: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2- to 4-character runs of a lower-cased text whose runs of other characters than
letters count as one space. Each hashes to a row of an embedding table; the mean of the rows goes through
a linear layer (Joulin et al., "Bag of Tricks for Efficient Text Classification", 2016). Embeddings
and layer are trained by mini-batch gradient descent in numpy on a bounded sample of whole
documents and short pieces cut from them. A temperature fitted on documents that took no part in
training makes the scores probabilities, and the rejection thresholds are low quantiles of
confidence and of the share of known subwords among those documents.

Since the layer is linear, table times layer is one small matrix (buckets x languages), and a text's logits are the mean of
its rows: that matrix is what tasks get.

Null texts and texts without a letter are `und` with score 0 and are rejected. Empty training data
gives `und` for all. Ties between languages go to the first by name. Repeated rows are predicted each by itself; columns other
than doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm import words
from tramline.llm.sampling import bounded_sample, fold

BUCKETS = 1 << 18
ORDERS = (2, 3, 4)
DIMENSION = 16
TRAIN_PER_LANGUAGE = 300  # documents at most, the bound of the sample
CALIBRATION_PER_LANGUAGE = 200
PIECE_LENGTHS = (6, 12, 25, 50, 100, 250)  # characters of training pieces beside whole texts
REJECT_QUANTILE = 0.0005

_OTHER, _SPACE = 0, 1


def _classes() -> np.ndarray:
    """Code of each character below 0x3000: 0 for no letter, else the lower-case letter's code point."""
    codes = np.zeros(0x3000, np.uint32)
    for point in range(0x3000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            codes[point] = ord(low[0])
    return codes


_CODES = _classes()


def letters(text: str) -> np.ndarray:
    """Lower-cased letters as code points, runs of anything else as a single 1, with a 1 at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _CODES[np.minimum(points, 0x2FFF)]
    high = points >= 0x3000
    if high.any():
        rare, place = np.unique(points[high], return_inverse=True)
        codes[high] = np.array([p if chr(p).isalpha() else _OTHER for p in rare.tolist()], np.uint32)[place]
    keep = codes > _OTHER
    if not keep.any():
        return np.zeros(0, np.uint32)
    gap = ~keep
    gap[1:] &= keep[:-1]  # the first of each run of others stays, as a space
    codes = np.where(keep, codes, np.uint32(_SPACE))[keep | gap]
    pad = np.array([_SPACE], np.uint32)
    return np.concatenate([pad[int(codes[0] == _SPACE) :], codes, pad[int(codes[-1] == _SPACE) :]])


def subwords(codes: np.ndarray) -> np.ndarray:
    """Bucket of every subword, of all orders."""
    out = []
    with np.errstate(over="ignore"):
        h = codes * np.uint32(0x9E3779B1)
        for order in range(2, max(ORDERS) + 1):
            if len(codes) < order:
                break
            h = (h[: len(codes) - order + 1] ^ codes[order - 1 :]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            if order in ORDERS:
                out.append(((h * np.uint32(0xC2B2AE35)) >> np.uint32(14)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Logits per bucket, known buckets, temperature and rejection thresholds."""

    languages: tuple[str, ...]
    logits: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    known: np.ndarray  # uint8 per bucket: seen in training
    temperature: float
    least_score: float
    least_known: float

    def raw(self, text: str | None) -> tuple[np.ndarray, float] | None:
        """Mean logits and the share of known subwords; None if there is nothing to go by."""
        found = subwords(letters(text or ""))
        if not len(found):
            return None
        return self.logits[found].sum(axis=0) / len(found) + self.bias, float(self.known[found].sum(dtype=np.int64)) / len(found)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether the prediction is rejected."""
        seen = self.raw(text) if self.languages else None
        if seen is None:
            return "und", 0.0, True
        p = softmax(seen[0][None, :] * self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least_score or seen[1] < self.least_known)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(text: str, seed: int) -> list[str]:
    """The whole text and one piece of each length from a fixed pseudo-random place."""
    draw = np.random.default_rng(seed)
    cut = [text]
    for length in PIECE_LENGTHS:
        if len(text) > length:
            at = int(draw.integers(0, len(text) - length + 1))
            cut.append(text[at : at + length])
    return cut


def _examples(rows: list) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Distinct buckets of each example with their shares, so that a long text costs no more than its vocabulary."""
    found, langs = [], []
    for row in rows:
        for piece in _pieces(row.text, abs(int(row.doc_id or 0))):
            x = subwords(letters(piece))
            if len(x):
                distinct, counts = np.unique(x, return_counts=True)
                found.append((distinct, (counts / counts.sum()).astype(np.float32)))
                langs.append(row.lang)
    return found, np.array(langs)


def fit(rows: list, calibration: list, epochs: int = 5, rate: float = 0.5, batch: int = 64) -> Model:
    """Train on rows (doc_id, text, lang); calibrate on other rows of the same kind."""
    found, langs = _examples(rows)
    names = tuple(sorted(set(langs.tolist())))
    known = np.zeros(BUCKETS, np.uint8)
    if not names:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), known, 1.0, 0.0, 0.0)
    y = np.searchsorted(np.array(names), langs)
    buckets, shares = [b for b, _ in found], [s for _, s in found]
    for b in buckets:
        known[b] = 1
    draw = np.random.default_rng(7)
    table = (draw.standard_normal((BUCKETS, DIMENSION)) * 0.05).astype(np.float32)
    layer = np.zeros((DIMENSION, len(names)), np.float32)
    layer += draw.standard_normal(layer.shape).astype(np.float32) * 0.1
    bias = np.zeros(len(names), np.float32)
    steps = epochs * -(-len(found) // batch)
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(found))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            now = rate * (1 - step / steps)
            step += 1
            flat = np.concatenate([buckets[i] for i in ids])
            share = np.concatenate([shares[i] for i in ids])
            begins = np.cumsum([0] + [len(buckets[i]) for i in ids[:-1]])
            hidden = np.add.reduceat(table[flat] * share[:, None], begins, axis=0)
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(ids)), y[ids]] -= 1
            back = error @ layer.T
            layer -= now * hidden.T @ error / len(ids)
            bias -= now * error.mean(axis=0)
            # Rows of the table get the plain step per example, as in per-example descent.
            sizes = [len(buckets[i]) for i in ids]
            order_of = np.argsort(flat, kind="stable")
            rows_hit, opens = np.unique(flat[order_of], return_index=True)
            example = np.repeat(np.arange(len(ids)), sizes)
            push = (share[:, None] * back[example])[order_of]
            table[rows_hit] -= now * np.add.reduceat(push, opens, axis=0)
    logits = (table @ layer).astype(np.float32)
    logits[known == 0] = 0  # an unseen subword says nothing
    model = Model(names, logits, bias.astype(np.float32), known, 1.0, 0.0, 0.0)
    return calibrated(model, calibration)


def calibrated(model: Model, rows: list) -> Model:
    """Set temperature and thresholds from labelled rows that were not trained on."""
    seen = [(model.raw(r.text), r.lang) for r in rows if r.lang in model.languages]
    seen = [(x, lang) for x, lang in seen if x is not None]
    if not seen:
        return model
    z = np.array([x[0] for x, _ in seen])
    share = np.array([x[1] for x, _ in seen])
    y = np.searchsorted(np.array(model.languages), [lang for _, lang in seen])
    grid = np.geomspace(0.25, 16, 49)
    loss = [-np.log(softmax(z * t)[np.arange(len(y)), y] + 1e-9).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    right = softmax(z * heat).max(axis=1)
    # Below what nearly all documents of known languages reach, with a margin for what the sample missed.
    low = float(np.quantile(right, REJECT_QUANTILE))
    least = min(0.4, 0.9 * low)
    known = 0.5 * float(np.quantile(share, REJECT_QUANTILE))
    return Model(model.languages, model.logits, model.bias, model.known, heat, least, known)


def train(docs: DataFrame, allowed: Column | None = None) -> Model:
    """Fit on bounded samples of the labelled rows of `docs(doc_id, text, lang)` that `allowed` admits."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    if allowed is not None:
        labelled = labelled.where(allowed)
    part = fold(F.col("doc_id"), 16)
    most = TRAIN_PER_LANGUAGE + CALIBRATION_PER_LANGUAGE
    rows = bounded_sample(labelled.withColumn("calibrates", part % 3 == 0), "lang", F.col("doc_id"), most).collect()
    rows.sort(key=lambda r: (str(r.lang), r.doc_id if r.doc_id is not None else -1, r.text))
    return fit([r for r in rows if not r.calibrates], [r for r in rows if r.calibrates])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of `docs(doc_id, text, ...)`."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.float64()),
                    pa.array([x[2] for x in out], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return words.batched(docs).select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose language is not rejected, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not model.predict(text.as_py())[2] for text in batch.column("text")], pa.bool_()))

    return words.batched(docs).mapInArrow(keep, docs.schema)
