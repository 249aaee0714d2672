"""Approximate nearest neighbours by a permutation index (Amato and Savino, "Approximate Similarity Search in
Metric Spaces Using Inverted Files", INFOSCALE 2008).

A vector is represented by its nearest pivots in order of distance. In a block of vectors, each pivot has
an inverted file: the vectors that have it among their nearest, with its place in their order. A query goes through the
files of its own pivots and ranks the block by Spearman's footrule between the orders, where a pivot that one of them lacks
counts as coming behind all. With places p and q of a common pivot out of K, the footrule is a constant less twice
the sum of K - max(p, q), so one pass over the files adds it up. The best share of the block is
compared with the query exactly, in double precision, and the ten nearest are kept; blocks are merged per query.

Pivots are the vectors of least hash among all. The share to rerank is fitted on a bounded sample: the least that reaches
`TARGET_RECALL` there among shares of a geometric grid. A block gives eleven candidates at least, so a query finds ten where there are ten.

Work is dealt by (block of queries, shard of vectors), both of bounded size or streamed: a task holds one block of queries and
one block of vectors at a time. Every vector is in the index. The queries are compared with it block by block and nothing
is emitted but the ten nearest of each query in a shard.

Vectors that are null, zero, or hold a null or a component that is not finite take no part, nor do those with a null id.
Vectors of another length than most (ties: the shorter) take no part. Rows with the same id and vector count
once; one id with several vectors is a row each, and a query never meets a row of its own id. Ties go to the
smaller id. Fewer than ten candidates give all of them. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import durable

NEAREST = 10
PIVOTS = 256
ORDER = 64  # nearest pivots that represent a vector
SAMPLE = 4096  # vectors the share is fitted on
SAMPLE_QUERIES = 256
TARGET_RECALL = 0.98
BLOCK = 2048  # vectors whose inverted files are in memory at once
QUERY_BLOCK = 1024
SHARD = 65_536  # vectors that one block of queries meets in one task
LEAST_SHARD = 512  # shards are not cut smaller to keep all tasks busy


@dataclass(frozen=True)
class Index:
    """The pivots, how many of them represent a vector, and the share of a block to rerank."""

    pivots: np.ndarray
    order: int
    share: float

    def orders(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first, ties by number."""
        distance = (self.pivots**2).sum(axis=1)[None, :] - 2.0 * vectors @ self.pivots.T
        return np.argsort(distance, axis=1, kind="stable")[:, : self.order].astype(np.int16)


class InvertedFiles:
    """For each pivot of a block: the vectors that have it, and its place in their order."""

    def __init__(self, orders: np.ndarray, n_pivots: int) -> None:
        self.rows, self.order = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.vectors, self.places = by_pivot // self.order, by_pivot % self.order
        self.begins = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Sum of K - max(places) over common pivots for each vector: the more, the less the footrule."""
        spans = [slice(self.begins[p], self.begins[p + 1]) for p in order]
        vectors = np.concatenate([self.vectors[s] for s in spans])
        gains = np.concatenate([self.order - np.maximum(self.places[s], i) for i, s in enumerate(spans)])
        return np.bincount(vectors, gains, self.rows)


def candidates(agreement: np.ndarray, share: float) -> np.ndarray:
    """The share of best agreement, eleven at least; ties to the smaller row, so to the smaller id."""
    most = max(NEAREST + 1, int(np.ceil(share * len(agreement))))
    if most >= len(agreement):
        return np.arange(len(agreement))
    ranked = (-agreement * len(agreement)).astype(np.int64) + np.arange(len(agreement))
    return np.argpartition(ranked, most - 1)[:most]


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def fit(sample: np.ndarray) -> Index:
    """Pivots and share from vectors in random order (a matrix of doubles, perhaps of no rows)."""
    pivots = sample[:PIVOTS]
    index = Index(pivots, min(ORDER, len(pivots)), 1.0)
    if len(sample) <= NEAREST + 1:
        return index
    orders = index.orders(sample)
    files = InvertedFiles(orders, len(pivots))
    found = []  # place of each true neighbour in the ranking by footrule
    for i in range(max(0, len(sample) - SAMPLE_QUERIES), len(sample)):  # the last ones: no pivots if there are others
        exact = distances(sample[i], sample)
        agreement = files.agreement(orders[i])
        exact[i], agreement[i] = np.inf, -1
        place = np.empty(len(sample))
        place[np.argsort(-agreement, kind="stable")] = np.arange(len(sample))
        found.append(place[np.argpartition(exact, NEAREST)[:NEAREST]])
    places = np.concatenate(found) + 2  # candidates needed, with the query's own row
    for share in np.geomspace(0.01, 1.0, 25):
        if (places <= share * len(sample)).mean() >= TARGET_RECALL:
            return Index(pivots, index.order, float(share))
    return index


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, vector) of the rows that take part, once each."""
    kind = rows.schema[vector].dataType.simpleString()
    values = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    big = float("inf")
    fit_for_use = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("vector", lambda x: x != 0)
    found = rows.select(F.col(key).cast("long").alias("vec_id"), values.alias("vector")).where("vec_id is not null")
    found = found.where(F.coalesce(fit_for_use, F.lit(False)))
    length = found.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    usual = length.orderBy(F.desc("n"), "length").head()
    return found.where(F.size("vector") == (usual.length if usual else 0)).distinct()


def _matrix(array: pa.ListArray, length: int) -> np.ndarray:
    return np.asarray(array.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(array), length)


def indexed(vectors: DataFrame, index: Index) -> DataFrame:
    """`vectors` with the order of each one's nearest pivots."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # PIVOTS vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                orders = index.orders(_matrix(batch.column("vector"), index.pivots.shape[1]))
                offsets = np.arange(len(orders) + 1, dtype=np.int32) * index.order
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(orders.ravel(), pa.int16()))],
                    ["vec_id", "vector", "pivots"],
                )

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.mapInArrow(place, f"vec_id long, vector {kind}, pivots array<short>")


FOUND = "query_id long, query_key long, vec_id long, score double"


class _Search:
    """One block of queries in one shard: it takes vectors in order of id and keeps the nearest of each query."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.length = index.pivots.shape[1]
        self.reset()

    def reset(self) -> None:
        self.queries: list[pa.RecordBatch] = []
        self.waiting: list[pa.RecordBatch] = []
        self.n_waiting = 0
        self.best: list[tuple[np.ndarray, np.ndarray]] | None = None

    def add_queries(self, rows: pa.RecordBatch) -> None:
        self.queries.append(rows)

    def add_vectors(self, rows: pa.RecordBatch) -> None:
        self.waiting.append(rows)
        self.n_waiting += rows.num_rows
        if self.n_waiting >= BLOCK:
            self.meet()

    def meet(self) -> None:
        """Compare all queries with the vectors that are waiting."""
        if not self.n_waiting or not self.queries:
            self.waiting, self.n_waiting = [], 0
            return
        if self.best is None:
            table = pa.Table.from_batches(self.queries).combine_chunks()
            self.ids = table.column("vec_id").to_numpy()
            self.keys = table.column("row_key").to_numpy()
            self.points = _matrix(table.column("vector").combine_chunks(), self.length)
            self.orders = _matrix(table.column("pivots").combine_chunks(), self.index.order).astype(np.int64)
            self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(self.ids)
        table = pa.Table.from_batches(self.waiting).combine_chunks()
        self.waiting, self.n_waiting = [], 0
        for at in range(0, table.num_rows, BLOCK):
            part = table.slice(at, BLOCK)
            ids = part.column("vec_id").to_numpy()
            points = _matrix(part.column("vector").combine_chunks(), self.length)
            files = InvertedFiles(
                _matrix(part.column("pivots").combine_chunks(), self.index.order).astype(np.int64), len(self.index.pivots)
            )
            for i, query_id in enumerate(self.ids):
                chosen = candidates(files.agreement(self.orders[i]), self.index.share)
                chosen = chosen[ids[chosen] != query_id]
                score = np.concatenate([self.best[i][0], distances(self.points[i], points[chosen])])
                found = np.concatenate([self.best[i][1], ids[chosen]])
                if len(score) > NEAREST:
                    cut = np.partition(score, NEAREST - 1)[NEAREST - 1]
                    near = np.flatnonzero(score <= cut)
                    near = near[np.lexsort((found[near], score[near]))[:NEAREST]]
                    score, found = score[near], found[near]
                self.best[i] = (score, found)

    def result(self) -> pa.RecordBatch | None:
        self.meet()
        if self.best is None:
            return None
        n = [len(x[0]) for x in self.best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, n)), pa.array(np.repeat(self.keys, n)),
                pa.array(np.concatenate([x[1] for x in self.best])), pa.array(np.concatenate([x[0] for x in self.best])),
            ],
            ["query_id", "query_key", "vec_id", "score"],
        )


def search(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of `usable` vectors for each of them that `is_query` admits."""
    vectors = durable(vectors, "permutations-vectors")
    spark = vectors.sparkSession
    random = F.xxhash64("vec_id", F.lit("pivots"))
    rows = vectors.select("vec_id", "vector").orderBy(random, "vec_id", "vector").limit(SAMPLE).collect()
    length = len(rows[0].vector) if rows else 1
    index = fit(np.array([r.vector for r in rows], np.float64).reshape(len(rows), length))
    # The key tells rows of one id apart and deals them out; equal rows were made one.
    posted = durable(
        indexed(vectors, index).withColumn("row_key", F.xxhash64("vec_id", "vector")).withColumn("asks", is_query),
        "permutations-index",
    )
    sizes = posted.agg(F.count("*").alias("all"), F.count_if("asks").alias("queries")).head()
    blocks = max(1, -(-sizes["queries"] // QUERY_BLOCK))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-sizes["all"] // SHARD), min(-(-sizes["all"] // LEAST_SHARD), -(-tasks // blocks)))
    block = F.pmod(F.xxhash64("row_key", F.lit("block")), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("row_key", F.lit("shard")), F.lit(shards)).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    columns = ["vec_id", "row_key", "vector", "pivots"]
    asked = posted.where("asks").select(block.alias("block"), F.explode(numbers(shards)).alias("shard"), F.lit(False).alias("posted"), *columns)
    all_rows = posted.select(F.explode(numbers(blocks)).alias("block"), shard.alias("shard"), F.lit(True).alias("posted"), *columns)
    pairs = min(blocks * shards, max(tasks, 1) * 8)
    dealt = (
        asked.unionByName(all_rows)
        .repartition(pairs, "block", "shard")
        .sortWithinPartitions("block", "shard", "posted", "vec_id", "row_key")
    )
    shared = spark.sparkContext.broadcast(index)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = _Search(shared.value), None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "shard", "posted")])
            edges = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
            for begin, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if begin == stop:
                    continue
                now = tuple(key[:2, begin].tolist())
                if now != at:
                    if (done := state.result()) is not None:
                        yield done
                    state.reset()
                    at = now
                part = batch.slice(begin, stop - begin).select(columns)
                (state.add_vectors if key[2, begin] else state.add_queries)(part)
        if (done := state.result()) is not None:
            yield done

    found = dealt.mapInArrow(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame) -> DataFrame:
    """The ten nearest found for every row of `rows(vec_id, embedding, ...)` whose id is divisible by 100."""
    return search(usable(rows), F.col("vec_id") % 100 == 0)
