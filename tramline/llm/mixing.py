"""Mixing sources to target weights by fitting a budget of words per source.

Sources get shares of a total budget by weight; a share stops at a multiple of what the source
holds and the excess goes to the others by weight. Inside a source the budget is whole copies of
everything plus a remainder below one copy. The remainder is a subset-sum problem over the
*counts of documents by exact length*: an even part of each length first, then a bounded-knapsack
dynamic programme for what is left, so the total meets the budget exactly wherever lengths allow.
Which documents of a length are taken is decided by a seeded hash of doc_id, or of the text where that is null.

Null texts have size 0, null sources are one source, placed last. Documents of size 0 take nothing.
Rows that repeat are separate documents. Empty tables give empty results. Other columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.sampling import salts_for, spread

WEIGHTS = (3.0, 1.0, 2.0)  # repeating over the sources in order of their names
TOTAL_SHARE = 1.5  # of all words
MOST_COPIES = 2
DP_BUDGET = 1 << 16  # words that the dynamic programme spends; larger remainders are cut down to it first


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Add `target` to one row per source (key, source, source_size).

    With shares proportional to weight, sources fill up in order of cap / weight; the level is that
    of the first source, in this order, which the remaining budget no longer fills.
    """
    named = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cap = float(MOST_COPIES) * F.col("source_size")
    capped = named.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ).withColumns({"cap": cap, "fills_at": cap / F.col("weight")})
    everything = Window.partitionBy()
    before = Window.orderBy("fills_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        TOTAL_SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = capped.withColumn("level", level)
    open_level = found.withColumn("level", F.when(F.col("level") <= F.col("fills_at"), F.col("level")))
    # min_by skips nothing, so sources that are full are put behind the others.
    order = F.struct(F.col("level").isNull(), F.col("fills_at"), F.col("place"))
    first = F.min_by(F.col("level"), order).over(everything)
    return open_level.select(
        "key", "source", "source_size", F.least(F.col("cap"), first * F.col("weight")).alias("target")
    )


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to `budget`, or just below."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.array([int(n) * budget // total for n in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # the longest first, until the rest is small enough to be solved exactly
        if left <= DP_BUDGET:
            break
        more = min(int(counts[i] - taken[i]), -(-(left - DP_BUDGET) // int(lengths[i])), left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    # Sums that can be reached, as bits of a number; counts are split into powers of two.
    reach, steps = 1, []
    for i in order:
        length, free = int(lengths[i]), int(counts[i] - taken[i])
        free = min(free, left // length) if length <= left else 0
        part = 1
        while free > 0 and not reach >> left & 1:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= (reach << part * length) & ((1 << left + 1) - 1)
            free -= part
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def _plan_source(hist: pd.DataFrame) -> pd.DataFrame:
    """Copies for all and the number of documents with one more, for each length of one source."""
    hist = hist.sort_values("size")
    size, target = int(hist["source_size"].iloc[0]), float(hist["target"].iloc[0])
    copies = min(MOST_COPIES, int(target // size)) if size else 0
    rest = int(target - copies * size) if copies < MOST_COPIES else 0
    lengths, counts = hist["size"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    some = np.zeros(len(hist), np.int64)
    real = lengths > 0
    some[real] = fit_budget(lengths[real], counts[real], rest)
    return pd.DataFrame({"key": hist["key"], "size": lengths, "copies": copies, "extra": some})


def mix(docs: DataFrame, carry: list[str] | None = None, seed: int = 17) -> DataFrame:
    """(row, size, source_size, target, copies) of each document: `row` holds the carried columns.

    `copies` is how often the mix takes the document, 0 to MOST_COPIES; `carry` is all of the columns
    unless named.
    """
    # Key text: never null, and a null source apart from every named one.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    draw = spread(F.col("doc_id").cast("string"), F.col("text"), F.lit(seed))
    salts = salts_for(docs.count())  # parts into which the documents of one source and length are dealt for ranking
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        key.alias("key"),
        F.col("source").alias("source"),
        word_count(F.col("text")).alias("size"),
        draw.alias("draw"),
        F.pmod(F.shiftrightunsigned(draw, 20), F.lit(salts)).cast("int").alias("salt"),
    )
    parts = rows.groupBy("key", "source", "size", "salt").agg(F.count("*").alias("n"))
    hist = parts.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    shares = targets(hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = (
        hist.drop("source")
        .join(shares.drop("source"), "key")
        .groupBy("key")
        .applyInPandas(_plan_source, "key string, size long, copies int, extra long")
    )
    before = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.drop("source")
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
        .join(plan, ["key", "size"])
        .join(shares.drop("source"), "key")
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("draw"))
    return (
        rows.withColumn("rank", rank)
        .join(placed, ["key", "size", "salt"])
        .select(
            "row", "size", "source_size", "target",
            (F.col("copies") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("int")).alias("copies"),
        )
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken."""
    return (
        mix(docs)
        .where("copies > 0 and size > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row.*")
    )
