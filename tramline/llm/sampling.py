"""Folds by doc_id, and bounded samples of labelled rows for fitting.

A sample is the rows of least hash in each class, so it is the same whenever the input is, and its
size has the bound that the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id written as text, modulo `folds`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(rows: DataFrame, by: str, order: Column, most: int) -> DataFrame:
    """At most about `most` rows of each value of `by`, those of least `order` hash.

    Counts per class give the share to keep; a hash threshold keeps it without a sort of the whole
    class, and the rank that makes the bound exact sees only rows under the threshold.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("n_of_class"))
    share = F.least(F.lit(1.0), F.lit(1.2 * most + 100) / F.col("n_of_class"))
    draw = F.xxhash64(order.cast("string"), F.lit("sample"))
    unit = (F.shiftrightunsigned(draw, 11).cast("double")) / float(1 << 53)
    near = rows.join(F.broadcast(counts), by).where(unit < share).drop("n_of_class")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw, order))
    return near.withColumn("rank_of_class", rank).where(F.col("rank_of_class") <= most).drop("rank_of_class")


LEAST_SALTS, SALT_ROWS = 64, 500_000


def salts_for(rows: int) -> int:
    """Parts into which groups of a table are dealt: one group may hold most rows, and a part of it stays below SALT_ROWS."""
    return max(LEAST_SALTS, -(-rows // SALT_ROWS))


def spread(doc_id: Column, text: Column, *seed: Column) -> Column:
    """A hash of each document: of its id, and of its text where it has none, so that such rows spread as well."""
    return F.when(doc_id.isNull(), F.xxhash64(text, F.lit("no id"), *seed)).otherwise(F.xxhash64(doc_id, *seed))
