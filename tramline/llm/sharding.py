"""Shards along a Hilbert curve over metadata, with counts at most one apart.

Language, source and size of a text are quantised to four bits each. A cell's place on the
three-dimensional Hilbert curve (Skilling, "Programming the Hilbert curve", 2004) orders the
rows; runs of equal length are cut from the order. Neighbours on the curve are close in every
dimension, so a file holds few languages, sources and sizes, and readers can skip files by any of them.

Only DataFrame functions run on the executors. The global rank comes from counts per cell and
salt, so no task sorts more than one salt of one cell (the salts follow the number of rows), and only the 4,096 cell totals meet in one task.

Null texts have no bytes; null languages and sources are values of their own. Rows that repeat are
separate rows with slots of their own. Empty tables give empty results. Other columns are carried
along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.sampling import salts_for, spread

BITS = 4
SHARDS = 16


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Place of a cell on the Hilbert curve through 2^bits cells a side."""
    x = list(point)
    top = 1 << (bits - 1)
    side = top
    while side > 1:  # undo the turns of each level
        low = side - 1
        for i in range(len(x)):
            if x[i] & side:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        side >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    flip, side = 0, top
    while side > 1:
        if x[-1] & side:
            flip ^= side - 1
        side >>= 1
    x = [v ^ flip for v in x]
    place = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | (v >> bit & 1)
    return place


def _of_name(name: Column) -> Column:
    """A name's coordinate: null first, the others by hash."""
    return F.when(name.isNull(), F.lit(0)).otherwise(F.crc32(name.cast("binary")) % (1 << BITS)).cast("int")


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def cell_of(lang: Column, source: Column, size: Column) -> Column:
    """Place of a row's cell on the curve: a look-up in the table of all cells."""
    side = 1 << BITS
    table = F.lit([hilbert_index((a, b, c)) for a in range(side) for b in range(side) for c in range(side)])
    of_size = F.least(F.floor(F.log2(size.cast("double"))), F.lit(side - 1)).cast("int")
    return F.element_at(table, _of_name(lang) * side * side + _of_name(source) * side + of_size + 1)


def shard(docs: DataFrame, shards: int = SHARDS, carry: list[str] | None = None) -> DataFrame:
    """(row, size, text_crc32, law, shard, slot, grown_shard) of each row; `row` holds the carried columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.col("doc_id").alias("key"),
        size_of(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        cell_of(F.col("lang"), F.col("source"), size_of(F.col("text"))).alias("cell"),
        F.pmod(spread(F.col("doc_id"), text), F.lit(salts_for(docs.count()))).cast("int").alias("salt"),
    )
    counts = rows.groupBy("cell", "salt").agg(F.count("*").alias("n"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n_cell"))
    along = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        "cell",
        F.coalesce(F.sum("n_cell").over(along), F.lit(0)).alias("cell_start"),
        F.sum("n_cell").over(Window.partitionBy()).alias("n_rows"),
    )
    inside = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(starts, "cell").select(
        "cell", "salt", "n_rows",
        (F.col("cell_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"),
    )
    own = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("key", "text_crc32"))
    ranked = rows.withColumn("own", own).join(offsets, ["cell", "salt"]).withColumn("rank", F.col("start") + F.col("own") - 1)
    number = F.expr(f"rank * {shards} div n_rows")
    begin = F.expr(f"(shard * n_rows + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", number.cast("int")).select(
        "row", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("rank") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
