"""Passages of benchmark items in documents, by SimHash of item-sized windows.

A window has as many words as an item; a document with fewer words than an item is one window for it as a whole. Its 128-bit SimHash over words (Charikar, STOC 2002) is
compared with those of the items of that length by multi-index Hamming search (Norouzi et al., CVPR
2012): split into RADIUS + 1 blocks, two fingerprints within RADIUS agree on at least one block, so an
equi-join on blocks finds all of them. The candidates are verified by the exact weighted
similarity of their five-word shingles (shingles weigh as often as they occur; sum of minima over
sum of maxima, 0.75 or more). That finds copies and lightly edited ones; similar windows of a greater distance meet their item by prefixes
(Xiao et al., WWW 2008): with shingles in one fixed order, similar texts share one near the beginning.

Only windows that can pass that verification are fingerprinted: at least three quarters of the
item's shingles must be in the window, so windows with fewer shingles of any item *of that length* are left
out. Membership is looked up in a bitmap over all items' shingles, with and without their item's length, whose size follows their number up to
32 MB; its false positives cost work, never results. Bitmap, item lengths and fingerprints come from the benchmark table alone.

Nulls and texts without words contain nothing, and items of that kind are found nowhere. Documents without a
doc_id are searched as well and told apart by their texts: equal ones are one, reported with a null doc_id. An item of fewer than five
words is one shingle. Items that repeat are found under each of their ids. Columns other than doc_id / item_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm import words
from tramline.session import durable

SHINGLE, SIMILAR = 5, 0.75
HASH_BITS = 128
RADIUS = 7
BLOCKS = RADIUS + 1  # of 16 bits each
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 22, 1 << 28  # of the bitmap: 32 MB at most
WORDS_AT_ONCE = 1 << 18  # words whose bits are added up at once: bounds memory only


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints (16 bytes) of rows of word hashes: the sign of each bit's sum."""
    total = np.zeros((len(hashes), HASH_BITS), np.int32)
    for half in range(HASH_BITS // 64):
        with np.errstate(over="ignore"):
            h = np.ascontiguousarray(words.mix(hashes + np.uint64(half * 7919 + 1)))
        bits = np.unpackbits(h.view(np.uint8).reshape(*hashes.shape, 8), axis=-1)
        total[:, half * 64 : half * 64 + 64] = bits.sum(axis=1, dtype=np.int32) * 2 - hashes.shape[1]
    return np.packbits(total > 0, axis=1)


def _own_shingles(hashes: np.ndarray) -> np.ndarray:
    return words.shingle_hashes(hashes, min(SHINGLE, len(hashes))) if len(hashes) else np.zeros(0, np.uint64)


def _bit(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Place of each shingle in a bitmap of `bits`, a power of two."""
    return (shingles & np.uint64(bits - 1)).astype(np.int64)


def _of_length(shingles: np.ndarray, n: int) -> np.ndarray:
    """Other hashes for the same shingles, as shingles of items of n words."""
    with np.errstate(over="ignore"):
        return words.mix(shingles + np.uint64(n) * words.BASE)


def _prefix(shingles: np.ndarray, others: int) -> np.ndarray:
    """The first shingles in order of their hashes; one of them is in each similar text with `others` or more shingles.

    The k-th occurrence of a shingle counts as a shingle of its own, so sets stand for the weights.
    """
    shingles = np.sort(shingles)
    place = np.arange(len(shingles))
    first = np.maximum.accumulate(np.where(np.diff(shingles, prepend=~shingles[:1]) != 0, place, 0))
    with np.errstate(over="ignore"):
        own = np.sort(words.mix(shingles + (place - first).astype(np.uint64) * words.BASE))
    common = int(np.ceil(SIMILAR * (len(own) + others) / (1 + SIMILAR) - 1e-9))
    return own[: max(0, len(own) - common + 1)]


def shingles_of(text: str) -> Counter:
    """Five-word shingles with their counts; fewer words are one shingle."""
    found = text.encode().lower().split()
    k = min(SHINGLE, len(found))
    return Counter(zip(*(found[i:] for i in range(k)), strict=False)) if k else Counter()


def similarity(left: str, right: str) -> float:
    """Weighted Jaccard similarity of the shingles."""
    x, y = shingles_of(left), shingles_of(right)
    larger = (x | y).total()
    return (x & y).total() / larger if larger else 0.0


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = words.utf8(batch.column("text"))
        starts, ends, first = words.word_spans(data, bounds)
        hashes = words.word_hashes(data, starts, ends)
        ids, lengths, prints, marks, keys = [], [], [], [], []
        for i, item in enumerate(batch.column("item_id").to_pylist()):
            own = hashes[first[i] : first[i + 1]]
            if item is not None and len(own):
                ids.append(item)
                lengths.append(len(own))
                prints.append(simhash(own[None, :])[0].tobytes())
                found = _own_shingles(own)
                keys.append(_prefix(found, int(np.ceil(SIMILAR * len(found)))).view(np.int64))
                marks.append(np.unique(np.concatenate([found, _of_length(found, len(own))])).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(prints, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
            ["item_id", "item_words", "print", "marks", "keys"],
        )


def _bitmap(items: DataFrame) -> np.ndarray:
    """One byte per 8 bits, set where any item has a shingle; gathered in buckets of 32,768 bits.

    The size follows the items' shingles, so few bits are set at any size up to MOST_BITS; beyond, more windows are
    looked at than need be. Spark counts values and buckets from 1.
    """
    n = items.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0))).head()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * n).bit_length()))
    marks = items.select(F.explode("marks").alias("mark"))
    set_bits = marks.select(F.col("mark").bitwiseAND(F.lit(bits - 1).cast("long")).alias("bit")).distinct()
    parts = set_bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("part")
    )
    whole = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # at most MOST_BITS / 8 bytes in all
        at = (row.bucket - 1) * 4096
        whole[at : at + len(row.part)] = np.frombuffer(row.part, np.uint8)
    return whole


def _is_set(bitmap: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    bits = _bit(shingles, len(bitmap) * 8)
    return bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 == 1


def _windows(bitmap: np.ndarray, lengths: list[int]):
    """Function that gives the windows of documents that can be similar to an item of their length."""
    by_size = {k: [n for n in lengths if min(SHINGLE, n) == k] for k in {min(SHINGLE, n) for n in lengths}}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in words.slices(whole)):
            column = batch.column("text")
            data, bounds = words.utf8(column)
            starts, ends, first = words.word_spans(data, bounds)
            hashes = words.word_hashes(data, starts, ends)
            out: list[tuple] = []
            for k, own in by_size.items():
                shingles = words.shingle_hashes(hashes, k)
                at_hit = np.flatnonzero(_is_set(bitmap, shingles))
                # No item of these lengths can be in a document with fewer of its shingles than this.
                fewest = min(SIMILAR * (n - k + 1) for n in own)
                begins, stops = np.searchsorted(at_hit, first[:-1]), np.searchsorted(at_hit, first[1:] - k + 1)
                for i in np.flatnonzero(stops - begins >= fewest).tolist():
                    a, b = int(first[i]), int(first[i + 1])
                    near = at_hit[begins[i] : stops[i]]
                    doc = batch.column("doc_id")[i].as_py(), batch.column("text_key")[i].as_py()
                    for n in own:
                        need = SIMILAR * (n - k + 1)
                        hit = near[_is_set(bitmap, _of_length(shingles[near], n))]
                        if len(hit) < need:
                            continue
                        if b - a < n:  # too short for a window of n words: the document is the window
                            text = bytes(data[starts[a] : ends[b - 1]]).decode()
                            out.append((*doc, 0, b - a, n, simhash(hashes[None, a:b])[0].tobytes(), text))
                            continue
                        sums = np.zeros(b - a + 1, np.int64)
                        sums[hit - a + 1] = 1
                        sums = np.cumsum(sums)
                        places = np.arange(b - a - n + 1)
                        places = places[sums[places + n - k + 1] - sums[places] >= need] + a
                        for group in np.array_split(places, -(-len(places) * n // WORDS_AT_ONCE) or 1):
                            if len(group):
                                prints = simhash(hashes[group[:, None] + np.arange(n)])
                                for at, print_ in zip(group.tolist(), prints, strict=True):
                                    text = bytes(data[starts[at] : ends[at + n - 1]]).decode()
                                    out.append((*doc, at - a, n, n, print_.tobytes(), text))
                                if len(out) >= 20_000:
                                    yield _batch(out)
                                    out = []
            yield _batch(out)

    return find


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
        ["doc_id", "text_key", "word_start", "n_words", "item_words", "print", "passage"],
    )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with the prefix of their shingles, as it is for items of the length they were looked up for."""
    for batch in batches:
        data, bounds = words.utf8(batch.column("passage"))
        starts, ends, first = words.word_spans(data, bounds)
        hashes = words.word_hashes(data, starts, ends)
        keys = []
        for i, n in enumerate(batch.column("item_words").to_pylist()):
            k = min(SHINGLE, n)
            keys.append(_prefix(words.shingle_hashes(hashes[first[i] : first[i + 1]], k), n - k + 1).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("item_words", "print", "passage")), pa.array(keys, pa.list_(pa.int64()))],
            ["item_words", "print", "passage", "keys"],
        )


def _blocks(print_: str) -> Column:
    """(block, value) of each block of a fingerprint."""
    width = HASH_BITS // BLOCKS // 8
    return F.posexplode(F.array(*[F.substring(print_, 1 + i * width, width) for i in range(BLOCKS)])).alias("block", "value")


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(item_words, passage, item_id, distance) of windows and items of one length that share a block and are near.

    Random fingerprints share one of the eight blocks with a probability of 1 in 8,192, so unlike windows meet few items.
    """
    return (
        windows.select("item_words", F.col("print").alias("seen"), "passage", _blocks("print"))
        .join(items.select("item_words", "item_id", "print", _blocks("print")), ["item_words", "block", "value"])
        .withColumn("distance", _distance("seen", "print"))
        .where(F.col("distance") <= RADIUS)
        .select("item_words", "passage", "item_id", "distance")
    )


def _text_key() -> Column:
    """What tells texts of one doc_id apart, and documents without one."""
    short = F.unhex(F.lpad(F.hex(F.xxhash64("text")), 16, "0"))
    return F.when(F.col("doc_id").cast("long").isNull(), F.unhex(F.sha2("text", 256))).otherwise(short)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, word_start, n_words, similarity, distance) of each item found in a document.

    One row per document and item: the most similar window, the first of equals. `n_words` is the
    window's own, less than the item's where the document is shorter.
    """
    return _found(docs, benchmark).drop("text_key")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `leaks` with `text_key`."""
    items = durable(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
            _item_rows, "item_id long, item_words int, print binary, marks array<long>, keys array<long>"
        ),
        "decontamination-items",
    )
    lengths = sorted(r.item_words for r in items.select("item_words").distinct().collect())
    find = _windows(_bitmap(items), lengths)
    windows = durable(
        words.batched(docs).where("text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
        .mapInArrow(find, "doc_id long, text_key binary, word_start long, n_words int, item_words int, print binary, passage string"),
        "decontamination-windows",
    )
    # Equal windows of many documents are compared once.
    distinct = windows.select("item_words", "print", "passage").distinct()
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    within = within_radius(distinct, items)
    beyond = (
        distinct.mapInArrow(_keyed, "item_words int, print binary, passage string, keys array<long>")
        .select("item_words", F.col("print").alias("seen"), "passage", F.explode("keys").alias("key"))
        .join(items.select("item_words", "item_id", "print", F.explode("keys").alias("key")), ["item_words", "key"])
        .withColumn("distance", _distance("seen", "print"))
        .where(F.col("distance") > RADIUS)
        .select("item_words", "passage", "item_id", "distance")
    )
    near = within.unionByName(beyond).distinct()
    measured = (
        near.join(texts.where("item_id is not null"), "item_id")
        .mapInArrow(_verify, "item_id long, item_words int, passage string, distance int, similarity double")
        .where(F.col("similarity") >= SIMILAR)
        .distinct()
    )
    best = F.max_by(
        F.struct("word_start", "n_words", "similarity", "distance"),
        F.struct("similarity", -F.col("word_start"), -F.col("distance")),
    )
    return (
        windows.select("doc_id", "text_key", "word_start", "n_words", "item_words", "passage")
        .join(measured, ["item_words", "passage"])
        .groupBy("doc_id", "text_key", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "text_key", "item_id", "best.*")
    )


def _distance(left: str, right: str) -> Column:
    """Hamming distance of two fingerprints."""
    whole = F.lit(0)
    for at in range(0, HASH_BITS // 8, 7):  # seven bytes at a time fit a long
        size = min(7, HASH_BITS // 8 - at)
        part = [F.conv(F.hex(F.substring(c, at + 1, size)), 16, 10).cast("long") for c in (left, right)]
        whole = whole + F.bit_count(part[0].bitwiseXOR(part[1]))
    return whole.cast("int")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("passage").to_pylist(), batch.column("item_text").to_pylist(), strict=True)
        found = [similarity(a, b or "") for a, b in pairs]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("item_id", "item_words", "passage", "distance")] + [pa.array(found, pa.float64())],
            ["item_id", "item_words", "passage", "distance", "similarity"],
        )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item was found, with all their columns.

    Rows that share a doc_id are told apart by their texts.
    """
    found = _found(docs, benchmark).select(F.col("doc_id").alias("leaking_id"), F.col("text_key").alias("leaking_text")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _text_key().alias("key"))
    same = F.col("id").eqNullSafe(F.col("leaking_id")) & F.col("key").eqNullSafe(F.col("leaking_text"))
    return rows.join(found, same, "left_anti").select("row.*")
