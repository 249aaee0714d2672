"""Near-duplicate documents by one-permutation hashing with optimal densification.

One hash per shingle; its leading bits choose a bin, the least hash of a bin is its value. Empty
bins borrow from the first full one in a fixed random order of all bins, one order for each bin (Shrivastava, "Optimal
Densification for Fast and Accurate Minwise Hashing", ICML 2017), so what is borrowed does not depend on how many bins are full. Bands of bins are the buckets.
In a bucket every set is linked to one centre (a star), so candidates grow with the members. Stars
that the full sets confirm give components. A star can miss a link between two members that are not
like its centre, so buckets that hold several components are gone through once more, exactly, by
what their sets can have in common (`across_components`).

With 5 bins a band and 51 bands, two sets of similarity 0.75 miss every common bucket with a
probability of 1e-6. Of few shingles two can fall in one bin, which makes that likelier; so small sets have
the first shingles in order of their hashes as buckets besides, and similar ones share one for certain.

Nulls and texts without words have an empty set and are linked with nothing. Equal texts, and texts
with equal word sequences, collapse before hashing, so a large group of copies is one set. Rows that
repeat a doc_id are documents of their own, by their texts; rows without doc_id are linked as others are and
named after the smallest doc_id they reach, null if there is none. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm import words
from tramline.operators.components import connected_components
from tramline.session import durable, durable_counted

SHINGLE, SIMILAR = 5, 75  # words; hundredths
ROWS, BANDS = 5, 51
BINS = 256
PROBES = 64  # looked at together: most texts need no more
SMALL = 12  # shingles: sets up to here meet by shingles as well
SIZE_CLASS = 1.03  # ratio of the sizes of a class
CENTRES, SALTS = 1000, 64  # centres whose pairs are dealt out at most, and over how many keys


@lru_cache(maxsize=1)
def _probe_table() -> np.ndarray:
    """Bin that an empty bin looks at in its k-th try, each of all bins once: the same for every text."""
    cells = np.arange(BINS * BINS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.argsort(words.mix(cells * words.BASE + np.uint64(77)).reshape(BINS, BINS), axis=1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Value of every bin for the sorted distinct hashes of one text, empty bins filled."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (hashes >> shift).astype(np.int64)
    least = np.flatnonzero(np.diff(bins, prepend=-1))
    values = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    values[bins[least]] = hashes[least]
    full[bins[least]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        table = _probe_table()
        hit = full[table[empty, :PROBES]]
        chosen = table[empty, hit.argmax(axis=1)]
        lost = empty[~hit.any(axis=1)]
        if len(lost):  # few full bins: the order goes on to the first of them
            chosen[~hit.any(axis=1)] = table[lost, full[table[lost]].argmax(axis=1)]
        values[empty] = values[chosen]
    return values


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, and those of the first shingles of a small set."""
    with np.errstate(over="ignore"):
        rows = signature(hashes)[: ROWS * BANDS].reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * words.BASE
        for k in range(ROWS):
            key = words.mix(key ^ rows[:, k])
        if len(hashes) <= SMALL:  # linked sets have SIMILAR hundredths of these in common at least
            first = len(hashes) + (-SIMILAR * len(hashes)) // 100 + 1
            key = np.concatenate([key, words.mix(hashes[:first] ^ words.BASE)])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in words.slices(whole)):
        data, bounds = words.utf8(batch.column("text"))
        starts, ends, first = words.word_spans(data, bounds)
        hashes = words.word_hashes(data, starts, ends)
        sets = words.shingle_sets(hashes, first, SHINGLE)
        keys = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
        with np.errstate(over="ignore"):  # two fingerprints of the word sequence
            spread = words.mix(hashes + np.uint64(11))
            places = np.arange(len(hashes), dtype=np.uint64)
            same = []
            for i, _ in enumerate(sets):
                a, b = first[i], first[i + 1]
                place = places[: b - a] * np.uint64(2) + np.uint64(1)
                same.append(
                    words.mix((hashes[a:b] * place).sum(dtype=np.uint64, keepdims=True)).tobytes()
                    + words.mix((spread[a:b] * words.mix(place)).sum(dtype=np.uint64, keepdims=True)).tobytes()
                    + int(b - a).to_bytes(8, "big")
                )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(same, pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["doc_id", "text_key", "same", "n_shingles", "bands"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): the key tells texts of one doc_id apart."""
    return words.batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


ROW_KEY = ["id", "unnamed", "key"]


def _row_key(doc_id: Column, text_key: Column) -> list[Column]:
    """Columns without nulls that tell rows of different ids or texts apart."""
    return [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("unnamed"), text_key.alias("key")]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, same, n_shingles, bands) of each document; `same` is equal for equal word sequences."""
    return _keyed(docs).mapInArrow(_sign, "doc_id long, text_key long, same binary, n_shingles long, bands array<long>")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full shingle sets are similar enough."""

    @lru_cache(maxsize=64)
    def shingles(text: str) -> frozenset:
        found = words_of(text)
        return frozenset(zip(*(found[k:] for k in range(SHINGLE)), strict=False)) if len(found) >= SHINGLE else frozenset([tuple(found)] if found else [])

    def words_of(text: str) -> list[bytes]:
        return text.encode().lower().split()  # of bytes: A-Z only, and exactly the six spaces

    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            x, y = shingles(left.as_py()), shingles(right.as_py())
            both = len(x & y)
            keep.append(both > 0 and 100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"]
        )


def confirmed(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that are linked by their full sets; `pairs` are many for a centre `a`.

    A centre with at least a `CENTRES`-th of all pairs has them dealt over `SALTS` keys, its text with each; there
    are `CENTRES` such centres at most, so the list of them is bounded.
    """
    pairs, seen = durable_counted(pairs, f"{name}-pairs", n=F.count(F.lit(1)))
    of_centre = pairs.groupBy("a").agg(F.count("*").alias("n"))
    many = (F.col("n") * CENTRES >= seen["n"]) & (F.col("n") > SALTS)
    crowded = [r.a for r in of_centre.where(many).collect()] if seen["n"] > SALTS else []
    dealt = F.col("a").isin(crowded) if crowded else F.lit(False)
    salt = F.when(dealt, F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    salts = F.when(dealt, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return durable(
        pairs.withColumn("salt", salt)
        .join(left.withColumn("salt", F.explode(salts)), ["a", "salt"])
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(_verify, "a long, b long"),
        name,
    )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in words.slices(whole)):
        data, bounds = words.utf8(batch.column("text"))
        starts, ends, first = words.word_spans(data, bounds)
        sets = words.shingle_sets(words.word_hashes(data, starts, ends), first, SHINGLE)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"]
        )


def _open(members: DataFrame, by: list[str]) -> DataFrame:
    """The rows of groups that hold more than one component."""
    mixed = members.groupBy(*by).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return members.join(mixed.select(*by), by)


def _can_reach(common: Column, left: Column, right: Column) -> Column:
    """Whether sets of these sizes with so many common shingles at most can be linked."""
    return 100 * common >= SIMILAR * (left + right - common)


def _least_common(sizes: Column) -> Column:
    """Common shingles that linked sets of this total size have at least."""
    return F.ceil(SIMILAR * sizes / (100.0 + SIMILAR) - 1e-9)


def across_components(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can be linked at all, among documents of open buckets.

    A bucket is open if it holds several components. Shingles that no other document of an open bucket has are common to no
    pair; counting them bounds what a document can share with any set of its bucket. Documents that
    were edited too much to be linked leave their buckets by that bound, and most buckets close.

    Those that are left are paired by prefixes (Xiao et al., "Efficient Similarity Joins for Near Duplicate
    Detection", WWW 2008): with the shingles of each set in order of rarity, linked sets have a common
    shingle near the beginning, so edited copies meet where they share an edit and not where all copies agree.
    How near depends on the sizes of both, hence on the size class of the smaller one.
    """
    members = durable(_open(members, ["bucket"]), "minhash-open")

    def shingles_of(ids: DataFrame) -> DataFrame:
        return (
            texts.join(ids, "node", "left_semi")
            .mapInArrow(_shingles, "node long, shingles array<long>")
            .select("node", F.explode("shingles").alias("shingle"))
        )

    own = (
        shingles_of(members.select("node").distinct())
        .groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
        .groupBy("node").agg(F.count("*").alias("n_own"))
    )
    sized = members.join(own, "node", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("n_own", F.lit(0)))
    least = members.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    # The partner that suits best has as many shingles as can be shared, or as few as the bucket offers.
    partner = F.greatest(F.col("least"), F.col("shared"))
    alive = durable(
        _open(sized.join(least, "bucket").where(_can_reach(F.col("shared"), F.col("n_shingles"), partner)), ["bucket"])
        .select("node", "n_shingles", "shared", "component").distinct(),
        "minhash-alive",
    )
    rows = shingles_of(alive.select("node"))
    rarity = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    ordered = rows.join(rarity, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    n = F.col("n_shingles")
    step = math.log(SIZE_CLASS)
    size_class = lambda size: F.floor(F.log(size.cast("double")) / step + 1e-9)
    whole = ordered.join(alive, "node").withColumn("s", F.transform("s", lambda x: x["shingle"]))
    smallest = F.greatest(F.floor(F.pow(F.lit(SIZE_CLASS), F.col("class")) - 1e-6), F.ceil(n * SIMILAR / 100.0 - 1e-9))
    low = size_class(F.greatest(F.lit(1), F.floor(n * SIMILAR / 100.0)))
    as_small = whole.select("*", size_class(n).alias("class"), F.lit(True).alias("small"))
    as_large = whole.select("*", F.explode(F.sequence(low, size_class(n))).alias("class"), F.lit(False).alias("small"))
    prefix = n - _least_common(n + F.when(F.col("small"), n).otherwise(smallest)) + 1
    begun = as_small.unionByName(as_large).withColumn("prefix", F.least(n, F.greatest(prefix, F.lit(1))).cast("int"))
    keyed = begun.select(
        "class", F.explode(F.slice("s", F.lit(1), F.col("prefix"))).alias("shingle"),
        "node", "n_shingles", "shared", "component", "small",
    )
    keyed = durable(_open(keyed, ["class", "shingle"]), "minhash-prefixes")
    # A common shingle is a large group of one component: only the others are paired with it.
    main = (
        keyed.groupBy("class", "shingle", "component").agg(F.count("*").alias("n"))
        .groupBy("class", "shingle").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    )
    keyed = keyed.join(main, ["class", "shingle"]).withColumn("in_main", F.col("component") == F.col("main"))
    x, y = keyed.where("small").alias("x"), keyed.where("not small").alias("y")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(
            right,
            (F.col("x.class") == F.col("y.class"))
            & (F.col("x.shingle") == F.col("y.shingle"))
            & (F.col("x.component") != F.col("y.component"))
            & (F.struct("x.n_shingles", "x.node") < F.struct("y.n_shingles", "y.node"))
            & _can_reach(F.least("x.shared", "y.shared"), F.col("x.n_shingles"), F.col("y.n_shingles")),
        ).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    return pairs(x.where("not in_main"), y).union(pairs(x.where("in_main"), y.where("not in_main"))).distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (same, first) of each group of copies: the first row of its component.

    A first row is (unnamed, doc_id, text_key), least doc_ids first and rows without one last.
    """
    signed = durable(signatures(docs), "minhash-signed")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    groups = durable(
        signed.where("n_shingles > 0")
        .groupBy("same")
        .agg(F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        # Numbered in order of doc_ids, as what others were made of often comes first and is the best centre.
        .repartitionByRange("first").sortWithinPartitions("first")
        .withColumn("node", F.monotonically_increasing_id()),  # written once, so it stays
        "minhash-groups",
    )
    members = groups.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    buckets = durable(members.join(stars.select("bucket", "centre"), "bucket"), "minhash-buckets")
    wanted = groups.join(buckets.select("node").distinct(), "node", "left_semi")
    texts = durable(
        _keyed(docs).select(*_row_key(F.col("doc_id"), F.col("text_key")), "text")
        .join(wanted.select("node", *_row_key(F.col("first.doc_id"), F.col("first.text_key"))), ROW_KEY)
        .groupBy(*ROW_KEY).agg(F.first("node").alias("node"), F.min("text").alias("text"))
        .select("node", "text"),
        "minhash-texts",
    )
    tried = durable(
        buckets.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(),
        "minhash-stars",
    )
    links = confirmed(tried, texts, "minhash-links")
    found = connected_components(links)
    placed = buckets.join(found, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    more = confirmed(across_components(placed, texts).join(tried, ["a", "b"], "left_anti"), texts, "minhash-more")
    if not more.isEmpty():
        found = connected_components(links.union(more))
    nodes = groups.select("same", "node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = nodes.groupBy("component").agg(F.min("first").alias("first"))
    return signed, nodes.select("same", "component").join(firsts, "component").select("same", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs(doc_id, text, ...)`."""
    signed, classes = _classes(docs)
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = signed.where("n_shingles > 0").join(classes, "same").select(
        "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id")
    )
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are the first of their group of near duplicates, with all their columns.

    Rows that share a doc_id are documents of their own: one stays if it is the first of its group. Of rows equal in
    doc_id and text one stays. Rows without words have nothing to be linked to and all stay. Rows without doc_id
    come last in their group.
    """
    _, classes = _classes(docs)
    kept = classes.select(*_row_key(F.col("first.doc_id"), F.col("first.text_key"))).distinct()
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), *_row_key(F.col("doc_id").cast("long"), F.xxhash64("text")),
        words.has_words(F.col("text")).alias("full"),
    )
    once = rows.where("full").join(kept, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return once.select("row.*").unionByName(rows.where("not full").select("row.*"))
