"""Words and word shingles of a batch of texts, as arrays of numbers.

A word is a run of bytes outside space and 0x09-0x0D; A-Z count as a-z. Every function works on
whole texts and handles nulls (as empty), empty texts and empty batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT_BYTES = 1 << 20  # bytes hashed at once: bounds memory, not what is read
SLICE_BYTES = 4 << 20  # bytes of text worked on at once
BATCH_BYTES = 8 << 20  # of Arrow batches between Spark and Python

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry for the end)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text (plus the end)."""
    inside = ~SPACES[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    if len(_powers.get(key, ())) < n:
        with np.errstate(over="ignore"):
            powers = np.full(max(n, SEGMENT_BYTES), base, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers)
        if n > SEGMENT_BYTES:
            return powers
        _powers[key] = powers
    return _powers[key]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z as a-z: differences of a running polynomial sum."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + SEGMENT_BYTES, "right")))
        size = int(ends[stop - 1] - begin)
        with np.errstate(over="ignore"):
            codes = LOWER[data[begin : begin + size]].astype(np.uint64)
            codes += np.uint64(1)
            codes *= _powers_of(BASE, size)[:size]
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(codes, out=sums[1:])
            s, e = starts[at:stop] - begin, ends[at:stop] - begin
            h = (sums[e] - sums[s]) * _powers_of(BASE_INVERSE, size)[s]
            out[at:stop] = mix(h + (e - s).astype(np.uint64))
        at = stop
    return out


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of `length` words that begins at each word; the last length - 1 are left out."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, length):
            h *= BASE
            h += words[k : n + k]
            h ^= h >> np.uint64(29)
        return mix(h)


def shingle_sets(words: np.ndarray, first: np.ndarray, length: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, one without words none."""
    runs = shingle_hashes(words, length)
    sets = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= length:
            sets.append(np.unique(runs[a : b - length + 1]))
        elif b > a:
            sets.append(shingle_hashes(words[a:b], int(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have `most` bytes together, or one longer text; in order, all rows.

    Arrays made of a slice are a few times its size, whatever the size of the batch.
    """
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def batched(docs: DataFrame) -> DataFrame:
    """`docs`, with Arrow batches of BATCH_BYTES from here on, unless the session has its own bound.

    By default a batch is up to 10,000 rows of 64 MB, of which the JVM and each Python worker hold copies.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b") == str(64 << 20):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def has_words(text: Column) -> Column:
    """Whether a text has a word; false for null."""
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores behind it until no column is called so."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
