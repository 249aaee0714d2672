"""Fingerprints of texts by a randomised edit embedding.

A walk reads a text from the left. At step j it writes the character it stands on and moves on if
a shared random bit for (j, character) is one. Walks over two texts that differ by few edits fall into step again, so
edit distance becomes Hamming distance of what they write (Chakraborty, Goldenberg, Koucky,
"Streaming algorithms for embedding and computing edit distance", STOC 2016). Random bits repeat after
PERIOD steps, which bounds the table whatever the length of texts.

What is kept is a stratified sample of the steps: SAMPLES places in [0, 64) and in every doubling after it, the
same for all texts, one hexadecimal digit each (a hash of the character there and the two before
it). Texts of any two lengths are thus comparable. The likeness of two fingerprints is the share
of equal digits, each stratum weighing as many steps as it spans.

Documents whose digits agree on a band of sampled places are candidates (`near_groups`): bands are drawn from the
last full stratum, buckets are stars around their smallest doc_id, and candidates are verified by likeness. Links
between two members that are unlike that centre are not found. `compare_with_next` uses no bands.

Rows without a doc_id have no place in the order and are left out of the result. A null text
counts as empty. An empty text has an empty fingerprint, like itself alone. Repeated doc_ids follow each other in
order of their texts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import words
from tramline.session import durable

CLASSES, PERIOD = 64, 1 << 15
FIRST, SAMPLES = 64, 32
STRATA = 32  # enough for texts of 2^37 steps
BANDS, BAND_DIGITS = 8, 6
BATCH_CHARS = 1 << 22  # characters walked together: bounds memory only
LOOPS_FROM = 160  # fewer texts than this at a step: plain loops are faster than array calls
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _dwell() -> np.ndarray:
    """Steps a walk stays on a character of each class that it reaches at each step (of a period)."""
    cells = np.arange(CLASSES * PERIOD, dtype=np.uint64)
    with np.errstate(over="ignore"):
        moves = (words.mix(cells * words.BASE + np.uint64(5)) & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    moves[:, -1] = True  # the longest stay ends with the period
    stay = np.zeros((CLASSES, PERIOD), np.int32)
    ahead = np.zeros(CLASSES, np.int32)
    for j in range(PERIOD - 1, -1, -1):
        ahead = np.where(moves[:, j], 1, ahead + 1)
        stay[:, j] = ahead
    return stay.ravel()


def _places() -> np.ndarray:
    """Sampled steps: SAMPLES in [0, FIRST), then as many in each doubling."""
    draw = np.random.default_rng(3)
    spans = [(0, FIRST)] + [(FIRST << k, FIRST << (k + 1)) for k in range(STRATA - 1)]
    return np.concatenate([np.sort(draw.choice(min(b - a, 1 << 20), SAMPLES, replace=False) * max(1, (b - a) >> 20) + a) for a, b in spans])


_tables: dict[str, np.ndarray] = {}


def _table(name: str, make) -> np.ndarray:
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def _walk(codes: np.ndarray, bounds: np.ndarray, known: list[np.ndarray] | None = None) -> np.ndarray:
    """Step at which each character of each text is reached; texts of one batch walk side by side.

    `known` has, for each text, the steps of its first characters and of the one after them, if they
    were walked before.
    """
    dwell = _table("dwell", _dwell)
    place = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int32) * np.int32(PERIOD)
    lengths = np.diff(bounds)
    steps = np.zeros(len(codes), np.int32)
    now, begins, sizes = np.zeros(len(lengths), np.int64), bounds[:-1].copy(), lengths.copy()
    for t, walked in enumerate(known or []):
        if len(walked):
            n = len(walked) - 1
            steps[begins[t] : begins[t] + n] = walked[:n]
            now[t] = walked[n]
            begins[t] += n
            sizes[t] -= n
    order = np.argsort(-sizes, kind="stable")
    begins, sizes, now = begins[order], sizes[order], now[order]
    turn = np.int64(PERIOD - 1)
    walking = len(order)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        while walking and sizes[walking - 1] <= i:
            walking -= 1
        if walking < LOOPS_FROM:
            for t in range(walking):
                _walk_on(place, steps, int(begins[t]) + i, int(begins[t] + sizes[t]), int(now[t]), dwell)
            break
        at = begins[:walking] + i
        j = now[:walking]
        steps[at] = j
        j += dwell[place[at] + (j & turn)]
    return steps


def _walk_on(place: np.ndarray, steps: np.ndarray, a: int, b: int, j: int, dwell: np.ndarray) -> None:
    if "dwell_bytes" not in _tables:
        _tables["dwell_bytes"] = dwell.astype(np.uint8).tobytes()
    stay, turn = _tables["dwell_bytes"], PERIOD - 1
    out = []
    put = out.append
    for p in place[a:b].tolist():
        put(j)
        j += stay[p + (j & turn)]
    steps[a:b] = out


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about BATCH_CHARS characters."""
    at, sizes = 0, np.cumsum([len(t) for t in texts])
    while at < len(texts):
        used = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, used + BATCH_CHARS, "right")))
        yield at, stop
        at = stop


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text: one digit per sampled step, up to the stratum in which the walk ends."""
    return [print_ for a, b in chunks(texts) for print_ in walked(texts[a:b])[0]]


def walked(texts: list[str], known: list[np.ndarray] | None = None) -> tuple[list[str], list[np.ndarray]]:
    """Fingerprints of a few texts and the steps of their characters; `known` as for the walk."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    steps = _walk(codes, bounds, known)
    with np.errstate(over="ignore"):
        h = codes * np.uint32(0x85EBCA6B)
        seen = h.copy()
        seen[1:] += h[:-1] * np.uint32(31)
        seen[2:] += h[:-2] * np.uint32(961)
        for back in (0, 1):  # nothing before the first character
            edge = bounds[:-1][np.diff(bounds) > back] + back
            seen[edge] = h[edge] + (h[edge - 1] * np.uint32(31) if back else np.uint32(0))
        seen = words.mix(seen.astype(np.uint64))
    digits = HEX[(seen >> np.uint64(60)).astype(np.int64)]
    places = _table("places", _places)
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            out.append("")
            continue
        own = steps[a:b]
        # The last character is held to the end of its stratum.
        strata = max(0, int(np.ceil(np.log2((own[-1] + 1) / FIRST)))) + 1
        hit = np.searchsorted(own, places[: strata * SAMPLES], "right") - 1
        past = places[: strata * SAMPLES] > own[-1] + 1
        row = digits[a:b][hit].copy()
        row[past] = ord("-")
        out.append(row.tobytes().decode())
    return out, [steps[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def likeness(left: str, right: str) -> float:
    """Share of equal digits, strata weighted by their spans; 1 for equal fingerprints, 0 beside an empty one."""
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0
    size, n = max(len(left), len(right)), min(len(left), len(right))
    same = np.zeros(size, bool)
    x, y = np.frombuffer(left.encode(), np.uint8)[:n], np.frombuffer(right.encode(), np.uint8)[:n]
    same[:n] = (x == y) & (x != ord("-"))
    real = np.ones(size, bool)
    real[:n] = ~((x == ord("-")) & (y == ord("-")))
    weight = np.repeat([1.0] + [2.0**k for k in range(size // SAMPLES - 1)], SAMPLES)
    return float((weight * same).sum() / (weight * real).sum())


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """(part, copy, doc_id, text): ranges of doc_id, each with a copy of the row that follows it.

    Range bounds are quantiles of doc_id, so a part is a fixed set of rows whatever task computes it.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(cuts or []))
    part = F.lit(0)
    if bounds:
        part = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
    placed = ids.where("doc_id is not null").withColumn("part", part.cast("int"))
    heads = sorted((r.part, r.head) for r in placed.groupBy("part").agg(F.min("doc_id").alias("head")).collect())
    # A part's first row also closes the part before it, and the very first one closes the last.
    closes = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}
    twice = F.array(F.struct(F.col("part"), F.lit(False).alias("copy")))
    if closes:
        before = F.element_at(F.create_map(*[F.lit(x) for pair in closes.items() for x in pair]), F.col("doc_id"))
        extra = F.array(F.struct(before.cast("int").alias("part"), F.lit(True).alias("copy")))
        is_head = F.col("doc_id").isin(list(closes))
        twice = F.when(is_head, F.concat(twice, extra)).otherwise(twice)
    return placed.select(F.explode(twice).alias("dealt"), "doc_id", "text").select("dealt.*", "doc_id", "text")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by part, copy last, then doc_id: each is paired with the one after it."""
    waiting: tuple | None = None  # part, doc_id, text, fingerprint, steps
    for frame in batches:
        rows = list(frame[["part", "copy", "doc_id", "text"]].itertuples(index=False, name=None))
        for a, b in chunks([r[3] for r in rows]):
            pairs = []
            for (part, copy, doc_id, text), print_, steps in zip(rows[a:b], *walked([r[3] for r in rows[a:b]]), strict=True):
                if waiting is not None and waiting[0] == part:
                    pairs.append((*waiting[1:], text, print_))
                # After the first copy come more rows of the same doc_id: they pair with nothing.
                waiting = None if copy else (part, doc_id, text, print_, steps)
            if pairs:
                yield _compared(pairs)


def _compared(pairs: list[tuple]) -> pd.DataFrame:
    ids, texts, prints, steps, following, next_prints = zip(*pairs, strict=True)
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # The walk over the first half, and the step at which the rest begins, are those of the text itself.
    known = [s[: len(t) - len(t) // 2 + 1] if len(t) > 1 else s[:0] for t, s in zip(texts, steps, strict=True)]
    changed_prints, _ = walked(changed, known)
    return pd.DataFrame(
        {
            "doc_id": ids,
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
            "fingerprint": prints,
            "edited_fingerprint": changed_prints,
            "near_edited": [likeness(p, c) for p, c in zip(prints, changed_prints, strict=True)],
            "near_next": [likeness(p, c) for p, c in zip(prints, next_prints, strict=True)],
        }
    )


DIGEST = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likenesses (the columns of DIGEST)."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        _dealt(docs, parts)
        .repartition(parts, "part")
        .sortWithinPartitions("part", "copy", "doc_id", "text")
        .mapInPandas(_digest, DIGEST)
    )


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    draw = np.random.default_rng(9)
    picks = [np.sort(draw.choice(SAMPLES, BAND_DIGITS, replace=False)) for _ in range(BANDS)]
    for frame in batches:
        rows = []
        for doc_id, print_ in zip(frame["doc_id"], fingerprints(frame["text"].tolist()), strict=True):
            strata = len(print_) // SAMPLES
            for level in range(max(0, strata - 3), strata):
                digits = print_[level * SAMPLES : (level + 1) * SAMPLES]
                for band, pick in enumerate(picks):
                    value = "".join(digits[k] for k in pick)
                    if "-" not in value:
                        rows.append((doc_id, f"{level}.{band}.{value}", print_))
        yield pd.DataFrame(rows, columns=["doc_id", "bucket", "fingerprint"])


def near_groups(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, near): documents whose likeness to the centre of a common bucket is at least `least`."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    banded = durable(texts.mapInPandas(_banded, "doc_id long, bucket string, fingerprint string"), "fingerprint-bands")
    centres = banded.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(centres, "bucket").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    prints = banded.select("doc_id", "fingerprint").dropDuplicates(["doc_id"])

    @F.pandas_udf("double")
    def near(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(left, right, strict=True)], dtype=float)

    return (
        pairs.join(prints.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("left")), "a")
        .join(prints.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("right")), "b")
        .select("a", "b", near("left", "right").alias("near"))
        .where(F.col("near") >= least)
    )
