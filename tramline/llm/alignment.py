"""Tokens of two tokenizers aligned on the bytes they cover, by pointer jumping.

Both tokenizers cut the same bytes (a space and the text) into tokens. Every token points to the
farthest-right token that overlaps it: the one of the other tokenizer that holds its last byte, if that reaches further.
Following successors with `next = next[next]` doubles the distance each round (Wyllie, "The Complexity of Parallel
Computations", 1979), so all tokens know the last token of their component after as many rounds as that
distance has bits. The last token labels the group; groups are what lies between two offsets where both tokenizers end a token.
Tokens of different tokenizers in a group are linked, every occurrence with every other.

Texts are taken in units that begin with a space behind another character. Neither tokenizer has a token across such a
place (words of the first begin there; no piece of the second, as is checked, has its space mark behind anything else), so
a unit has the same tokens in every text. Distinct units are encoded and aligned once by a Python process, which keeps a
bounded number of them.

What a text contributes to the corpus is the set of its linked id pairs; the count of a pair is the number
of texts that hold it. Pairs that make up at least a `FREQUENT`-th of all those (text, pair) rows are at most
`FREQUENT` pairs, so they are broadcast, with that bound; rows of all other pairs are shuffled to their
counts, and no such pair has more than that share of the rows.

Null and empty texts, and texts that the tokens of a tokenizer do not give back byte by byte, have no tokens: zeros,
an empty digest, no part in counts. Each row is a text by itself, repeated rows and null ids included. An
empty table gives an empty one. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import words
from tramline.session import durable

TOKENIZERS = "/opt/tokenizers"
FIRST_FILE, SECOND_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
FREQUENT = 100_000  # pairs broadcast at most
KNOWN_UNITS, KNOWN_BYTES = 100_000, 16 << 20  # units a process keeps, and bytes of those it takes in at once
UNITS_AT_ONCE = 1 << 13  # units encoded and aligned together: bounds memory only
TEXTS_AT_ONCE = 512 << 10  # bytes of texts aligned together, or one longer text: bounds memory only
LARGE_GROUP = 10_000  # links of a group from which its ids are counted before they are paired

# Fixed value: how byte-level vocabularies split a text before their merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = 0x20
# Second last and last bytes of the other white space in UTF-8 (code points with the property White_Space).
_WIDE_SPACE = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, b) for b in range(0x80, 0x8B)),
               (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]


@dataclass(frozen=True)
class TokenizerFiles:
    """Content of the two vocabulary files: a few MB that tasks get."""

    first: bytes
    second: bytes


def read_files(spark: SparkSession, folder: str = TOKENIZERS) -> TokenizerFiles:
    """The vocabulary files below a folder that Spark can read."""
    def content(name: str) -> bytes:
        return bytes(spark.read.format("binaryFile").load(f"{folder}/{name}").head().content)

    return TokenizerFiles(content(FIRST_FILE), content(SECOND_FILE))


def _byte_of_char() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, files: TokenizerFiles) -> None:
        import sentencepiece
        import tiktoken

        byte = _byte_of_char()
        model = json.loads(files.first)
        added = {t["id"] for t in model["added_tokens"]}
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        order = [vocabulary[a + b] for a, b in pairs]
        if order != sorted(order) or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("merges of the first vocabulary are not in order of their ids")
        self.first_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            self.first_bytes[i] = entry.encode() if i in added else bytes(byte[c] for c in entry)
        # With merges in order of ids, ids are ranks; special tokens are left out, so their strings are ordinary text.
        ranks = {b: i for i, b in enumerate(self.first_bytes) if i not in added}
        self.first = tiktoken.Encoding("first", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=files.second)
        size = self.second.get_piece_size()
        pieces = [self.second.id_to_piece(i) for i in range(size)]
        self.second_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        #: Units are only cut where no piece can lie across; otherwise a text is one unit.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.sizes = len(self.first_bytes), size
        self.lengths = tuple(np.array([len(b) for b in t], np.int64) for t in (self.first_bytes, self.second_bytes))
        #: Ids as text behind what stands before them: the first of a group, any other, the first of the second tokenizer.
        self.texts = tuple(np.array([f"{c}{i}" for i in range(max(self.sizes))], object) for c in ";,|")

    def encode(self, units: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of each unit (which begins with a space) in both; None if the second does not give its bytes back.

        The first works on bytes and always does.
        """
        texts = [u.decode() for u in units]
        # The second adds the space itself, but not to an empty text: a unit of one space is its mark.
        second = [ids or [self.second.piece_to_id("▁")] for ids in self.second.encode([t[1:] for t in texts], num_threads=1)]
        of = self.second_bytes
        return [
            (self.first.encode_ordinary(t), b) if b"".join([of[i] for i in b]) == u else None
            for u, t, b in zip(units, texts, second, strict=True)
        ]


def terminals(first_ends: np.ndarray, second_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the last token of each token's component; tokens of the second come behind those of the first.

    Ends are offsets in one row of bytes that both tokenizers cover without a gap.
    """
    n = len(first_ends)
    follow = np.arange(n + len(second_ends))
    # Of a token of the first: the token of the second with its last byte, which reaches as far or farther.
    follow[:n] = n + np.searchsorted(second_ends, first_ends)
    # Of a token of the second: the token of the first with its last byte, if that reaches farther.
    other = np.searchsorted(first_ends, second_ends)
    farther = first_ends[other] > second_ends
    follow[n:][farther] = other[farther]
    while True:
        further = follow[follow]
        if np.array_equal(further, follow):
            return follow[:n], follow[n:]
        follow = further


@dataclass
class Aligned:
    """Units one after another: counts (tokens of both, groups, links), groups as text, and distinct linked pairs.

    The text of a unit has `;` before each group. Pairs of unit i are those from begins[i] on, sizes[i] in number.
    """

    counts: np.ndarray
    texts: list[str]
    sizes: np.ndarray
    pairs: np.ndarray
    times: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def joined(parts: list[Aligned]) -> Aligned:
    together = lambda name: np.concatenate([getattr(p, name) for p in parts])
    texts = [t for p in parts for t in p.texts]
    return Aligned(together("counts"), texts, together("sizes"), together("pairs"), together("times"))


def no_units() -> Aligned:
    none = np.zeros(0, np.int64)
    return Aligned(np.zeros((0, 4), np.int64), [], none, none, none)


def align(encoded: list[tuple[list[int], list[int]]], tokens: Tokens) -> Aligned:
    """Groups of each unit, all units in one row of bytes (both end a token at the end of a unit)."""
    if not encoded:
        return no_units()
    n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
    first = np.fromiter((i for a, _ in encoded for i in a), np.int64, int(n_a.sum()))
    second = np.fromiter((i for _, b in encoded for i in b), np.int64, int(n_b.sum()))
    label_a, label_b = terminals(np.cumsum(tokens.lengths[0][first]), np.cumsum(tokens.lengths[1][second]))
    # The last token of a component is one of the second: groups are numbered in order of theirs.
    last = np.cumsum(label_b == np.arange(len(second)) + len(first)) - 1
    group_a, group_b = last[label_a - len(first)], last[label_b - len(first)]
    n_groups = int(last[-1]) + 1
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    begin_a, begin_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    unit_of = np.repeat(np.arange(len(encoded)), n_b)[begin_b]
    of_units = lambda values: np.bincount(unit_of, values, len(encoded)).astype(np.int64)
    counts = np.stack([n_a, n_b, of_units(np.ones(n_groups)), of_units(in_a * in_b)], axis=1)

    width = tokens.sizes[0] * tokens.sizes[1]
    small = in_a * in_b <= LARGE_GROUP
    chosen = np.flatnonzero(small[group_a])  # each of these with every token of the second in its group
    many = in_b[group_a[chosen]]
    left = np.repeat(chosen, many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + begin_b[group_a[left]]
    keys = [unit_of[group_a[left]] * width + first[left] * tokens.sizes[1] + second[right]]
    times = [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(~small):  # counted by distinct ids first
        x, n = np.unique(first[begin_a[g] : begin_a[g] + in_a[g]], return_counts=True)
        y, m = np.unique(second[begin_b[g] : begin_b[g] + in_b[g]], return_counts=True)
        keys.append((unit_of[g] * width + x[:, None] * tokens.sizes[1] + y).ravel())
        times.append((n[:, None] * m).ravel())
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    often = np.bincount(back, np.concatenate(times), len(distinct)).astype(np.int64)
    sizes = np.bincount(distinct // width, minlength=len(encoded))

    # Groups as text: of each group the tokens of the first, then those of the second, each with what stands before it.
    text = np.empty(len(first) + len(second), object)
    head_a, head_b = np.zeros(len(first), bool), np.zeros(len(second), bool)
    head_a[begin_a], head_b[begin_b] = True, True
    text[np.arange(len(first)) + begin_b[group_a]] = np.where(head_a, tokens.texts[0][first], tokens.texts[1][first])
    text[np.arange(len(second)) + (begin_a + in_a)[group_b]] = np.where(head_b, tokens.texts[2][second], tokens.texts[1][second])
    pieces, ends = text.tolist(), np.cumsum(n_a + n_b).tolist()
    texts = ["".join(pieces[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return Aligned(counts, texts, sizes, distinct % width, often)


class Known:
    """Units that were aligned before, by content, and their numbers; all are forgotten when there are too many."""

    def __init__(self, tokens: Tokens) -> None:
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.units = no_units()

    def find(self, units: list[bytes]) -> tuple[np.ndarray, Aligned]:
        """The number of each distinct unit among those returned with it; -1 for one that is not given back."""
        if len(self.number) > KNOWN_UNITS or len(self.units.pairs) > 8 * KNOWN_UNITS:
            self.clear()
        new = [u for u in units if u not in self.number]
        fresh: dict[bytes, int] = {}
        parts, count = [self.units], len(self.units.texts)
        gc.disable()  # many small lists and no cycles: collections would take a quarter of the time
        try:
            for at in range(0, len(new), UNITS_AT_ONCE):
                part = new[at : at + UNITS_AT_ONCE]
                encoded = self.tokens.encode(part)
                for u, e in zip(part, encoded, strict=True):
                    fresh[u] = count if e is not None else -1
                    count += e is not None
                parts.append(align([e for e in encoded if e is not None], self.tokens))
        finally:
            gc.enable()
        aligned = joined(parts)
        numbers = np.array([fresh[u] if u in fresh else self.number[u] for u in units], np.int64)
        if sum(map(len, new)) <= KNOWN_BYTES:  # very long units are not worth keeping
            self.number.update(fresh)
            self.units = aligned
        return numbers, aligned


_known: dict[str, Known] = {}


def _known_units(files: TokenizerFiles) -> Known:
    """The units of this Python process, which Spark uses for many tasks."""
    key = hashlib.sha256(files.first + files.second).hexdigest()
    if key not in _known:
        _known.clear()
        _known[key] = Known(Tokens(files))
    return _known[key]


def unit_bounds(data: np.ndarray, bounds: np.ndarray, cuts: bool) -> np.ndarray:
    """Where units begin, in texts that each begin with a space: there, and at spaces behind other characters."""
    starts = np.zeros(len(data) + 1, bool)
    if cuts and len(data):
        before, before_that = np.concatenate([[_SPACE], data[:-1]]), np.concatenate([[0, 0], data[:-2]])[: len(data)]
        spaces = words.SPACES[before]
        high = np.flatnonzero(before >= 0x80)
        for x, y in _WIDE_SPACE:
            spaces[high[(before_that[high] == x) & (before[high] == y)]] = True
        starts[:-1] = (data == _SPACE) & ~spaces
    starts[bounds] = True
    return np.flatnonzero(starts)


TEXT_SCHEMA = (
    "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
)


def tokenized(docs: DataFrame, files: TokenizerFiles) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row of `docs(doc_id, text, ...)`.

    `pairs` are the distinct linked pairs, as id of the first times the second's vocabulary plus id of the second; `times`
    says how many links each makes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)  # a few MB: the vocabularies

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known_units(shared.value)
        for whole in batches:
            for batch in words.slices(whole, most=TEXTS_AT_ONCE):
                yield _rows(batch, known)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return words.batched(docs).select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {TEXT_SCHEMA}")


def _rows(batch: pa.RecordBatch, known: Known) -> pa.RecordBatch:
    texts = [b" " + t.encode() if t else b"" for t in batch.column("text").to_pylist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    starts = unit_bounds(data, bounds, known.tokens.cuts)
    offsets = pa.py_buffer(starts.astype(np.int64))
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    numbers, found = known.find(units.dictionary.to_pylist())
    place = numbers[units.indices.to_numpy(zero_copy_only=False)]
    begins, nothing = found.begins, np.zeros(0, np.int64)
    first = np.searchsorted(starts, bounds)  # unit with which each text begins
    rows, digests, pairs, times = [], [], [], []
    for i in range(len(texts)):
        in_text = place[first[i] : first[i + 1]]
        own, n = np.unique(in_text, return_counts=True)
        if not len(own) or own[0] < 0:
            rows.append((0, 0, 0, 0))
            digests.append("")
            pairs.append(nothing)
            times.append(nothing)
            continue
        rows.append(tuple(n @ found.counts[own]))
        groups = "".join([found.texts[u] for u in in_text.tolist()])[1:]
        digests.append(hashlib.sha256(groups.encode()).hexdigest())
        many = found.sizes[own]
        at = np.repeat(begins[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pair, back = np.unique(found.pairs[at], return_inverse=True)
        pairs.append(pair)
        times.append(np.bincount(back, found.times[at] * np.repeat(n, many), len(pair)).astype(np.int64))
    columns = [pa.array([int(x[k]) for x in rows], pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), *columns, pa.array(digests, pa.string()),
            pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())),
        ],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def pair_counts(texts: DataFrame, second_size: int) -> DataFrame:
    """(pair, n, best): the texts that hold each linked pair, and whether no pair of its first id is in more."""
    counted = durable(texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "alignment-counts")
    first = F.floor(F.col("pair") / second_size).alias("first_id")
    most = counted.groupBy(first).agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    return counted.withColumn("first_id", first).join(most, "first_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of `docs(doc_id, text, ...)`."""
    files = read_files(docs.sparkSession, folder)
    second_size = Tokens(files).sizes[1]
    texts = durable(tokenized(docs, files).withColumn("row_key", F.monotonically_increasing_id()), "alignment-texts")
    counts = durable(pair_counts(texts, second_size), "alignment-pairs")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    often = F.col("n") * FREQUENT >= total
    held = texts.select("row_key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row_key", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")
    )
    frequent, rare = F.broadcast(counts.where(often)), counts.where(~often)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("row_key").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )

    near = summed(held.join(frequent, "pair"))
    far = summed(held.join(frequent.select("pair"), "pair", "left_anti").join(rare, "pair"))
    sums = near.unionByName(far).groupBy("row_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.drop("pairs", "times").join(sums, "row_key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
