"""Fill-in-the-middle documents: prefix, middle and suffix by tokens, over memoized content-defined chunks.

A token is a run of space (0x20, 0x09-0x0D) and the run of other characters behind it; space at the
end is a token of its own. Where a document is cut is drawn from its doc_id alone, as a number of tokens. To find those
places, the text is cut into chunks where a rolling hash of the last 32 bytes has its high bits zero
(Muthitacharoen et al., "A Low-bandwidth Network File System", SOSP 2001), so passages that documents share
become the same chunks wherever they stand. A task keeps a summary of each chunk: how many tokens end
inside it, its characters, and whether it begins and ends with space. The key of the summary is the chunk's content, so a
chunk counts as known only if all its bytes are equal. The counts of a document's chunks, joined at their
boundaries, say in which chunk a cut lies; only that chunk is looked through.

Form `plain` leaves a text as it is: empty ones, those that contain a marker, and the share of documents that
the rate leaves out. `psm` puts the markers before prefix, suffix and middle in that order; `spm` puts the
suffix first. `restore` gives the exact text back.

A null text counts as empty, a null doc_id as the empty id. Equal doc_ids draw the same numbers, so repeated rows give
repeated results. An empty table gives an empty one. Other columns are not read, so their names may be any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm import words

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BITS = 9  # chunks of 512 bytes on average
LONGEST_CHUNK = 1 << 13
CACHE_BYTES = 16 << 20  # content of the chunks a task remembers

_GEAR = words.mix(np.arange(1, 257, dtype=np.uint64) * words.BASE)
_SPACE_BYTES = bytes(np.flatnonzero(words.SPACES).tolist())


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """End of every chunk of the bytes `data`, by their content."""
    rolled = _GEAR[data]
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8, 16):  # sums over twice as many bytes each time, the older ones shifted out
            rolled[step:] += rolled[:-step] << np.uint64(step)
    cuts = np.flatnonzero(rolled >> np.uint64(64 - CHUNK_BITS) == 0) + 1
    bounds = np.unique(np.concatenate([cuts, [len(data)]]))
    far = np.flatnonzero(np.diff(bounds, prepend=0) > LONGEST_CHUNK)
    if len(far):  # runs without a cut are cut by length from where they begin
        begins = np.concatenate([[0], bounds[:-1]])[far]
        more = [np.arange(b + LONGEST_CHUNK, bounds[i], LONGEST_CHUNK) for b, i in zip(begins, far, strict=True)]
        bounds = np.unique(np.concatenate([bounds, *more]))
    return bounds


def token_ends(content: bytes) -> np.ndarray:
    """Where tokens end inside a chunk: behind each character that is no space but has a space behind it."""
    inside = ~words.SPACES[np.frombuffer(content, np.uint8)]
    return np.flatnonzero(inside[:-1] & ~inside[1:]) + 1


class Summaries:
    """Summaries of chunks by their content; when full, the older half is forgotten."""

    def __init__(self, most_bytes: int = CACHE_BYTES) -> None:
        self.most, self.held = most_bytes, 0
        self.new: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.old: dict[bytes, tuple[int, int, bool, bool]] = {}

    def of(self, content: bytes) -> tuple[int, int, bool, bool]:
        """Token ends inside, characters, whether it begins with space, whether it ends with space."""
        found = self.new.get(content)
        if found is None:
            found = self.old.get(content)
            if found is None:
                points = np.frombuffer(content, np.uint8)
                found = (
                    len(token_ends(content)),
                    int(np.count_nonzero((points & 0xC0) != 0x80)),
                    content[0] in _SPACE_BYTES,
                    content[-1] in _SPACE_BYTES,
                )
            if self.held > self.most // 2:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[content] = found
            self.held += len(content) + 100
        return found


class Located:
    """The tokens of one text: how many there are, and where the k-th ends, in bytes and characters."""

    def __init__(self, content: bytes, summaries: Summaries) -> None:
        self.content, self.n = content, 0
        if not content:
            return
        self.bounds = np.concatenate([[0], chunk_ends(np.frombuffer(content, np.uint8))])
        parts = [summaries.of(content[a:b]) for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]
        inside = np.array([p[0] for p in parts], np.int64)
        opens = np.array([p[2] for p in parts], bool)
        closes = np.array([p[3] for p in parts], bool)
        # A chunk's last character ends a token if the next chunk, or the end of the text, comes as space does;
        # space at the end of the text is a token too.
        at_end = np.append(~closes[:-1] & opens[1:], True)
        self.upto = np.cumsum(inside + at_end)  # tokens that end in each chunk or before
        self.chars = np.cumsum([0] + [p[1] for p in parts])
        self.n = int(self.upto[-1])

    def end(self, k: int) -> tuple[int, int]:
        """Bytes and characters up to the end of the k-th token; of none for k = 0."""
        if k == 0:
            return 0, 0
        chunk = int(np.searchsorted(self.upto, k))
        begin, stop = int(self.bounds[chunk]), int(self.bounds[chunk + 1])
        nth = k - 1 - (int(self.upto[chunk - 1]) if chunk else 0)
        ends = token_ends(self.content[begin:stop])
        place = begin + int(ends[nth]) if nth < len(ends) else stop
        part = np.frombuffer(self.content, np.uint8)[begin:place]
        return place, int(self.chars[chunk]) + int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int = 42) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that a document's id and the seed decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))  # type: ignore[return-value]


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of `docs(doc_id, text, ...)`.

    `rate` hundredths of the documents are transformed, `spm_rate` hundredths of those with the suffix first.
    """
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p_mark, s_mark, m_mark = markers

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries()
        for whole in batches:
            for batch in words.slices(whole):
                counts, forms, prefixes, middles, outputs = [], [], [], [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    content = (text.as_py() or "").encode()
                    found = Located(content, summaries)
                    h1, h2, h3, h4 = draws(doc_id, seed)
                    counts.append(found.n)
                    if not content or h3 % 100 >= rate or any(m in content for m in markers):
                        forms.append("plain")
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(content)
                        continue
                    first, second = sorted((h1 % (found.n + 1), h2 % (found.n + 1)))
                    (a, a_chars), (b, b_chars) = found.end(first), found.end(second)
                    spm = h4 % 100 < spm_rate
                    forms.append("spm" if spm else "psm")
                    prefixes.append(a_chars)
                    middles.append(b_chars - a_chars)
                    head, tail = p_mark + content[:a], s_mark + content[b:]
                    outputs.append((tail + head if spm else head + tail) + m_mark + content[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array(prefixes, pa.int64()),
                        pa.array(middles, pa.int64()),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return words.batched(docs).select("doc_id", "text").mapInArrow(
        fill, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restore(output: Column, form: Column) -> Column:
    """The exact text from what `transform` made of it: markers are where they come first, as no text holds one."""

    def between(begin: str, end: str) -> Column:
        start = F.locate(begin, output) + len(begin)
        return F.substring(output, start, F.locate(end, output) - start)

    middle = F.substring(output, F.locate(MIDDLE, output) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The rows of `transform` with digests in place of the output: its own, and that of the text restored from it."""
    made = transform(docs)
    restored = restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )
