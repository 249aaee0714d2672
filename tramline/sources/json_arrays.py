"""JSON documents of any size as tables: the elements of one array of a document, cut out as it streams past.

A document is an array, or an object with an array under some key (`body`, `features`). Spark's own reader holds a document
that spans lines as one row; here a task streams a file and gives each element as a row of text, which Spark
then parses. Documents are dealt to tasks, elements are as many rows as there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.sources.files import open_file

BLOCK_BYTES = 4 << 20
_KEY_BYTES = 4096  # looked back for the key of an array


class ArrayCutter:
    """Cuts the elements out of a document that is fed in blocks of bytes."""

    def __init__(self, key: str | None) -> None:
        self.key = None if key is None else re.compile(rb'"%s"\s*:\s*$' % re.escape(key.encode()))
        self.level = 1 if key is None else 2  # depth of brackets inside the array
        self.depth, self.in_text, self.slashes = 0, 0, 0
        self.found = self.ended = self.begun = self.broken = False
        self.held = b""  # what came before in the current element, or before the array

    def feed(self, block: bytes) -> list[bytes]:
        """Elements that end in this block."""
        data = np.frombuffer(block, np.uint8)
        if not len(data):
            return []
        place = np.arange(len(data))
        last = np.maximum.accumulate(np.where(data != 0x5C, place, -1))  # the last byte that is no backslash
        before = np.concatenate([[-1], last[:-1]])
        run = place - 1 - before + np.where(before < 0, self.slashes, 0)  # backslashes right before
        quotes = (data == 0x22) & (run % 2 == 0)
        parity = (self.in_text + np.cumsum(quotes)) % 2
        outside = (parity == 0) & ~quotes
        opens = outside & ((data == 0x5B) | (data == 0x7B))
        closes = outside & ((data == 0x5D) | (data == 0x7D))
        depth = self.depth + np.cumsum(opens.astype(np.int32) - closes)
        self.depth, self.in_text = int(depth[-1]), int(parity[-1])
        self.slashes = int(len(data) - 1 - last[-1]) + (self.slashes if last[-1] < 0 else 0)
        self.begun = self.begun or bool(opens.any())
        out, start = [], 0
        for stop in (np.flatnonzero(closes & (depth == 0)) + 1).tolist():  # a document ends; another may follow, as on the next line
            own = slice(start, stop)
            out += self._cut(block[own], data[own], opens[own], closes[own], outside[own], depth[own])
            self.broken = self.broken or (self.found and not self.ended)
            self.found, self.ended, self.held, start = False, False, b"", stop
        own = slice(start, len(data))
        return out + self._cut(block[own], data[own], opens[own], closes[own], outside[own], depth[own])

    def _cut(self, block: bytes, data, opens, closes, outside, depth) -> list[bytes]:
        """Elements that end in this piece of one document."""
        start = 0
        if not self.found:
            for at in np.flatnonzero(opens & (data == 0x5B) & (depth == self.level)).tolist():
                if self.key is None or self.key.search((self.held + block[:at])[-_KEY_BYTES:]):
                    self.found, self.held, start = True, b"", at + 1
                    break
            else:
                self.held = (self.held + block)[-_KEY_BYTES:]
                return []
        if self.ended:
            return []
        ends = outside & ((data == 0x2C) & (depth == self.level) | (data == 0x5D) & closes & (depth == self.level - 1))
        out = []
        for at in np.flatnonzero(ends[start:]).tolist():
            out.append((self.held + block[start : start + at]).strip() if not out else block[begin : start + at].strip())
            self.held, begin = b"", start + at + 1
            if data[start + at] == 0x5D:
                self.ended = True
                break
        self.held += b"" if self.ended else block[begin:] if out else block[start:]
        return [e for e in out if e]

    def check(self) -> None:
        """Complain about a document that is not whole; one without the array is an empty one."""
        if self.depth or self.in_text or not self.begun or self.broken or (self.found and not self.ended):
            raise ValueError("not a whole JSON document")


def array_elements(spark: SparkSession, path: str | list[str], key: str | None = None) -> DataFrame:
    """(path, element) of each element of the array of every document below `path`, as JSON text."""
    files = spark.read.format("binaryFile").load(path).select("path")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                cutter = ArrayCutter(key)
                with open_file(name) as file:
                    block = file.read(BLOCK_BYTES).removeprefix(b"\xef\xbb\xbf")
                    while block:
                        found = cutter.feed(block)
                        if found:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([name] * len(found)), pa.array(found, pa.binary()).cast(pa.string())], ["path", "element"]
                            )
                        block = file.read(BLOCK_BYTES)
                try:
                    cutter.check()
                except ValueError as error:
                    raise ValueError(f"{name}: {error}") from None

    return files.repartition(tasks, "path").mapInArrow(cut, "path string, element string")


def read_array(spark: SparkSession, path: str | list[str], schema: T.StructType, key: str | None = None) -> DataFrame:
    """(path, element) with the elements parsed; an element of another form is an error."""
    return array_elements(spark, path, key).withColumn("element", F.from_json("element", schema, {"mode": "FAILFAST"}))
