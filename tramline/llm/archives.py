"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

ARC files hold records `header line, document, newline`. Version 1 header lines have five fields (URL, IP
address, date, type, length), version 2 lines ten, with result code, checksum, location, offset and file
name before the length. Which one a file uses stands in its first record. Documents are cut out by
the declared length, never by searching, so payloads may hold anything. Conversion makes up what WARC
has and ARC lacks: record identifiers (a digest of URL, date and payload written as a UUID), ISO dates,
types and payload digests; of records with equal payloads of at least 100 bytes the one with the
smallest page_id stays a response and the others become revisits of it (WARC 1.1, profile
identical-payload-digest).

Files are written by Spark's text writer, gzipped, each with a bounded number of records, and read whole, one
at a time. They are left in the shared folder.

Null payloads are empty payloads, null URLs are written as `-`; white space in URLs is escaped. Repeated
page_ids are separate records; those that share the smallest page_id are all responses. A null page_id comes back as null and
loses against any other. An empty table gives empty results. A damaged archive ends with a row whose
`problem` says what is wrong. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.session import fresh_path

FILE_BYTES = 6 << 20  # aimed at per archive
LEAST_REVISIT = 100  # bytes of payload
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def _records_per_file(payload_bytes: Column, rows: DataFrame) -> int:
    mean = rows.agg(F.avg(payload_bytes)).first()[0] or 0
    return max(1, int(FILE_BYTES / (mean + 400)))


def write_arc(pages: DataFrame) -> str:
    """Write `pages(page_id, url, html)` as ARC files, versions 1 and 2 by turns; returns their folder."""
    spark = pages.sparkSession
    per_file = _records_per_file(F.octet_length(F.coalesce("html", F.lit(""))), pages)
    number = F.monotonically_increasing_id()
    inside = number.bitwiseAND((1 << 33) - 1)
    file_number = F.shiftright(number, 33) + F.floor(inside / per_file)
    version = F.when(file_number % 2 == 0, 1).otherwise(2)
    url = F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.lit("-"))
    url = F.when(url == "", "-").otherwise(url)
    date = F.date_format(F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) % 500_000_000 + 946_684_800), "yyyyMMddHHmmss")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("\r\n"),
    )
    lines = pages.select(
        F.when(inside % per_file == 0, F.lit(True)).otherwise(False).alias("opens"),
        version.alias("version"), url.alias("url"), date.alias("date"),
        F.concat(http, F.coalesce("html", F.lit(""))).alias("document"),
    )
    length = F.octet_length("document").cast("string")
    header = F.concat_ws(
        " ", "url", F.lit("192.0.2.1"), "date", F.lit("text/html"),
        F.when(F.col("version") == 2, F.concat_ws(" ", F.lit("200"), *[F.lit("-")] * 4)), length,
    )

    def opening(v: int) -> Column:
        block = f"{v} 0 tramline\n{ARC_FIELDS[v]}\n"
        line = "filedesc://pages.arc 0.0.0.0 20000101000000 text/plain " + ("200 - - - - " if v == 2 else "") + str(len(block))
        return F.lit(f"{line}\n{block}\n")

    first = F.when(F.col("opens"), F.when(F.col("version") == 1, opening(1)).otherwise(opening(2))).otherwise("")
    path = fresh_path(spark, "arc")
    lines.select(F.concat(first, header, F.lit("\n"), "document").alias("value")).write.option(
        "maxRecordsPerFile", per_file
    ).text(path, compression="gzip", lineSep="\n")
    return path


def iter_arc(data: bytes) -> Iterator[dict]:
    """Records of one archive, version blocks left out; a last one with `problem` if it is damaged."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        fields = data[at:end].split(b" ") if end >= 0 else []
        if version is None and not (fields and fields[0].startswith(b"filedesc:")):
            yield {"problem": "no version block"}
            return
        wanted = len(fields) if version is None else len(ARC_FIELDS[version].split())
        if len(fields) != wanted or not fields[-1].isdigit():
            yield {"problem": "header line not understood"}
            return
        size = int(fields[-1])
        document = data[end + 1 : end + 1 + size]
        if len(document) < size:
            yield {"problem": "shorter than declared"}
            return
        at = end + 1 + size
        if version is None:
            number = document.split(b" ", 1)[0]
            version = int(number) if number.isdigit() else 0
            if version not in ARC_FIELDS:
                yield {"problem": "unknown version"}
                return
            continue
        head, _, payload = document.partition(b"\r\n\r\n")
        page = [x[10:] for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")]
        yield {
            "page_id": int(page[0]) if page else None, "version": version, "url": fields[0].decode(),
            "ip": fields[1].decode(), "date": fields[2].decode(), "http": head + b"\r\n\r\n",
            "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload),
        }


ARC_COLUMNS = {
    "page_id": pa.int64(), "version": pa.int32(), "url": pa.string(), "ip": pa.string(), "date": pa.string(),
    "http": pa.binary(), "payload": pa.binary(), "digest": pa.string(), "payload_bytes": pa.int64(), "problem": pa.string(),
}
WARC_COLUMNS = {
    "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
    "refers_to": pa.int64(), "record_id": pa.string(), "refers_to_id": pa.string(), "target_uri": pa.string(),
    "date": pa.string(), "problem": pa.string(),
}
_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _read(spark: SparkSession, path: str, records, columns: dict[str, pa.DataType]) -> DataFrame:
    """Rows of all archives of a folder; `records` gives those of one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                found = list(records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                for a in range(0, len(found), 2000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r.get(c) for r in found[a : a + 2000]], kind) for c, kind in columns.items()],
                        list(columns),
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, ", ".join(f"{c} {_SPARK[kind]}" for c, kind in columns.items()))


def read_arc(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(ARC_COLUMNS)) -> DataFrame:
    """(page_id, version, url, ip, date, http, payload, digest, payload_bytes, problem) of every record."""
    return _read(spark, path, iter_arc, {c: ARC_COLUMNS[c] for c in columns})


def _urn(*parts: Column) -> Column:
    """A name made of a digest of its parts, in the form of a UUID."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record_id(page_id: Column, digest: Column) -> Column:
    """The digest decides together with page_id, so a revisit can name its response without seeing it."""
    return _urn(F.coalesce(page_id.cast("string"), F.lit("-")), digest)


def convert(spark: SparkSession, arc_path: str) -> str:
    """Turn ARC files into WARC files; returns their folder."""
    slim = read_arc(spark, arc_path, ("page_id", "digest", "payload_bytes"))
    repeated = (
        slim.where(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    records = read_arc(spark, arc_path).where("problem is null").join(repeated, "digest", "left")
    again = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") > F.col("first"), F.lit(True)))
    iso = F.date_format(F.to_timestamp("date", "yyyyMMddHHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.when(again, F.col("http")).otherwise(F.concat("http", "payload"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", iso),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"))),
                line("X-Refers-To-Page-Id", F.col("first").cast("string")),
                line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    # Bytes go through the text writer as they are.
    value = F.concat(header.cast("binary"), block, F.lit("\r\n").cast("binary")).cast("string")
    per_file = _records_per_file(F.col("payload_bytes"), slim)
    path = fresh_path(spark, "warc")
    records.select(value.alias("value")).write.option("maxRecordsPerFile", per_file).text(path, compression="gzip", lineSep="\r\n")
    return path


def iter_warc(data: bytes) -> Iterator[dict]:
    """Records of one archive, digests checked; a last one with `problem` if it is damaged."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            yield {"problem": "header not understood"}
            return
        block = data[end + 4 : end + 4 + int(fields["content-length"])]
        at = end + 4 + int(fields["content-length"]) + 4
        if at > len(data):
            yield {"problem": "shorter than declared"}
            return
        kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
        head, _, payload = block.partition(b"\r\n\r\n")
        page = [x[10:] for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")]
        own = hashlib.sha256(payload).hexdigest() if kind == "response" else digest
        yield {
            "page_id": int(page[0]) if page else None, "record_type": kind, "payload_digest": own,
            "payload_bytes": len(payload) if kind == "response" else int(fields.get("x-payload-length", 0)),
            "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None,
            "record_id": fields.get("warc-record-id"), "refers_to_id": fields.get("warc-refers-to"),
            "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "problem": None if own == digest else "digest differs",
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The columns of WARC_COLUMNS for every record of a folder of WARC files."""
    return _read(spark, path, iter_warc, WARC_COLUMNS)


def convert_pages(pages: DataFrame) -> DataFrame:
    """`pages` written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return read_warc(spark, convert(spark, write_arc(plain)))
