"""Zipped feeds: scan, check, report and staging as typed tables.

Archives are read by entry. A first pass opens each file at its end and lists the tables in it; the entries are then dealt
to tasks, each of which seeks to its own and unpacks it as a stream, so an archive may have any size, its
tables are read side by side, and no content passes through a join or lies in memory as a whole. For stores that only Spark's
own readers open, archives can be read as contents instead (`read_archives`). Everything after the scan is DataFrame work.
"""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tramline.functions.curve import place_on_curve
from tramline.functions.text import base_name
from tramline.functions.times import time_to_secs
from tramline.schemas import CALENDAR_TABLES, FEED_COLUMNS, REQUIRED_TABLES, FeedTables
from tramline.session import durable
from tramline.sources.files import open_file, plain_path

CHUNK_ROWS = 20_000
BLOCK_BYTES = 8 << 20  # of a table file parsed at once; a longer row makes the archive unreadable
ENTRY_BYTES = 64 << 20  # of tables for a task, on average

RECORD_SCHEMA = "feed_id string, gtfs_table string, fields array<string>, report string"
ENTRY_SCHEMA = "feed_id string, path string, gtfs_table string, size long, archive_size long, report string"

REJECTED_SCHEMA = "feed_id string, gtfs_table string, `column` string, n_rejected long"

PRESENT = "present"
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, csv.Error)


def list_archives(spark: SparkSession, path: str | list[str], manifest: DataFrame | None = None) -> DataFrame:
    """Archive files as (feed_id, path, length), without reading them.

    `manifest(feed_id, path)` says which feed a file is; files it does not name are left out. Without one the
    name up to its first dot is the feed, and files that share that name keep apart by their whole paths.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    if manifest is not None:
        wanted = manifest.select("feed_id", plain_path(F.col("path")).alias("plain")).distinct()
        twice = wanted.groupBy("feed_id").agg(F.count("*").alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError(f"feeds with several archives: {[r.feed_id for r in twice.limit(10).collect()]}")
        return files.withColumn("plain", plain_path(F.col("path"))).join(wanted, "plain").select("feed_id", "path", "length")
    named = files.withColumn("name", base_name(F.col("path")))
    shared = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("shared"))
    feed = F.when(F.col("shared"), plain_path(F.col("path"))).otherwise(F.col("name"))
    return named.join(shared, "name", "left").select(feed.alias("feed_id"), "path", "length")


def read_archives(spark: SparkSession, path: str | list[str], manifest: DataFrame | None = None) -> DataFrame:
    """Archives as (feed_id, content), for stores that tasks cannot open by themselves; of 2 GB at most.

    Feeds are named as `list_archives` does. Paths are matched first and written; the contents meet that small table
    without being shuffled.
    """
    listed = durable(list_archives(spark, path, manifest).select("path", "feed_id"), "listed-archives")
    contents = spark.read.format("binaryFile").load(path).select("path", "content")
    return contents.join(listed, "path").select("feed_id", "content")


def archive_entries(archives: DataFrame) -> DataFrame:
    """(feed_id, path, gtfs_table, size, archive_size, report) of each known table in `archives(feed_id, path)`.

    Sizes are those of the unpacked tables. Only the directories at the ends of the files are read. A file without a readable one gives a report instead.
    """
    return archives.select("feed_id", "path").mapInArrow(_list_entries, ENTRY_SCHEMA)


def _list_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for feed_id, path in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            try:
                with open_file(path) as file, zipfile.ZipFile(file) as archive:
                    found = {i.filename: i.file_size for i in archive.infolist()}
                sizes = {t: found[f"{t}.txt"] for t in FEED_COLUMNS if f"{t}.txt" in found}
                rows += [(feed_id, path, t, n, sum(sizes.values()), None) for t, n in sizes.items()]
            except UNREADABLE as error:
                rows.append((feed_id, path, None, 0, 0, _reason(error)))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
            ["feed_id", "path", "gtfs_table", "size", "archive_size", "report"],
        )


def scan_archives(archives: DataFrame) -> DataFrame:
    """Records of every known table in `archives(feed_id, path)` or `archives(feed_id, content)`.

    `fields` holds the columns of FEED_COLUMNS in order, null where a file lacks one, and
    `report` is null. Besides, every table found gives one row with `report` = 'present', and an
    archive that cannot be read gives one with the reason instead of failing the job.
    """
    if "content" in archives.columns:
        return archives.select("feed_id", "content").mapInArrow(_unzip, RECORD_SCHEMA)
    entries = durable(archive_entries(archives), "archive-entries")
    total = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).head()
    cores = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(total["n"], max(cores, -(-total["bytes"] // ENTRY_BYTES))))
    # Small archives are opened once; the tables of large ones go to tasks of their own. Dealt by number: a list of
    # entries is small, and adaptive execution would put it into one task.
    apart = F.when(F.col("archive_size") > ENTRY_BYTES, F.col("gtfs_table"))
    dealt = entries.repartition(tasks, F.col("path"), apart).sortWithinPartitions("path")
    return dealt.mapInArrow(_read_entries, RECORD_SCHEMA)


def _read_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _merged(_entries_of(batches))


def _entries_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, file, archive = None, None, None
    for row in (row for batch in batches for row in batch.to_pylist()):
        if row["report"] is not None:
            yield _told(row["feed_id"], None, row["report"])
            continue
        try:
            if row["path"] != at:
                if file is not None:
                    file.close()
                at, file = None, open_file(row["path"])
                archive = zipfile.ZipFile(file)
                at = row["path"]
            yield from _table(row["feed_id"], archive, row["gtfs_table"])
        except UNREADABLE as error:
            yield _told(row["feed_id"], None, _reason(error))
    if file is not None:
        file.close()


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, small batches put together."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= CHUNK_ROWS or len(waiting) >= 200:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting = []
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _unzip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _merged(_contents_of(batches))


def _contents_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for feed_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as archive:
                    present = set(archive.namelist())
                    for table in FEED_COLUMNS:
                        if f"{table}.txt" in present:
                            yield from _table(feed_id, archive, table)
            except UNREADABLE as error:
                yield _told(feed_id, None, _reason(error))


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _table(feed_id: str, archive: zipfile.ZipFile, table: str) -> Iterator[pa.RecordBatch]:
    with archive.open(f"{table}.txt") as entry:
        for columns in _parsed(entry, [name for name, _ in FEED_COLUMNS[table]]):
            yield _records(feed_id, table, columns)
    yield _told(feed_id, table, PRESENT)


class _Rest(io.RawIOBase):
    """A stream with what was already read of it put back."""

    def __init__(self, begun: bytes, stream) -> None:
        self.begun, self.stream = begun, stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        block = self.begun[: len(buffer)] or self.stream.read(len(buffer))
        self.begun = self.begun[len(block) :] if self.begun else b""
        buffer[: len(block)] = block
        return len(block)


def _parsed(entry, wanted: list[str]) -> Iterator[list[pa.Array]]:
    """The wanted columns of a table file, a block of rows at a time; null where a row or the file lacks one.

    Arrow parses rows as long as the header. It hands over the others, which are read one by one, as are whole
    files whose header is no plain line.
    """
    line = entry.readline()
    header = line.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r\n")
    if b'"' in header or b"\r" in header or not header:
        for rows in _chunks(_Rest(line, entry), wanted):
            yield [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
        return
    names = [name.strip() for name in next(csv.reader([header.decode()]), [])]
    begun = entry.read(1)
    if not begun:
        return
    places = [names.index(name) if name in names else -1 for name in wanted]
    odd: list[str] = []

    def put_aside(row) -> str:
        odd.append(row.text)
        return "skip"

    kept = sorted({p for p in places if p >= 0}) or [0]
    reader = arrow_csv.open_csv(
        io.BufferedReader(_Rest(begun, entry)),
        read_options=arrow_csv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES, column_names=[str(i) for i in range(len(names))]),
        parse_options=arrow_csv.ParseOptions(newlines_in_values=True, invalid_row_handler=put_aside),
        convert_options=arrow_csv.ConvertOptions(
            include_columns=[str(p) for p in kept], column_types={str(p): pa.string() for p in kept}, strings_can_be_null=False
        ),
    )
    for batch in reader:
        none = pa.nulls(batch.num_rows, pa.string())
        yield [batch.column(kept.index(p)) if p >= 0 else none for p in places]
        yield from _one_by_one(odd, places)
        odd.clear()
    yield from _one_by_one(odd, places)


def _one_by_one(texts: list[str], places: list[int]) -> Iterator[list[pa.Array]]:
    rows = [row for text in texts for row in csv.reader(io.StringIO(text, newline="")) if row]
    if rows:
        yield [pa.array([row[p] if 0 <= p < len(row) else None for row in rows], pa.string()) for p in places]


def _chunks(entry, wanted: list[str]) -> Iterator[list]:
    """Rows of one table file in chunks; each row a list of the wanted columns."""
    csv.field_size_limit(2**31 - 1)  # texts of any length
    reader = csv.reader(io.TextIOWrapper(io.BufferedReader(entry), encoding="utf-8-sig", newline=""))
    header = [name.strip() for name in next(reader, [])]
    places = [header.index(name) if name in header else -1 for name in wanted]
    while rows := list(islice(reader, CHUNK_ROWS)):
        if some := [[row[p] if 0 <= p < len(row) else None for p in places] for row in rows if row]:
            yield some


def _records(feed_id: str, table: str, columns: list[pa.Array]) -> pa.RecordBatch:
    """Rows of a table, their fields as one list each."""
    count, width = len(columns[0]), len(columns)
    by_row = np.arange(count * width).reshape(width, count).T.ravel()
    fields = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * width, pa.concat_arrays(columns).take(pa.array(by_row)))
    return _batch([feed_id] * count, [table] * count, fields, pa.nulls(count, pa.string()))


def _told(feed_id: str, table: str | None, report: str) -> pa.RecordBatch:
    return _batch([feed_id], [table], pa.nulls(1, pa.list_(pa.string())), pa.array([report]))


def _batch(feeds: list, tables: list, fields: pa.Array, reports: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(feeds, pa.string()), pa.array(tables, pa.string()), fields, reports],
        names=["feed_id", "gtfs_table", "fields", "report"],
    )


def _reports(records: DataFrame) -> DataFrame:
    """The few rows that tell about tables and problems; a Parquet scan skips all others."""
    return records.where(F.col("report").isNotNull()).select("feed_id", "gtfs_table", "report")


def ingest_report(records: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per feed of `fetched(feed_id, status)`: whether it can be used and why not, its rows and the values lost.

    A feed that was not fetched, or whose archive is unreadable or holds no feed table (Spark
    skips empty files altogether), is skipped; the others go on. `n_rejected` counts values that do not fit their
    column and are null from here on; feeds that are skipped have 0 rows and values.
    """
    seen = _reports(records).groupBy("feed_id").agg(F.max((F.col("report") != PRESENT).cast("int")).alias("broken"))
    rows = (
        records.where(F.col("report").isNull())
        .groupBy("feed_id")
        .agg(F.count("*").alias("n_rows"), F.sum(_rejected_in_row()).alias("n_rejected"))
    )
    outcome = (
        F.when(F.col("status") != 200, F.lit("not fetched"))
        .when(F.col("broken").isNull() | (F.col("broken") == 1), F.lit("unreadable"))
        .otherwise(F.lit("ok"))
    )
    used = lambda name: F.when(F.col("outcome") == "ok", F.coalesce(name, F.lit(0))).otherwise(0).cast("long").alias(name)
    return (
        fetched.join(seen, "feed_id", "left")
        .withColumn("outcome", outcome)
        .join(rows, "feed_id", "left")
        .select("feed_id", "status", "outcome", used("n_rows"), used("n_rejected"))
    )


def usable_records(records: DataFrame) -> DataFrame:
    """Records of the archives that were read to the end, reports included."""
    # Written first, so that Spark knows its size: a short list is then broadcast, and the
    # records need no shuffle by feed.
    broken = durable(
        _reports(records).where(F.col("report") != PRESENT).select("feed_id").distinct(), "broken-feeds"
    )
    return records.join(broken, "feed_id", "left_anti")


def required_tables(records: DataFrame) -> DataFrame:
    """Per feed: the required tables it lacks, and whether it is complete.

    At least one of the two calendar tables is needed. The sets hold at most eight names.
    """
    present = F.collect_set("gtfs_table").alias("present")
    absent = F.array_sort(F.array_except(F.array(*[F.lit(t) for t in REQUIRED_TABLES]), "present"))
    no_calendar = ~F.arrays_overlap("present", F.array(*[F.lit(t) for t in CALENDAR_TABLES]))
    missing = F.when(no_calendar, F.concat(absent, F.array(F.lit("calendar")))).otherwise(absent)
    return (
        _reports(records)
        .groupBy("feed_id")
        .agg(present)
        .select("feed_id", F.array_sort(missing).alias("missing"))
        .withColumn("complete", F.size("missing") == 0)
    )


def _typed(value: Column, kind: str) -> Column:
    text = F.nullif(F.trim(value), F.lit(""))
    if kind == "date":
        return F.try_to_date(text, "yyyyMMdd")
    if kind == "string":
        return F.nullif(value, F.lit(""))
    return text.try_cast(kind)


def _rejects(table: str) -> list[tuple[str, Column]]:
    """For each column of a table that is no text: whether a record has a value there that does not fit."""
    found = []
    for i, (name, kind) in enumerate(FEED_COLUMNS[table]):
        if kind != "string":
            value = F.get("fields", F.lit(i))
            found.append((name, (F.trim(value) != "") & _typed(value, kind).isNull()))
    return found


def _rejected_in_row() -> Column:
    """Number of values of a record that do not fit their columns."""
    of_table = F.lit(0)
    for table in FEED_COLUMNS:
        of_row = reduce(lambda n, flag: n + F.coalesce(flag.cast("int"), F.lit(0)), [f for _, f in _rejects(table)], F.lit(0))
        of_table = F.when(F.col("gtfs_table") == table, of_row).otherwise(of_table)
    return of_table


def rejected_values(records: DataFrame, tables: Iterable[str] = FEED_COLUMNS) -> DataFrame:
    """(feed_id, gtfs_table, column, n_rejected) where a feed has values that do not fit."""
    parts = []
    for table in tables:
        flags = _rejects(table)
        if flags:
            own = records.where((F.col("gtfs_table") == table) & F.col("report").isNull())
            counted = own.groupBy("feed_id", "gtfs_table").agg(*[F.count_if(flag).alias(name) for name, flag in flags])
            parts.append(counted.unpivot(["feed_id", "gtfs_table"], [n for n, _ in flags], "column", "n_rejected").where("n_rejected > 0"))
    return reduce(DataFrame.unionByName, parts) if parts else records.sparkSession.createDataFrame([], REJECTED_SCHEMA)


def table_from_records(records: DataFrame, table: str, keep: Iterable[str] = ()) -> DataFrame:
    """One feed table with its types; a value that does not fit its type is null, and so is ''."""
    typed = [
        _typed(F.get("fields", F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(FEED_COLUMNS[table])
    ]
    rows = records.where((F.col("gtfs_table") == table) & F.col("report").isNull()).select("feed_id", *typed, *keep)
    if table == "stop_times":
        rows = rows.withColumn("departure_secs", time_to_secs(F.col("departure_time")))
    return rows


# How staged tables are laid out: rows of one trip, shape or feed lie together, so later
# groupings combine them before the shuffle and filters skip row groups by their statistics.
# Range boundaries are sampled over all the listed columns, so one huge feed still spreads.
# Stops lie along a curve through the map, so that a search in a box reads the row groups around it.
STAGED_ORDER = {
    "agency": ["feed_id", "agency_id"],
    "stops": [place_on_curve, "feed_id", "stop_id"],
    "routes": ["feed_id", "route_id"],
    "trips": ["feed_id", "trip_id"],
    "stop_times": ["feed_id", "trip_id", "stop_sequence"],
    "calendar": ["feed_id", "service_id"],
    "calendar_dates": ["feed_id", "date", "service_id"],
    "shapes": ["feed_id", "shape_id", "shape_pt_sequence"],
}
TRIP, BY_TRIP = ["feed_id", "trip_id"], ("trips", "stop_times")
LAYOUT, LAYOUT_SCHEMA = "layout", "gtfs_table string, buckets int"
STOP_GROUP_BYTES = 1 << 20  # of a row group of stops: small, as they are what a box skips


def complete_records(records: DataFrame) -> DataFrame:
    """Records of the feeds that have all required tables."""
    complete = durable(required_tables(records).where("complete").select("feed_id"), "complete-feeds")
    return records.join(complete, "feed_id", "left_semi")


def in_staged_order(rows: DataFrame, table: str) -> DataFrame:
    """Rows of a table ranged and sorted as they are staged."""
    order = [c(F.col("stop_lon"), F.col("stop_lat")) if callable(c) else F.col(c) for c in STAGED_ORDER[table]]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def stage_feeds(archives: DataFrame, folder: str, only_complete: bool = True, buckets: int | None = None) -> FeedTables:
    """Read archives once and write the feed tables as Parquet below `folder`.

    Feeds that lack a required table are left out unless `only_complete` is off. `folder`/rejected says how many
    values of each feed, table and column did not fit. The pass that writes a table counts them; only
    tables that have any are looked through by feed.

    With `buckets`, trips and stop times are stored in that many buckets by trip, and whatever joins or groups them by
    trip needs no shuffle again. A bucket is read by one task, so this suits timetables as they are, of many
    trips; in ranges, the layout without it, one trip of any length spreads over tasks.
    """
    # one folder per table, so that each of the reads below touches its own rows only
    records = usable_records(durable(scan_archives(archives), "records", partition_by="gtfs_table"))
    if only_complete:
        records = complete_records(records)
    spark = archives.sparkSession
    damaged, layout = [], []
    for table in STAGED_ORDER:
        # Flags go through the shuffle as one number: what is counted before it is counted twice, by its sampling.
        flags = [F.when(flag, 1 << i).otherwise(0) for i, (_, flag) in enumerate(_rejects(table))]
        odd = reduce(lambda a, b: a.bitwiseOR(b), flags, F.lit(0))
        seen = Observation()
        rows = table_from_records(records.withColumn("odd", odd), table, keep=["odd"])
        bucketed = buckets is not None and table in BY_TRIP
        dealt = rows.repartition(buckets, *TRIP) if bucketed else in_staged_order(rows, table)
        writer = dealt.observe(seen, F.count_if(F.col("odd") > 0).alias("n")).drop("odd").write.mode("overwrite")
        if table == "stops":
            writer = writer.option("parquet.block.size", STOP_GROUP_BYTES)
        if bucketed:
            spark.sql(f"drop table if exists {_table_name(folder, table)}")
            writer = writer.bucketBy(buckets, *TRIP).sortBy(*STAGED_ORDER[table])
            writer.option("path", f"{folder}/{table}").saveAsTable(_table_name(folder, table))
            layout.append((table, buckets))
        else:
            writer.parquet(f"{folder}/{table}")
        damaged += [table] if seen.get["n"] else []
    rejected_values(records, damaged).write.mode("overwrite").parquet(f"{folder}/rejected")
    spark.createDataFrame(layout, LAYOUT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{LAYOUT}")
    return staged_feeds(spark, folder)


def staged_feeds(spark: SparkSession, folder: str) -> FeedTables:
    """The tables below `folder`. Those in buckets are put into the session's catalog, where Spark keeps that layout."""
    buckets = {r.gtfs_table: r.buckets for r in spark.read.schema(LAYOUT_SCHEMA).parquet(f"{folder}/{LAYOUT}").collect()}
    found = {}
    for table in STAGED_ORDER:
        found[table] = spark.read.parquet(f"{folder}/{table}")
        if table in buckets:
            name = _table_name(folder, table)
            if not spark.catalog.tableExists(name):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found[table].schema)
                spark.sql(
                    f"create table {name} ({columns}) using parquet clustered by ({', '.join(TRIP)}) "
                    f"sorted by ({', '.join(STAGED_ORDER[table])}) into {buckets[table]} buckets location '{folder}/{table}'"
                )
            found[table] = spark.table(name)
    return FeedTables(**found)


def _table_name(folder: str, table: str) -> str:
    return f"tramline_{hashlib.md5(folder.encode()).hexdigest()[:16]}_{table}"
