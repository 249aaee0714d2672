"""Session settings and tables that outlive the executors which made them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_folders: dict[str, str] = {}
_passing = threading.local()

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "tramline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; `conf` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Call sites recorded for every column make plans of many columns slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a fresh one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="tramline-")
    return _local_folders[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where a result is read several times or fed back into a loop: the lineage is
    cut by a table that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    for tables in getattr(_passing, "scopes", [])[-1:]:
        tables.append((spark, path))
    writer = df.write.option("compression", "zstd")
    with shuffles_removed(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    written = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    written.durable_path = path
    return written


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they end, instead of when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `durable` writes inside are removed at the end, but for those that `keep`, the value given, was told of.

    For steps towards a result that is itself written. What is kept belongs to the scope around, if there is one.
    """
    scopes = _passing.scopes = getattr(_passing, "scopes", [])
    tables: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.durable_path)
        return df

    scopes.append(tables)
    try:
        yield keep
    finally:
        scopes.pop()
        for spark, path in tables:
            if path not in kept:
                remove(spark, path)
            elif scopes:
                scopes[-1].append((spark, path))


def durable_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """`durable`, with aggregates over the rows that the same pass takes."""
    seen = Observation()
    written = durable(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)
    return written, dict(seen.get)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in Hadoop's form."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all that is in it, if it is there."""
    system, folder = file_system(spark, path)
    system.delete(folder, True)


def discard(df: DataFrame) -> None:
    """Remove the table behind a `durable` result that nothing reads any more, such as an earlier round's."""
    path = getattr(df, "durable_path", None)
    if path:
        remove(df.sparkSession, path)
