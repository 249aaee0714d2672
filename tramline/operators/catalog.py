"""Feed catalogue: search, table, selection, and the feeds to process."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.fixed_values import CATALOG_COLUMNS, PREFECTURES
from tramline.functions.text import base_name, extent_numbers, source_kind

FILE_KEY = ["organization_id", "feed_id", "file_uid"]


def prefectures(spark: SparkSession) -> DataFrame:
    """The 47 prefectures: feed_pref_id, feed_pref."""
    return spark.createDataFrame(
        [(code, name) for code, name in enumerate(PREFECTURES, start=1)], "feed_pref_id int, feed_pref string"
    )


def add_pref_name(entries: DataFrame, strict: bool = True) -> DataFrame:
    """Prefecture name by code. An unknown code is an error when `strict`, otherwise null.

    The broadcast side is the fixed list of 47.
    """
    named = entries.join(F.broadcast(prefectures(entries.sparkSession)), "feed_pref_id", "left")
    if not strict:
        return named
    unknown = F.raise_error(
        F.concat(F.lit("unknown prefecture code: "), F.coalesce(F.col("feed_pref_id").cast("string"), F.lit("null")))
    )
    return named.withColumn("feed_pref", F.when(F.col("feed_pref").isNull(), unknown).otherwise(F.col("feed_pref")))


def add_pref_code(rows: DataFrame, name: str = "feed_pref") -> DataFrame:
    """Prefecture code by name; an unknown name gives null."""
    codes = prefectures(rows.sparkSession).select(F.col("feed_pref").alias(name), "feed_pref_id")
    return rows.join(F.broadcast(codes), name, "left")


def pref_code(name: str | None) -> int | None:
    """Option value to code: None (any prefecture) and unknown names give None."""
    return PREFECTURES.index(name) + 1 if name in PREFECTURES else None


def catalog_search(
    entries: DataFrame,
    target_date: datetime.date,
    extent: str | None = None,
    pref: int | None = None,
    stops: DataFrame | None = None,
) -> DataFrame:
    """Entries valid on `target_date`, optionally of one prefecture and with a stop in `extent`.

    `stops` holds the stops of the catalogue's feeds (feed_id, stop_lon, stop_lat) and is needed
    for `extent` only.
    """
    day = F.lit(target_date)
    found = entries.where(
        (F.col("file_from_date").try_cast("date") <= day) & (F.col("file_to_date").try_cast("date") >= day)
    )
    if pref is not None:
        found = found.where(F.col("feed_pref_id") == pref)
    if extent:
        if stops is None:
            raise ValueError("a search by extent needs the stops of the feeds")
        found = found.join(feeds_in_extent(stops, extent), "feed_id", "left_semi")
    return found


def feeds_in_extent(stops: DataFrame, extent: str) -> DataFrame:
    """Feeds with a stop inside the closed box `xmin,ymin : xmax,ymax`."""
    corners = stops.sparkSession.range(1).select(extent_numbers(F.lit(extent)).alias("box")).first().box
    if corners is None:
        raise ValueError(f"not an extent: {extent!r}")
    # plain numbers, so that the box reaches the scan as pushed-down comparisons
    inside = F.col("stop_lon").between(corners.xmin, corners.xmax) & F.col("stop_lat").between(
        corners.ymin, corners.ymax
    )
    return stops.where(inside).select("feed_id").distinct()


def catalog_table(entries: DataFrame) -> DataFrame:
    """The 21 columns of the table under their display names; what is missing becomes ''."""
    return entries.select(
        *[
            (F.coalesce(F.col(key).cast("string"), F.lit("")) if key in entries.columns else F.lit("")).alias(column)
            for column, key, _ in CATALOG_COLUMNS
        ]
    )


def catalog_visible(table: DataFrame) -> DataFrame:
    """The columns shown to the user."""
    return table.select(*[column for column, _, shown in CATALOG_COLUMNS if shown])


def sort_key(column: str) -> Column:
    """Texts sort without regard to case, the prefecture code by number."""
    return F.col(column).try_cast("int") if column == "feed_pref_id" else F.lower(F.col(column))


def catalog_sorted(table: DataFrame, column: str | None = None, ascending: bool = True) -> DataFrame:
    """Table sorted by one column, ties by file; unsorted when no column is chosen."""
    if column is None:
        return table
    key = sort_key(column)
    return table.orderBy(key.asc() if ascending else key.desc(), *FILE_KEY)


def catalog_selected(table: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the table that `selection` (organization_id, feed_id, file_uid) names."""
    return table.join(selection, FILE_KEY, "left_semi")


def catalog_feed_infos(table: DataFrame) -> DataFrame:
    """Catalogue rows as feeds to process: path, group, dir."""

    def dashed(*names: str) -> Column:
        parts = [F.col(names[0])]
        for name in names[1:]:
            parts += [F.lit("-"), F.col(name)]
        return F.concat(*parts)

    return table.select(
        F.col("file_url").alias("path"),
        dashed("organization", "feed").alias("group"),
        dashed(*FILE_KEY).alias("dir"),
    )


def preset_feed_infos(presets: DataFrame) -> DataFrame:
    """Preset feeds as feeds to process: path, group, dir."""
    return presets.select(F.col("url").alias("path"), F.col("name").alias("group"), F.col("name").alias("dir"))


def local_feed_infos(paths: DataFrame) -> DataFrame:
    """Local archives (column `path`) as feeds to process: path, group, dir."""
    name = base_name(F.col("path"))
    return paths.select("path", name.alias("group"), name.alias("dir"))


def feed_manifest(infos: DataFrame) -> DataFrame:
    """Feeds to process with where they come from; the output folder identifies the feed."""
    return infos.select(
        F.col("dir").alias("feed_id"), "path", "group", "dir", source_kind(F.col("path")).alias("source_kind")
    )
