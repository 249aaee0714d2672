"""Preset lists and catalogue responses staged as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.fixed_values import CATALOG_COLUMNS, PRESET_FEEDS
from tramline.functions.text import feed_label
from tramline.schemas import PRESET_SCHEMA
from tramline.sources.json_arrays import read_array

# Prefecture names come from the fixed list, not from the response.
RESPONSE_KEYS = [key for _, key, _ in CATALOG_COLUMNS if key != "feed_pref"]

ENTRY_SCHEMA = T.StructType([T.StructField(key, T.StringType()) for key in RESPONSE_KEYS])
RESPONSE_SCHEMA = T.StructType([T.StructField("body", T.ArrayType(ENTRY_SCHEMA))])


def read_presets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Preset list: one JSON array per file, of any size, or with `multi_line=False` one object per line."""
    if multi_line:
        return read_array(spark, path, PRESET_SCHEMA).select("element.*")
    return spark.read.schema(PRESET_SCHEMA).json(path, mode="FAILFAST")


def builtin_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESET_FEEDS), PRESET_SCHEMA)


def with_label(presets: DataFrame) -> DataFrame:
    return presets.withColumn("label", feed_label(F.col("country"), F.col("region"), F.col("name")))


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Entries of staged catalogue responses: one response per file, of any size, or with `multi_line=False` per line.

    A response without `body` has no entries; a text that is no JSON is an error.
    """
    if multi_line:
        entries = read_array(spark, path, ENTRY_SCHEMA, "body").select("element.*")
    else:
        responses = spark.read.schema(RESPONSE_SCHEMA).json(path, mode="FAILFAST")
        entries = responses.select(F.explode("body").alias("entry")).select("entry.*")
    return entries.withColumn("feed_pref_id", F.col("feed_pref_id").try_cast("int"))
