"""Earlier outputs read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.schemas import FEATURE_SCHEMA, GEOJSON_READ_SCHEMA, RELATION_SCHEMA
from tramline.sources.json_arrays import read_array


def features_of(texts: DataFrame) -> DataFrame:
    """One row per feature of GeoJSON features or collections: properties, geometry_type, coordinates (JSON text)."""
    other = [c for c in texts.columns if c not in ("type", "geometry", "properties", "features")]
    single = F.array(F.struct("type", "geometry", "properties"))
    features = F.when(F.col("type") == "Feature", single).otherwise(F.col("features"))
    return texts.select(*other, F.explode(features).alias("feature")).select(
        *other,
        F.col("feature.properties").alias("properties"),
        F.col("feature.geometry.type").alias("geometry_type"),
        F.col("feature.geometry.coordinates").alias("coordinates"),
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of every line or collection below `path`; folders like feed_dir=X become columns."""
    return features_of(spark.read.schema(GEOJSON_READ_SCHEMA).json(path, mode="FAILFAST"))


def read_collections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Features of documents that are one feature collection each, of any size, with the folder's `feed_dir`."""
    found = read_array(spark, path, FEATURE_SCHEMA, "features")
    return found.select(
        F.regexp_extract("path", "/feed_dir=([^/]*)/[^/]*$", 1).alias("feed_dir"),
        F.col("element.properties").alias("properties"),
        F.col("element.geometry.type").alias("geometry_type"),
        F.col("element.geometry.coordinates").alias("coordinates"),
    )


def read_relations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Stop relation tables below `path`, always as UTF-8."""
    return spark.read.schema(RELATION_SCHEMA).csv(
        path, header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"', mode="FAILFAST"
    )
