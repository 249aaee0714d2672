"""Texts made from feed and catalogue fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feed_label(country: Column, region: Column, name: Column) -> Column:
    """`[country][region]name`."""
    return F.concat(F.lit("["), country, F.lit("]["), region, F.lit("]"), name)


def base_name(path: Column) -> Column:
    """Last part of a path up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def source_kind(path: Column) -> Column:
    return F.when(path.startswith("http"), F.lit("remote")).otherwise(F.lit("local"))


def extent_numbers(text: Column) -> Column:
    """`xmin,ymin : xmax,ymax` to a struct of doubles; null when a number is missing or malformed."""
    numbers = F.split(F.replace(text, F.lit(" : "), F.lit(",")), ",")

    def number(position: int) -> Column:
        return F.get(numbers, F.lit(position)).try_cast("double")

    corners = [number(i) for i in range(4)]
    whole = F.lit(True)
    for corner in corners:
        whole = whole & corner.isNotNull()
    named = F.struct(*[c.alias(n) for c, n in zip(corners, ("xmin", "ymin", "xmax", "ymax"))])
    return F.when(whole, named)
