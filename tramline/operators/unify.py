"""Unification of similar stops: parent station, then id prefix, then name and distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.near import near_groups
from tramline.session import durable, durable_counted

STOP = ["feed_id", "stop_id"]


def identity_relation(stops: DataFrame) -> DataFrame:
    """Every stop stands for itself."""
    return stops.select(*STOP, F.col("stop_id").alias("similar_stop_id"), F.lit("none").alias("rule"))


def parent_matches(stops: DataFrame) -> DataFrame:
    """Stops with an existing parent go to the station at the top, and parents without one stay themselves.

    Stops that lead round in a circle of parents have no top and are left to the other rules.
    """
    # stops without a parent are set apart first: as join keys they would all meet in one task
    children = stops.where("trim(parent_station) <> ''").selectExpr("feed_id", "stop_id", "parent_station as parent")
    known = stops.selectExpr("feed_id", "stop_id as parent")
    valid = (
        children.join(known, ["feed_id", "parent"], "left_semi").groupBy(*STOP).agg(F.max("parent").alias("above"))
    )
    above = valid.selectExpr("feed_id", "above as stop_id", "above").distinct()
    tops = above.join(valid.where("stop_id <> above"), STOP, "left_anti")
    top = tops.select(*STOP).withColumn("at_top", F.lit(True))
    first = valid.where("stop_id <> above").join(top.withColumnRenamed("stop_id", "above"), ["feed_id", "above"], "left")
    first = first.select(*STOP, "above", F.coalesce("at_top", F.lit(False)).alias("at_top"))
    arrived = F.count_if("at_top")
    up, seen = durable_counted(first, "parents", arrived=arrived, on_the_way=F.count_if(~F.col("at_top")))
    done = [up.where("at_top")]
    # A round doubles the levels that are passed. Whoever has a top above has a stop on the way that arrives in the next
    # round, so a round in which nobody arrives leaves circles only.
    while seen["on_the_way"]:
        way = up.where("not at_top")
        known = reduce(DataFrame.unionByName, done, way).select("feed_id", F.col("stop_id").alias("above"), F.col("above").alias("over"), "at_top")
        further = way.drop("at_top").join(known, ["feed_id", "above"]).select(*STOP, F.col("over").alias("above"), "at_top")
        up, seen = durable_counted(further, "parents", arrived=arrived, on_the_way=F.count_if(~F.col("at_top")))
        done.append(up.where("at_top"))
        if not seen["arrived"]:
            break
    found = reduce(DataFrame.unionByName, done).select(*STOP, F.col("above").alias("similar_stop_id"))
    return found.unionByName(tops.select(*STOP, F.col("above").alias("similar_stop_id")))


def id_prefix(stop_id: Column, delimiter: str) -> Column:
    """The part of an id before the last delimiter; null without a delimiter or before it nothing."""
    last = F.substring_index(stop_id, delimiter, -1)
    cut = F.length(stop_id) - F.length(last) - len(delimiter)
    return F.when(F.contains(stop_id, F.lit(delimiter)) & (cut > 0), F.substring(stop_id, F.lit(1), cut))


def prefix_matches(stops: DataFrame, delimiter: str) -> DataFrame:
    """Stops sharing an id prefix go to the first of them by id."""
    prefixed = stops.select(*STOP, id_prefix(F.col("stop_id"), delimiter).alias("prefix")).where(
        F.col("prefix").isNotNull()
    )
    firsts = (
        prefixed.groupBy("feed_id", "prefix")
        .agg(F.min("stop_id").alias("similar_stop_id"), F.count("*").alias("members"))
        .where(F.col("members") > 1)
    )
    return prefixed.join(firsts, ["feed_id", "prefix"]).select(*STOP, "similar_stop_id")


def near_matches(stops: DataFrame) -> DataFrame:
    """Stops of one name near each other go to the first of the group by id."""
    return near_groups(stops)


def _apply(stops: DataFrame, matches: DataFrame, rule: str) -> DataFrame:
    """Fill in `similar_stop_id` and `rule` for the stops that `matches` names."""
    found = matches.selectExpr(*STOP, "similar_stop_id as found_id")
    rest = [c for c in stops.columns if c not in ("similar_stop_id", "rule")]
    return stops.join(found, STOP, "left").selectExpr(
        *rest,
        "coalesce(similar_stop_id, found_id) as similar_stop_id",
        f"coalesce(rule, case when found_id is not null then '{rule}' end) as rule",
    )


def unify_stops(stops: DataFrame, unify: bool = True, delimiter: str = "") -> DataFrame:
    """The relation (feed_id, stop_id, similar_stop_id, rule), one row per stop.

    A stop follows the first rule that matches it; later rules only see what is left.
    """
    if not unify:
        return identity_relation(stops)
    decided = stops.selectExpr(
        *STOP, "stop_name", "stop_lon", "stop_lat", "parent_station",
        "cast(null as string) as similar_stop_id", "cast(null as string) as rule",
    )
    decided = _apply(decided, parent_matches(stops), "parent").drop("parent_station")
    if delimiter:
        decided = _apply(decided, prefix_matches(decided.where("rule is null"), delimiter), "prefix")
    # read many times below
    decided = durable(decided, "decided-by-id")
    decided = _apply(decided, near_matches(decided.where("rule is null")), "near")
    return decided.selectExpr(
        *STOP, "coalesce(similar_stop_id, stop_id) as similar_stop_id", "coalesce(rule, 'none') as rule"
    )


def one_row_per_stop(stops: DataFrame) -> DataFrame:
    """Stops with repeated ids reduced to one row each, always the same one; rows without id left out."""
    others = [c for c in stops.columns if c not in STOP]
    return (
        stops.where(F.col("stop_id").isNotNull())
        .groupBy(*STOP)
        .agg(F.min(F.struct(*others)).alias("row"))
        .select(*STOP, *[F.col(f"row.{c}").alias(c) for c in others])
    )


def stop_relations(relation: DataFrame, stops: DataFrame) -> DataFrame:
    """The relation with names before and after, one row per stop."""
    names = stops.select(*STOP, "stop_name")
    after = names.select(
        "feed_id", F.col("stop_id").alias("similar_stop_id"), F.col("stop_name").alias("similar_stop_name")
    )
    return (
        relation.join(names, STOP)
        .join(after, ["feed_id", "similar_stop_id"])
        .select(*STOP, "stop_name", "similar_stop_id", "similar_stop_name", "rule")
    )


# Coordinates are averaged as whole numbers of 1e-7 degrees (about a centimetre): integer sums
# do not depend on the order of the rows, so a repeated task gives the same position.
_UNITS = 10_000_000


def _mean_six_decimals(total: str, members: str) -> Column:
    """total / members in units of 1e-7, rounded half up to 1e-6, by integer arithmetic."""
    millionths = F.expr(
        f"(2 * {total} + 10 * {members} - pmod(2 * {total} + 10 * {members}, 20 * {members})) div (20 * {members})"
    )
    return millionths / F.lit(1e6)


def unified_stops(relation: DataFrame, stops: DataFrame) -> DataFrame:
    """Name and position of each unified stop.

    A parent keeps its own position; other groups get the mean of their members, those without a
    position left out, and a null position if none has one. The name is that of the stop whose id the
    group carries.
    """
    places = stops.select(*STOP, "stop_lon", "stop_lat")
    placed = F.col("stop_lon").isNotNull() & F.col("stop_lat").isNotNull()
    parents = F.col("rule") == "parent"
    # under the parent rule only the parent's own row gives the position
    counted = relation.where(~parents | (F.col("stop_id") == F.col("similar_stop_id")))
    means = (
        counted.join(places, STOP)
        .groupBy("feed_id", "similar_stop_id")
        .agg(
            F.sum(F.when(placed, F.round(F.col("stop_lon") * _UNITS).cast("long"))).alias("lon_total"),
            F.sum(F.when(placed, F.round(F.col("stop_lat") * _UNITS).cast("long"))).alias("lat_total"),
            F.nullif(F.sum(placed.cast("long")), F.lit(0)).alias("members"),
        )
        .select(
            "feed_id",
            "similar_stop_id",
            _mean_six_decimals("lon_total", "members").alias("lon"),
            _mean_six_decimals("lat_total", "members").alias("lat"),
        )
    )
    names = stops.select(
        "feed_id", F.col("stop_id").alias("similar_stop_id"), F.col("stop_name").alias("similar_stop_name")
    )
    return means.join(names, ["feed_id", "similar_stop_id"]).select(
        "feed_id", "similar_stop_id", "similar_stop_name", "lon", "lat"
    )
