"""Groups of stops with the same name that lie near each other.

Two stops are near when their distance in the lon/lat plane is at most RADIUS; a group is a
connected component of that relation inside one name. Pairs of stops are never enumerated:

1. A grid cell is small enough that all its stops are near each other, so each cell with a
   stop is one node, whatever the number of stops in it.
2. Two cells up to two steps apart are linked when any stop of one is near any stop of the
   other. Each cell carries the bounding boxes of its 16 parts, and two boxes usually decide:
   all of one is near all of the other, or nothing is. Where they do not, the two parts are
   halved in each direction and compared again, until every case is decided: a part with one
   position is compared by its exact distance.
3. Components of the linked cells give the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.components import connected_components
from tramline.session import durable

# Fixed value: near means at most 0.003 degrees.
RADIUS = 0.003

# The diagonal of a cell, 0.00283, is below RADIUS.
CELL = 0.002

# Cells within reach, each unordered pair of cells once: two steps of 0.002 pass 0.003.
AHEAD = [(dx, dy) for dx in range(0, 3) for dy in range(-2, 3) if dx > 0 or dy > 0]

# Cells of a tile in each direction. Cells meet by tile: each in its own, and in those that reach it.
TILE = 8

# Halvings of a cell that make its 16 parts.
PART_LEVEL = 2

CELL_KEY = ["feed_id", "stop_name", "cell_x", "cell_y"]

BOX = "min(stop_lon) as x0, max(stop_lon) as x1, min(stop_lat) as y0, max(stop_lat) as y1"


def with_cell(stops: DataFrame) -> DataFrame:
    """Stops with their grid cell; stops without a name or a position have no neighbours."""
    return stops.where("stop_name is not null and stop_lon is not null and stop_lat is not null").selectExpr(
        "feed_id", "stop_id", "stop_name", "stop_lon", "stop_lat", *_grid("cell", 0)
    )


def _grid(name: str, level: int) -> list[str]:
    """Grid position after `level` halvings. Dividing by a power of two is exact, so a part at
    one level lies in exactly one part of the level before."""
    size = f"cast({CELL / 2**level!r} as double)"
    return [f"floor(stop_lon / {size}) as {name}_x", f"floor(stop_lat / {size}) as {name}_y"]


def numbered_cells(placed: DataFrame) -> DataFrame:
    """One row per occupied cell: node number, part boxes, number of stops, smallest stop id."""
    parts = placed.selectExpr("*", *_grid("part", PART_LEVEL)).groupBy(*CELL_KEY, "part_x", "part_y")
    cells = (
        parts.agg(*_boxed("min(stop_id) as first_id", "count(*) as n"))
        .groupBy(*CELL_KEY)
        .agg(
            F.expr("collect_list(struct(part_x, part_y, x0, x1, y0, y1, first_id)) as boxes"),  # 16 at most
            F.expr("sum(n) as n_stops"),
            F.expr("min(first_id) as first_stop_id"),
        )
    )
    # the numbers are assigned as the table is written, and fixed from then on
    return durable(cells.withColumn("node", F.monotonically_increasing_id()), "cells")


def _boxed(*more: str) -> list[Column]:
    return [F.expr(text) for text in [*BOX.split(", "), *more]]


def _farthest(p: str, q: str) -> str:
    """SQL for the square of the largest distance between the boxes p and q."""
    across = [f"greatest({q}.{axis}1 - {p}.{axis}0, {p}.{axis}1 - {q}.{axis}0)" for axis in "xy"]
    return " + ".join(f"{d} * {d}" for d in across)


def _closest(p: str, q: str) -> str:
    """SQL for the square of the smallest distance between the boxes p and q."""
    gaps = [f"greatest(0D, {q}.{axis}0 - {p}.{axis}1, {p}.{axis}0 - {q}.{axis}1)" for axis in "xy"]
    return " + ".join(f"{d} * {d}" for d in gaps)


LIMIT = f"cast({RADIUS * RADIUS!r} as double)"


def _all_near(p: str, q: str) -> str:
    return f"({_farthest(p, q)} <= {LIMIT})"


def _undecided(p: str, q: str) -> str:
    return f"({_closest(p, q)} <= {LIMIT} and {_farthest(p, q)} > {LIMIT})"


def linked_cells(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, feed_id, near_a, near_b): two different cells, by node number, and a near pair of their stops.

    Each pair of cells once. All of one box near all of the other makes the first stops of both a near pair.
    """
    tile = ["feed_id", "stop_name", "tile_x", "tile_y"]
    own = [f"floor(cell_{axis} / {TILE}) as tile_{axis}" for axis in "xy"]
    # the tiles of the cells that have a cell ahead: two steps back in x, two steps either way in y
    back = [f"floor((cell_x - {dx}) / {TILE})" for dx in (0, 2)]
    beside = [f"floor((cell_y + {dy}) / {TILE})" for dy in (-2, 2)]
    reached = [f"explode(array_distinct(array({', '.join(t)}))) as tile_{axis}" for axis, t in (("x", back), ("y", beside))]
    here = cells.selectExpr("feed_id", "stop_name", *own, "cell_x as x_a", "cell_y as y_a", "node as a", "boxes as boxes_a")
    there = cells.selectExpr("feed_id", "stop_name", reached[0], "cell_x as x_b", "cell_y", "node as b", "boxes as boxes_b")
    there = there.selectExpr("feed_id", "stop_name", "tile_x", reached[1], "x_b", "cell_y as y_b", "b", "boxes_b")
    dx, dy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
    ahead = dx.between(0, 2) & dy.between(-2, 2) & ((dx > 0) | (dy > 0))
    ends = "struct({p}.first_id as near_a, {q}.first_id as near_b)"
    parts = "struct({p}.part_x as ax, {p}.part_y as ay, {q}.part_x as bx, {q}.part_y as by)"
    # most cells have one part, and then no lists are gone through
    single, one = "size(boxes_a) = 1 and size(boxes_b) = 1", {"p": "boxes_a[0]", "q": "boxes_b[0]"}
    near = f"""case when {single} then case when {_all_near(**one)} then {ends.format(**one)} end
        else get(flatten(transform(boxes_a, p -> transform(filter(boxes_b, q -> {_all_near('p', 'q')}), q -> {ends.format(p='p', q='q')}))), 0) end"""
    unsure = f"""case when {single} then case when {_undecided(**one)} then array({parts.format(**one)}) end
        else flatten(transform(boxes_a, p -> transform(filter(boxes_b, q -> {_undecided('p', 'q')}), q -> {parts.format(p='p', q='q')}))) end"""
    pairs = (
        here.join(there, [here[c] == there[c] for c in tile] + [ahead])
        .select(here["feed_id"], here["stop_name"], "a", "b", "boxes_a", "boxes_b")
        .selectExpr("feed_id", "stop_name", "a", "b", f"{near} as near", "boxes_a", "boxes_b")
        .selectExpr("feed_id", "stop_name", "a", "b", "near", f"case when near is null then {unsure} end as unsure")
        .where("near is not null or size(unsure) > 0")
    )
    pairs = durable(pairs, "cell-pairs")
    found = pairs.where("near is not null").select("a", "b", "feed_id", "near.*")
    open_pairs = pairs.where("near is null").selectExpr("feed_id", "stop_name", "a", "b", "inline(unsure)")
    level = PART_LEVEL
    while not open_pairs.isEmpty():
        level += 1
        compared = durable(_compare_halves(placed, open_pairs, level), "cell-parts")
        hits = compared.where("near is not null").groupBy("a", "b", "feed_id").agg(F.min("near").alias("near"))
        found = found.unionByName(hits.select("a", "b", "feed_id", "near.*"))
        open_pairs = compared.where("near is null").drop("near").join(hits, ["a", "b"], "left_anti")
    return found


def _compare_halves(placed: DataFrame, open_pairs: DataFrame, level: int) -> DataFrame:
    """Compare the halves, at `level`, of the undecided parts, and keep what is linked or undecided."""
    part = ["feed_id", "stop_name", "part_x", "part_y"]
    needed = (
        open_pairs.selectExpr("feed_id", "stop_name", "inline(array(struct(ax as part_x, ay as part_y), struct(bx as part_x, by as part_y)))")
        .distinct()
    )
    halves = (
        placed.selectExpr(
            "feed_id", "stop_id", "stop_name", "stop_lon", "stop_lat", *_grid("part", level - 1), *_grid("half", level)
        )
        .join(needed, part, "left_semi")
        .groupBy(*part, "half_x", "half_y")
        .agg(*_boxed("min(stop_id) as first_id"))
    )

    def side(s: str) -> DataFrame:
        return halves.selectExpr(
            "feed_id", "stop_name", f"part_x as {s}x", f"part_y as {s}y",
            f"struct(half_x, half_y, x0, x1, y0, y1, first_id) as {s}_box",
        )

    return (
        open_pairs.join(side("a"), ["feed_id", "stop_name", "ax", "ay"])
        .join(side("b"), ["feed_id", "stop_name", "bx", "by"])
        .where(f"{_closest('a_box', 'b_box')} <= {LIMIT}")
        .selectExpr(
            "feed_id", "stop_name", "a", "b",
            "a_box.half_x as ax", "a_box.half_y as ay", "b_box.half_x as bx", "b_box.half_y as by",
            f"case when {_all_near('a_box', 'b_box')} then struct(a_box.first_id as near_a, b_box.first_id as near_b) end as near",
        )
    )


def near_group_links(stops: DataFrame) -> DataFrame:
    """Near pairs that hold each near group together: feed_id, stop_id_a, stop_id_b, link.

    At most one per stop (`same_cell`, with the first stop of its cell) and one per pair of cells
    (`linked_cells`). Every row is a near pair; the components of the rows are those of all near pairs, while
    their number stays proportional to the number of stops.
    """
    placed = with_cell(stops)
    cells = numbered_cells(placed)
    same_cell = (
        placed.select("stop_id", *CELL_KEY)
        .join(cells.where("n_stops > 1").select(*CELL_KEY, "first_stop_id"), CELL_KEY)
        .where("stop_id <> first_stop_id")
        .selectExpr("feed_id", "first_stop_id as stop_id_a", "stop_id as stop_id_b", "'same_cell' as link")
    )
    between = linked_cells(placed, cells).selectExpr(
        "feed_id", "least(near_a, near_b) as stop_id_a", "greatest(near_a, near_b) as stop_id_b", "'linked_cells' as link"
    )
    return same_cell.unionByName(between)


def near_groups(stops: DataFrame) -> DataFrame:
    """(feed_id, stop_id, similar_stop_id) for stops in a near group of two or more."""
    placed = with_cell(stops)
    cells = numbered_cells(placed)
    components = connected_components(linked_cells(placed, cells))
    labelled = (
        cells.select(*CELL_KEY, "node", "n_stops", "first_stop_id")
        .join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    # a component holds cells of one feed and one name only
    groups = (
        labelled.groupBy("component")
        .agg(F.min("first_stop_id").alias("similar_stop_id"), F.sum("n_stops").alias("members"))
        .where("members > 1")
    )
    answer = labelled.join(groups, "component").select(*CELL_KEY, "similar_stop_id")
    return placed.select("stop_id", *CELL_KEY).join(answer, CELL_KEY).select("feed_id", "stop_id", "similar_stop_id")
