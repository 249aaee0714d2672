"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.session import discard, durable_counted

HUB = 1_000  # edges of a node that one task may hold in any case
HUBS = 1_000  # a node with so small a part of all edges is no hub either


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; component = smallest node in it.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", SoCC 2014): the number of rounds grows with the logarithm of the
    graph, not with its diameter. Every step is a minimum per node, combined before the
    shuffle, and a join back. Hubs have their minima broadcast for that join, so their edges stay
    where they are; all other nodes have few edges. A round is one write, which also counts and
    hashes the edges: the same edges as before are the end.
    """
    links, now = _written(_downward(edges.select("a", "b")).distinct())
    while True:
        earlier, before = links, now
        links, now = _written(_small_star(_large_star(links, before["n"]), before["n"]))
        discard(earlier)
        if now == before:
            break
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)


def _written(links: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, their number and two hashes of the set of them."""
    return durable_counted(
        links, "components", n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("a", "b")), y=F.bit_xor(F.xxhash64("b", "a", F.lit(1)))
    )


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge from the larger to the smaller node, loops left out."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _with_smallest(edges: DataFrame, around: DataFrame, total: int) -> DataFrame:
    """Add `smallest` of `around(a, smallest, n)` to `edges(a, ...)`, of which a node has n among about `total`.

    Hubs have more than HUB edges and at least a HUBS-th of all, so there are 2 * HUBS of them at most: that
    is the size of what is broadcast.
    """
    if total <= HUB:  # then no node has so many
        return edges.join(around.select("a", "smallest"), "a")
    is_hub = (F.col("n") > HUB) & (F.col("n") * HUBS >= total)
    hubs = F.broadcast(around.where(is_hub).select("a", "smallest"))
    others = around.where(~is_hub).select("a", "smallest")
    return edges.join(hubs, "a").unionByName(edges.join(hubs.select("a"), "a", "left_anti").join(others, "a"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("smallest"), F.count(F.lit(1)).alias("n"))
    larger = _with_smallest(links.select(F.col("b").alias("a"), F.col("a").alias("larger")), around, total)
    return _downward(larger.select(F.col("larger").alias("a"), F.col("smallest").alias("b")))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    around = links.groupBy("a").agg(F.min("b").alias("smallest"), F.count(F.lit(1)).alias("n"))
    smaller = _with_smallest(links, around, total).select(F.col("b").alias("a"), F.col("smallest").alias("b"))
    return _downward(smaller.unionByName(around.select("a", F.col("smallest").alias("b")))).distinct()
