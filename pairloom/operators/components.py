"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.runtime import cut

#: Links up to which the least neighbours, at most two rows a link, are broadcast.
FEW = 300_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every node of ``edges`` with the smallest node it reaches.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest of them; a few rounds turn each component into a star around its
    smallest node. The smallest neighbour of a node is found with map-side
    aggregation and joined back as a table of its own, so a node with very many
    edges is never gathered in one task. Edges with a null end and loops are ignored.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    links = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).distinct()
    links = cut(links)
    before = _print(links)
    while before[0]:
        few = before[0] <= FEW
        large = cut(_star(links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u"))), True, few))
        links = cut(_star(large, False, few))
        after = _print(links)
        if after == before:  # no link has changed
            break
        before = after
    stars = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _print(links: DataFrame) -> tuple:
    """Number of links and two sums of their hashes: equal for equal tables, else different but with probability 2^-64."""
    h, g = F.xxhash64("v", "u"), F.xxhash64("u", "v")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(low(h)), F.lit(0)), F.coalesce(F.sum(low(g)), F.lit(0))).first())


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """One step over links from ``v`` to ``u``; the result has ``v`` above ``u``."""
    least = links.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    # where a node has very many links they stay where they are, or, as a table of its own lets Spark do, are split
    least = F.broadcast(least) if few else cut(least)
    joined = links.join(least, "v")
    if large:  # v's larger neighbours, to the least of v and its neighbours
        moved = joined.where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    else:  # v and its smaller neighbours, to the least of them
        moved = joined.where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
    return moved.where(F.col("v") != F.col("u")).distinct()
