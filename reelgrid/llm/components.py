"""Connected components of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_once


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node of links (``a``, ``b``).

    Each round points the larger neighbours of every node at its smallest neighbour, then does the same with
    the smaller ones. Rounds work on written tables and end when one changes nothing, i.e. the links are stars;
    the number of rounds grows with the logarithm of the nodes. Null ends are not links.
    """
    edges = written_once(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, now = None, _print(edges)
    while before != now:
        edges = written_once(_small_star(_large_star(edges)))
        before, now = now, _print(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _print(edges: DataFrame) -> tuple:
    """Number of links and two independent digests of them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return (
        moved.where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
