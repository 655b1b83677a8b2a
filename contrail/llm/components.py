"""Connected components of a graph of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches. Nodes without a link are left out.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest; the table is written after
    every round, and the rounds end when it no longer changes: after about the logarithm of the longest chain. rows: how
    many links there are, if that is known.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", rows=rows)
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "cc", rows=2 * state[0])  # an edge gives one at most, and one for each node
        was, state = state, digest(edges)
        if state == was:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
