"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import settle


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of the links (a, b); a component is named by its smallest node.

    Each round ties the larger neighbours of every node to its smallest
    neighbour, then the smaller ones likewise, until every node is tied to the
    smallest of its component. Only per-node minima are grouped, so a node may
    have any number of links; every round is a table in the shared folder.
    """
    current = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(rounds):
        two = _both_ways(current)
        lowest = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = two.filter("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = settle(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = settle(after, "small-star")
        state = lambda t: t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        done = tuple(state(after)) == tuple(state(current))
        current = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    tied = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
