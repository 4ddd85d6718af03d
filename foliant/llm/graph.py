"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, root): root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the edges shrink to stars in
    O(log n) rounds, each a partial aggregate and an equi-join; every round is written out, so no
    lineage builds up and nothing is collected. Nulls and self loops are ignored; an empty table
    gives an empty result.
    """
    now = stage(_canonical(edges), "cc-edges")
    before = None
    while True:
        nodes = _both(now)
        least = stage(nodes.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = stage(_canonical(nodes.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))), "cc-large")
        small_least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "cc-small-least")
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        done = stage(_canonical(small), "cc-edges")
        release(now, least, large, small_least)
        state = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = done
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def _canonical(edges: DataFrame) -> DataFrame:
    """Larger end first, once each."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
