"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.session import stored


def components(links: DataFrame) -> DataFrame:
    """Rows ``node``, ``component`` for every node of ``links`` (columns ``a``, ``b``, both long).

    ``component`` is the smallest node that can be reached. Rounds alternate between
    hanging the larger neighbours of each node under its smallest neighbour and doing
    so with the smaller ones, until nothing changes; their number grows with the
    logarithm of the longest path. Every round is two aggregates and two joins by node
    whose results are written to the shared folder; a node with many links is an
    ordinary skewed key of an inner join, which Spark splits.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # The aggregates are written too: a join right on top of one could not split a node with many links.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        larger = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())
        lowest = stored(larger.groupBy("hi").agg(F.min("lo").alias("m")))
        smaller = larger.join(lowest, "hi")
        edges = stored(
            smaller.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(smaller.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
