"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that can be reached, for every node of ``links``.

    Each round hangs the larger neighbours of a node under its smallest one, then the smaller ones;
    rounds grow with the logarithm of the longest path. All results are written, and a node of
    many links is a key of inner joins alone, which Spark splits.
    """
    pairs = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo")
    edges, state = stored(pairs.distinct()), None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        larger = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct())
        lowest = stored(larger.groupBy("hi").agg(F.min("lo").alias("m")))
        smaller = larger.join(lowest, "hi")
        edges = stored(smaller.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(smaller.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
