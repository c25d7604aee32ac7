"""Density clustering of anomalies on all chosen features.

Equal rows are one weighted point. The nearest neighbours of every point (``neighbours``) are the
links of a graph; a link is as long as the distance or the farther one of the core distances of its
ends, the reach of the first few rows around a point. The minimum spanning forest of the graph gives
a hierarchy of groups, from which the clusters that last longest are chosen (``hierarchy``), so dense
and thin ones are found side by side. Points in none are noise (-1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from vigilog.operators import hierarchy, labels, neighbours
from vigilog.operators.joins import attach
from vigilog.operators.scaling import fit_scaler, matrix_row
from vigilog.session import pinned, stored

# Neighbours that a point can be joined with.
JOINED = 15
DIRECT = 10
# Points of each part of the graph that are asked for a way to other parts.
BRIDGES = 16
NOISE = -1


def cluster_features(df: DataFrame, features: list[str]) -> list[str]:
    """The features whose variance exceeds the 30 % quantile of all variances; the ten
    largest if that leaves fewer than five, the first ten if it leaves none."""
    row = df.agg(*[F.var_samp(f).alias(f) for f in features]).first().asDict()
    variances = {f: (np.nan if row[f] is None else row[f]) for f in features}
    known = [v for v in variances.values() if not np.isnan(v)]
    limit = np.quantile(known, 0.3) if known else np.inf
    chosen = [f for f in features if variances[f] > limit]
    if len(chosen) < 5 and len(features) >= 5:
        ranked = sorted((f for f in features if not np.isnan(variances[f])), key=lambda f: -variances[f])
        return ranked[:10] or features[:10]
    return chosen or features[:10]


def cluster_sizes(rows: int, minimum: int = 5) -> tuple[int, int]:
    """Smallest cluster and rows around a point that its core distance spans."""
    if rows < 10:
        size = max(2, rows // 3)
    elif rows < 20:
        size = max(3, rows // 4)
    else:
        size = min(minimum, rows // 5)
    return size, max(1, min(3, size // 2))


def _asked_points(placed: DataFrame) -> DataFrame:
    """The first ``BRIDGES`` points of every tree, by hash."""
    order = Window.partitionBy("tree").orderBy(F.xxhash64("id"), "id")
    return placed.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= BRIDGES).drop("_place")


def _one_tree(points: DataFrame, width: int, core: DataFrame, forest: DataFrame, places: DataFrame) -> DataFrame:
    """The forest joined to one tree, so that the density at which its parts fall asunder is known.

    ``BRIDGES`` points of every tree, chosen by hash, are searched among each other with lists
    that are longer than that, so every tree is joined with another one in each round. The points of
    a joined tree are among those of its parts, and the forest is grown once, with all that were found.
    """
    links = forest.count()
    if links >= points.count() - 1:
        return forest
    labels = hierarchy.trees(forest, links, places)
    placed = points.select("id", "x").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("tree", F.coalesce("component", "id"))
    some = stored(_asked_points(placed.select("id", "x", F.lit(1).cast("long").alias("w"), "tree")).join(core, "id"))
    found, last = forest, None
    while 1 < (left := some.select("tree").distinct().count()) != last:
        near = neighbours.searched(some.select("id", "x", "w"), width, BRIDGES + DIRECT, by_rows=False).near
        edges = near.select("id", F.explode("near").alias("e")).select("id", "e.nb", "e.d")
        for end, other in (("id", "_a"), ("nb", "_b")):
            edges = edges.join(some.select(F.col("id").alias(end), F.col("tree").alias(f"{other}_tree"), F.col("core").alias(f"{other}_core")), end)
        bridges = stored(edges.filter("_a_tree <> _b_tree").select(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b"), F.greatest("d", "_a_core", "_b_core").alias("w"), "_a_tree", "_b_tree"))
        found = found.unionAll(bridges.groupBy("a", "b").agg(F.min("w").alias("w")))
        pairs = stored(bridges.select(F.least("_a_tree", "_b_tree").alias("a"), F.greatest("_a_tree", "_b_tree").alias("b")).distinct())
        joined = hierarchy.trees(pairs, pairs.count()).toDF("tree", "whole")
        some = stored(_asked_points(some.join(joined, "tree", "left").withColumn("tree", F.coalesce("whole", "tree")).drop("whole")))
        last = left
    return hierarchy.spanning_forest(found, places=places)


def point_clusters(points: DataFrame, width: int, smallest: int, samples: int) -> DataFrame:
    """``id`` and ``Cluster`` of weighted points ``id``, ``x``, ``w`` (stored)."""
    graph = neighbours.searched(points, width, JOINED + 1, by_rows=False)
    near, places = graph.near, graph.homes
    core = stored(neighbours.counted(near, samples, True).select("id", F.coalesce(F.array_max("used.d"), F.lit(0.0)).alias("core")))
    edges = near.select("id", F.explode("near").alias("e")).select("id", "e.nb", "e.d").filter("id <> nb")
    ends = core.select(F.col("id").alias("nb"), F.col("core").alias("far"))
    links = edges.join(core, "id").join(ends, "nb").select(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b"), F.greatest("d", "core", "far").alias("w"))
    forest = hierarchy.spanning_forest(links.groupBy("a", "b").agg(F.min("w").alias("w")), places=places)
    forest = _one_tree(points, width, core, forest, places)
    found = stored(hierarchy.density_hierarchy(points.select("id", "w"), forest, smallest).join(points.select("id", "w"), "id"))
    sizes = found.filter("cluster is not null").groupBy("cluster").agg(F.sum("w").alias("size"))
    numbers = hierarchy.numbered(sizes, F.desc("size"), "cluster").select("cluster", "number")
    return found.join(numbers, "cluster", "left").select("id", F.coalesce("number", F.lit(NOISE)).cast("int").alias("Cluster"))


def density_clusters(anomalies: DataFrame, features: list[str], minimum: int = 5) -> DataFrame:
    """Column ``Cluster`` for all rows; ``anomalies`` should be a stored table with ``record_id``."""
    rows = anomalies.count()
    smallest, samples = cluster_sizes(rows, minimum)
    if rows < 2:
        return anomalies.withColumn("Cluster", F.lit(NOISE))
    scaler = fit_scaler(anomalies, features)
    points, members = neighbours.points_of(stored(anomalies.select("record_id", neighbours.scaled_row(scaler, matrix_row(features)).alias("x"))))
    found = point_clusters(points, len(features), max(2, smallest), samples)
    return anomalies.join(members.join(found, "id").select("record_id", "Cluster"), "record_id")


def clean_name(feature: str) -> str:
    """A feature name as used in cluster labels."""
    return feature.replace("_", " ").replace("Is", "").replace("Has", "").strip()


def cluster_names(df: DataFrame, features: list[str]) -> DataFrame:
    """``(Cluster, ClusterLabel)``: the two features with the largest means."""
    means = df.filter(F.col("Cluster") != NOISE).groupBy("Cluster").agg(*[F.avg(f).alias(f) for f in features])
    entries = F.array(
        *[F.struct(F.col(f).cast("double").alias("mean"), F.lit(-i).alias("order"), F.lit(clean_name(f)).alias("name"))
          for i, f in enumerate(features)]
    )
    top = F.slice(F.sort_array(entries, asc=False), 1, 2)
    text = F.array_join(F.transform(top, lambda e: e["name"]), ", ")
    return means.select(
        "Cluster", F.concat(F.lit("Cluster "), F.col("Cluster").cast("string"), F.lit(": "), text).alias("ClusterLabel")
    )


def grouped_anomalies(anomalies: DataFrame, features: list[str], direct: int = DIRECT) -> DataFrame:
    """Columns ``Cluster`` and ``ClusterLabel``: attack patterns for few anomalies,
    density clusters named by their features for many."""
    if anomalies.limit(direct + 1).count() <= direct:
        return labels.with_attack_pattern(anomalies)
    chosen = cluster_features(anomalies, features)
    found = density_clusters(anomalies, chosen)
    names = cluster_names(found, chosen)
    named = pinned(found.groupBy("Cluster").agg(F.count(F.lit(1)).alias("_weight")).join(names, "Cluster", "left"))
    labelled = attach(found, named, "Cluster", "_weight")
    return labelled.withColumn("ClusterLabel", F.coalesce("ClusterLabel", F.lit("Unclustered")))
