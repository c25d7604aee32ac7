"""Spanning forests of weighted links, and clusters of unlike density from their hierarchy.

The minimum spanning forest is grown by rounds. Where the cells of the points are known, each chunk of
cells takes its links and those that lead out of it in ascending order: a group takes its lightest link,
until that is one that leads out, and the heaviest link of a circle goes. What is left joins the groups,
and chunks become larger. Without cells, or if they leave too many links, Boruvka rounds follow: every
component takes its lightest link, the components that these join become one, and links inside a
component go. Once the links that are left fit in one bounded task, it takes them in ascending order;
the forest is the same, since links are ordered by weight and ends, without ties.

Read in ascending order, the forest's links merge groups. A group that reaches the smallest size is
a cluster; two clusters that meet are the children of a new one; points of smaller groups join a
cluster at the link that brings them. The density of a link is 1 / weight, and a cluster lasts for
each of its points from the density at which it parts from its sibling to that at which the point
joins. A cluster that lasts longer than the best of its descendants do in all is chosen over them.
Links are read ``LINKS`` at a time, with the state of the groups that they touch, so that no task
holds them all, and the chosen clusters are handed down from the top in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigilog.operators.components import components
from vigilog.session import pinned, stored

LINKS = 1_000_000
# Ends of links in one chunk of cells, about.
ENDS = 400_000


def _find(above: list[int], i: int) -> int:
    while (up := above[i]) != i:
        above[i] = above[up]
        i = above[i]
    return i


def _numbers(*columns: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """The different values of the columns in order, where each comes first, and the columns as numbers of these values."""
    names, first, at = np.unique(np.concatenate([c.to_numpy() for c in columns]), return_index=True, return_inverse=True)
    return names, first, [x.tolist() for x in np.split(at, len(columns))]


def _kruskal(links: pa.Table) -> pa.Table:
    links = links.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
    names, _, (us, vs) = _numbers(links.column("u"), links.column("v"))
    above = list(range(len(names)))
    kept = []
    for i, (u, v) in enumerate(zip(us, vs, strict=True)):
        u, v = _find(above, u), _find(above, v)
        if u != v:
            above[u] = v
            kept.append(i)
    return links.select(["a", "b", "w"]).take(pa.array(kept, pa.int64()))


def _trees(links: pa.Table) -> pa.Table:
    names, _, (us, vs) = _numbers(links.column("a"), links.column("b"))
    above = list(range(len(names)))
    for u, v in zip(us, vs, strict=True):
        u, v = _find(above, u), _find(above, v)
        above[max(u, v)] = min(u, v)
    return pa.table({"node": names, "component": names[[_find(above, i) for i in range(len(names))]]})


def trees(forest: DataFrame, size: int, places: DataFrame | None = None) -> DataFrame:
    """``node`` and ``component``, its smallest node, of the stored ``size`` links of a forest; ``places``: ``id``, ``node``, the cells of its points."""
    if size <= LINKS:
        return stored(forest.groupBy(F.lit("all")).applyInArrow(_trees, "node long, component long"))
    if places is None:
        return components(forest)
    # The trees of each chunk, then those that share a point.
    links = _chunked(forest, places, LINKS)[0].select("a", "b", F.coalesce("cu", "cv", F.pmod(F.xxhash64("a"), F.lit(1000)) - 1000).alias("chunk"))
    parts = stored(links.groupBy("chunk").applyInArrow(_trees, "node long, component long"))
    shared = parts.groupBy("node").count().filter("count > 1").select("node")
    pairs = stored(parts.join(shared, "node").toDF("a", "b"))
    met = trees(pairs, pairs.count()).toDF("component", "whole")
    return stored(parts.join(met, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).distinct())


def _chunked(links: DataFrame, places: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Stored ``links`` with the groups ``u``, ``v`` of the ends, at first the ends, and their chunks ``cu``, ``cv``, and the number of chunks.

    Chunks are runs of cells. Ends without a cell, or in one of more than ``most`` ends, are in no chunk.
    """
    cell = places.groupBy("id").agg(F.min("node").alias("cell"))
    placed = stored(links.select("a", "b", "w").join(cell.toDF("a", "pu"), "a", "left").join(cell.toDF("b", "pv"), "b", "left"))
    cells = placed.select(F.col("pu").alias("cell")).unionAll(placed.select("pv")).filter("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # One row per cell.
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = stored(cells.withColumn("chunk", F.floor(before / ENDS)).filter(F.col("n") <= most).select("cell", "chunk"))
    for own, name in (("pu", "cu"), ("pv", "cv")):
        placed = placed.join(F.broadcast(cells.toDF(own, name)), own, "left")
    return placed.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v"), "cu", "cv"), 1 + (cells.agg(F.max("chunk")).first()[0] or 0)


GROUPED = "a long, b long, w double, u long, v long, cu long, cv long"
_grouped = pa.schema([(n, pa.float64() if n == "w" else pa.int64()) for n in ("a", "b", "w", "u", "v", "cu", "cv")] + [("chosen", pa.bool_())])


def _contracted(links: pa.Table) -> pa.Table:
    """The links of a chunk that are surely in the forest, and those that are left between its groups and to others."""
    own = links.column("chunk")[0].as_py()
    links = links.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
    names, _, (us, vs) = _numbers(links.column("u"), links.column("v"))
    cu, cv = (links.column(n).to_pylist() for n in ("cu", "cv"))
    above = list(range(len(names)))
    reached = list(above)  # by any links
    led_out: set[int] = set()
    chosen, left = [], []
    for i, (u, v) in enumerate(zip(us, vs, strict=True)):
        x, y = _find(reached, u), _find(reached, v)
        if x == y:  # the heaviest of a circle
            continue
        reached[x] = y
        if cu[i] == own == cv[i]:
            x, y = _find(above, u), _find(above, v)
            if x in led_out and y in led_out:
                left.append(i)
                continue
            if x in led_out:
                x, y = y, x
            above[x] = y
            chosen.append(i)
        else:
            led_out.add(_find(above, u if cu[i] == own else v))
            left.append(i)
    # An end in another chunk gets its group there.
    names = names.tolist()
    ends = ([names[_find(above, end[i])] if c[i] == own else names[end[i]] if c[i] is None else None for i in left] for end, c in ((us, cu), (vs, cv)))
    sure, rest = (links.take(pa.array(rows, pa.int64())) for rows in (chosen, left))
    rest = [*(rest.column(n) for n in ("a", "b", "w")), *(pa.array(e, pa.int64()) for e in ends), rest.column("cu"), rest.column("cv"), pa.array([False] * len(left))]
    sure = [*(sure.column(n) for n in _grouped.names[:-1]), pa.array([True] * len(chosen))]
    return pa.concat_tables([pa.table(sure, schema=_grouped), pa.table(rest, schema=_grouped)])


def _joined_chunks(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the forest, and what is left of ``rest`` between groups, by one round over all chunks."""
    copies = rest.filter("cu IS NOT NULL").withColumn("chunk", F.col("cu")).unionAll(rest.filter("cv IS NOT NULL AND NOT cu <=> cv").withColumn("chunk", F.col("cv")))
    out = stored(copies.groupBy("chunk").applyInArrow(_contracted, GROUPED + ", chosen boolean"))
    # A link goes if it is the heaviest of a circle in either chunk.
    left = out.filter("NOT chosen").groupBy("a", "b").agg(*[F.max(n).alias(n) for n in ("w", "u", "v", "cu", "cv")], F.count(F.lit(1)).alias("n"))
    left = left.filter("n = IF(cu <> cv, 2, 1)").drop("n")
    return out.filter("chosen").select("a", "b", "w"), stored(left.unionByName(rest.filter("cu IS NULL AND cv IS NULL")))


def spanning_forest(links: DataFrame, most: int = 0, places: DataFrame | None = None) -> DataFrame:
    """The links ``a``, ``b``, ``w`` of the minimum spanning forest; ``links`` has each pair once.

    A link of a point with itself is in no forest. ``places``: ``id``, ``node``, the cells of the points,
    if neighbouring points are mostly in one cell or in cells of near numbers.
    """
    most = most or LINKS
    rest = stored(links.filter("a <> b").select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")))
    chosen = []
    count = rest.count()
    if count > most and places is not None:
        rest, chunks = _chunked(rest, places, LINKS)
        while count > most:
            found, rest = _joined_chunks(rest)
            chosen.append(found)
            last, count = count, rest.count()
            if count > last / 2:
                break
            wanted = -(-2 * count // ENDS)
            if wanted < chunks:
                rest = rest.withColumns({c: F.floor(F.col(c) * wanted / chunks) for c in ("cu", "cv")})
                chunks = wanted
        rest = rest.select("a", "b", "w", "u", "v")
    while count > most:
        link = F.struct("w", "a", "b").alias("link")
        ends = rest.select(F.col("u").alias("node"), link).unionAll(rest.select(F.col("v").alias("node"), link))
        picked = stored(ends.groupBy("node").agg(F.min("link").alias("link")).select("link.*").distinct())
        chosen.append(picked.select("a", "b", "w"))
        joined = components(rest.join(picked, ["w", "a", "b"], "left_semi"), "u", "v")
        for end in ("u", "v"):  # every component has a link, so each is found
            rest = rest.join(joined.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("component", end)
        apart = rest.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        rest = stored(apart.agg(F.min(link).alias("link")).select("link.*", "u", "v"))
        count = rest.count()
    if count:
        chosen.append(rest.groupBy(F.lit("all")).applyInArrow(_kruskal, "a long, b long, w double"))
    out = chosen[0] if chosen else links.select("a", "b", "w").limit(0)
    for more in chosen[1:]:
        out = out.unionAll(more)
    return stored(out)


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with a column ``number`` from 0 in the given order, without a single task
    that sees all rows: places inside the sorted partitions plus their offsets."""
    placed = pinned(df.orderBy(*order)).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    parts = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = placed.join(F.broadcast(shifts), "_part")
    return joined.withColumn("number", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


STATE = "rows long, cluster long, total double, below double"
MERGED = f"kind string, label long, cluster long, parent long, chosen boolean, new long, rows long, total double, below double"
_merged = pa.schema([("kind", pa.string()), *((n, pa.int64()) for n in ("label", "cluster", "parent")), ("chosen", pa.bool_()), ("new", pa.int64()), ("rows", pa.int64()), ("total", pa.float64()), ("below", pa.float64())])


def _merging(smallest: int) -> Callable[[pa.Table], pa.Table]:
    def merging(links: pa.Table) -> pa.Table:
        links = links.sort_by("number")
        names, first, (us, vs) = _numbers(links.column("u"), links.column("v"))
        # Groups of points on the way up, by the number of the point that leads them: the rows, the cluster that it
        # is (if it is one), what the cluster's rows have in densities, and the sum of the best clusters below.
        both = (pa.chunked_array([*links.column(f"u_{n}").chunks, *links.column(f"v_{n}").chunks]) for n in ("rows", "cluster", "total", "below"))
        rows, cluster, total, below = (c.take(pa.array(first)).to_pylist() for c in both)
        above = list(range(len(names)))
        waiting = [[i] if c is None else [] for i, c in enumerate(cluster)]  # points in no cluster yet
        joined: tuple[list, list] = [], []
        closed: tuple[list, list, list] = [], [], []

        def join(points: list[int], name: int) -> None:
            joined[0].extend(points)
            joined[1].extend([name] * len(points))

        def opened(group: int, name: int, density: float) -> None:
            cluster[group], total[group], below[group] = name, rows[group] * density, 0.0
            join(waiting[group], name)
            waiting[group] = []

        def close(group: int, parent: int, density: float) -> float:
            lasts = total[group] - rows[group] * density
            for column, value in zip(closed, (cluster[group], parent, lasts >= below[group]), strict=True):
                column.append(value)
            return max(lasts, below[group])

        for number, w, a, b in zip(links.column("number").to_pylist(), links.column("w").to_pylist(), us, vs, strict=True):
            density = 1.0 / max(w, 1e-12)
            a, b = _find(above, a), _find(above, b)
            for j, group in enumerate((a, b)):
                if cluster[group] is None and rows[group] >= smallest:  # many equal rows
                    opened(group, 4 * number + j, density)
            if cluster[a] is None:
                a, b = b, a
            if cluster[b] is not None:
                parent = 4 * number + 2
                below[a] = close(a, parent, density) + close(b, parent, density)
                cluster[a], rows[a] = parent, rows[a] + rows[b]
                total[a] = rows[a] * density
            elif cluster[a] is not None:
                rows[a], total[a] = rows[a] + rows[b], total[a] + rows[b] * density
                join(waiting[b], cluster[a])
            else:
                rows[a] += rows[b]
                waiting[a].extend(waiting[b])
                if rows[a] >= smallest:
                    opened(a, 4 * number + 2, density)
            above[b] = a
            waiting[b] = []

        def table(kind: str, count: int, **columns) -> pa.Table:
            columns["kind"] = [kind] * count
            return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _merged], schema=_merged)

        tops = [_find(above, i) for i in range(len(names))]
        gone, left = [i for i, top in enumerate(tops) if top != i], [i for i, top in enumerate(tops) if top == i]
        state = {n: [c[i] for i in left] for n, c in (("rows", rows), ("cluster", cluster), ("total", total), ("below", below))}
        parts = [
            table("joined", len(joined[0]), label=names.take(joined[0]), cluster=joined[1]),
            table("cluster", len(closed[0]), cluster=closed[0], parent=closed[1], chosen=closed[2]),
            table("alias", len(gone), label=names.take(gone), new=names.take([tops[i] for i in gone])),
            table("state", len(left), label=names.take(left), **state),
        ]
        return pa.concat_tables(parts)

    return merging


def _handed_down(clusters: pa.Table) -> pa.Table:
    """The topmost chosen cluster at or above each one; parents have higher numbers than their children."""
    rows = clusters.sort_by([("cluster", "descending")]).to_pydict()
    top: dict[int, int | None] = {}
    for own, parent, chosen, given in zip(rows["cluster"], rows["parent"], rows["chosen"], rows["given"], strict=True):
        found = top.get(parent, given)
        top[own] = own if found is None and chosen else found
    return pa.table({"cluster": pa.array(list(top), pa.int64()), "top": pa.array(list(top.values()), pa.int64())})


def density_hierarchy(points: DataFrame, forest: DataFrame, smallest: int) -> DataFrame:
    """``id`` and ``cluster`` (null: in none that was chosen) of stored ``points`` ``id``, ``w`` (rows).

    A forest of one tree has one cluster at the top, which is never chosen; the tops of several
    trees are, if they last longer than what is below them.
    """
    links = stored(numbered(forest, "w", "a", "b"))
    labels = stored(points.select("id", F.col("id").alias("label")))
    states = stored(points.select(F.col("id").alias("label"), F.col("w").alias("rows"), *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "long"), ("total", "double"), ("below", "double"))]))
    first, clusters = [], []
    count = links.count()
    for at in range(0, count, LINKS):
        part = links.filter(F.col("number").between(at, at + LINKS - 1))
        for end, name in (("a", "u"), ("b", "v")):
            part = part.join(labels.select(F.col("id").alias(end), F.col("label").alias(name)), end)
            part = part.join(states.select(F.col("label").alias(name), *[F.col(n).alias(f"{name}_{n}") for n in ("rows", "cluster", "total", "below")]), name)
        out = stored(part.drop("a", "b").groupBy(F.lit("all")).applyInArrow(_merging(smallest), MERGED))
        joined = out.filter("kind = 'joined'").select("label", "cluster")
        first.append(stored(labels.join(joined, "label").select("id", "cluster")))
        clusters.append(out.filter("kind = 'cluster'").select("cluster", "parent", "chosen"))
        new = out.filter("kind = 'state'").select("label", "rows", "cluster", "total", "below")
        if at + LINKS < count:
            alias = out.filter("kind = 'alias'").select("label", "new")
            gone = alias.select("label").unionAll(new.select("label"))
            states = stored(states.join(gone, "label", "left_anti").unionByName(new))
            labels = stored(labels.join(alias, "label", "left").select("id", F.coalesce("new", "label").alias("label")))
        else:
            states = stored(states.join(out.filter("kind = 'alias'").select("label").unionAll(new.select("label")), "label", "left_anti").unionByName(new))
    # Many equal rows that no link reaches are a cluster of their own.
    alone = states.filter(F.col("cluster").isNull() & (F.col("rows") >= smallest)).select(F.col("label").alias("id"), (-1 - F.abs("label")).alias("cluster"))
    tops = stored(states.filter("cluster IS NOT NULL").select("cluster", F.lit(None).cast("long").alias("parent"), (F.col("total") >= F.col("below")).alias("chosen")))
    if tops.count() + alone.count() <= 1:
        tops = tops.withColumn("chosen", F.lit(False))
    tree = tops
    for more in clusters:
        tree = tree.unionAll(more)
    tree = stored(tree)
    size = tree.count()
    down = None
    ranked = stored(numbered(tree, F.desc("cluster"))) if size > LINKS else tree.withColumn("number", F.lit(0))
    for at in range(0, max(size, 1), LINKS):
        part = ranked.filter(F.col("number").between(at, at + LINKS - 1))
        if down is None:
            part = part.withColumn("given", F.lit(None).cast("long"))
        else:
            part = part.join(down.select(F.col("cluster").alias("parent"), F.col("top").alias("given")), "parent", "left")
        found = part.select("cluster", "parent", "chosen", "given").groupBy(F.lit("all")).applyInArrow(_handed_down, "cluster long, top long")
        down = stored(found if down is None else down.unionAll(found))
    joined = None
    for part in first:
        joined = part if joined is None else joined.unionAll(part)
    own = alone if joined is None else joined.join(down, "cluster").select("id", F.col("top").alias("cluster")).unionAll(alone)
    return points.select("id").join(own, "id", "left")
