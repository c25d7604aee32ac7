"""Mixing of sources to target weights by nested hash thresholds.

Every document has a place on a line of 60 bits, its hash. A source takes its documents
from the left up to a threshold, a second time up to a second threshold, and so on; so
budgets nest, and nothing is sorted. A threshold is found by histograms: sizes are summed
by source and hash bucket, the bucket that crosses the budget is found from running sums,
and only the documents of that bucket go into the next, finer histogram.

Defined results: a null text has size 0, a null source is a source of its own and comes
last. Repeated rows and documents without an id (placed by their text) share a place and
are taken or left together. Sources without words have target 0. An empty table gives no
rows. Other columns, also such with the names used here, are kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilog.llm.batches import SPACE, column, fresh
from vigilog.session import stored

HASH_BITS = 60
LEVEL_BITS = 12
# The table of sources is broadcast up to this many rows and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000
WORDS = SPACE.replace("[", "[^")


def place(id_column: Column, text_column: Column) -> Column:
    """The place of a document: the first 60 bits of the MD5 of its id."""
    name = F.coalesce(id_column.cast("string"), F.concat(F.lit("text:"), F.coalesce(text_column, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (``source``, ``source_size``).

    ``share`` times the sum of sizes is dealt by weight; what exceeds ``most`` times a
    source's size goes to the others by weight. Sources in ascending order of cap per
    weight: the first ones reach their caps, the level of the others follows from the rest.
    """
    ranked = sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))).cast("int")])
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    state = ranked.select(
        "source",
        "source_size",
        "weight",
        "cap",
        (share * F.sum("source_size").over(everything)).alias("budget"),
        (F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open_weight"),
    )
    state = state.withColumn("full", F.col("cap") * F.col("open_weight") <= (F.col("budget") - F.col("before")) * F.col("weight"))
    state = state.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)))
    state = state.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    return state.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("rest") / F.col("open")).cast("double").alias("target"))


def with_source(rows: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """Inner join by source (null equals null); ``table`` has one row per source."""
    other = table.withColumnRenamed("source", "_of")
    return rows.join(F.broadcast(other) if count <= BROADCAST_SOURCES else other, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def thresholds(rows: DataFrame, goals: DataFrame, count: int) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``passes``, ``limit`` for rows ``source``, ``place``, ``size``.

    All documents of a source are taken ``passes`` times and those with a place below
    ``limit`` once more. Of the two sides of the document that crosses the budget, the
    nearer one is chosen.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = goals.withColumn("passes", whole.cast("int")).withColumn("missing", F.col("target") - F.col("passes") * F.col("source_size"))
    state = state.withColumn("low", F.lit(0).cast("long")).withColumn("limit", F.when(F.col("missing") <= 0, F.lit(0).cast("long")))
    state = stored(state)
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        if state.filter("limit IS NULL").isEmpty():
            break
        width = 1 << shift
        asked = state.filter("limit IS NULL").select("source", "low")
        inside = with_source(rows, asked, count).filter((F.col("place") >= F.col("low")) & (F.col("place") - F.col("low") < F.lit(width * (1 << LEVEL_BITS))))
        bars = inside.groupBy("source", ((F.col("place") - F.col("low")) / F.lit(width)).cast("long").alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        running = bars.withColumn("until", F.sum("size").over(W.partitionBy("source").orderBy("bucket")))
        crossed = with_source(running, state.select("source", "missing"), count).filter((F.col("until") >= F.col("missing")) & (F.col("until") - F.col("size") < F.col("missing")))
        found = crossed.groupBy("source").agg(F.min(F.struct("bucket", "size", "rows", "until")).alias("b"))
        joined = state.join(found.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
        start = F.col("low") + F.col("b.bucket") * F.lit(width).cast("long")
        left = F.col("missing") - (F.col("b.until") - F.col("b.size"))
        last = (F.col("b.rows") == 1) | (F.lit(shift) == 0)
        limit = F.when(F.col("b.size") - left < left, start + width).otherwise(start)
        state = stored(
            joined.select(
                "source",
                "source_size",
                "target",
                "passes",
                F.when(F.col("b").isNull(), F.col("missing")).otherwise(left).alias("missing"),
                F.when(F.col("b").isNull(), F.col("low")).otherwise(start).alias("low"),
                # A single document in a bucket needs no finer one: the bucket's edge parts it from the rest.
                F.when(F.col("b").isNull(), F.col("limit")).when(last, limit).alias("limit"),
            )
        )
    return state.select("source", "source_size", "target", "passes", F.coalesce("limit", F.lit(1 << HASH_BITS)).alias("limit"))


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words) and ``place`` of every document, stored once."""
    text = F.coalesce(column(docs, text_column).cast("string"), F.lit(""))
    return stored(
        docs.select(
            column(docs, id_column).alias("doc_id"),
            column(docs, source_column).alias("source"),
            F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
            place(column(docs, id_column), text).alias("place"),
        )
    )


def plan(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """Thresholds of every source, and how many sources there are."""
    sources = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    count = sources.count()
    return thresholds(rows, targets(sources, weights, share, most), count), count


def shares(rows: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` of ``sized`` rows."""
    chosen, count = plan(rows, **options)
    copies = F.col("passes") + (F.col("place") < F.col("limit")).cast("int")
    return with_source(rows, chosen, count).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    chosen, count = plan(sized(docs, id_column, text_column, source_column), **options)
    names = {n: fresh(docs, f"mix_{n}") for n in ("source", "passes", "limit", "copy")}
    other = chosen.select(*[F.col(n).alias(names[n]) for n in ("source", "passes", "limit")])
    met = docs.join(F.broadcast(other) if count <= BROADCAST_SOURCES else other, column(docs, source_column).eqNullSafe(other[names["source"]]))
    copies = met[names["passes"]] + (place(column(docs, id_column), column(docs, text_column).cast("string")) < met[names["limit"]]).cast("int")
    repeated = met.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(0), copies)))
    return repeated.drop(*names.values())
