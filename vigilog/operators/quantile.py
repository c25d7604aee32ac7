"""Exact order statistics of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BINS = 4096
# A range of at most this many rows is sorted by one aggregate.
SMALL = 100_000


def order_statistic(df: DataFrame, column: str, rank: int) -> float:
    """The value at a 0-based rank of the sorted, non-null column.

    The range of the column is cut into bins and the bin that holds the rank is cut
    again, until it holds few rows or a single value. Every step is one aggregate
    with at most 4096 groups, so no task sees the whole column.
    """
    value = F.col(column).cast("double")
    rows = df.select(value.alias("x")).filter("x is not null and not isnan(x)")
    low, high, count = rows.agg(F.min("x"), F.max("x"), F.count("x")).first()
    while True:
        if low is None or rank >= count:
            raise ValueError("rank outside the column")
        if low == high:
            return low
        if count <= SMALL:
            return rows.agg(F.percentile("x", F.lit(rank / (count - 1) if count > 1 else 0.0))).first()[0]
        width = high / BINS - low / BINS
        if width == 0 or not math.isfinite(width):
            middle = low / 2 + high / 2
            place = (F.col("x") > middle).cast("int")
        else:
            place = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1))
        bins = (
            rows.groupBy(place.alias("bin")).agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        ).orderBy("bin").collect()
        for row in bins:
            if rank < row["n"]:
                break
            rank -= row["n"]
        low, high, count = row["a"], row["b"], row["n"]
        rows = rows.filter(F.col("x").between(low, high))


def quantile(df: DataFrame, column: str, share: float) -> float:
    """Quantile with linear interpolation between the two nearest rows."""
    value = F.col(column).cast("double")
    rows = df.filter(value.isNotNull() & ~F.isnan(value))
    count = rows.count()
    if count == 0:
        raise ValueError("the column is empty")
    place = share * (count - 1)
    below = math.floor(place)
    first = order_statistic(rows, column, below)
    if below + 1 >= count or place == below:
        return first
    second = order_statistic(rows, column, below + 1)
    return first + (second - first) * (place - below)
