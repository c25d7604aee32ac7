"""Joins of the log with tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A derived table is broadcast up to this many (narrow) rows.
BROADCAST_ROWS = 2_000_000
# Text keys longer than this count as several rows.
KEY_BYTES = 64
# A key is hot when it holds more than this many rows of the large side.
HOT_ROWS = 2_000_000


def attach(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    measured: tuple[int, int] | None = None,
) -> DataFrame:
    """Left join of ``rows`` with ``table`` (pinned, one row per ``key``).

    ``weight`` is the column of ``table`` that counts the rows holding the key. A
    table of at most ``broadcast_rows`` rows is broadcast. A larger one is joined by
    shuffle, where a hot key is split: its rows are spread over ``ceil(weight /
    hot_rows)`` salts and its table row is repeated for each of them. ``measured``
    holds the rows of the table and the sum of the weights where they are known. Keys
    that are text count with their longest one, so that the bytes are bounded too. Rows
    without a key meet nothing: they are spread evenly over the tasks of the join.
    """
    size, total = measured or table.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if size <= broadcast_rows and dict(table.dtypes)[key] == "string":
        size *= 1 + (table.agg(F.coalesce(F.max(F.octet_length(key)), F.lit(0))).first()[0] // KEY_BYTES)
    if size <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(weight)), key, "left")
    # The list of hot keys is bounded too: total / limit keys at most.
    limit = max(hot_rows, total // 100_000)
    salts = F.ceil(F.col(weight) / limit).cast("int")
    hot = table.filter(F.col(weight) > limit).select(key, salts.alias("_salts"))
    own = F.xxhash64("record_id")
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.pmod(own, F.lit(1 << 20)).cast("int")).when(F.col("_salts").isNull(), 0).otherwise(F.pmod(own, F.col("_salts")).cast("int")),
    )
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted_rows.join(salted_table.drop(weight), [key, "_salt"], "left").drop("_salt", "_salts")
