"""Standard scaling with the population standard deviation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from vigilog.operators.features import finite


def matrix_row(features: list[str]) -> Column:
    """The features of a row as one array; nulls, NaN and infinity become 0."""
    return F.transform(F.array(*[F.col(f).cast("double") for f in features]), finite)


def matrix_of(columns: list[pa.Array]) -> np.ndarray:
    """Rows of the columns; nulls, NaN and infinity become 0."""
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
    x[~np.isfinite(x)] = 0.0
    return x


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix_of(batch.columns[1:])
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, x.ravel())], ["record_id", "x"])


def matrix_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """``record_id`` and ``x``, what ``matrix_row`` gives, for a pass over all rows: columns travel to Python as they are."""
    columns = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    kind = df.schema["record_id"].dataType.simpleString()
    return df.select("record_id", *columns).mapInArrow(_as_arrays, f"record_id {kind}, x array<double>")


@dataclass
class Scaler:
    """Mean and spread of each feature; one number per feature, held by the driver."""

    features: list[str]
    means: list[float]
    spreads: list[float]
    rows: int

    def columns(self) -> list[Column]:
        """The scaled features as columns, in order."""
        return [(finite(F.col(f)) - m) / s for f, m, s in zip(self.features, self.means, self.spreads)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Rows of features, scaled."""
        return (x - np.asarray(self.means)) / np.asarray(self.spreads)


def fit_scaler(df: DataFrame, features: list[str], row: Column | None = None) -> Scaler:
    """One aggregate over the features; a constant feature keeps spread 1.

    ``row`` is the array of the features where ``df`` holds it already.
    """
    vector = array_to_vector(row if row is not None else matrix_row(features))
    summary = df.agg(Summarizer.metrics("count", "mean", "variance").summary(vector).alias("s")).select("s.*").first()
    rows = summary["count"]
    if rows == 0:
        raise ValueError("no rows to fit")
    means = summary["mean"].toArray()
    # The summary has the sample variance.
    spreads = np.sqrt(summary["variance"].toArray() * (rows - 1) / rows)
    constant = spreads <= 1e-12 * np.maximum(1.0, np.abs(means))
    return Scaler(list(features), means.tolist(), np.where(constant, 1.0, spreads).tolist(), rows)
