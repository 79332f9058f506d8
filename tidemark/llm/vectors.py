"""Columns of vectors as matrices: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_floats(df: DataFrame, column: str) -> DataFrame:
    """The column as array<float> if it is one, else as array<double>."""
    return df if dict(df.dtypes)[column] == "array<float>" else df.withColumn(column, F.col(column).cast("array<double>"))


def matrix_of(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Vectors of one length, without nulls, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) for each length of vectors; those that are null, empty or hold a null or non-finite component are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begins = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == n)
        rows = flat[begins[places][:, None] + np.arange(n)]
        sound = np.isfinite(rows).all(axis=1)
        if sound.any():
            yield places[sound], rows[sound]


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows over a power of two, which changes no digit, so that no square overflows or vanishes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=-1, keepdims=True))[1])


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows aren't zero."""
    rows = scaled(rows)
    size = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(size > 0, size, 1.0)[:, None], size > 0
