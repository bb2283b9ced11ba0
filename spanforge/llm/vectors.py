"""Vectors of a table as packed doubles or floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(column: str = "embedding"):
    """Whether a vector takes part: not null or empty, without null or non-finite components, and not zero."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows all have one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def usual_length(df: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of valid vectors (the smallest of several); 0 without any."""
    row = df.where(valid(column)).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0
