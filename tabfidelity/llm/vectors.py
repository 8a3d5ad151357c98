"""What the operators on embeddings share: usable vectors, filled to one length, and Arrow columns of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def filled(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(df with all vectors of the column as long as the longest, zeros behind; that length)."""
    d = df.agg(F.max(F.size(column)).alias("d")).first()["d"] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(column))
    return df.withColumn(column, F.concat(F.col(column), zeros)), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow column of vectors of length d, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
