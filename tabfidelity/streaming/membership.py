"""Row membership of a stream of synthetic rows: the static sides are joined as they are, counts are kept by class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.membership import membership


def class_counts(stream: DataFrame, population: DataFrame, training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(class, rows) of all rows so far, for outputMode("complete"); the state is one row a class, so it needs no watermark."""
    return membership(stream, population, training, columns).groupBy("class").agg(F.count("*").alias("rows"))
