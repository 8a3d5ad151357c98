"""Comparing two tables' structure, physical and semantic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import infer_meta


def _schema_rows(df: DataFrame, name: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias(name)) for c, t in df.dtypes])
    return df.sparkSession.range(1, numPartitions=1).select(F.inline(rows))


def _compared(a: DataFrame, b: DataFrame) -> DataFrame:
    out = a.join(b, "column", "full")
    status = F.when(F.col("synthetic").isNull(), "missing").when(F.col("real").isNull(), "extra").when(F.col("real") == F.col("synthetic"), "match").otherwise("mismatch")
    return out.select("column", "real", "synthetic", status.alias("status"))


def table_structure(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(column, real, synthetic, status): match, mismatch, missing or extra."""
    return _compared(_schema_rows(real, "real"), _schema_rows(synthetic, "synthetic"))


def structure_score(compared: DataFrame, mismatch_twice: bool = True) -> DataFrame:
    """One row: matches over all (name, type) combinations, where a mismatch is two; or over columns."""
    n = F.count("*") + (F.count_if(F.col("status") == "mismatch") if mismatch_twice else F.lit(0))
    return compared.agg(F.count_if(F.col("status") == "match").alias("matches"), n.alias("combinations"), (F.count_if(F.col("status") == "match") / n).alias("score"))


def semantic_structure(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """table_structure() of inferred semantic types."""
    a, b = (infer_meta(df).withColumnRenamed("sdtype", side) for df, side in ((real, "real"), (synthetic, "synthetic")))
    return _compared(a, b)
