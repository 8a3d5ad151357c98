"""Intrinsic data quality: completeness, validity, uniqueness, consistency, and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ratio
from ..functions.quantiles import exact_quantiles
from .prep import long_form


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: cells, missing_cells, completeness, complete_rows, complete_row_rate."""
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns), F.lit(0))
    one = df.select(missing.alias("m")).agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing_cells"), F.count_if(F.col("m") == 0).alias("complete_rows"))
    cells = F.col("n") * len(columns)
    return one.select(cells.alias("cells"), "missing_cells", (1 - ratio(F.col("missing_cells"), cells)).alias("completeness"), "complete_rows", ratio(F.col("complete_rows"), F.col("n")).alias("complete_row_rate"))


def missing_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))


def validity(df: DataFrame, columns: Sequence[str], of_columns: int | None = None) -> DataFrame:
    """One row: infinite, extreme (beyond the 1st and 99th percentile by ten times their distance), issues, validity.

    columns are the numeric ones; each has two possible issues, of twice the number of all columns of the table.
    """
    ends = exact_quantiles(df, columns, (0.01, 0.99))
    far = {c: ~F.col(c).cast("double").between(q[0] - 10 * (q[1] - q[0]), q[1] + 10 * (q[1] - q[0])) if q else F.lit(False) for c, q in ends.items()}
    counted = df.agg(
        *[F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(f"{c}__inf") for c in columns], *[F.count_if(far[c]).alias(f"{c}__far") for c in columns]
    )
    add = lambda n: sum((F.col(f"{c}__{n}") for c in columns), F.lit(0))
    issues = sum((F.when(F.col(f"{c}__{n}") > 0, 1).otherwise(0) for c in columns for n in ("inf", "far")), F.lit(0))
    return counted.select(add("inf").alias("infinite"), add("far").alias("extreme"), issues.alias("issues"), (1 - issues / F.lit(2.0 * (of_columns if of_columns is not None else len(df.columns)))).alias("validity"))


def uniqueness(df: DataFrame) -> DataFrame:
    """One row: rows, distinct_rows, duplicate_rows, uniqueness. Rows are counted by value, so no row set is gathered."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    one = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return one.select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"), ratio(F.col("distinct_rows"), F.col("rows")).alias("uniqueness"))


def uniqueness_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).groupBy("column").agg(F.count_distinct("value").alias("distinct"), F.count("value").alias("non_null"))


def consistency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per text column: numeric-looking and other values, mixed, and lengths, over the whole table."""
    looks = F.col("value").rlike(r"^-?\d+\.?\d*$")
    out = long_form(df, columns).where("value is not null").groupBy("column").agg(
        F.count_if(looks).alias("numeric_like"),
        F.count_if(~looks).alias("text_like"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.avg(F.length("value")).alias("avg_length"),
        F.stddev_samp(F.length("value")).alias("std_length"),
    )
    return out.withColumn("mixed", (F.col("numeric_like") > 0) & (F.col("text_like") > 0))


def quality_score(df: DataFrame, columns: Sequence[str], numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row: the four scores and their mean. Validity and consistency are shares of all columns."""
    mixed = consistency(df, text).agg((1 - F.count_if("mixed") / F.lit(float(len(columns)))).alias("consistency"))
    parts = [completeness(df, columns).select("completeness"), validity(df, numeric, len(columns)).select("validity"), uniqueness(df.select(*columns)).select("uniqueness"), mixed]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    names = ("completeness", "validity", "uniqueness", "consistency")
    return out.select(*names, (sum((F.col(n) for n in names), F.lit(0.0)) / 4).alias("quality"))


def compare_quality(a: DataFrame, b: DataFrame, columns: Sequence[str], numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """measure, original, other, difference, preservation."""
    names = ("completeness", "validity", "uniqueness", "consistency", "quality")
    rows = [quality_score(df, columns, numeric, text).select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias(role)) for n in names]))) for df, role in ((a, "original"), (b, "other"))]
    return rows[0].join(F.broadcast(rows[1]), "measure").select("measure", "original", "other", (F.col("other") - F.col("original")).alias("difference"), ratio(F.col("other"), F.col("original")).alias("preservation"))


