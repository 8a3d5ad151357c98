"""Similarity of columns one by one. All columns go through one long table; a column without values on a side is NULL.

Values are counted before anything is ordered, and running sums go by column and a cell of the value range, with
the cells' sums added afterwards, so that few columns over many rows still keep all tasks busy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import ratio
from .prep import long_form, long_numeric

#: Cells of a column's range in a running sum.
CELLS = 64


def _long(df: DataFrame, columns: Sequence[str], numeric: bool, by: Sequence[str] = ()) -> DataFrame:
    """(column, value). With run columns by, the column is a struct of them and its name, so that every run's columns go through one job."""
    out = (long_numeric if numeric else long_form)(df, columns, [*by])
    return out.select(F.struct(*by, "column").alias("column"), "value") if by else out


def value_table(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], numeric: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(column, value, r, s): how often each value occurs on either side."""
    both = _long(real, columns, numeric, by).withColumn("side", F.lit("r")).unionAll(_long(synthetic, columns, numeric, by).withColumn("side", F.lit("s")))
    one = lambda side: F.count_if(F.col("side") == side).alias(side)
    return both.groupBy("column", "value").agg(one("r"), one("s"))


def ecdf(values: DataFrame) -> DataFrame:
    """value_table() of numbers plus fr and fs, the shares up to and with each value, and following, the next value."""
    ends = values.groupBy(F.col("column").alias("_c")).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    cell = F.coalesce(F.floor((F.col("value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * CELLS), F.lit(0))
    celled = values.join(ends, F.col("column") == F.col("_c")).withColumn("cell", F.least(cell, F.lit(CELLS - 1)).cast("int")).drop("_c", "_low", "_high")
    sums = celled.groupBy("column", "cell").agg(F.sum("r").alias("r"), F.sum("s").alias("s"), F.min("value").alias("least"))
    by = Window.partitionBy("column").orderBy("cell")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    sums = sums.select(
        F.col("column").alias("_c"),
        F.col("cell").alias("_cell"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r_before"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"),
        F.sum("r").over(whole).alias("r_all"),
        F.sum("s").over(whole).alias("s_all"),
        F.lead("least").over(by).alias("next_cell"),
    )
    own = Window.partitionBy("column", "cell").orderBy("value")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = celled.withColumns({"r_upto": F.sum("r").over(upto), "s_upto": F.sum("s").over(upto), "following": F.lead("value").over(own)})
    joined = running.join(sums, (F.col("column") == F.col("_c")) & (F.col("cell") == F.col("_cell")))
    return joined.select(
        "column",
        "value",
        "r",
        "s",
        ratio(F.col("r_before") + F.col("r_upto"), F.col("r_all")).alias("fr"),
        ratio(F.col("s_before") + F.col("s_upto"), F.col("s_all")).alias("fs"),
        F.coalesce("following", "next_cell").alias("following"),
    )


def ks_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, score: one less the largest distance of the two distribution functions; NULLs are ignored."""
    return ecdf(value_table(real, synthetic, columns, by=by)).groupBy("column").agg((1 - F.max(F.abs(F.col("fr") - F.col("fs")))).alias("score"))


def wasserstein_1d(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, distance: the area between the distribution functions, in units of the real range."""
    e = ecdf(value_table(real, synthetic, columns, by=by))
    width = F.nullif(F.max(F.when(F.col("r") > 0, F.col("value"))) - F.min(F.when(F.col("r") > 0, F.col("value"))), F.lit(0.0))
    area = F.coalesce(F.sum(F.abs(F.col("fr") - F.col("fs")) * (F.col("following") - F.col("value"))), F.lit(0.0))
    return e.groupBy("column").agg((area / F.coalesce(width, F.lit(1.0))).alias("distance"))


def shares(values: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """value_table() plus p and q, the shares of each side within by."""
    w = Window.partitionBy(*by)
    return values.withColumns({"p": ratio(F.col("r"), F.sum("r").over(w)), "q": ratio(F.col("s"), F.sum("s").over(w))})


def tv_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, score: one less half the summed differences of shares; NULL counts as a category."""
    return shares(value_table(real, synthetic, columns, numeric=False, by=by)).groupBy("column").agg((1 - F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("score"))


def boundary_adherence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, score: share of synthetic values within the real ends; NULLs are ignored."""
    ends = _long(real, columns, True, by).groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return _long(synthetic, columns, True, by).join(ends, "column").groupBy("column").agg(F.avg(F.col("value").between(F.col("low"), F.col("high")).cast("double")).alias("score"))


def category_adherence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, score: share of synthetic values that occur among the real ones; NULL is a category."""
    counts = value_table(real, synthetic, columns, numeric=False, by=by)
    return counts.groupBy("column").agg(ratio(F.sum(F.when(F.col("r") > 0, F.col("s")).otherwise(0)), F.sum("s")).alias("score"))


def _divergence(parts: DataFrame) -> DataFrame:
    """column, distance from rows with p and q: the root of the Jensen-Shannon divergence in nats."""
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    return parts.groupBy("column").agg(F.sqrt(F.greatest(F.sum(half("p") + half("q")) / 2, F.lit(0.0))).alias("distance"))


def _binned(values: DataFrame, edges: DataFrame, drop_outside: bool) -> DataFrame:
    """Counts by bin. edges: column, low, high, bins. The last bin holds its upper end."""
    joined = values.join(edges, "column")
    if drop_outside:
        joined = joined.where(F.col("value").between(F.col("low"), F.col("high")))
    number = F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * F.col("bins"))
    b = F.least(F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)), F.col("bins") - 1)
    return joined.groupBy("column", b.alias("value")).agg(F.sum("r").alias("r"), F.sum("s").alias("s"))


def jsd_equal_width(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """column, distance over equal-width bins between the ends of both sides."""
    values = value_table(real, synthetic, columns, by=by)
    edges = values.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.lit(bins).cast("long").alias("bins"))
    return _divergence(shares(_binned(values, edges, False)))


def doane_bins(n: Column, skew_g1_adjusted: Column) -> Column:
    """Doane's number of bins, between 10 and 50."""
    sigma = F.sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3.0)))
    count = F.floor(1 + F.log2(n.cast("double")) + F.log2(1 + F.abs(skew_g1_adjusted) / sigma))
    return F.least(F.greatest(F.coalesce(count, F.lit(10)), F.lit(10)), F.lit(50)).cast("long")


def jsd_adaptive(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, distance with Doane's bins between the real ends; synthetic values outside are left out."""
    n = F.count("value")
    adjusted = F.skewness("value") * F.sqrt(n * (n - 1.0)) / (n - 2.0)
    edges = _long(real, columns, True, by).groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), doane_bins(n, adjusted).alias("bins"))
    return _divergence(shares(_binned(value_table(real, synthetic, columns, by=by), edges, True)))


def jsd_categorical(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, distance over the union of categories; NULLs are left out."""
    return _divergence(shares(value_table(real, synthetic, columns, numeric=False, by=by).where("value is not null")))


def jsd_mixed(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: int = 10, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """column, distance: columns with more than threshold values in both sides together are binned, others compared value by value."""
    values = value_table(real, synthetic, columns, by=by)
    edges = values.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("distinct"), F.lit(bins).cast("long").alias("bins"))
    few = values.join(edges.where(F.col("distinct") <= threshold).select("column"), "column", "left_semi")
    many = _binned(values, edges.where(F.col("distinct") > threshold), False).withColumn("value", F.col("value").cast("double"))
    return _divergence(shares(few.unionByName(many)))


def missingness_compare(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, real_nulls, synthetic_nulls, and their rates."""
    nulls = lambda df, side: long_form(df, columns).groupBy("column").agg(F.count_if(F.col("value").isNull()).alias(f"{side}_nulls"), F.avg(F.col("value").isNull().cast("double")).alias(f"{side}_rate"))
    return nulls(real, "real").join(nulls(synthetic, "synthetic"), "column")


def mean_score(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: the mean over the columns that have one, and their number."""
    return scores.agg(F.avg(column).alias("mean"), F.count(column).alias("columns"))


def shape_interpretation(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown").when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.7, "fair").when(score >= 0.5, "poor").otherwise("very poor")
    )
