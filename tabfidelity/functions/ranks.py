"""Row numbers over tables of any size: rows are dealt by ranges of their order, and no task sorts more than a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import scratch_path, stored


def ranked_within(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with its row number (from 1) within by, in order (a key, or ties are numbered at will), and part, the range it was dealt to.

    The ranges are written to the scratch folder, as their bounds come from a sample that need not be the same twice.
    """
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "part").agg(F.count("*").alias("__n"))
    starts = counts.select(*by, "part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = dealt.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)))
    return numbered.join(starts, [*by, "part"]).withColumn(name, (F.col("__i") + F.col("__before")).cast("int")).drop("__i", "__before")


def running_sum(df: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """df with the sum of amount over its row and all before it, by order (distinct values; NULL first): sums within ranges of the order, and sums of
    the ranges before. The result is a table in the scratch folder.
    """
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("__part").agg(F.sum(amount).alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__part").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn(name, F.sum(amount).over(own)).join(starts, "__part")
    return stored(summed.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before"), "sums")
