"""Sampling, splits and leakage checks. Choices come from hashed keys, so they hold on any partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import shuffle_key
from ..functions.ranks import ranked_within


def sample_entities(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of n distinct keys; an error if there are fewer."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    chosen = ids.orderBy(shuffle_key(key, seed=seed), key).limit(n)
    if (found := chosen.count()) < n:
        raise ValueError(f"{n} distinct values of {key} are asked for, there are {found}")
    return df.join(chosen, key, "left_semi")


def stratified_split(df: DataFrame, by: str, key: str, fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """df with split: train for the first ceil(fraction * n) keys of each stratum in seeded order, else test.

    A key goes whole to one side; its stratum is its smallest. Ranks within a stratum are counted in two levels - by
    the hash's first byte, then within it - so that a stratum with most of the rows is spread over 256 tasks.
    """
    keys = df.groupBy(F.col(key).alias("_key")).agg(F.min(by).alias("_stratum")).withColumn("_order", shuffle_key("_key", seed=seed))
    keys = keys.withColumn("_cell", F.substring("_order", 1, 2))
    cells = keys.groupBy("_stratum", "_cell").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_stratum").orderBy("_cell")
    cells = cells.withColumns({"_before": F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("_stratum"))})
    own = Window.partitionBy("_stratum", "_cell").orderBy("_order", "_key")
    cells = cells.select(F.col("_stratum").alias("_c_stratum"), F.col("_cell").alias("_c_cell"), "_before", "_all")
    ranked = keys.withColumn("_rank", F.row_number().over(own)).join(cells, F.col("_stratum").eqNullSafe(F.col("_c_stratum")) & (F.col("_cell") == F.col("_c_cell")))
    side = F.when(F.col("_before") + F.col("_rank") <= F.ceil(F.lit(fraction) * F.col("_all")), "train").otherwise("test")
    sides = ranked.select("_key", side.alias("split"))
    return df.join(sides, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def split_by_group(df: DataFrame, key: str, seed: int = 0, train_rows: int | None = None, test_rows: int | None = None) -> DataFrame:
    """df with split: the first half of the keys in seeded order is train, the others test; an odd key goes to test.

    Of a side with a target, so many rows in seeded order keep the side and the others are unsampled; a side with fewer rows keeps all. A NULL key is a key.
    """
    keys = ranked_within(df.select(F.col(key).alias("_key")).distinct().withColumn("_order", shuffle_key("_key", seed=seed)), [], ["_order", "_key"], "_rank")
    half = keys.agg(F.floor(F.count("*") / 2).alias("_half"))
    sides = keys.crossJoin(F.broadcast(half)).select("_key", F.when(F.col("_rank") <= F.col("_half"), "train").otherwise("test").alias("split"))  # one row
    out = df.join(sides, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    targets = {side: n for side, n in (("train", train_rows), ("test", test_rows)) if n is not None}
    if not targets:
        return out
    ranked = ranked_within(out.withColumn("_order", shuffle_key(*df.columns, seed=seed)), ["split"], ["_order", *df.columns], "_rank")
    beyond = F.lit(False)
    for side, n in targets.items():
        beyond = beyond | ((F.col("split") == side) & (F.col("_rank") > n))
    return ranked.select(*df.columns, F.when(beyond, "unsampled").otherwise(F.col("split")).alias("split"))


def complement(df: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the cohort."""
    return df.join(cohort.select(key).distinct(), key, "left_anti")


def leakage_report(splits: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """level, first, second, overlap, verdict: distinct keys that two splits share, for each key column; one pass for all pairs."""
    names = list(splits)
    tagged = reduce(DataFrame.unionAll, [df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).cast("string").alias("key")) for k in keys])), F.lit(1 << i).alias("bit")) for i, df in enumerate(splits.values())])
    masks = tagged.where("key is not null").groupBy("level", "key").agg(F.bit_or("bit").alias("mask"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    both = lambda i, j: F.col("mask").bitwiseAND(F.lit(1 << i | 1 << j)) == F.lit(1 << i | 1 << j)
    counts = masks.groupBy("level").agg(*[F.count_if(both(i, j)).alias(f"{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(names[i]).alias("first"), F.lit(names[j]).alias("second"), F.col(f"{i}_{j}").alias("overlap")) for i, j in pairs])
    return counts.select("level", F.inline(rows)).withColumn("verdict", F.when(F.col("overlap") == 0, "ok").otherwise("leak"))


def target_rate_report(df: DataFrame, target: Column) -> DataFrame:
    """One row for a df with split: the rates of train, test and unsampled rows, the gap of the first two and its verdict."""
    rate = lambda side: F.avg(F.when(F.col("split") == side, target.cast("double"))).alias(f"{side}_rate")
    out = df.agg(*map(rate, ("train", "test", "unsampled"))).withColumn("gap", F.abs(F.col("train_rate") - F.col("test_rate")))
    return out.withColumn("verdict", F.when(F.col("gap") < 0.001, "excellent").when(F.col("gap") < 0.02, "good").otherwise("warning"))


def absent_rows(reference: DataFrame, population: DataFrame) -> DataFrame:
    """One row: how many rows of reference, NULLs equal to NULLs, population lacks."""
    names = {c: f"__{c}" for c in population.columns}
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(names[c])) for c in reference.columns])
    return reference.join(population.distinct().withColumnsRenamed(names), on, "left_anti").agg(F.count("*").alias("absent"))


def assert_subset(reference: DataFrame, population: DataFrame) -> None:
    if n := absent_rows(reference, population).first()["absent"]:
        raise ValueError(f"{n} reference rows are not in the population")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 0, by: str | None = None) -> DataFrame:
    """df with fold 0..k-1: rows in seeded order within by, dealt in turn.

    The order is cut by the hash's first byte, as in stratified_split(); dealing starts anew in each cut, so folds of
    a stratum differ by 256 rows at most, and by 1 within a cut.
    """
    order = shuffle_key(key, seed=seed)
    parts = [*([by] if by else []), F.substring(order, 1, 2)]
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(*parts).orderBy(order, key)) - 1) % k).cast("int"))
