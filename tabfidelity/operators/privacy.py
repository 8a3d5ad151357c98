"""k-anonymity, exact and by clusters, and its ratios between roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ratio


def class_sizes(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """A row per equivalence class: its size as members."""
    return df.groupBy(*quasi).agg(F.count("*").alias("members"))


def k_anonymity(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """One row: k (smallest class), classes, rows_below (rows in classes under k)."""
    return class_sizes(df, quasi).agg(F.min("members").alias("k"), F.count("*").alias("classes"), F.coalesce(F.sum(F.when(F.col("members") < k, F.col("members"))), F.lit(0)).alias("rows_below"))


def class_histogram(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """(members, classes): how many classes have each size."""
    return class_sizes(df, quasi).groupBy("members").agg(F.count("*").alias("classes"))


def k_anonymity_clustered(df: DataFrame, columns: Sequence[str], clusters: Sequence[int] = (5, 10, 20), seed: int = 0) -> DataFrame:
    """(clusters, k): the smallest cluster over numeric columns, for each number of clusters."""
    x = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)
    out = None
    for n in clusters:
        sizes = KMeans(k=n, seed=seed).fit(x).transform(x).groupBy("prediction").agg(F.count("*").alias("members"))
        part = sizes.agg(F.lit(n).alias("clusters"), F.min("members").alias("k"))
        out = part if out is None else out.unionAll(part)
    return out


RATIOS = (("reference", "population"), ("synthetic", "population"), ("synthetic", "reference"), ("synthetic", "training"))


def k_ratios(roles: Mapping[str, DataFrame], quasi: Sequence[str], zero_as_infinite: bool = False) -> DataFrame:
    """(numerator, denominator, numerator_k, denominator_k, ratio) for the role pairs that are there."""
    ks = None
    for name, df in roles.items():
        part = k_anonymity(df, quasi).select(F.lit(name).alias("role"), "k")
        ks = part if ks is None else ks.unionAll(part)
    wanted = [p for p in RATIOS if set(p) <= set(roles)]
    pairs = ks.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("numerator"), F.lit(b).alias("denominator")) for a, b in wanted])))
    out = pairs.join(ks.select(F.col("role").alias("numerator"), F.col("k").alias("numerator_k")), "numerator")
    out = out.join(ks.select(F.col("role").alias("denominator"), F.col("k").alias("denominator_k")), "denominator")
    r = ratio(F.col("numerator_k"), F.col("denominator_k"))
    if zero_as_infinite:
        r = F.coalesce(r, F.lit(float("inf")))
    return out.select("numerator", "denominator", "numerator_k", "denominator_k", r.alias("ratio")).where("ratio is not null")


def interpret_k(k: Column) -> Column:
    return F.when(k >= 10, "Excellent").when(k >= 5, "Good").when(k >= 3, "Moderate").otherwise("Poor")


def interpret_ratio(r: Column) -> Column:
    return F.when(r > 1.5, "Much better privacy").when(r > 1.1, "Better privacy").when(r > 0.9, "Similar privacy").when(r > 0.7, "Worse privacy").otherwise("Much worse privacy")


def qi_check(roles: Mapping[str, DataFrame | None], quasi: Sequence[str], required: Sequence[str] = ("population", "reference", "synthetic")) -> dict[str, str]:
    """role -> ok or skipped; a required role without a column is an error."""
    out = {}
    for name, df in roles.items():
        missing = [c for c in quasi if df is None or c not in df.columns]
        if missing and name in required:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        out[name] = "skipped" if missing else "ok"
    return out
