"""Analytics over many runs and generations of an experiment: chains, intervals, designs, drift."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import uniform

#: Fixed value: library_model_refhash_roothash_trnhash_gen_N_name_cfghash_seed.
MODEL_ID = r"^([^_]+)_(.+?)_([0-9a-f]{8})_([0-9a-f]{8})_([0-9a-f]{8})_gen_([0-9]+)_(.+)_([0-9a-f]{8})_([0-9]+)$"
ID_PARTS = ("library", "model", "ref_hash", "root_hash", "training_hash", "generation", "name", "config_hash", "seed")


def parse_model_id(df: DataFrame, column: str) -> DataFrame:
    """df with the parts of the id; all NULL where it doesn't match."""
    ok = F.col(column).rlike(MODEL_ID)
    parts = {p: F.when(ok, F.regexp_extract(column, MODEL_ID, i + 1)) for i, p in enumerate(ID_PARTS)}
    return df.withColumns({p: x.cast("int") if p in ("generation", "seed") else x for p, x in parts.items()})


def chain(df: DataFrame, invariants: Sequence[str]) -> DataFrame:
    """The rows of each chain up to its first missing generation; one row a generation is expected."""
    w = Window.partitionBy(*invariants).orderBy("generation")
    return df.withColumn("_at", F.row_number().over(w) - 1).where(F.col("_at") == F.col("generation")).drop("_at")


def cumulative_time(df: DataFrame, by: Sequence[str], column: str = "training_time") -> DataFrame:
    w = Window.partitionBy(*by).orderBy("generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(f"{column}_cumulative", F.sum(column).over(w))


def mean_of(columns: Sequence[str]) -> Column:
    """The mean of those that aren't NULL."""
    n = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(n, F.lit(0))


def derived_metrics(df: DataFrame, averages: Mapping[str, Sequence[str]], percents: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """Adds the named averages, and rates from percent columns."""
    return df.withColumns({**{n: mean_of(cs) for n, cs in averages.items()}, **{new: F.col(old) / 100.0 for new, old in percents.items()}})


def bootstrap_ci(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], replicates: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by..., mean, std, n, ci_lower, ci_upper): percentile bootstrap of the mean in a group.

    Every row draws its count in each replicate from a Poisson distribution of mean 1, hashed from its key, so that
    nothing is gathered and all replicates are sums.
    """
    cuts = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(8)]
    u = uniform(*key, F.col("_b"), seed=seed)
    draws = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    known = df.where(F.col(value).isNotNull())
    long = known.select(*by, value, *[k for k in key if k not in by], F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b")).withColumn("_n", draws)
    means = long.groupBy(*by, "_b").agg((F.sum(F.col(value) * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0))).alias("_m"))
    ends = means.groupBy(*by).agg(F.percentile("_m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"))
    base = known.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    return base.join(ends, list(by)).select(*by, "mean", "std", "n", F.get("_q", F.lit(0)).alias("ci_lower"), F.get("_q", F.lit(1)).alias("ci_upper"))


def dseed_average(df: DataFrame) -> DataFrame:
    """(generation, dseed, metric, value, n_mseeds): the mean over model seeds."""
    return df.groupBy("generation", "dseed", "metric").agg(F.avg("value").alias("value"), F.count_distinct("mseed").alias("n_mseeds"))


def _log_gamma_ratio(df: int) -> float:
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2)


def t_quantile(p: float, df: int) -> float:
    """Student's quantile: bisection on the distribution function, which Simpson's rule gives in the angle arctan(t / sqrt(df))."""
    scale = math.exp(_log_gamma_ratio(df)) / math.sqrt(math.pi)

    def cdf(t: float) -> float:
        top, n = math.atan(t / math.sqrt(df)), 400
        h = top / n
        total = sum((1 if i in (0, n) else 4 if i % 2 else 2) * math.cos(i * h) ** (df - 1) for i in range(n + 1))
        return 0.5 + scale * total * h / 3

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def t_table(spark: SparkSession, alpha: float = 0.05, most: int = 200) -> DataFrame:
    """(df, t_crit) for 1 to most degrees of freedom."""
    rows = F.array(*[F.struct(F.lit(d).alias("df"), F.lit(t_quantile(1 - alpha / 2, d)).alias("t_crit")) for d in range(1, most + 1)])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def stratified_ci(averages: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(generation, metric, mean, std, n, df, se, t_crit, ci_lower, ci_upper, total_obs) over data seeds.

    One seed gives an interval of no width; beyond the table's degrees of freedom its last value serves.
    """
    g = averages.groupBy("generation", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"), F.sum("n_mseeds").alias("total_obs"))
    g = g.withColumn("df", (F.col("n") - 1).cast("int")).withColumn("_df", F.least(F.greatest(F.col("df"), F.lit(1)), F.lit(200)))
    t = t_table(averages.sparkSession, alpha).withColumnRenamed("df", "_df")
    out = g.join(F.broadcast(t), "_df").drop("_df")  # 200 rows
    se = F.col("std") / F.sqrt(F.col("n").cast("double"))
    half = F.when(F.col("n") > 1, F.col("t_crit") * se).otherwise(0.0)
    return out.withColumns({"se": se, "ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})


def prediction_interval(ci: DataFrame) -> DataFrame:
    """Adds pi_lower and pi_upper: where a further data seed's mean falls."""
    half = F.when(F.col("n") > 1, F.col("t_crit") * F.col("std") * F.sqrt(1 + 1 / F.col("n").cast("double"))).otherwise(0.0)
    return ci.withColumns({"pi_lower": F.col("mean") - half, "pi_upper": F.col("mean") + half})


def check_design(df: DataFrame) -> DataFrame:
    """Offenders: (dseed, mseed, problem, found, expected). Expected are the largest number of model seeds, and of generations."""
    seeds = df.groupBy("dseed").agg(F.count_distinct("mseed").alias("found"))
    most = seeds.agg(F.max("found").alias("expected"))
    uneven = seeds.crossJoin(F.broadcast(most)).where("found != expected").select("dseed", F.lit(None).cast("long").alias("mseed"), F.lit("model seeds").alias("problem"), "found", "expected")  # one row
    runs = df.groupBy("dseed", "mseed").agg(F.count_distinct("generation").alias("found"))
    all_of = df.agg(F.count_distinct("generation").alias("expected"))
    short = runs.crossJoin(F.broadcast(all_of)).where("found != expected").select("dseed", "mseed", F.lit("generations").alias("problem"), "found", "expected")  # one row
    return uneven.unionByName(short)


def experiment_grid(spark: SparkSession, lists: Mapping[str, Sequence[object]]) -> DataFrame:
    """Every combination of the settings, with a name; a driver-side list, as long as the product of its parts."""
    out = None
    for name, values in lists.items():
        part = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
        out = part if out is None else out.crossJoin(part)
    return out.withColumn("name", F.concat_ws("_", *[F.concat(F.lit(n), F.col(n).cast("string")) for n in lists]))


def generation_drift(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds since_first and since_previous."""
    w = Window.partitionBy(*by).orderBy("generation")
    return df.withColumns({"since_first": F.col("value") - F.first("value").over(w), "since_previous": F.col("value") - F.lag("value").over(w)})


def latest_checkpoint(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., generation, model_id): the highest completed generation."""
    return df.groupBy(*by).agg(F.max("generation").alias("generation"), F.max_by("model_id", "generation").alias("model_id"))
