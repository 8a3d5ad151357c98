"""Simple generators as Spark jobs: independent marginals, a Gaussian copula, and generations of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import uniform
from ..functions.ranks import running_sum


def value_intervals(df: DataFrame, column: str) -> DataFrame:
    """(value, lo, hi): each distinct value's interval of [0, 1) by its share, in value order, NULL first.

    Values are ordered by ranges, so a column of as many values as rows keeps all tasks busy.
    """
    counts = running_sum(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", "n", "upto")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", ((F.col("upto") - F.col("n")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))  # one row


def _looked_up(rows: DataFrame, intervals: DataFrame, u: str, name: str, least_cells: int = 1024) -> DataFrame:
    """rows with the value whose interval holds u: both sides meet in cells of [0, 1], which grow in number with the values.

    A frequent value's rows spread over the many cells that its interval covers, and a cell holds few of the rare ones.
    """
    cells = max(least_cells, 1 << (intervals.count() // 4).bit_length())
    cut = intervals.select("value", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.least(F.col("hi"), F.lit(1 - 1e-12)) * cells))).alias("cell"))
    joined = rows.withColumn("cell", F.floor(F.col(u) * cells)).join(cut, "cell").where((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi")))
    return joined.withColumnRenamed("value", name).drop("cell", "lo", "hi", u)


def marginal_sampler(df: DataFrame, n: int | None = None, seed: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """n rows (as many as df by default), each column drawn by itself from its values."""
    columns = list(columns or df.columns)
    out = df.sparkSession.range(n if n is not None else df.count())
    for c in columns:
        out = _looked_up(out.withColumn("__u", uniform("id", F.lit(c), seed=seed)), value_intervals(df, c), "__u", c)
    return out.select(*columns)


def _inverse_normal(u):
    """Acklam's rational approximation of the normal quantile."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(xs, x):
        out = F.lit(xs[0])
        for y in xs[1:]:
            out = out * x + F.lit(y)
        return out

    q = F.sqrt(-2 * F.ln(u))
    p = F.sqrt(-2 * F.ln(1 - u))
    m = u - 0.5
    r = m * m
    tail = lambda x: poly(c, x) / (poly(d, x) * x + 1.0)
    return F.when(u < 0.02425, tail(q)).when(u > 1 - 0.02425, -tail(p)).otherwise(poly(a, r) * m / (poly(b, r) * r + 1.0))


def _hashed_uniform(ids: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1) by id, so that they hold on any partitioning."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((stream * 1_000_003 + seed * 7_919 + 1) * 0x632BE5AB & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def _copula_draws(factor: np.ndarray, seed: int):
    """mapInArrow: id -> (id, correlated uniforms)."""
    d = len(factor)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            radius = [np.sqrt(-2 * np.log(_hashed_uniform(ids, 2 * i, seed))) for i in range(d)]
            angle = [2 * np.pi * _hashed_uniform(ids, 2 * i + 1, seed) for i in range(d)]
            z = np.column_stack([r * np.cos(t) for r, t in zip(radius, angle, strict=True)]) @ factor.T
            u = np.clip(_normal_cdf(z), 1e-9, 1 - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(u[:, i]) for i in range(d)]], ["id", *[f"__u{i}" for i in range(d)]])

    return run


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Zelen and Severo's approximation, within 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = np.exp(-x * x / 2) / 2.5066282746310002 * poly
    return np.where(x >= 0, 1 - upper, upper)


def gaussian_copula_sampler(df: DataFrame, n: int | None = None, seed: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """n rows with the columns' marginals and the correlation of their normal scores. Only a d by d matrix reaches the driver."""
    columns = list(columns or df.columns)
    scored = df.select(*columns)
    intervals = {c: value_intervals(df, c) for c in columns}
    for i, c in enumerate(columns):
        mid = intervals[c].select(F.col("value").alias("__v"), _inverse_normal((F.col("lo") + F.col("hi")) / 2).alias(f"__z{i}"))
        scored = scored.join(mid, F.col(c).eqNullSafe(F.col("__v"))).drop("__v")
    z = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(columns))], outputCol="z").transform(scored)
    r = np.nan_to_num(np.array(Correlation.corr(z, "z").first()[0].toArray()))
    np.fill_diagonal(r, 1.0)
    factor = np.linalg.cholesky(0.999 * r + 0.001 * np.eye(len(columns)))
    rows = df.sparkSession.range(n if n is not None else df.count())
    out = rows.mapInArrow(_copula_draws(factor, seed), "id long, " + ", ".join(f"__u{i} double" for i in range(len(columns))))
    for i, c in enumerate(columns):
        out = _looked_up(out, intervals[c], f"__u{i}", c)
    return out.select(*columns)


def recursive_generations(df: DataFrame, generations: int, sampler: Callable[..., DataFrame], measure: Callable[[DataFrame, DataFrame], DataFrame], path: str, seed: int = 0) -> DataFrame:
    """The measure of each generation against df, with its number: each is sampled from the one before, written below path and read again."""
    spark, current, out = df.sparkSession, df, None
    for g in range(generations):
        sampler(current, seed=seed + g).write.mode("errorifexists").parquet(f"{path}/generation={g}")
        current = spark.read.schema(df.schema).parquet(f"{path}/generation={g}")
        part = measure(df, current).withColumn("generation", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out
