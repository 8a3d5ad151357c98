"""Similarity of whole rows as vectors (id, v), and distances to the closest record."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.comoments import co_moments, mean_product
from ..functions.keys import ratio, uniform
from ..functions.quantiles import exact_quantiles
from ..functions.ranks import ranked_within
from ..functions.scratch import stored
from .association import column_means
from .nn import Metric, kernel_mean, knn_join, within_radius
from .univariate import wasserstein_1d


def _radii(x: DataFrame, k: int) -> DataFrame:
    return knn_join(x, x, k, exclude_self=True).where(F.col("rank") == k).select("id", F.col("distance").alias("radius"))


def prdc(real: DataFrame, synthetic: DataFrame, k: int = 5) -> DataFrame:
    """One row: precision, recall, density, coverage, from balls that reach the k-th neighbour of the own side."""
    balls_r, balls_s = real.join(_radii(real, k), "id"), synthetic.join(_radii(synthetic, k), "id")
    n_r, n_s = real.agg(F.count("*").alias("n_r")), synthetic.agg(F.count("*").alias("n_s"))
    in_real = within_radius(synthetic, balls_r).agg(F.count("*").alias("hit_s"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"))
    in_synthetic = within_radius(real, balls_s).agg(F.count("*").alias("hit_r"))
    nearest = knn_join(real, synthetic, 1).join(balls_r.select("id", "radius"), "id").agg(F.count_if(F.col("distance") <= F.col("radius")).alias("covered"))
    one = n_r
    for part in (n_s, in_real, in_synthetic, nearest):
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one.select(
        ratio(F.col("hit_s"), F.col("n_s")).alias("precision"),
        ratio(F.col("hit_r"), F.col("n_r")).alias("recall"),
        (F.col("inside") / (F.col("n_s") * F.lit(float(k)))).alias("density"),
        ratio(F.col("covered"), F.col("n_r")).alias("coverage"),
    )


def centroid(x: DataFrame, d: int) -> DataFrame:
    """One row: the mean vector."""
    return x.agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(d)]).alias("center"))


def _to_center(v: Column, c: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def alpha_precision_naive(real: DataFrame, synthetic: DataFrame, d: int, steps: int = 30) -> DataFrame:
    """One row: delta_precision_alpha, delta_coverage_beta, authenticity, in the encoded space itself.

    Shares of synthetic rows within the real support at each level, and of real ones near a synthetic row within the
    synthetic support, against the level; authentic rows are farther from their real neighbour than that is
    from its own.
    """
    grid = [i / (steps - 1) for i in range(steps)]
    cr, cs = F.broadcast(centroid(real, d)), F.broadcast(centroid(synthetic, d))  # one row each
    to_r = lambda x: x.crossJoin(cr).select("id", _to_center(F.col("v"), F.col("center")).alias("dist"))
    of = lambda dist: exact_quantiles(stored(dist.select("dist"), "distances"), ["dist"], grid)["dist"] or [None] * steps
    levels = of(to_r(real))
    inside = to_r(synthetic).agg(*[F.avg((F.col("dist") <= F.lit(q)).cast("double")).alias(f"a{i}") for i, q in enumerate(levels)])
    to_s = synthetic.crossJoin(cs).select("id", _to_center(F.col("v"), F.col("center")).alias("dist"))
    s_levels = of(to_s)
    own = knn_join(real, real, 1, exclude_self=True).select("id", F.col("distance").alias("own"))
    near = knn_join(real, synthetic, 1).select("id", "neighbour", F.col("distance").alias("near"))
    covered = near.join(own, "id").where(F.col("near") <= F.col("own")).join(to_s.select(F.col("id").alias("neighbour"), "dist"), "neighbour")
    n_real = F.broadcast(real.agg(F.count("*").alias("n")))
    beta = covered.agg(*[F.coalesce(F.sum((F.col("dist") <= F.lit(q)).cast("double")), F.lit(0.0)).alias(f"c{i}") for i, q in enumerate(s_levels)]).crossJoin(n_real)
    back = knn_join(synthetic, real, 1).select(F.col("neighbour").alias("id"), F.col("distance").alias("back"))
    auth = back.join(own, "id").agg(F.avg((F.col("back") > F.col("own")).cast("double")).alias("authenticity"))
    one = inside.crossJoin(F.broadcast(beta)).crossJoin(F.broadcast(auth))
    gap = lambda f: sum((F.abs(F.lit(g) - f(i)) for i, g in enumerate(grid)), F.lit(0.0)) / sum(grid)
    return one.select((1 - gap(lambda i: F.col(f"a{i}"))).alias("delta_precision_alpha"), (1 - gap(lambda i: F.col(f"c{i}") / F.col("n"))).alias("delta_coverage_beta"), "authenticity")


def mmd_linear(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each run of by: the squared distance of the means."""
    means = [df.groupBy(*by).agg(*[F.avg(c).alias(f"{side}_{c}") for c in columns]) for side, df in (("r", real), ("s", synthetic))]
    m = means[0].join(means[1], [*by]) if by else means[0].crossJoin(F.broadcast(means[1]))  # one row each
    return m.select(*by, sum((F.pow(F.col(f"r_{c}") - F.col(f"s_{c}"), F.lit(2.0)) for c in columns), F.lit(0.0)).alias("mmd"))


def _moments(df: DataFrame, side: str) -> DataFrame:
    """(i, <side>): sums over the vectors v: 1, then v, then the products of all pairs. Tasks add up their own rows, so few numbers are shuffled."""

    def run(batches):
        total = None
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            if len(b):
                x = flat.reshape(len(b), -1)
                part = np.concatenate([[float(len(x))], x.sum(axis=0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], ["i", "x"])

    return df.select("v").where("v is not null").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias(side))


def mmd_polynomial_vectors(real: DataFrame, synthetic: DataFrame, gamma: float = 1.0, coef: float = 1.0) -> DataFrame:
    """mmd_polynomial() over vectors v of one length, of any number of dimensions."""
    both = _moments(real, "r").join(_moments(synthetic, "s"), "i")
    n = both.where("i = 0").select(F.col("r").alias("n_r"), F.col("s").alias("n_s"))
    size = F.col("dims")
    dims = both.agg(((F.sqrt(4.0 * F.count("*") - 3) - 1) / 2).cast("long").alias("dims"))
    gap = F.pow(F.col("r") / F.col("n_r") - F.col("s") / F.col("n_s"), F.lit(2.0))
    weight = F.when(F.col("i") == 0, 0.0).when(F.col("i") <= size, 2 * gamma * coef).otherwise(gamma**2)
    return both.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(dims)).agg(F.sum(weight * gap).alias("mmd"))  # one row each


def mmd_polynomial(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], gamma: float = 1.0, coef: float = 1.0) -> DataFrame:
    """One row: mean degree-two kernels, exact through first and second moments instead of pairs of rows."""
    d = len(columns)
    one = None
    for side, df in (("r", real), ("s", synthetic)):
        m = df.agg(*[F.avg(c).alias(f"{side}_{i}") for i, c in enumerate(columns)], *[F.avg(F.col(columns[i]) * F.col(columns[j])).alias(f"{side}_{i}_{j}") for i in range(d) for j in range(i, d)])
        one = m if one is None else one.crossJoin(F.broadcast(m))  # one row each

    def mean_kernel(a: str, b: str) -> Column:
        first = sum((F.col(f"{a}_{i}") * F.col(f"{b}_{i}") for i in range(d)), F.lit(0.0))
        second = sum(((1.0 if i == j else 2.0) * F.col(f"{a}_{i}_{j}") * F.col(f"{b}_{i}_{j}") for i in range(d) for j in range(i, d)), F.lit(0.0))
        return F.lit(gamma**2) * second + F.lit(2 * gamma * coef) * first + F.lit(coef**2)

    return one.select((mean_kernel("r", "r") + mean_kernel("s", "s") - 2 * mean_kernel("r", "s")).alias("mmd"))


def mmd_polynomial_by(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str], gamma: float = 1.0, coef: float = 1.0) -> DataFrame:
    """(by..., mmd): mmd_polynomial() of every run of the synthetic table, from one pass over either table; a real table without the run columns
    serves all runs. A mean of a product is over the rows where both columns are there.
    """
    shifts = column_means(real, columns)
    at = F.get(F.array(*[F.lit(s) for s in shifts]), F.col("i"))
    own = [b for b in by if b in real.columns]
    sides = []
    for df, keys, side in ((real, own, "r"), (synthetic, [*by], "s")):
        mean = F.col("x") / F.nullif(F.col("n"), F.lit(0)) + at
        sides.append(co_moments(df, columns, keys, shifts).select(*keys, "i", "j", mean.alias(f"{side}_1"), mean_product(shifts).alias(f"{side}_2")))
    first, second = (F.pow(F.col(f"r_{k}") - F.col(f"s_{k}"), F.lit(2.0)) for k in (1, 2))
    same = F.col("i") == F.col("j")
    gap = F.when(same, 2 * gamma * coef * first + gamma**2 * second).otherwise(2 * gamma**2 * second)
    return sides[1].join(sides[0], [*own, "i", "j"]).groupBy(*by).agg(F.sum(gap).alias("mmd"))


def mmd_rbf(real: DataFrame, synthetic: DataFrame, gamma: float = 1.0, share: float = 1.0, block_rows: int = 5000, seed: int = 0) -> DataFrame:
    """One row: the Gaussian kernel's distance, exact, over all pairs of rows (id, v), or those of a hashed share of either side.

    Work is rows times rows, in blocks; mmd_rbf_features() is linear, and comes within about sqrt(8 / features) of this.
    """
    if share < 1:
        real, synthetic = (x.where(uniform("id", F.lit("mmd"), seed=seed) < share) for x in (real, synthetic))
    real, synthetic = stored(real.select("id", "v"), "real"), stored(synthetic.select("id", "v"), "synthetic")
    one = kernel_mean(real, real, gamma, "rr", block_rows)
    for x, y, name in ((synthetic, synthetic, "ss"), (real, synthetic, "rs")):
        one = one.crossJoin(F.broadcast(kernel_mean(x, y, gamma, name, block_rows)))  # one row each
    return one.select((F.col("rr") + F.col("ss") - 2 * F.col("rs")).alias("mmd"))


def fourier(d: int, gamma: float, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, shifts) of random features whose products are the Gaussian kernel's estimate."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (features, d)), rng.uniform(0, 2 * np.pi, features)


def mmd_rbf_features(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], gamma: float = 1.0, features: int = 64, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each run of by: the Gaussian kernel's distance through random Fourier features; linear in the rows.

    A real table without the run columns serves all runs.
    """
    weights, shift = fourier(len(columns), gamma, features, seed)
    own = [b for b in by if b in real.columns]

    def means(df: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
        dot = lambda i: sum((F.lit(float(weights[i, j])) * F.col(c) for j, c in enumerate(columns)), F.lit(float(shift[i])))
        return df.groupBy(*keys).agg(*[F.avg(F.cos(dot(i))).alias(f"{side}_{i}") for i in range(features)])

    r, s = means(real, "r", own), means(synthetic, "s", by)
    one = s.join(r, own) if own else s.crossJoin(F.broadcast(r))  # one row
    return one.select(*by, (sum((F.pow(F.col(f"r_{i}") - F.col(f"s_{i}"), F.lit(2.0)) for i in range(features)), F.lit(0.0)) * 2 / features).alias("mmd"))


def directions(d: int, projections: int, seed: int) -> np.ndarray:
    """Unit vectors."""
    out = np.random.default_rng(seed).normal(size=(projections, d))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def sliced_wasserstein(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], projections: int = 16, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each run of by: the mean one-dimensional distance over seeded random directions; the columns are expected scaled."""
    along = directions(len(columns), projections, seed)
    names = [f"p{i}" for i in range(projections)]
    project = lambda df: df.select(*by, *[sum((F.lit(float(w)) * F.col(c) for w, c in zip(along[i], columns, strict=True)), F.lit(0.0)).alias(names[i]) for i in range(projections)])
    found = wasserstein_1d(project(real), project(synthetic), names, by=by)
    return found.groupBy(*[F.col(f"column.{b}").alias(b) for b in by]).agg(F.avg("distance").alias("distance"))


def mixed_vectors(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], fit: DataFrame) -> DataFrame:
    """(id, v) for the metric ("mixed", number of numeric): numbers in units of fit's range, NaN for NULL, and codes of the categories' texts.

    A column of one value in fit has no range: other values are then at distance 1. Codes are 53 bits of a digest; a NULL's is -1.
    """
    ends = fit.agg(*[f(F.col(c).cast("double")).alias(f"{x}{i}") for i, c in enumerate(numeric) for x, f in (("low", F.min), ("high", F.max))]).first() if numeric else None
    parts = []
    for i, c in enumerate(numeric):
        low, high = ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0
        x = F.col(c).cast("double") - low
        scaled = x / (high - low) if high > low else F.when(x == 0, 0.0).otherwise(2 + F.abs(x))
        parts.append(F.coalesce(scaled, F.lit(float("nan"))))
    parts += [F.when(F.col(c).isNull(), -1.0).otherwise(F.shiftrightunsigned(F.xxhash64(F.col(c).cast("string")), 11).cast("double")) for c in categorical]
    return df.select(F.col(key).cast("long").alias("id"), F.array(*parts).alias("v"))


def dcr(a: DataFrame, b: DataFrame, exclude_self: bool = False, metric: Metric = "euclidean") -> DataFrame:
    """(id, distance): to the closest record. Where most rows repeat others, distinct ones alone are looked for, among distinct ones."""
    if not exclude_self:
        a = stored(a.select("id", "v"), "rows")
        n, kinds = a.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("v"))).first()
        m, other_kinds = b.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("v"))).first()
        if 2 * other_kinds < m:
            b = b.groupBy("v").agg(F.min("id").alias("id"))
        if 2 * kinds < n:
            one = stored(a.groupBy("v").agg(F.min("id").alias("id")), "distinct")
            found = knn_join(one, b, 1, metric).select(F.col("id").alias("one"), "distance").join(one.withColumnRenamed("id", "one"), "one")
            return a.join(found, "v").select("id", "distance")
    return knn_join(a, b, 1, metric, exclude_self=exclude_self).select("id", "distance")


def median_dcr_by(real: DataFrame, synthetic: DataFrame, runs: DataFrame, by: Sequence[str], metric: Metric = "euclidean") -> DataFrame:
    """(by..., distance): each run's median distance to the closest real record. runs: (id, by...) of the synthetic rows.

    A synthetic row's closest real one doesn't depend on its run, so one join serves all runs; rows are ranked by ranges of the distance.
    """
    found = stored(dcr(synthetic, real, metric=metric).join(runs, "id").select(*by, "distance", "id"), "closest")
    sizes = found.groupBy(*by).agg(F.count("*").alias("__n"))
    ranked = ranked_within(found, by, ["distance", "id"], "__rank")
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    joined = ranked.join(sizes.select(*[F.col(b).alias(f"__{b}") for b in by], "__n"), same)
    middle = joined.where(F.col("__rank").isin(F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2)))
    return middle.groupBy(*by).agg(F.avg("distance").alias("distance"))


def random_baseline(real: DataFrame, numeric: Sequence[str], categorical: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """(id, columns): n rows drawn evenly within the numbers' real ends and evenly among the categories that occur (a NULL is none)."""
    spark = real.sparkSession
    draw = lambda c: uniform("id", F.lit(c), seed=seed)
    ends = real.agg(*[f(c).cast("double").alias(f"{x}{i}") for i, c in enumerate(numeric) for x, f in (("low", F.min), ("high", F.max))]).first() if numeric else None
    numbers = [(F.lit(ends[f"low{i}"]) + F.lit((ends[f"high{i}"] or 0.0) - (ends[f"low{i}"] or 0.0)) * draw(c)).alias(c) for i, c in enumerate(numeric)]
    rows = spark.range(n).select("id", *numbers)
    for c in categorical:
        values = stored(ranked_within(real.where(F.col(c).isNotNull()).select(c).distinct(), [], [c], "__at").select(c, "__at"), "categories")
        rows = rows.withColumn("__at", (F.floor(draw(c) * values.count()) + 1).cast("int")).join(values, "__at", "left").drop("__at")
    return rows.select("id", *numeric, *categorical)


def dcr_baseline_protection(real: DataFrame, synthetic: DataFrame, baseline: DataFrame, metric: Metric = "euclidean") -> DataFrame:
    """One row: the synthetic median distance over that of random rows, 1 at most. All three are (id, v)."""
    medians = []
    for side in (synthetic, baseline):
        found = exact_quantiles(stored(dcr(side, real, metric=metric).select("distance"), "closest"), ["distance"], [0.5])["distance"]
        medians.append(F.lit(found[0] if found else None).cast("double"))
    one = real.sparkSession.range(1).select(medians[0].alias("synthetic_median"), medians[1].alias("baseline_median"))
    return one.withColumn("protection", F.least(F.lit(1.0), ratio(F.col("synthetic_median"), F.col("baseline_median"))))
