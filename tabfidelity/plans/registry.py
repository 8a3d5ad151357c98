"""Metrics by name, and their evaluation over roles into one tidy table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scratch import stored
from ..operators import association, detect, membership, multivariate, nn, prep, privacy, schema_cmp, univariate
from .roles import Roles


@dataclass(frozen=True)
class Columns:
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    #: SQL expression of a whole number that tells rows apart; metrics over single rows need it.
    key: str | None = None


@dataclass(frozen=True)
class Metric:
    """run gives (column_1, value) or (column_1, column_2, value) rows; higher tells which way is better."""

    run: Callable[[Roles, Columns], DataFrame]
    higher: bool
    best: float


def _one(name: str, score: str, numeric: bool):
    def run(r: Roles, c: Columns) -> DataFrame:
        return getattr(univariate, name)(r.reference, r.synthetic, c.numeric if numeric else c.categorical).select(F.col("column").alias("column_1"), F.col(score).alias("value"))

    return run


def _two(f, which):
    return lambda r, c: f(r.reference, r.synthetic, *which(c)).select("column_1", "column_2", F.col("score").alias("value"))


def _pair_vectors(r: Roles, c: Columns) -> list[DataFrame]:
    """(id, v) of reference and synthetic, scaled to the reference's ends."""
    if c.key is None:
        raise ValueError("the metric needs a key of the rows")
    scaled = [prep.minmax_scale(df.withColumn("__key", F.expr(c.key)).na.drop(subset=[*c.numeric]), c.numeric, r.reference) for df in (r.reference, r.synthetic)]
    return [nn.vectors(df, "__key", c.numeric) for df in scaled]


def _named_values(df: DataFrame) -> DataFrame:
    """The columns of a table of one row as (column_1, value)."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_1"), F.col(c).cast("double").alias("value")) for c in df.columns])))


def _detection(r: Roles, c: Columns) -> DataFrame:
    if c.key is None:
        raise ValueError("the metric needs a key of the rows")
    data = detect.labelled(*[df.withColumn("__key", F.expr(c.key)) for df in (r.reference, r.synthetic)], [*c.numeric], "__key")
    return detect.detect_linear(data, "__key").agg(F.avg("auc").alias("value"))


def _scaled(r: Roles, c: Columns) -> list[DataFrame]:
    return [prep.minmax_scale(df.select(*c.numeric).na.drop(), c.numeric, r.reference) for df in (r.reference, r.synthetic)]


def _median(distances: DataFrame) -> DataFrame:
    found = exact_quantiles(stored(distances.select("distance"), "closest"), ["distance"], [0.5])["distance"]
    return distances.sparkSession.range(1).select(F.lit(found[0] if found else None).cast("double").alias("value"))


def _protection(r: Roles, c: Columns) -> DataFrame:
    """Numbers by their range and categories by equality, against random rows as many as the synthetic ones."""
    numbered = lambda df: df.withColumn("__id", F.monotonically_increasing_id())
    base = multivariate.random_baseline(r.reference, c.numeric, c.categorical, r.synthetic.count())
    vectors = [multivariate.mixed_vectors(df, key, c.numeric, c.categorical, r.reference) for df, key in ((numbered(r.reference), "__id"), (numbered(r.synthetic), "__id"), (base, "id"))]
    return multivariate.dcr_baseline_protection(*vectors, metric=("mixed", len(c.numeric))).select(F.col("protection").alias("value"))


METRICS: dict[str, Metric] = {
    "ks_complement": Metric(_one("ks_complement", "score", True), True, 1.0),
    "tv_complement": Metric(_one("tv_complement", "score", False), True, 1.0),
    "boundary_adherence": Metric(_one("boundary_adherence", "score", True), True, 1.0),
    "category_adherence": Metric(_one("category_adherence", "score", False), True, 1.0),
    "jsd_equal_width": Metric(_one("jsd_equal_width", "distance", True), False, 0.0),
    "jsd_adaptive": Metric(_one("jsd_adaptive", "distance", True), False, 0.0),
    "jsd_categorical": Metric(_one("jsd_categorical", "distance", False), False, 0.0),
    "jsd_mixed": Metric(_one("jsd_mixed", "distance", True), False, 0.0),
    "wasserstein_1d": Metric(_one("wasserstein_1d", "distance", True), False, 0.0),
    "correlation_similarity": Metric(_two(association.correlation_similarity, lambda c: (c.numeric,)), True, 1.0),
    "contingency_similarity": Metric(_two(association.contingency_similarity, lambda c: (c.categorical, c.numeric)), True, 1.0),
    "mmd_linear": Metric(lambda r, c: multivariate.mmd_linear(r.reference, r.synthetic, c.numeric).select(F.col("mmd").alias("value")), False, 0.0),
    "mmd_polynomial": Metric(lambda r, c: multivariate.mmd_polynomial(r.reference, r.synthetic, c.numeric).select(F.col("mmd").alias("value")), False, 0.0),
    "mmd_rbf": Metric(lambda r, c: multivariate.mmd_rbf_features(*_scaled(r, c), c.numeric).select(F.col("mmd").alias("value")), False, 0.0),
    "sliced_wasserstein": Metric(lambda r, c: multivariate.sliced_wasserstein(*_scaled(r, c), c.numeric).select(F.col("distance").alias("value")), False, 0.0),
    "prdc": Metric(lambda r, c: _named_values(multivariate.prdc(*_pair_vectors(r, c))), True, 1.0),
    "alpha_precision": Metric(lambda r, c: _named_values(multivariate.alpha_precision_naive(*_pair_vectors(r, c), len(c.numeric))), True, 1.0),
    "dcr_median": Metric(lambda r, c: _median(multivariate.dcr(*_pair_vectors(r, c)[::-1])), True, float("inf")),
    "dcr_protection": Metric(lambda r, c: _protection(r, c), True, 1.0),
    "new_row_synthesis": Metric(lambda r, c: membership.new_row_synthesis(r.reference, r.synthetic, c.categorical, c.numeric).select(F.col("score").alias("value")), True, 1.0),
    "detection_linear": Metric(_detection, False, 0.5),
    "structure": Metric(lambda r, c: schema_cmp.structure_score(schema_cmp.table_structure(r.reference, r.synthetic)).select(F.col("score").alias("value")), True, 1.0),
    "k_anonymity": Metric(lambda r, c: privacy.k_anonymity(r.synthetic, c.categorical).select(F.col("k").cast("double").alias("value")), True, float("inf")),
}


RESULT = "metric string, column_1 string, column_2 string, value double, status string, message string"


def evaluate(roles: Roles, columns: Columns, names: Sequence[str]) -> DataFrame:
    """(metric, column_1, column_2, value, status, message).

    Each metric runs on its own; one that fails, in planning or while it runs, is a row of its own, not a failure of all. What is gathered are
    the results, a row for each column or pair of columns.
    """
    rows = []
    for name in names:
        try:
            found = METRICS[name].run(roles, columns)
            there = [F.col(c).cast("string").alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("column_1", "column_2")]
            rows += [(name, r[0], r[1], r[2], "success", None) for r in found.select(*there, F.col("value").cast("double").alias("value")).collect()]
        except (PySparkException, Py4JError, KeyError, ValueError, np.linalg.LinAlgError) as e:
            rows.append((name, None, None, None, "error", str(e)[:300]))
    return roles.synthetic.sparkSession.createDataFrame(rows, RESULT)


@dataclass(frozen=True)
class Runs:
    """Runs of a synthetic table, told apart by the columns by, and the real rows: of each run, or for all of them."""

    real: DataFrame
    synthetic: DataFrame
    by: tuple[str, ...]
    #: The most runs that are broadcast, which is checked.
    most: int = 10_000

    @property
    def shared(self) -> bool:
        return not set(self.by) <= set(self.real.columns)

    @property
    def common(self) -> DataFrame:
        """The real rows without run columns where they serve all runs."""
        return self.real.drop(*self.by) if self.shared else self.real

    def dealt(self) -> DataFrame:
        """The real rows with run columns, a copy of them for each run where they serve all."""
        if not self.shared:
            return self.real
        runs = self.synthetic.select(*self.by).distinct()
        if runs.limit(self.most + 1).count() > self.most:
            raise ValueError(f"more than {self.most} runs: give the real rows of each run")
        return self.common.crossJoin(F.broadcast(runs))

    def named(self, found: DataFrame, value: str, column: str | None = None) -> DataFrame:
        """found as (by..., column, value)."""
        return found.select(*self.by, (F.expr(column) if column else F.lit(None)).cast("string").alias("column"), F.col(value).cast("double").alias("value"))


def _by_column(name: str, score: str, numeric: bool):
    def run(t: Runs, c: Columns) -> DataFrame:
        found = getattr(univariate, name)(t.dealt(), t.synthetic, c.numeric if numeric else c.categorical, by=t.by)
        return t.named(found.select("column.*", score), score, "column")

    return run


#: What the name of a pair of columns is made of.
PAIR = "concat(column_1, ' / ', column_2)"


def _scaled_runs(t: Runs, c: Columns, real: DataFrame) -> list[DataFrame]:
    """Numbers in units of the ends of all real rows, with run columns where there are any; rows with a NULL are left out."""
    return [prep.minmax_scale(df.select(*[b for b in t.by if b in df.columns], *c.numeric).na.drop(subset=[*c.numeric]), c.numeric, t.common) for df in (real, t.synthetic)]


def _dcr_by_run(t: Runs, c: Columns) -> DataFrame:
    if c.key is None or not t.shared:
        raise ValueError("the metric needs a key of the rows, and real rows that serve all runs")
    real, synthetic = (df.withColumn("__key", F.expr(c.key).cast("long")) for df in (t.common, t.synthetic))
    ends = real.na.drop(subset=[*c.numeric])
    vectors = [nn.vectors(prep.minmax_scale(df.na.drop(subset=[*c.numeric]), c.numeric, ends), "__key", c.numeric) for df in (real, synthetic)]
    return t.named(multivariate.median_dcr_by(*vectors, synthetic.select(F.col("__key").alias("id"), *t.by), t.by), "distance")


def _structure_by_run(t: Runs, c: Columns) -> DataFrame:
    score = schema_cmp.structure_score(schema_cmp.table_structure(t.real.drop(*t.by), t.synthetic.drop(*t.by)))
    return t.named(t.synthetic.select(*t.by).distinct().crossJoin(F.broadcast(score)), "score")  # one row


#: Metrics of all runs in one job: (by..., column, value); the column of a pair is named after both.
METRICS_BY_RUN: dict[str, Callable[[Runs, Columns], DataFrame]] = {
    **{n: _by_column(n, "score", True) for n in ("ks_complement", "boundary_adherence")},
    **{n: _by_column(n, "score", False) for n in ("tv_complement", "category_adherence")},
    **{n: _by_column(n, "distance", True) for n in ("jsd_equal_width", "jsd_adaptive", "jsd_mixed", "wasserstein_1d")},
    "jsd_categorical": _by_column("jsd_categorical", "distance", False),
    "correlation_similarity": lambda t, c: t.named(association.correlation_similarity_by(t.common, t.synthetic, c.numeric, t.by), "score", PAIR),
    "contingency_similarity": lambda t, c: t.named(association.contingency_similarity_by(t.common, t.synthetic, c.categorical, c.numeric, t.by), "score", PAIR),
    "mmd_linear": lambda t, c: t.named(multivariate.mmd_linear(t.dealt(), t.synthetic, c.numeric, t.by), "mmd"),
    "mmd_polynomial": lambda t, c: t.named(multivariate.mmd_polynomial_by(t.common, t.synthetic, c.numeric, t.by), "mmd"),
    "mmd_rbf": lambda t, c: t.named(multivariate.mmd_rbf_features(*_scaled_runs(t, c, t.common), c.numeric, by=t.by), "mmd"),
    "sliced_wasserstein": lambda t, c: t.named(multivariate.sliced_wasserstein(*_scaled_runs(t, c, t.dealt()), c.numeric, by=t.by), "distance"),
    "dcr_median": _dcr_by_run,
    "new_row_synthesis": lambda t, c: t.named(membership.new_row_synthesis(t.common, t.synthetic, c.categorical, c.numeric, by=t.by), "score"),
    "structure": _structure_by_run,
    "k_anonymity": lambda t, c: t.named(privacy.class_sizes(t.synthetic, [*t.by, *c.categorical]).groupBy(*t.by).agg(F.min("members").alias("k")), "k"),
}


def evaluate_runs(real: DataFrame, synthetic: DataFrame, columns: Columns, by: Sequence[str], names: Sequence[str] | None = None, most_runs: int = 10_000) -> DataFrame:
    """(by..., metric, column, value) of all runs in one job: the synthetic table holds the rows of every run, told apart by the run columns.

    A real table without the run columns serves every run; metrics of single columns then meet it once for each run (at most most_runs, which is
    checked), those of pairs and rows reduce it once for all. names: those of METRICS_BY_RUN; by default all but dcr_median, which needs a key.
    """
    t = Runs(real, synthetic, tuple(by), most_runs)
    names = names if names is not None else [n for n in METRICS_BY_RUN if n != "dcr_median"]
    parts = [METRICS_BY_RUN[n](t, columns).select(*by, F.lit(n).alias("metric"), "column", "value") for n in names]
    return reduce(DataFrame.unionByName, parts)
