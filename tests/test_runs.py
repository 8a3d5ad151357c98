"""Metrics of many runs at once, against the same metrics run by run."""

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfidelity.functions.comoments import co_moments, correlation, mean_product
from tabfidelity.operators import association, generate, membership, multivariate, prep
from tabfidelity.plans.registry import METRICS_BY_RUN, Columns, evaluate_runs

SCHEMA = "id long, run string, c string, d string, x double, y double, z double"


def rows(n=240, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x = draw.gauss(1e6, 3)
        y = x / 2 + draw.gauss(0, 1)
        out.append((i, ("a", "b", None)[i % 3], draw.choice("pqr"), draw.choice(["u", "v", None]), None if i % 11 == 0 else x, math.nan if i % 13 == 0 else y, 7.0))
    return out


@pytest.mark.parametrize("most", [1, 1 << 22])
def test_co_moments_by_run(spark, most):
    data, columns, shifts = rows(), ["x", "y", "z"], [1e6, 5e5, 0.0]
    got = co_moments(spark.createDataFrame(data, SCHEMA).repartition(5), columns, ["run"], shifts, most).withColumns({"r": correlation(), "p": mean_product(shifts)}).collect()
    assert len(got) == 3 * 6
    for m in got:
        own = [(v[4 + m.i], v[4 + m.j]) for v in data if v[1] == m.run]
        both = np.array([v for v in own if all(u is not None and not math.isnan(u) for u in v)])
        assert m.n == len(both) and m.p == pytest.approx((both[:, 0] * both[:, 1]).mean(), rel=1e-12)
        if 2 in (m.i, m.j):
            assert m.r is None
        else:
            assert m.r == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)


def test_co_moments_of_nothing(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert co_moments(d, ["x", "y"], ["run"]).count() == 0
    assert [(r.n, r.r) for r in co_moments(spark.createDataFrame([(1, "a", "p", "u", None, None, None)], SCHEMA), ["x"]).withColumn("r", correlation()).collect()] == [(0, None)]


@pytest.mark.parametrize("shared", [True, False])
def test_every_run_is_as_if_alone(spark, shared):
    """Run columns are never NULL here: metrics of single columns drop such runs."""
    data = [(*v[:1], v[1] or "e", *v[2:5], None if v[5] is not None and math.isnan(v[5]) else v[5], float(v[0] % 5)) for v in rows()]
    d = spark.createDataFrame(data, SCHEMA)
    real, synthetic = d.where("id % 2 = 0"), d.where("id % 2 = 1").withColumn("x", F.col("x") + F.col("id") % 3)
    real = real.drop("run") if shared else real
    columns = Columns(("c", "d"), ("x", "y", "z"), "id")
    names = ["correlation_similarity", "contingency_similarity", "mmd_polynomial", "mmd_rbf", "sliced_wasserstein", "new_row_synthesis", "ks_complement", *(["dcr_median"] if shared else [])]
    got = {(r.run, r.metric, r.column): r.value for r in evaluate_runs(real, synthetic, columns, ["run"], names).collect()}
    for run in "abe":
        r, s = (real if shared else real.where(F.col("run") == run).drop("run")), synthetic.where(F.col("run") == run).drop("run")
        for p in association.correlation_similarity(r, s, columns.numeric).collect():
            assert got[run, "correlation_similarity", f"{p.column_1} / {p.column_2}"] == pytest.approx(p.score, abs=1e-6)
        if shared:  # with run columns, bins have the ends of all real rows
            for p in association.contingency_similarity(r, s, columns.categorical, columns.numeric).collect():
                assert got[run, "contingency_similarity", f"{p.column_1} / {p.column_2}"] == pytest.approx(p.score, abs=1e-9)
        if run == "e":
            continue
        whole = lambda df: prep.minmax_scale(df.select(*columns.numeric).na.drop(), columns.numeric, real.select(*columns.numeric))
        assert got[run, "mmd_rbf", None] == pytest.approx(multivariate.mmd_rbf_features(whole(r), whole(s), columns.numeric).first().mmd, abs=1e-9)
        assert got[run, "sliced_wasserstein", None] == pytest.approx(multivariate.sliced_wasserstein(whole(r), whole(s), columns.numeric).first().distance, abs=1e-9)
        assert got[run, "new_row_synthesis", None] == pytest.approx(membership.new_row_synthesis(r, s, columns.categorical, columns.numeric).first().score)
        assert got[run, "mmd_polynomial", None] == pytest.approx(multivariate.mmd_polynomial(r, s, columns.numeric).first().mmd, rel=1e-3)
        if shared:
            a, b = ([[*v] for v in whole(df).collect()] for df in (r, s))
            assert got[run, "dcr_median", None] == pytest.approx(median(min(math.dist(v, w) for w in a) for v in b), abs=1e-9)


def test_most_metrics_take_runs(spark):
    assert len(METRICS_BY_RUN) >= 19
    d = spark.createDataFrame([(i, "ab"[i % 2], "p", "u", 1.0, float(i), 2.0) for i in range(12)], SCHEMA)
    with pytest.raises(ValueError):
        evaluate_runs(d.drop("run"), d, Columns(("c",), ("x",)), ["run"], ["dcr_median"])
    with pytest.raises(ValueError):
        evaluate_runs(d.drop("run"), d, Columns(("c",), ("x",)), ["run"], ["ks_complement"], most_runs=1)


def test_new_rows_where_most_rows_share_a_number(spark):
    """Nine tenths hold the same first number, and every number has rows near the tolerance's edge."""
    draw = random.Random(5)
    number = lambda: 100.0 if draw.random() < 0.9 else draw.choice([None, 0.0, -3.0, draw.uniform(1, 50)])
    make = lambda n: [(draw.choice("pq"), number(), draw.choice([draw.uniform(-5, 5), 1.0, 1.01, 0.0]), float(draw.randrange(2))) for _ in range(n)]
    real, synthetic = make(400), make(300)
    schema, near = "c string, x double, y double, z double", lambda a, b: a is b is None or (a is not None and b is not None and abs(a - b) <= 0.01 * abs(b))
    matched = sum(any(r[0] == s[0] and all(near(a, b) for a, b in zip(r[1:], s[1:], strict=True)) for r in real) for s in synthetic)
    got = membership.new_row_synthesis(spark.createDataFrame(real, schema), spark.createDataFrame(synthetic, schema), ["c"], ["x", "y", "z"]).first()
    assert (got.total, got.matched) == (300, matched) and 0 < matched < 300
    empty = spark.createDataFrame([], schema)
    assert membership.new_row_synthesis(empty, empty, ["c"], ["x"]).first().asDict() == {"total": 0, "matched": 0, "new_rows": 0, "score": None}


def test_intervals_of_any_values(spark):
    """NULL comes first, and no task orders more than a range."""
    values = [None, None, -1.5, 2.0, 2.0, 2.0, *[float(x) / 7 for x in range(500)]]
    d = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    got = sorted(((r.lo, r.hi, r.value) for r in generate.value_intervals(d, "x").collect()))
    n, at = len(values), 0
    for value in [None, *sorted({v for v in values if v is not None})]:
        k = sum(v == value for v in values)
        assert got[0] == (at / n, (at + k) / n, value)
        got, at = got[1:], at + k
    assert not got and at == n
    drawn = generate.marginal_sampler(d, 3000, seed=4)
    assert drawn.count() == 3000 and {r.x for r in drawn.distinct().collect()} <= set(values)
    assert generate.value_intervals(d.where("x > 1e9"), "x").count() == 0


def test_value_sets_of_any_size(spark):
    from tabfidelity.operators import rules

    d = spark.range(60_000).select(F.concat(F.lit("customer"), "id").alias("a"), (F.col("id") % 3).alias("b"), F.lit(None).cast("string").alias("c"))
    got = {r.column: r for r in rules.generate_rules(d, ["a", "b", "c"]).collect()}
    assert got["a"].allowed == sorted(f"customer{i}" for i in range(60_000)) and got["b"].allowed == ["0", "1", "2"] and got["c"].allowed == [] and got["c"].has_null
    new = spark.createDataFrame([(1, "customer7", 2), (2, "customerx", 3), (3, None, None), (4, "customer7", 0)], "id long, a string, b long")
    allowed = rules.allowed_values(d, ["a", "b"])
    for nulls in (False, True):
        found = {r.id: (r.categorical_a, r.categorical_b) for r in rules.check_allowed(new, allowed, ["a", "b"], nulls).collect()}
        assert found == {1: (True, True), 2: (False, False), 3: (nulls, nulls), 4: (True, True)}


def test_summary_with_many_categories(spark):
    """Values of the population that the synthetic rows have or not, one of them in most rows."""
    from tabfidelity.plans.roles import Roles

    population = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 10).cast("double").alias("x"))
    synthetic = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "k0").otherwise(F.concat(F.lit("k"), F.col("id") * 3)).alias("k"), (F.col("id") % 12).cast("double").alias("x"))
    row = membership.validation_summary(Roles(population, population.limit(0), population, synthetic), membership.Spec(("k",), ("x",))).first()
    passing = sum(1 for i in range(3000) if i % 12 < 10 and (i % 10 < 9 or i * 3 < 5000))
    assert (row.synthetic_total_count, row.plausible_total_count, row.training_unique_count) == (3000, passing, 0)
