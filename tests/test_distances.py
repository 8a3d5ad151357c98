"""Quantiles, nearest neighbours by pivots, truncated Shapley values, kernels and mixed distances against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfidelity.functions.quantiles import exact_quantiles, order_statistics
from tabfidelity.operators import multivariate, nn, prep, valuation

VECTORS = "id long, v array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in row]) for i, row in enumerate(x)], VECTORS)


def clusters(n, groups, d=4, seed=0):
    r = np.random.default_rng(seed)
    centres = 100 * r.normal(size=(groups, d))
    return np.round(centres[r.integers(0, groups, n)] + r.normal(size=(n, d)), 3)


def neighbours(df):
    return sorted((r.id, r.rank, r.neighbour, round(r.distance, 9)) for r in df.collect())


def brute_neighbours(x, y, k, distance, own=False):
    out = []
    for i, p in enumerate(x):
        near = sorted((distance(p, q), j) for j, q in enumerate(y) if not (own and i == j))[:k]
        out += [(i, rank, j, round(d, 9)) for rank, (d, j) in enumerate(near, 1)]
    return out


def euclidean(p, q):
    return math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))


def mixed(p, q):
    parts = []
    for i, (a, b) in enumerate(zip(p, q, strict=True)):
        parts.append(float(a != b) if i >= 2 else float(math.isnan(a) != math.isnan(b)) if math.isnan(a) or math.isnan(b) else min(abs(a - b), 1.0))
    return sum(parts) / len(parts)


@pytest.mark.parametrize("few,bins", [(1000, 256), (1, 4)])
def test_quantiles_are_exact(spark, few, bins):
    r = np.random.default_rng(3)
    columns = {"even": r.random(500), "tail": np.exp(20 * r.normal(size=500)), "ties": r.integers(0, 3, 500).astype(float), "one": np.full(500, 2.5), "signs": np.append(r.normal(size=498), [np.inf, -np.inf])}
    df = spark.createDataFrame([tuple(float(columns[c][i]) if (i + len(c)) % 9 else None for c in columns) for i in range(500)], ", ".join(f"{c} double" for c in columns))
    for c in columns:
        own = np.sort([columns[c][i] for i in range(500) if (i + len(c)) % 9])
        ranks = [0, 1, 7, 250, len(own) - 1]
        assert order_statistics(df, {c: ranks}, few, bins) == {(c, k): own[k] for k in ranks}
    shares = (0.0, 0.013, 0.25, 0.5, 0.99, 1.0)
    got = exact_quantiles(df, [*columns], shares)
    for c in columns:
        assert got[c] == pytest.approx(df.agg(F.percentile(c, F.array(*map(F.lit, shares)))).first()[0], nan_ok=True)


def test_quantiles_of_nothing_and_of_nan(spark):
    df = spark.createDataFrame([(None, float("nan"), 1), (None, 1.0, 5)], "a double, b double, c int")
    got = exact_quantiles(df, ["a", "b", "c"], [0.0, 0.5])
    assert got["a"] is None and got["b"][0] == 1.0 and math.isnan(got["b"][1]) and got["c"] == [1.0, 3.0]
    kept = prep.remove_outliers_iqr(df, ["a", "c"], sequential=False)
    assert kept.count() == 2 and prep.remove_outliers_iqr(df.limit(0), ["c"]).count() == 0


def test_pivots_and_blocks_agree(spark):
    far, near = clusters(300, 6), clusters(250, 6)
    for x, y, own in ((far, near, False), (near, near, True)):
        want = brute_neighbours(x, y, 3, euclidean, own)
        a, b = frame(spark, x), frame(spark, y)
        for way in (True, False):
            assert neighbours(nn.knn_join(a, b, 3, exclude_self=own, block_rows=40, by_pivots=way)) == want


def test_pivots_of_ties_few_rows_and_other_metrics(spark):
    same = frame(spark, [[1.0, 2.0]] * 30)
    assert neighbours(nn.knn_join(same, same, 2, exclude_self=True, by_pivots=True)) == brute_neighbours([[1.0, 2.0]] * 30, [[1.0, 2.0]] * 30, 2, euclidean, True)
    few = frame(spark, [[0.0, 0.0], [3.0, 4.0]])
    assert neighbours(nn.knn_join(same, few, 5, by_pivots=True)) == brute_neighbours([[1.0, 2.0]] * 30, [[0.0, 0.0], [3.0, 4.0]], 5, euclidean)
    for none in (nn.knn_join(same, few.limit(0), 2, by_pivots=True), nn.knn_join(few.limit(0), same, 2, by_pivots=True)):
        assert none.count() == 0
    r = np.random.default_rng(1)
    rows = [[float("nan") if r.random() < 0.1 else float(r.random() * 3), float(r.integers(0, 4)), float(r.integers(-1, 3)), float(r.integers(0, 2))] for _ in range(120)]
    for way in (True, False):
        got = nn.knn_join(frame(spark, rows[:60]), frame(spark, rows[60:]), 3, ("mixed", 2), block_rows=20, by_pivots=way)
        assert neighbours(got) == brute_neighbours(rows[:60], rows[60:], 3, mixed)


def test_pivots_shuffle_few_rows_on_clusters(spark):
    """Below a tenth of what blocks shuffle, and far fewer pairs."""
    a, b = frame(spark, clusters(4000, 40)), frame(spark, clusters(4000, 40))
    plan, _ = nn.plan_join(a, b, 3, block_rows=50)
    assert plan.by_pivots and plan.pivot_rows < 0.1 * plan.block_rows_total and plan.pairs < 0.1 * 4000 * 4000
    r = np.random.default_rng(0)
    even, _ = nn.plan_join(frame(spark, r.normal(size=(400, 60))), frame(spark, r.normal(size=(400, 60))), 3, block_rows=200)
    assert not even.by_pivots


def test_near_shapley_values_are_within_epsilon(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.normal(size=3)], int(r.integers(0, 2))) for i in range(90)]
    train, test = (spark.createDataFrame(x, "id long, v array<double>, label long") for x in (rows[:70], rows[70:]))
    exact = {(x.test_id, x.id): x.value for x in valuation.knn_shapley(train, test, 5).collect()}
    for epsilon, n in ((0.1, 10), (0.05, 20), (0.01, 70)):
        near = {(x.test_id, x.id): x.value for x in valuation.knn_shapley_near(train, test, 5, epsilon).collect()}
        assert len(near) == 20 * n
        assert max(abs(v - near.get(k, 0.0)) for k, v in exact.items()) <= (epsilon if n < 70 else 1e-12)
    with pytest.raises(ValueError):
        valuation.knn_shapley(train, test, most_test_rows=5)


def test_kernel_distance(spark):
    r = np.random.default_rng(4)
    x, y = r.random((90, 2)), r.random((70, 2)) + 0.2
    mean = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2)).mean()
    want = mean(x, x) + mean(y, y) - 2 * mean(x, y)
    for rows in (1000, 16):
        assert multivariate.mmd_rbf(frame(spark, x), frame(spark, y), block_rows=rows).first()[0] == pytest.approx(want, abs=1e-12)
    columns = [F.get("v", F.lit(i)).alias(c) for i, c in enumerate("ab")]
    features = multivariate.mmd_rbf_features(frame(spark, x).select(*columns), frame(spark, y).select(*columns), ["a", "b"], features=256).first()[0]
    assert abs(features - want) < (8 / 256) ** 0.5
    part = multivariate.mmd_rbf(frame(spark, x), frame(spark, y), share=0.5).first()[0]
    assert 0 < part < 1 and multivariate.mmd_rbf(frame(spark, x).limit(0), frame(spark, y)).first()[0] is None


def test_mixed_vectors_and_baseline(spark):
    rows = [(1, 0.0, 5.0, "a"), (2, 10.0, 5.0, "b"), (3, None, 5.0, None), (4, 2.5, 5.0, "c")]
    real = spark.createDataFrame(rows, "id long, x double, still double, kind string")
    v = {r.id: r.v for r in multivariate.mixed_vectors(real, "id", ["x", "still"], ["kind"], real).collect()}
    assert v[4][0] == 0.25 and math.isnan(v[3][0]) and v[3][2] == -1.0 and len({v[i][2] for i in (1, 2, 4)}) == 3
    other = spark.createDataFrame([(9, 20.0, 6.0, "a")], real.schema)
    d = multivariate.dcr(multivariate.mixed_vectors(other, "id", ["x", "still"], ["kind"], real), multivariate.mixed_vectors(real, "id", ["x", "still"], ["kind"], real), metric=("mixed", 2)).first()
    assert d.distance == pytest.approx((1 + 1 + 0) / 3)
    drawn = multivariate.random_baseline(real, ["x"], ["kind"], 300)
    got = drawn.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.collect_set("kind").alias("kinds")).first()
    assert got.n == 300 and 0 <= got.low < 1 and 9 < got.high <= 10 and sorted(got.kinds) == ["a", "b", "c"]


def test_equal_rows_are_looked_for_once(spark, monkeypatch):
    """Rows that repeat others meet the searched side as one, and each gets its distance."""
    met = []
    join = multivariate.knn_join
    monkeypatch.setattr(multivariate, "knn_join", lambda a, b, *rest, **more: (met.append((a.count(), b.count())), join(a, b, *rest, **more))[1])
    a, b = [[i % 7 / 7, float("nan") if i % 2 else 0.5, i % 3] for i in range(420)], [[i % 5 / 5, 0.25, i % 3] for i in range(300)]
    got = multivariate.dcr(frame(spark, a), frame(spark, b), metric=("mixed", 2))
    want = [(i, 1, round(min(mixed(p, q) for q in b), 9)) for i, p in enumerate(a)]
    assert sorted((r.id, 1, round(r.distance, 9)) for r in got.collect()) == want
    assert met == [(42, 15)]


def test_boxes_and_ties_within_a_block(spark):
    """Blocks of many boxes, equal rows and rows of one id give the nearest by distance, then id."""
    r = np.random.default_rng(6)
    for x, y, metric, distance in ((r.random((300, 2)).round(1), r.random((400, 2)).round(1), "euclidean", euclidean), (clusters(300, 5, 3), clusters(400, 5, 3), "euclidean", euclidean)):
        best = nn.Best(np.arange(300), x, 3, metric, True)
        for at in (slice(0, 250), slice(250, 400)):
            best.meet(np.arange(400)[at], y[at])
        got = [[(round(d, 9), j) for d, j in zip(ds, js, strict=True)] for ds, js in zip(best.distance.tolist(), best.other.tolist(), strict=True)]
        assert got == [[(round(d, 9), j) for d, j in sorted((distance(p, q), j) for j, q in enumerate(y) if i != j)[:3]] for i, p in enumerate(x)]


def test_shapley_values_in_tasks_and_by_ranges(spark):
    """With equal rows, unknown labels and a vector that isn't finite, both ways give the same, and so do their statistics; in tasks no pair is shuffled."""
    r = np.random.default_rng(5)
    points = np.round(r.random((60, 2)) * 9)  # whole numbers: equal distances are equal in both
    points[7] = np.inf
    rows = [(i, [float(c) for c in p], None if i in (3, 50) else int(r.integers(0, 3))) for i, p in enumerate(points)]
    train, test = (spark.createDataFrame(x, "id long, v array<double>, label long") for x in (rows[:40], rows[40:]))
    for k in (5, 100):
        got, want = ({(x.test_id, x.id): x.value for x in valuation.knn_shapley(train, test, k, 9, held_pairs=held).collect()} for held in (90, 10))
        assert got.keys() == want.keys() and len(got) == 800
        assert all((v is None) == (want[at] is None) and (v is None or abs(v - want[at]) < 1e-12) for at, v in got.items())
        stats, one = (sorted((x.id, x.m, *(round(v, 9) for v in (x.value or 0, x.std, x.se or 0))) for x in df.collect()) for df in (valuation.knn_shapley_uncertainty(train, test, k, 9, held_pairs=90), valuation.valuation_uncertainty(valuation.knn_shapley(train, test, k, held_pairs=10))))
        assert stats == one
    plan = valuation.knn_shapley(train, test)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan


def test_rows_on_a_ball_s_edge_are_inside(spark):
    """A radius is a distance to some row, which lies on the edge, whatever the precision of a matrix product."""
    r = np.random.default_rng(8)
    a, b = r.normal(size=(300, 64)), r.normal(size=(300, 64))
    far = lambda p, q: math.sqrt(np.add.accumulate((p - q) ** 2)[-1])  # noqa: E731 - added one by one
    radius = [far(p, q) for p, q in zip(a, b, strict=True)]
    balls = frame(spark, b).join(spark.createDataFrame([*enumerate(radius)], "id long, radius double"), "id")
    got = {x.id: x.inside for x in nn.within_radius(frame(spark, a), balls).collect()}
    assert got == {i: n for i in range(300) if (n := sum(far(a[i], b[j]) <= radius[j] for j in range(300)))}


def test_blocks_are_shuffled_once(spark):
    """Where pivots rule nothing out, rows meet in packed blocks: no side is copied for the other's blocks."""
    r = np.random.default_rng(9)
    a, b = frame(spark, r.normal(size=(90, 20))), frame(spark, r.normal(size=(80, 20)), 1000)
    for df in (nn.knn_join(a, b, 2, block_rows=10, by_pivots=False), nn.within_radius(a, b.withColumn("radius", F.lit(1.0)), 10), nn.kernel_mean(a, b, 1.0, "x", 10)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "Generate explode" not in plan
