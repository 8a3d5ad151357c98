"""Invariants, hand-made tables and planted properties."""

import math

import pytest
from pyspark.sql import functions as F

from tabfidelity.functions.keys import row_key, uniform
from tabfidelity.operators import association, detect, encode, experiments, generate, membership, nn, prep, privacy, repair, splits, univariate
from tabfidelity.plans.roles import Roles
from tabfidelity.sources import tables

ROWS = [("a", 1.0, None), ("a", 1.0, None), ("b", -0.0, "x"), (None, 0.0, "x"), ("b", None, "|~")]
SCHEMA = "k string, v double, t string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_row_key_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("~", "x"), ("x|x", None), ("x", "x")], "a string, b string")
    assert df.select(row_key(df, ["a", "b"])).distinct().count() == 5


def test_row_key_of_negative_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert df.select(row_key(df, ["a"])).distinct().count() == 1


def test_uniform_holds_on_any_partitioning(spark):
    values = lambda n: spark.range(200).repartition(n).select("id", uniform("id", seed=3)).orderBy("id").collect()
    assert values(1) == values(7)
    assert all(0 <= r[1] < 1 for r in values(1))


def test_classes_partition_the_synthetic_table(spark, df):
    other = spark.createDataFrame([("a", 1.0, None), ("z", 9.0, "q")], SCHEMA)
    roles = Roles(df, other, df, df.unionAll(other))
    spec = membership.Spec(categorical=("k", "t"), numeric=("v",))
    row = membership.validation_summary(roles, spec).first().asDict()
    assert sum(row[f"{c}_total_count"] for c in membership.CLASSES) == row["synthetic_total_count"] == 7
    assert all(row[f"{c}_total_count"] >= row[f"{c}_unique_count"] for c in membership.CLASSES)


def test_empty_tables(spark, df):
    empty = df.limit(0)
    assert membership.ddr_summary(empty, df, df, ["k", "v"]).first()["total_synthetic_records"] == 0
    assert membership.duplicate_rows(empty).count() == 0
    assert univariate.ks_complement(df, empty, ["v"]).first()["score"] is None


def test_identical_tables_score_best(df):
    assert univariate.ks_complement(df, df, ["v"]).first()["score"] == 1.0
    assert univariate.tv_complement(df, df, ["k"]).first()["score"] == 1.0
    assert univariate.jsd_equal_width(df, df, ["v"]).first()["distance"] == 0.0
    assert univariate.wasserstein_1d(df, df, ["v"]).first()["distance"] == 0.0


def test_disjoint_tables_reach_the_bound(spark):
    a, b = (spark.createDataFrame([(x,)], "k string") for x in "ab")
    assert univariate.jsd_categorical(a, b, ["k"]).first()["distance"] == pytest.approx(math.sqrt(math.log(2)))


def test_constant_column_has_one_bin(spark):
    c = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    out = membership.bin_numeric(c, membership.numeric_ranges(c, ["v"]), ["v"]).collect()
    assert sorted((r.v for r in out), key=str) == [1, 1, None]


def test_perfect_association(spark):
    d = spark.createDataFrame([(x, x.upper(), float(ord(x))) for x in "aabbcc"], "a string, b string, n double")
    assert association.cramers_v_matrix(d, ["a", "b"]).first()["value"] == pytest.approx(1.0)
    assert association.correlation_ratio_matrix(d, ["a"], ["n"]).first()["value"] == pytest.approx(1.0)


def test_leakage(spark):
    ids = spark.range(10).withColumnRenamed("id", "k")
    out = {(r["first"], r["second"]): r["overlap"] for r in splits.leakage_report({"a": ids, "b": ids.where("k < 3"), "c": ids.where("k > 7")}, ["k"]).collect()}
    assert out == {("a", "b"): 3, ("a", "c"): 2, ("b", "c"): 0}


def test_subset_assertion(spark, df):
    splits.assert_subset(df, df)
    with pytest.raises(ValueError, match="1 reference"):
        splits.assert_subset(df.unionAll(spark.createDataFrame([("q", None, None)], SCHEMA)), df)


def test_too_few_entities(df):
    with pytest.raises(ValueError, match="3 distinct"):
        splits.sample_entities(df, "k", 3)


def test_encoders_turn_back(spark):
    d = spark.createDataFrame([(i, c, f) for i, (c, f) in enumerate([("x", True), ("y", False), ("x", None), ("z", True)])], "id long, c string, f boolean")
    e = encode.Encoder({"c": encode.ColumnPlan("onehot"), "f": encode.ColumnPlan("binary")}, key=["id"]).fit(d)
    assert sorted(e.reverse(e.transform(d)).select("id", "c", "f").collect()) == sorted(d.collect())


def test_unknown_encoder():
    with pytest.raises(ValueError, match="unknown kinds"):
        encode.Encoder({"c": encode.ColumnPlan("magic")}, key=[])


def test_renaming_clash(df):
    with pytest.raises(ValueError, match="several columns"):
        prep.rename_columns(df, {"k": "v"})


def test_typed_columns(spark):
    meta = tables.TableMeta({"n": tables.ColumnMeta("numerical", "UInt8"), "b": tables.ColumnMeta("boolean"), "d": tables.ColumnMeta("datetime", datetime_format="%d/%m/%Y"), "x": tables.ColumnMeta("numerical")})
    raw = spark.createDataFrame([("12", "TRUE", "31/12/2020", "nan"), ("300", "maybe", "bad", "1e3"), (None, "0", None, "x")], "n string, b string, d string, x string")
    rows = tables.apply_meta(raw, meta).collect()
    assert [r.n for r in rows] == [12, None, None]
    assert [r.b for r in rows] == [True, None, False]
    assert [r.d and r.d.year for r in rows] == [2020, None, None]
    assert [r.x for r in rows] == [None, 1000.0, None]


def test_auc(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)]
    assert detect.auroc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] == 0.75
    assert detect.auroc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first()["auc"] is None


def test_detection_of_planted_difference(spark):
    real = spark.range(300).select("id", uniform("id").alias("x"))
    far = spark.range(300).select("id", (uniform("id", seed=9) + 5).alias("x"))
    data = detect.labelled(real, far, ["x"], "id")
    assert detect.detect_linear(data, "id", folds=2).agg(F.min("auc")).first()[0] > 0.99


def test_knn_blocks_agree(spark):
    x = spark.range(50).select("id", F.array(uniform("id"), uniform("id", seed=1)).alias("v"))
    one, many = (sorted(nn.knn_join(x, x, 3, exclude_self=True, block_rows=n).select("id", "rank", "neighbour").collect()) for n in (100, 7))
    assert one == many


def test_t_quantile():
    assert experiments.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert experiments.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)


def test_bootstrap_holds_the_mean(spark):
    d = spark.range(40).select(F.lit("g").alias("g"), "id", F.col("id").cast("double").alias("x"))
    r = experiments.bootstrap_ci(d, ["g"], "x", ["id"], replicates=200).first()
    assert r.ci_lower < r["mean"] == 19.5 < r.ci_upper


def test_repairs_leave_valid_categories_only(spark):
    real = spark.createDataFrame([("a", "p"), ("b", "q")] * 5, "c string, d string")
    bad = spark.createDataFrame([(i, "z" if i % 2 else "a", "pq"[i % 2]) for i in range(10)], "id long, c string, d string")
    for method in ("random", "weighted", "knn"):
        fixed = repair.repair_categories(bad, real, ["c", "d"], ["id"], method)
        assert fixed.count() == 10
        assert repair.invalid_categories(fixed, real, ["c", "d"]).count() == 0


def test_sampler_keeps_the_marginals(spark):
    d = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "k string")
    got = {r.k: r["count"] for r in generate.marginal_sampler(d, 2000).groupBy("k").count().collect()}
    assert abs(got["a"] / 2000 - 0.75) < 0.05


def test_copula_keeps_the_correlation(spark):
    d = spark.range(400).select(uniform("id").alias("x")).withColumn("y", F.col("x") * 2)
    s = generate.gaussian_copula_sampler(d, 500, seed=2)
    assert s.count() == 500 and s.agg(F.corr("x", "y")).first()[0] > 0.9


def test_k_anonymity_of_a_constant(spark):
    assert privacy.k_anonymity(spark.range(7).select(F.lit(1).alias("q")), ["q"]).first()["k"] == 7


def test_readings_at_their_thresholds(spark):
    from tabfidelity.operators import downstream

    rows = [(0.70, 0.0, 0.80), (0.69, 0.0, 0.80), (0.29, 0.29, 0.1), (0.30, 0.29, 0.1), (0.70, 0.9, 0.59), (0.70, 0.9, 0.60), (None, 0.5, 0.5), (0.80, 0.8, 0.85), (0.39, 0.70, 0.49), (0.40, 0.70, 0.49)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, real_association double, synthetic_association double, quality double")
    got = d.select("i", association._reading(association.FLAGS, "-", "⚠").alias("f"), association._reading(association.DIAGNOSES, "Insufficient data", "Mixed quality").alias("d")).orderBy("i").collect()
    assert [r.f for r in got] == ["✓", "✓", "✓", "⚠", "✗", "⚠", "-", "✓", "⚠", "⚠"]
    assert [r.d for r in got][6:] == ["Insufficient data", "Strong correlation well preserved", "Synthetic created spurious correlation", "Mixed quality"]
    ratios = spark.createDataFrame([(x,) for x in (1.5, 1.51, 1.1, 0.9, 0.7, 0.71)], "r double").select(privacy.interpret_ratio(F.col("r"))).collect()
    assert [r[0].split(" privacy")[0] for r in ratios] == ["Better", "Much better", "Similar", "Worse", "Much worse", "Worse"]
    none = downstream.screening_report(spark.createDataFrame([(0.5, 3, 0, 2, 0)], "threshold double, tn long, fp long, fn long, tp long")).first()
    assert none.number_needed_to_screen == math.inf and none.false_alarm_rate == 0 and none.miss_rate == 100


def test_ranks_and_shapley_values(spark):
    from tabfidelity.functions.ranks import ranked_within
    from tabfidelity.operators import valuation

    d = spark.createDataFrame([(i, i % 2, float((i * 7) % 10)) for i in range(50)], "id long, g long, x double")
    got = {r.id: r.rank for r in ranked_within(d, ["g"], ["x", "id"], "rank").collect()}
    for g in (0, 1):
        order = sorted((float((i * 7) % 10), i) for i in range(50) if i % 2 == g)
        assert [got[i] for _, i in order] == list(range(1, 26))
    train = spark.createDataFrame([(i, [float(i)], i % 3) for i in range(12)], "id long, v array<double>, label long")
    test = spark.createDataFrame([(100, [2.2], 2), (101, [9.0], 0)], "id long, v array<double>, label long")
    found = {(r.test_id, r.id): r.value for r in valuation.knn_shapley(train, test, 3, block_rows=5).collect()}
    for t, v, y in ((100, 2.2, 2), (101, 9.0, 0)):
        order = sorted(range(12), key=lambda i: (abs(i - v), i))
        same, value = [float(i % 3 == y) for i in order], {}
        value[order[-1]] = same[-1] / 12
        for j in range(10, -1, -1):
            value[order[j]] = value[order[j + 1]] + (same[j] - same[j + 1]) / 3 * min(3, j + 1) / (j + 1)
        assert all(found[t, i] == pytest.approx(x) for i, x in value.items())


def test_vector_metrics_by_name_and_errors_as_rows(spark):
    from tabfidelity.plans.registry import Columns, evaluate

    rows = [(i, "ab"[i % 2], float(i % 7), float(i % 5)) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, c string, x double, y double")
    names = ["prdc", "alpha_precision", "dcr_median", "dcr_protection", "detection_linear", "structure", "absent"]
    got = evaluate(Roles(d, d, d.where("id % 2 = 0"), d.where("id % 2 = 1")), Columns(("c",), ("x", "y"), "id"), names).collect()
    assert {r.metric for r in got if r.status == "success"} == set(names[:-1]) and [r.metric for r in got if r.status == "error"] == ["absent"]
    keyless = evaluate(Roles(d, d, d, d), Columns(("c",), ("x", "y")), ["prdc"]).collect()
    assert [r.status for r in keyless] == ["error"]


def test_equal_contingency_scores_are_equal(spark):
    """Shares sum up to different doubles in different orders; names alone decide between pairs of equal quality."""
    sides = []
    for counts in ([3, 41, 7, 19, 2, 31, 11, 5, 23, 13, 29], [17, 1, 37, 8, 43, 6, 47, 9, 3, 14, 22]):
        rows = [(str(k), "abcdefghijk"[k * 7 % 11], f"v{k * k * 31 % 97}", f"{k * 1777 % 101}x", "one") for k, n in enumerate(counts) for _ in range(n)]
        sides.append(spark.createDataFrame(rows, "u string, v string, w string, x string, z string"))
    got = association.contingency_similarity(*sides, ["u", "v", "w", "x", "z"]).collect()
    assert len(got) == 10 and len({r.score for r in got}) == 1
    nothing = association.contingency_similarity(sides[0].limit(0), sides[1], ["u", "z"]).first()
    assert nothing.score == 0.5


def test_detectors_over_weighted_rows(spark, monkeypatch):
    """Equal rows of a fold are one row with a weight, and give what they would give one by one; the network finds what no line separates."""
    rows = [(i, float(i % 2), float(i // 2 % 2)) for i in range(400)]
    real, fake = (spark.createDataFrame([r for r in rows if (r[1] == r[2]) == same], "id long, x double, y double") for same in (True, False))
    data = detect.labelled(real, fake, ["x", "y"], "id")
    folded = detect._folded(data, "id", 2, 0)
    assert folded.count() <= 8 and folded.agg(F.sum("weight")).first()[0] == 400
    assert detect.detect_mlp(data, "id", folds=2, seed=1).agg(F.min("auc")).first()[0] > 0.99
    assert detect.detect_boosted(data, "id", folds=2, rounds=3).agg(F.min("auc")).first()[0] > 0.99
    uneven = detect.labelled(real.unionAll(fake.where("id % 4 = 1")), fake, ["x", "y"], "id")
    whole = uneven.withColumn("fold", F.col("id").cast("int") % 3).withColumn("weight", F.lit(1.0))
    grouped = whole.groupBy("fold", "label", "features").agg(F.sum("weight").alias("weight"))
    found = []
    for df in (whole, grouped):
        monkeypatch.setattr(detect, "_folded", lambda *_, df=df: df)
        found.append({r.fold: r.auc for r in detect.detect_linear(uneven, "id", folds=3).collect()} | {-r.fold - 1: r.auc for r in detect.detect_mlp(uneven, "id", folds=3).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 6 and all(abs(v - found[1][k]) < 1e-6 for k, v in found[0].items())
