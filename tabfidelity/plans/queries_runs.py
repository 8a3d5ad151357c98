"""Queries over downstream utility, valuation, category repair, experiments and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import detect, downstream, experiments, generate, multivariate, repair, univariate, valuation
from .base import query, table, union_sql
from .queries_metrics import AUC, CAT, NUM, SCORED, binned_sql, embedded, rounded, scored, sorted_pairs
from .queries_tables import RUNS, runs
from .registry import Columns, evaluate_runs
from .roles import CATEGORICAL, NUMERIC, lineitem_roles, with_roles

# Downstream


def order_features(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("target"), F.year("o_orderdate").cast("double").alias("year"), (F.col("o_custkey") % 7).cast("double").alias("group"))


@query()
def dwn1_train_on_synthetic(spark, sf):
    o = order_features(spark, sf)
    _, aucs = downstream.train_on_synthetic(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_totalprice", "year", "group"], "target", weighted=True, folds=2)
    return aucs


#: Scores between 0 and 1 from the length of a text.
UNIT = f"SELECT doc_id, label, score / 5000.0 AS score FROM ({SCORED})"
CM = "SELECT threshold, count(*) FILTER (label <> 1 AND score < threshold) AS tn, count(*) FILTER (label <> 1 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 1 AND score >= threshold) AS tp FROM ({}), (SELECT unnest([{}]) AS threshold) GROUP BY 1"
ZERO = "coalesce({} / nullif(cast({} AS DOUBLE), 0), 0)"
CM_ALL = f"SELECT *, {ZERO.format('(tp + tn)', '(tp + tn + fp + fn)')} AS accuracy, {ZERO.format('tp', '(tp + fp)')} AS precision, {ZERO.format('tp', '(tp + fn)')} AS recall, {ZERO.format('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM ({CM.format(UNIT, ', '.join(f'cast({t} AS DOUBLE)' for t in downstream.THRESHOLDS))})"


def unit(spark, sf):
    return scored(spark, sf).withColumn("score", F.col("score") / 5000.0)


@query(f"SELECT CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold, f1 AS value FROM ({CM_ALL}) ORDER BY f1 DESC, threshold LIMIT 1")
def dwn2_optimal_threshold(spark, sf):
    return downstream.optimal_threshold(unit(spark, sf))


@query(CM_ALL)
def dwn3_confusion(spark, sf):
    return downstream.confusion_at(unit(spark, sf))


def _share(x, y):
    return f"{x} / nullif(cast({y} AS DOUBLE), 0)"


def _percent(x, y):
    return f"coalesce(100 * {_share(x, y)}, 0)"


@query(f"SELECT threshold, {_percent('tp', '(tp + fn)')} AS catch_rate, {_percent('fn', '(tp + fn)')} AS miss_rate, {_percent('tp', '(tp + fp)')} AS hit_rate, {_percent('fp', '(tp + fp)')} AS false_alarm_rate, coalesce({_share('(tp + fp)', 'tp')}, cast('inf' AS DOUBLE)) AS number_needed_to_screen, {_percent('tn', '(tn + fp)')} AS specificity, {_percent('tn', '(tn + fn)')} AS npv, {_percent('tp', '(tp + fp)')} AS ppv FROM ({CM_ALL})")
def dwn4_screening_report(spark, sf):
    return downstream.screening_report(downstream.confusion_at(unit(spark, sf)))


_HALVES = f"SELECT lang, doc_id % 2 AS half, score, label FROM ({SCORED})"
_HALF_AUC = "SELECT lang, half, (rp - p * (p + 1) / 2.0) / nullif(cast(p AS DOUBLE) * n, 0) AS auc FROM (" + AUC.format(by="lang, half,", part="lang, half", src=_HALVES, group="GROUP BY lang, half") + ")"
_GAP = "max(auc) FILTER (half = 0) - max(auc) FILTER (half = 1)"


@query(f"SELECT lang, round(gap, 6) + 0.0 AS gap, CASE WHEN gap < 0.05 THEN 'excellent' WHEN gap < 0.15 THEN 'good' WHEN gap < 0.25 THEN 'moderate' ELSE 'poor' END AS band FROM (SELECT lang, {_GAP} AS gap FROM ({_HALF_AUC}) GROUP BY 1)")
def dwn5_transfer_gap(spark, sf):
    """A score's AUC on one half of the documents against that on the other, by language."""
    aucs = detect.auroc(scored(spark, sf).withColumn("half", F.col("doc_id") % 2), "score", "label", by=["lang", "half"])
    both = aucs.groupBy("lang").agg(*[F.max(F.when(F.col("half") == h, F.col("auc"))).alias(f"auc_{h}") for h in (0, 1)])
    gap, band = downstream.transfer_gap(F.col("auc_0"), F.col("auc_1"))
    return rounded(both.select("lang", gap.alias("gap"), band.alias("band")), "gap")


# Valuation

LABELLED = "SELECT vec_id AS id, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS v, label FROM embeddings WHERE vec_id % 2 = {}"
#: The recursion from the farthest training row inwards.
SHAPLEY = f"""WITH RECURSIVE d AS (SELECT t.id AS test_id, a.id, a.label = t.label AS same, list_sum(list_transform(list_zip(a.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM ({LABELLED.format(0)}) a, ({LABELLED.format(1)}) t),
k AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, id) AS i, count(*) OVER (PARTITION BY test_id) AS n FROM d),
s AS (SELECT test_id, id, i, same, cast(same AS INTEGER) / cast(n AS DOUBLE) AS value FROM k WHERE i = n
UNION ALL SELECT k.test_id, k.id, k.i, k.same, s.value + (cast(k.same AS INTEGER) - cast(s.same AS INTEGER)) / 5.0 * least(5, k.i) / k.i FROM s JOIN k ON k.test_id = s.test_id AND k.i = s.i - 1)
SELECT test_id, id, value FROM s"""


def shapley(spark, sf):
    train, test = embedded(spark, sf)
    return valuation.knn_shapley(train, test)


@query(f"SELECT test_id, id, round(value, 6) + 0.0 AS value FROM ({SHAPLEY})")
def val1_knn_shapley(spark, sf):
    return rounded(shapley(spark, sf), "value")


#: The nearest 50 rows alone; the 50th counts as 0.
SHAPLEY_NEAR = f"""WITH d AS (SELECT t.id AS test_id, a.id, cast(a.label = t.label AS INTEGER) AS same, list_sum(list_transform(list_zip(a.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM ({LABELLED.format(0)}) a, ({LABELLED.format(1)}) t),
k AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, id) AS i FROM d QUALIFY i <= 50),
s AS (SELECT *, coalesce((same - lead(same) OVER (PARTITION BY test_id ORDER BY i)) / 5.0 * least(5, i) / i, 0) AS step FROM k)
SELECT test_id, id, sum(step) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM s"""


@query(f"SELECT test_id, id, round(value, 6) + 0.0 AS value FROM ({SHAPLEY_NEAR})")
def val1_knn_shapley_near(spark, sf):
    """Values within 0.02 from each row's 50 nearest."""
    train, test = embedded(spark, sf)
    return rounded(valuation.knn_shapley_near(train, test, epsilon=0.02), "value")


@query("SELECT label, round(avg(x), 6) AS value, count(x) AS m, round(coalesce(stddev_samp(x), 0), 6) AS std, round(coalesce(stddev_samp(x), 0) / sqrt(count(x)), 6) AS se, round(avg(x) - 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 6) AS ci_lower, round(avg(x) + 1.96 * coalesce(stddev_samp(x), 0) / sqrt(count(x)), 6) AS ci_upper FROM (SELECT label, cast(embedding[1] AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def val2_uncertainty(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return rounded(valuation.valuation_uncertainty(e, "label", "x"), "value", "std", "se", "ci_lower", "ci_upper")


def wilson_sql(k: str, n: str, z: float = 1.959963984540054) -> tuple[str, str]:
    p = f"({k} / cast({n} AS DOUBLE))"
    mid, spread = f"(({p} + {z * z} / (2 * {n})) / (1 + {z * z} / {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n}))"
    return tuple(f"greatest(least(100 * ({mid} {sign} {spread}), 100), 0)" for sign in "-+")


_K, _N = "count(*) FILTER (c_acctbal < 0)", "count(*)"
_LOW, _HIGH = wilson_sql("k", "n")


@query(f"SELECT c_mktsegment, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM (SELECT c_mktsegment, {_K} AS k, {_N} AS n FROM customer GROUP BY 1)")
def val3_wilson_interval(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("k"), F.count("*").alias("n"))
    low, high = valuation.wilson_interval(F.col("k"), F.col("n"))
    return rounded(c.select("c_mktsegment", low.alias("low"), high.alias("high")), "low", "high")


VALUES = f"SELECT id, avg(value) AS value, coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS se, avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS ci_upper FROM ({SHAPLEY}) GROUP BY 1"
_NL, _NH = wilson_sql("negative", "n")
_RL, _RH = wilson_sql("reliably_negative", "n")


@query(f"SELECT n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('mean', 'std', 'min', 'max', 'mean_se', 'max_se'))}, negative, reliably_negative, round(100.0 * negative / n, 6) AS negative_pct, round({_NL}, 6) AS negative_low, round({_NH}, 6) AS negative_high, round(100.0 * reliably_negative / n, 6) AS reliably_negative_pct, round({_RL}, 6) + 0.0 AS reliably_negative_low, round({_RH}, 6) AS reliably_negative_high FROM (SELECT count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, avg(se) AS mean_se, max(se) AS max_se, count(*) FILTER (round(value, 9) < 0) AS negative, count(*) FILTER (round(ci_upper, 9) < 0) AS reliably_negative FROM ({VALUES}))")
def val4_valuation_summary(spark, sf):
    v = valuation.knn_shapley_uncertainty(*embedded(spark, sf)).withColumns({"value": F.round("value", 9), "ci_upper": F.round("ci_upper", 9)})
    return rounded(valuation.valuation_summary(v), "mean", "std", "min", "max", "mean_se", "max_se", "negative_pct", "negative_low", "negative_high", "reliably_negative_pct", "reliably_negative_low", "reliably_negative_high")


@query(f"SELECT id, label, value, cast(row_number() OVER (ORDER BY value, id) AS INTEGER) AS rank FROM (SELECT e.vec_id AS id, label, round(avg(s.value), 6) + 0.0 AS value FROM ({SHAPLEY}) s JOIN embeddings e ON e.vec_id = s.id GROUP BY 1, 2)")
def val5_rank_by_value(spark, sf):
    v = rounded(valuation.knn_shapley_uncertainty(*embedded(spark, sf)), "value")
    return valuation.rank_by_value(v, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"))


# Repair

ROW = ["l_orderkey", "l_linenumber"]


@query(with_roles(union_sql([f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS \"rows\", cast(count(*) AS DOUBLE) / (SELECT count(*) FROM synthetic) AS rate FROM synthetic WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM reference) GROUP BY {c}" for c in CATEGORICAL])))
def rep1_invalid_categories(spark, sf):
    r = lineitem_roles(spark, sf)
    return repair.invalid_categories(r.synthetic, r.reference, CATEGORICAL)


HASHED = "cast(('0x' || substr(md5(concat_ws('|', cast(l_orderkey AS VARCHAR), cast(l_linenumber AS VARCHAR), '{c}', '{seed}')), 1, 8)) AS BIGINT) / 4294967296.0"


@query(with_roles(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN (SELECT l_returnflag FROM reference) THEN l_returnflag ELSE (SELECT list_sort(list(DISTINCT l_returnflag)) FROM reference)[cast(floor({HASHED.format(c='l_returnflag', seed=3)} * (SELECT count(DISTINCT l_returnflag) FROM reference)) AS INTEGER) + 1] END AS l_returnflag FROM synthetic"))
def rep2_repair_random(spark, sf):
    r = lineitem_roles(spark, sf)
    return repair.repair_random(r.synthetic, r.reference, "l_returnflag", ROW, seed=3).select(*ROW, "l_returnflag")


CUTS = "SELECT l_returnflag AS c, (sum(n) OVER w - n) / cast(sum(n) OVER () AS DOUBLE) AS lo, sum(n) OVER w / cast(sum(n) OVER () AS DOUBLE) AS hi FROM (SELECT l_returnflag, count(*) AS n FROM reference GROUP BY 1) WINDOW w AS (ORDER BY n DESC, l_returnflag)"


@query(with_roles(f"WITH cuts AS ({CUTS}), u AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_returnflag IN (SELECT l_returnflag FROM reference) AS ok, {HASHED.format(c='l_returnflag', seed=3)} AS u FROM synthetic) SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN l_returnflag ELSE c END AS l_returnflag FROM u LEFT JOIN cuts ON NOT ok AND u >= lo AND u < hi"))
def rep3_repair_weighted(spark, sf):
    r = lineitem_roles(spark, sf)
    return repair.repair_weighted(r.synthetic, r.reference, "l_returnflag", ROW, seed=3).select(*ROW, "l_returnflag")


@query()
def rep4_repair_knn(spark, sf):
    r = lineitem_roles(spark, sf)
    return repair.repair_knn(r.synthetic, r.reference, "l_returnflag", ["l_linestatus"], ROW).select(*ROW, "l_returnflag")


@query()
def rep5_repair_categories(spark, sf):
    r = lineitem_roles(spark, sf)
    fixed = repair.repair_categories(r.synthetic, r.reference, CATEGORICAL, ROW)
    before, after = (repair.repair_report(x, r.reference, CATEGORICAL) for x in (r.synthetic, fixed))
    return before.join(after.withColumnsRenamed({c: f"{c}_after" for c in after.columns[1:]}), "column", "left")


#: A column of which no value is real, so that its fallback is used.
_HOPELESS = "SELECT * REPLACE (concat('no ', l_linestatus) AS l_linestatus) FROM synthetic"
_LINE_CUTS = CUTS.replace("l_returnflag", "l_linestatus")


@query(with_roles(f"WITH h AS ({_HOPELESS}), cuts AS ({_LINE_CUTS}), u AS (SELECT l_orderkey, l_linenumber, {HASHED.format(c='l_linestatus', seed=0)} AS u FROM h) SELECT l_orderkey, l_linenumber, c AS l_linestatus FROM u JOIN cuts ON u >= lo AND u < hi"))
def rep5_fallback(spark, sf):
    r = lineitem_roles(spark, sf)
    hopeless = r.synthetic.withColumn("l_linestatus", F.concat(F.lit("no "), F.col("l_linestatus")))
    return repair.repair_categories(hopeless, r.reference, ["l_linestatus"], ROW, method="knn", fallback="weighted").select(*ROW, "l_linestatus")


@query(with_roles(f"SELECT \"column\", fixed FROM (SELECT 'l_returnflag' AS \"column\", count(*) FILTER (l_returnflag NOT IN (SELECT l_returnflag FROM reference)) AS fixed FROM synthetic UNION ALL SELECT 'l_linestatus', count(*) FILTER (l_linestatus NOT IN (SELECT l_linestatus FROM reference)) FROM synthetic) WHERE fixed > 0"))
def rep5_fixed_counts(spark, sf):
    r = lineitem_roles(spark, sf)
    return repair.fixed_counts(r.synthetic, repair.repair_categories(r.synthetic, r.reference, CATEGORICAL, ROW), r.reference, CATEGORICAL)


# Experiments

MODEL = "SELECT *, concat('lib_two_part_', substr(md5(cast(dseed AS VARCHAR)), 1, 8), '_', substr(md5('r'), 1, 8), '_', substr(md5(cast(generation AS VARCHAR)), 1, 8), '_gen_', cast(generation AS VARCHAR), '_base_name_', substr(md5('c'), 1, 8), '_', cast(mseed AS VARCHAR)) AS model_id FROM ({})"


def models(spark, sf):
    h = lambda c: F.substring(F.md5(c), 1, 8)
    text = F.concat(F.lit("lib_two_part_"), h(F.col("dseed").cast("string")), F.lit("_"), h(F.lit("r")), F.lit("_"), h(F.col("generation").cast("string")), F.lit("_gen_"), F.col("generation").cast("string"), F.lit("_base_name_"), h(F.lit("c")), F.lit("_"), F.col("mseed").cast("string"))
    return runs(spark, sf).withColumn("model_id", text)


@query(f"SELECT DISTINCT model_id, 'lib' AS library, 'two_part' AS model, substr(md5(cast(dseed AS VARCHAR)), 1, 8) AS ref_hash, substr(md5('r'), 1, 8) AS root_hash, substr(md5(cast(generation AS VARCHAR)), 1, 8) AS training_hash, generation, 'base_name' AS name, substr(md5('c'), 1, 8) AS config_hash, cast(mseed AS INTEGER) AS seed FROM ({MODEL.format(RUNS)})")
def exp1_parse_model_id(spark, sf):
    return experiments.parse_model_id(models(spark, sf).select("model_id").distinct(), "model_id")


#: One metric of each run, with a generation taken out of some runs.
ONE = f"SELECT dseed, mseed, generation, value FROM ({RUNS}) WHERE metric = 'click' AND NOT (generation = dseed + 3 AND mseed = 1)"


def one(spark, sf):
    return runs(spark, sf).where("metric = 'click' AND NOT (generation = dseed + 3 AND mseed = 1)").select("dseed", "mseed", "generation", "value")


@query(f"SELECT dseed, mseed, generation, value FROM (SELECT *, row_number() OVER (PARTITION BY dseed, mseed ORDER BY generation) - 1 AS place FROM ({ONE})) WHERE place = generation")
def exp2_chain(spark, sf):
    return experiments.chain(one(spark, sf), ["dseed", "mseed"])


@query(f"SELECT dseed, mseed, generation, round(value, 6) AS value, round(sum(value) OVER (PARTITION BY dseed, mseed ORDER BY generation), 6) AS value_cumulative FROM ({ONE})")
def exp3_cumulative_time(spark, sf):
    return rounded(experiments.cumulative_time(one(spark, sf), ["dseed", "mseed"], "value"), "value", "value_cumulative")


WIDE = f"SELECT dseed, mseed, generation, max(value) FILTER (metric = 'click') AS click, max(value) FILTER (metric = 'view' AND dseed <> 2) AS view, max(value) FILTER (metric = 'purchase') AS purchase FROM ({RUNS}) GROUP BY 1, 2, 3"


@query(f"SELECT dseed, mseed, generation, round((coalesce(click, 0) + coalesce(view, 0)) / nullif((click IS NOT NULL)::INTEGER + (view IS NOT NULL)::INTEGER, 0), 6) AS average, round(purchase / 100.0, 6) AS purchase_rate FROM ({WIDE})")
def exp4_derived_metrics(spark, sf):
    wide = runs(spark, sf).groupBy("dseed", "mseed", "generation").agg(*[F.max(F.when(c, F.col("value"))).alias(n) for n, c in (("click", F.col("metric") == "click"), ("view", (F.col("metric") == "view") & (F.col("dseed") != 2)), ("purchase", F.col("metric") == "purchase"))])
    out = experiments.derived_metrics(wide, {"average": ["click", "view"]}, {"purchase_rate": "purchase"})
    return rounded(out.select("dseed", "mseed", "generation", "average", "purchase_rate"), "average", "purchase_rate")


@query()
def exp5_bootstrap_ci(spark, sf):
    return experiments.bootstrap_ci(runs(spark, sf), ["generation", "metric"], "value", ["dseed", "mseed"], replicates=10_000)


AVERAGED = f"SELECT generation, dseed, metric, avg(value) AS value, count(DISTINCT mseed) AS n_mseeds FROM ({RUNS}) GROUP BY 1, 2, 3"


@query(f"SELECT generation, dseed, metric, round(value, 6) AS value, n_mseeds FROM ({AVERAGED})")
def exp6_dseed_average(spark, sf):
    return rounded(experiments.dseed_average(runs(spark, sf)), "value")


#: The quantile by degrees of freedom, for up to six data seeds.
T_SQL = "CASE greatest(count(*) - 1, 1) " + " ".join(f"WHEN {d} THEN cast({experiments.t_quantile(0.975, d)} AS DOUBLE)" for d in range(1, 6)) + " END"
CI = f"SELECT *, std / sqrt(n) AS se, CASE WHEN n > 1 THEN t_crit ELSE 0 END AS half FROM (SELECT generation, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n, cast(sum(n_mseeds) AS BIGINT) AS total_obs, cast(count(*) - 1 AS INTEGER) AS df, {T_SQL} AS t_crit FROM ({AVERAGED}) GROUP BY 1, 2)"
_R = lambda *cs: ", ".join(f"round({x}, 6) AS {n}" for x, n in cs)


@query(f"SELECT generation, metric, n, total_obs, df, {_R(('mean', 'mean'), ('std', 'std'), ('t_crit', 't_crit'), ('se', 'se'), ('mean - half * se', 'ci_lower'), ('mean + half * se', 'ci_upper'))} FROM ({CI})")
def exp7_stratified_ci(spark, sf):
    ci = experiments.stratified_ci(experiments.dseed_average(runs(spark, sf)))
    return rounded(ci, "mean", "std", "t_crit", "se", "ci_lower", "ci_upper")


@query(f"SELECT generation, metric, {_R(('mean - half * std * sqrt(1 + 1.0 / n)', 'pi_lower'), ('mean + half * std * sqrt(1 + 1.0 / n)', 'pi_upper'))} FROM ({CI})")
def exp8_prediction_interval(spark, sf):
    ci = experiments.stratified_ci(experiments.dseed_average(runs(spark, sf)))
    return rounded(experiments.prediction_interval(ci).select("generation", "metric", "pi_lower", "pi_upper"), "pi_lower", "pi_upper")


UNEVEN = RUNS.replace("user_id % 6", "event_id % 6")


@query(f"WITH e AS ({UNEVEN}), s AS (SELECT dseed, count(DISTINCT mseed) AS found FROM e GROUP BY 1), r AS (SELECT dseed, mseed, count(DISTINCT generation) AS found FROM e GROUP BY 1, 2) SELECT dseed, cast(NULL AS BIGINT) AS mseed, 'model seeds' AS problem, found, (SELECT max(found) FROM s) AS expected FROM s WHERE found <> (SELECT max(found) FROM s) UNION ALL SELECT dseed, mseed, 'generations', found, (SELECT count(DISTINCT generation) FROM e) FROM r WHERE found <> (SELECT count(DISTINCT generation) FROM e)")
def exp9_check_design(spark, sf):
    return experiments.check_design(runs(spark, sf, UNEVEN))


@query("SELECT r_regionkey AS region, epochs, concat('region', r_regionkey, '_epochs', epochs) AS name FROM region, (SELECT unnest([100, 300]) AS epochs)")
def exp10_experiment_grid(spark, sf):
    regions = [r[0] for r in table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    return experiments.experiment_grid(spark, {"region": regions, "epochs": [100, 300]})


@query(f"SELECT dseed, mseed, generation, metric, round(value - first(value) OVER w, 6) + 0.0 AS since_first, round(value - lag(value) OVER w, 6) + 0.0 AS since_previous FROM ({RUNS}) WINDOW w AS (PARTITION BY dseed, mseed, metric ORDER BY generation)")
def exp11_generation_drift(spark, sf):
    return rounded(experiments.generation_drift(runs(spark, sf), ["dseed", "mseed", "metric"]).drop("value"), "since_first", "since_previous")


@query(f"SELECT dseed, mseed, max(generation) AS generation, max_by(model_id, generation) AS model_id FROM ({MODEL.format(RUNS)}) WHERE metric = 'click' GROUP BY 1, 2")
def exp12_latest_checkpoint(spark, sf):
    return experiments.latest_checkpoint(models(spark, sf).where("metric = 'click'"), ["dseed", "mseed"])


#: Runs of the synthetic table: one for each line number, all against the same reference.
BY_RUN = ("ks_complement", "tv_complement", "boundary_adherence", "category_adherence", "wasserstein_1d", "mmd_linear", "k_anonymity")
_NUMBERS = union_sql([f"SELECT {{run}} AS run, '{c}' AS \"column\", cast({c} AS DOUBLE) AS value FROM {{role}} WHERE {c} IS NOT NULL" for c in NUMERIC])
_TEXTS = union_sql([f"SELECT {{run}} AS run, '{c}' AS \"column\", {c} AS value FROM {{role}}" for c in CATEGORICAL])
_ALL = "reference, (SELECT DISTINCT l_linenumber AS run FROM synthetic)"
_BOTH = "SELECT run, \"column\", value, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 's') AS s FROM (SELECT *, 'r' AS side FROM ({r}) UNION ALL SELECT *, 's' FROM ({s})) GROUP BY 1, 2, 3"
_NUM2, _CAT2 = (_BOTH.format(r=x.format(run="run", role=_ALL), s=x.format(run="l_linenumber", role="synthetic")) for x in (_NUMBERS, _TEXTS))
_BY = "PARTITION BY run, \"column\""
_FIRST = union_sql([f"SELECT run, '{c}' AS \"column\", {c} AS r FROM (SELECT run, {', '.join(f'avg({x}) AS {x}' for x in NUMERIC)} FROM {_ALL} GROUP BY 1)" for c in NUMERIC])
_SECOND = union_sql([f"SELECT run, '{c}' AS \"column\", {c} AS s FROM (SELECT l_linenumber AS run, {', '.join(f'avg({x}) AS {x}' for x in NUMERIC)} FROM synthetic GROUP BY 1)" for c in NUMERIC])
EXP13_SQL = f"""WITH num AS ({_NUM2}), cat AS ({_CAT2}),
e AS (SELECT *, sum(r) OVER w / sum(r) OVER ({_BY}) AS fr, sum(s) OVER w / sum(s) OVER ({_BY}) AS fs, lead(value) OVER w AS following FROM num WINDOW w AS ({_BY} ORDER BY value)),
p AS (SELECT *, r / sum(r) OVER ({_BY}) AS p, s / sum(s) OVER ({_BY}) AS q FROM cat), ends AS (SELECT run, "column", min(value) AS low, max(value) AS high FROM num WHERE r > 0 GROUP BY 1, 2)
SELECT run AS l_linenumber, metric, "column", round(value, 6) + 0.0 AS value FROM (
SELECT run, 'ks_complement' AS metric, "column", 1 - max(abs(fr - fs)) AS value FROM e GROUP BY run, "column"
UNION ALL SELECT run, 'wasserstein_1d', "column", sum(abs(fr - fs) * (following - value)) / (max(value) FILTER (r > 0) - min(value) FILTER (r > 0)) FROM e GROUP BY run, "column"
UNION ALL SELECT run, 'tv_complement', "column", 1 - sum(abs(p - q)) / 2 FROM p GROUP BY run, "column"
UNION ALL SELECT run, 'category_adherence', "column", sum(CASE WHEN r > 0 THEN s ELSE 0 END) / sum(s) FROM cat GROUP BY run, "column"
UNION ALL SELECT run, 'boundary_adherence', "column", sum(CASE WHEN value BETWEEN low AND high THEN s ELSE 0 END) / sum(s) FROM num JOIN ends USING (run, "column") GROUP BY run, "column"
UNION ALL SELECT run, 'mmd_linear', NULL, sum(pow(r - s, 2)) FROM ({_FIRST}) JOIN ({_SECOND}) USING (run, "column") GROUP BY run
UNION ALL SELECT run, 'k_anonymity', NULL, min(n) FROM (SELECT l_linenumber AS run, count(*) AS n FROM synthetic GROUP BY l_linenumber, {', '.join(CATEGORICAL)}) GROUP BY run)"""


@query(with_roles(EXP13_SQL))
def exp13_evaluate_runs(spark, sf):
    r = lineitem_roles(spark, sf)
    return rounded(evaluate_runs(r.reference.drop("l_linenumber"), r.synthetic, Columns(CATEGORICAL, NUMERIC), ["l_linenumber"], BY_RUN), "value")


#: Metrics of pairs and of rows, by run; the real rows serve all runs.
PAIRS_BY_RUN = ("correlation_similarity", "contingency_similarity", "mmd_polynomial", "mmd_rbf", "sliced_wasserstein", "new_row_synthesis", "structure", "jsd_equal_width", "jsd_categorical")
_SYN = "SELECT l_linenumber AS run, * FROM synthetic"
_RUNS = "SELECT DISTINCT l_linenumber AS run FROM synthetic"


def _number(x: float) -> str:
    return f"cast('{x!r}' AS DOUBLE)"


def _corr_by(x: str, y: str) -> str:
    return f"SELECT run, 'correlation_similarity' AS metric, '{x} / {y}' AS \"column\", 1 - abs((SELECT corr({x}, {y}) FROM reference) - corr({x}, {y})) / 2 AS value FROM ({_SYN}) GROUP BY run"


def _joint_by(x: str, y: str) -> str:
    ex, ey = (binned_sql(c) if c in NUM else c for c in (x, y))
    there = f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY"
    p = f"SELECT run, a, b, p FROM ({_RUNS}), (SELECT {ex} AS a, {ey} AS b, count(*) / sum(count(*)) OVER () AS p FROM reference {there} 1, 2)"
    q = f"SELECT run, {ex} AS a, {ey} AS b, count(*) / sum(count(*)) OVER (PARTITION BY run) AS q FROM ({_SYN}) {there} 1, 2, 3"
    return f"SELECT run, 'contingency_similarity', '{x} / {y}', 1 - sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 FROM ({p}) FULL JOIN ({q}) USING (run, a, b) GROUP BY run"


_PRODUCTS = [*[(f"avg({c})", 2.0) for c in NUM], *[(f"avg({x} * {y})", 1.0 if x == y else 2.0) for i, x in enumerate(NUM) for y in NUM[i:]]]
_POLY_BY = f"SELECT run, 'mmd_polynomial', NULL, {' + '.join(f'{w} * pow({e} - (SELECT {e} FROM reference), 2)' for e, w in _PRODUCTS)} FROM ({_SYN}) GROUP BY run"
_UNIT = ", ".join(f"({c} - (SELECT min({c}) FROM reference)) / (SELECT max({c}) - min({c}) FROM reference) AS {c}" for c in NUM)
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in NUM)
_ADDED = lambda ws, first=0.0: " + ".join([_number(first), *[f"{_number(float(w))} * {c}" for w, c in zip(ws, NUM, strict=True)]])
_WEIGHTS, _SHIFTS = multivariate.fourier(len(NUM), 1.0, 64, 0)
_COSINES = ", ".join(f"avg(cos({_ADDED(w, float(b))})) AS f{i}" for i, (w, b) in enumerate(zip(_WEIGHTS, _SHIFTS, strict=True)))
_RBF_BY = f"SELECT s.run, 'mmd_rbf', NULL, ({' + '.join(f'pow(r.f{i} - s.f{i}, 2)' for i in range(64))}) * 2 / 64 FROM (SELECT {_COSINES} FROM ru) r, (SELECT run, {_COSINES} FROM su GROUP BY run) s"
_ALONG = lambda src: union_sql([f"SELECT run, 'p{i}' AS \"column\", {_ADDED(w)} AS value FROM {src}" for i, w in enumerate(multivariate.directions(len(NUM), 16, 0))])
_MATCHED = " AND ".join([*[f"r.{c} = s.{c}" for c in CAT], *[f"abs(r.{c} - s.{c}) <= 0.01 * abs(s.{c})" for c in NUM]])
_HALF = lambda x: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / ((p + q) / 2)) ELSE 0 END"
_JSD = f"sqrt(greatest(sum({_HALF('p')} + {_HALF('q')}) / 2, 0))"
_SHARED = f"r / sum(r) OVER ({_BY}) AS p, s / sum(s) OVER ({_BY}) AS q"
PAIRS_BY_RUN_SQL = f"""WITH num AS ({_NUM2}), cat AS ({_CAT2}), ru AS (SELECT {_UNIT} FROM reference WHERE {_WHOLE}), su AS (SELECT run, {_UNIT} FROM ({_SYN}) WHERE {_WHOLE}),
along AS ({_BOTH.format(r=_ALONG(f'ru, ({_RUNS})'), s=_ALONG('su'))}),
e AS (SELECT *, sum(r) OVER w / sum(r) OVER ({_BY}) AS fr, sum(s) OVER w / sum(s) OVER ({_BY}) AS fs, lead(value) OVER w AS following FROM along WINDOW w AS ({_BY} ORDER BY value)),
bins AS (SELECT run, "column", least(floor((value - low) / (high - low) * 10), 9) AS bin, sum(r) AS r, sum(s) AS s FROM (SELECT *, min(value) OVER ({_BY}) AS low, max(value) OVER ({_BY}) AS high FROM num) GROUP BY 1, 2, 3)
SELECT run, metric, "column", round(value, 6) + 0.0 AS value FROM ({union_sql([
    *[_corr_by(x, y) for x, y in sorted_pairs(NUM)], *[_joint_by(*sorted(p)) for p in [CAT, *[(c, x) for c in CAT for x in NUM]]], _POLY_BY, _RBF_BY,
    'SELECT run, ' + "'sliced_wasserstein', NULL, avg(d) FROM (SELECT run, sum(abs(fr - fs) * (following - value)) / (max(value) FILTER (r > 0) - min(value) FILTER (r > 0)) AS d FROM e GROUP BY run, " + '"column") GROUP BY run',
    f"SELECT run, 'new_row_synthesis', NULL, avg(CASE WHEN EXISTS (SELECT 1 FROM reference r WHERE {_MATCHED}) THEN 0 ELSE 1 END) FROM ({_SYN}) s GROUP BY run",
    f"SELECT run, 'structure', NULL, 1.0 FROM ({_RUNS})",
    f'SELECT run, ' + f"'jsd_equal_width', " + f'"column", {_JSD} FROM (SELECT *, {_SHARED} FROM bins) GROUP BY run, "column"',
    f'SELECT run, ' + f"'jsd_categorical', " + f'"column", {_JSD} FROM (SELECT *, {_SHARED} FROM cat WHERE value IS NOT NULL) GROUP BY run, "column"',
])})"""


@query(with_roles(PAIRS_BY_RUN_SQL))
def exp13_pairs_and_rows_by_run(spark, sf):
    r = lineitem_roles(spark, sf)
    return rounded(evaluate_runs(r.reference, r.synthetic.withColumn("run", F.col("l_linenumber")), Columns(CATEGORICAL, NUMERIC), ["run"], PAIRS_BY_RUN), "value")


# Generators


def drawn_sql(source: str, c: str, seed: int) -> str:
    """A column drawn from its own values: each value's interval is its share, in value order."""
    u = f"SELECT cast(('0x' || substr(md5(concat_ws('|', cast(row_number() OVER () - 1 AS VARCHAR), '{c}', '{seed}')), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM part"
    cut = f"SELECT {c}, (upto - n) / total AS lo, upto / total AS hi FROM (SELECT {c}, count(*) AS n, sum(count(*)) OVER (ORDER BY {c} NULLS FIRST) AS upto, sum(count(*)) OVER () AS total FROM ({source}) GROUP BY {c})"
    return f"SELECT {c} FROM ({u}) JOIN ({cut}) ON u >= lo AND u < hi"


def kept_sql(c: str, source: str) -> str:
    """(column, score): how well the column's shares are kept."""
    side = lambda t, p: f"SELECT {c}, count(*) / sum(count(*)) OVER () AS {p} FROM ({t}) GROUP BY {c}"
    return f"SELECT '{c}' AS \"column\", round(1 - sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) + 0.0 AS score FROM ({side(f'SELECT {c} FROM part', 'p')}) FULL JOIN ({side(source, 'q')}) USING ({c})"


def generations_sql(columns: tuple[str, ...], generations: int) -> str:
    parts = []
    for c in columns:
        source = f"SELECT {c} FROM part"
        for g in range(generations):
            source = drawn_sql(source, c, g)
            parts.append(f"SELECT *, {g} AS generation FROM ({kept_sql(c, source)})")
    return union_sql(parts)


MARGINALS = ("p_brand", "p_type", "p_size")


@query(union_sql([kept_sql(c, drawn_sql(f"SELECT {c} FROM part", c, 1)) for c in MARGINALS]))
def gen1_marginal_sampler(spark, sf):
    p = table(spark, sf, "part").select(*MARGINALS)
    return rounded(univariate.tv_complement(p, generate.marginal_sampler(p, seed=1), [*MARGINALS]), "score")


_PRICE = "SELECT l_extendedprice FROM lineitem"


@query(f"SELECT l_extendedprice AS value, round((upto - n) / total, 9) + 0.0 AS lo, round(upto / total, 9) + 0.0 AS hi FROM (SELECT l_extendedprice, count(*) AS n, sum(count(*)) OVER (ORDER BY l_extendedprice NULLS FIRST) AS upto, sum(count(*)) OVER () AS total FROM ({_PRICE}) GROUP BY 1)")
def gen1_value_intervals(spark, sf):
    """Each price's interval of [0, 1): nearly as many values as rows."""
    return rounded(generate.value_intervals(table(spark, sf, "lineitem"), "l_extendedprice"), "lo", "hi", digits=9)


@query()
def gen2_gaussian_copula(spark, sf):
    r = lineitem_roles(spark, sf).reference.select(*NUMERIC, "l_returnflag")
    return univariate.ks_complement(r, generate.gaussian_copula_sampler(r, seed=1), NUMERIC)


@query(generations_sql(("p_brand", "p_type"), 3))
def gen3_recursive_generations(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type")
    measure = lambda real, s: univariate.tv_complement(real, s, ["p_brand", "p_type"])
    return rounded(generate.recursive_generations(p, 3, generate.marginal_sampler, measure, scratch_path(spark, "generations")), "score")
