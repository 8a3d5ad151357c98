"""Queries over sources and sinks, preparation, splits and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import row_key
from ..functions.scratch import scratch_path
from ..operators import encode, prep, splits
from ..sources import tables
from .base import query, table, union_sql
from .roles import CATEGORICAL, NUMERIC, lineitem_roles, with_roles

ORDERS_META = tables.TableMeta({
    "o_orderkey": tables.ColumnMeta("id"),
    "o_custkey": tables.ColumnMeta("numerical", "Int32"),
    "o_orderstatus": tables.ColumnMeta("categorical"),
    "o_totalprice": tables.ColumnMeta("numerical", "Float"),
    "o_orderdate": tables.ColumnMeta("datetime"),
})


@query("SELECT cast(o_orderkey AS VARCHAR) AS o_orderkey, cast(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def src1_read_table(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet", ORDERS_META)


@query()
def src2_infer_meta(spark, sf):
    return tables.infer_meta(table(spark, sf, "lineitem"))


@query()
def src3_meta_summary(spark, sf):
    return tables.meta_summary(tables.apply_meta(table(spark, sf, "orders"), ORDERS_META))


RUNS = "SELECT user_id % 6 AS dseed, event_id % 3 AS mseed, cast(event_id % 10 AS INTEGER) AS generation, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2, 3, 4"


def runs(spark, sf, text=RUNS):
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


@query(f"SELECT cast(generation AS INTEGER) AS generation, metric, round(value, 6) AS value, cast(dseed AS INTEGER) AS dseed, cast(mseed AS INTEGER) AS mseed FROM ({RUNS})")
def src4_metric_tables(spark, sf):
    path = scratch_path(spark, "metrics")
    name = F.concat(F.lit("lib_dseed"), F.col("dseed"), F.lit("_x_mseed"), F.col("mseed"))
    runs(spark, sf).select("generation", "metric", "value", name.alias("run")).write.partitionBy("run").option("header", True).csv(path)
    found = tables.read_metric_tables(spark, f"{path}/*", ["generation", "metric"])
    return found.select("generation", "metric", F.round(F.col("value").cast("double"), 6).alias("value"), "dseed", "mseed")


_JSON = f"SELECT concat_ws('_', dseed, mseed, generation) AS model_id, max(value) FILTER (metric = 'click') AS a, max(value) FILTER (metric = 'view') AS b, max(value) FILTER (metric = 'purchase') AS c FROM ({RUNS}) GROUP BY 1"


@query("SELECT model_id, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT model_id, '{n}' AS metric, {x} AS value FROM j WHERE {w}" for n, x, w in (
    ("alpha_authenticity_OC", "a", "a > 45"), ("prdc_precision", "a", "true"), ("prdc_recall", "b", "true"), ("prdc_avg", "(coalesce(a, 0) + coalesce(b, 0)) / 4", "true"), ("tv_complement", "c", "true"), ("k_ratio_synthetic_reference", "b", "true"),
    ("detection_gmm", "b", "true"), ("detection_avg", "b", "true"), ("factual_total", "c / 100", "true"), ("training_time", "a", "true"))) .replace("FROM j", f"FROM ({_JSON})") + ") WHERE value IS NOT NULL")
def src5_metric_json(spark, sf):
    """A JSON document for each run and generation, a file each, in the nested layouts of the metric files."""
    path = scratch_path(spark, "metrics-json")
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = runs(spark, sf).groupBy(F.concat_ws("_", "dseed", "mseed", "generation").alias("model_id")).agg(value("click").alias("a"), value("view").alias("b"), value("purchase").alias("c"))
    ok, bad = F.lit("success"), F.lit("error")
    metrics = F.struct(
        F.struct(F.when(F.col("a") > 45, ok).otherwise(bad).alias("status"), F.struct(F.col("a").alias("authenticity_OC")).alias("scores")).alias("alpha_precision"),
        F.struct(ok.alias("status"), F.col("a").alias("precision"), F.col("b").alias("recall")).alias("prdc_score"),
        F.struct(ok.alias("status"), F.col("c").alias("aggregate_score")).alias("tv_complement"),
        F.struct(ok.alias("status"), F.create_map(F.lit("Synthetic / Reference"), F.struct(F.col("b").alias("ratio"))).alias("k_ratios")).alias("k_anonymization"),
    )
    scores = F.struct(F.struct(ok.alias("status"), F.col("b").alias("auc_score")).alias("detection_gmm"), F.struct(bad.alias("status")).alias("detection_mlp"))
    matrix = F.struct(F.struct(F.col("c").alias("rate_pct")).alias("total_factual"))
    doc = F.struct("model_id", metrics.alias("metrics"), scores.alias("individual_scores"), matrix.alias("quality_matrix_2x2"), F.col("a").alias("training_time"))
    wide.select(F.to_json(doc).alias("value"), F.col("model_id").alias("run")).write.partitionBy("run").text(path)
    return tables.read_metric_json(spark, f"{path}/*").select("model_id", "metric", F.round("value", 6).alias("value"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def snk1_write_table(spark, sf):
    path = scratch_path(spark, "customers")
    tables.write_table(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return spark.read.parquet(path)


@query(f"WITH e AS ({RUNS}) SELECT * FROM e WHERE generation < 5 UNION ALL SELECT dseed, mseed, generation, metric, value + 1 FROM e WHERE generation >= 5")
def snk2_merge_metrics(spark, sf):
    e, path = runs(spark, sf), scratch_path(spark, "merged")
    keys = ["dseed", "mseed", "generation", "metric"]
    tables.write_metrics(e, path, keys)
    tables.write_metrics(e.where("generation >= 5").withColumn("value", F.col("value") + 1), path, keys)
    return spark.read.schema(e.schema).parquet(f"{path}/version=1")


def sql_bin(c: str, n: int = 20, low: str = "", high: str = "") -> str:
    """Integer bins as equal_width_bin() makes them."""
    low, high = low or f"{c}_min", high or f"{c}_max"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(coalesce(cast(floor(({c} - {low}) / nullif({high} - {low}, 0) * {n}) AS INTEGER) + 1, 1), 1), {n}) END"


RANGES = "SELECT " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in NUMERIC) + " FROM population"
BINNED = {role: "SELECT l_returnflag, l_linestatus, " + ", ".join(f"{sql_bin(c)} AS {c}" for c in NUMERIC) + f" FROM {role}, ranges" for role in ("population", "training", "synthetic")}


@query(with_roles(f"WITH ranges AS ({RANGES}) SELECT role, {', '.join(CATEGORICAL + NUMERIC)}, count(*) AS n FROM ("
                  + union_sql([f"SELECT *, '{r}' AS role FROM ({t})" for r, t in BINNED.items()]) + ") GROUP BY ALL"))
def snk3_export_binned(spark, sf):
    r = lineitem_roles(spark, sf)
    path = scratch_path(spark, "binned")
    columns = [*CATEGORICAL, *NUMERIC]
    three = {n: getattr(r, n).select(*columns) for n in ("population", "training", "synthetic")}
    tables.write_table(tables.export_binned(three, three["population"], NUMERIC), path)
    return spark.read.parquet(path).groupBy("role", *columns).agg(F.count("*").alias("n"))


@query(f"WITH e AS ({RUNS}) SELECT * FROM e WHERE NOT (dseed < 2 AND generation < 5)")
def snk4_skip_existing(spark, sf):
    e = runs(spark, sf)
    return tables.skip_existing(e, e.where("dseed < 2 AND generation < 5"), ["dseed", "mseed", "generation", "metric"])


# Preparation


@query("SELECT c_name, c_acctbal, c_custkey FROM customer")
def prep1_drop_columns(spark, sf):
    return prep.drop_columns(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey", "absent"], keep=["c_custkey"])


@query("SELECT c_custkey AS ID, c_acctbal AS BALANCE, c_mktsegment FROM customer")
def prep2_rename_columns(spark, sf):
    return prep.rename_columns(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_custkey": "ID", "c_acctbal": "BALANCE", "cust_id": "ID"})


@query('SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_NAME", n_regionkey AS "N_REGIONKEY" FROM nation')
def prep3_uppercase_columns(spark, sf):
    return prep.uppercase_columns(table(spark, sf, "nation"))


DIRTY = "SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat(cast(value AS {text}), CASE WHEN event_id % 19 = 0 THEN 'x' ELSE '' END) END AS dirty FROM events"


def dirty(spark, sf):
    return spark.sql(DIRTY.replace("FROM events", "FROM {events}").replace("{text}", "STRING"), events=table(spark, sf, "events"))


DIRTY_SQL = DIRTY.replace("{text}", "VARCHAR")


@query(f"SELECT event_id, try_cast(dirty AS DOUBLE) AS dirty FROM ({DIRTY_SQL})")
def prep4_coerce_numeric(spark, sf):
    return prep.coerce_numeric(dirty(spark, sf), ["dirty"])


@query(f"SELECT * FROM ({DIRTY_SQL}) WHERE dirty IS NULL OR try_cast(dirty AS DOUBLE) IS NOT NULL")
def prep5_drop_non_numeric(spark, sf):
    return prep.drop_non_numeric(dirty(spark, sf), "dirty")


@query("SELECT event_id, try_cast(round_even(value, 0) AS SMALLINT) AS value FROM events")
def prep6_cast_integral(spark, sf):
    return prep.cast_integral(table(spark, sf, "events").select("event_id", "value"), ["value"])


@query("SELECT event_id, round(round_even(value, 1), 6) AS value FROM events")
def prep7_round_columns(spark, sf):
    return prep.round_columns(table(spark, sf, "events").select("event_id", "value"), ["value"], 1).withColumn("value", F.round("value", 6))


@query(with_roles("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'X' THEN NULL ELSE l_returnflag END, 'Missing') AS flag FROM synthetic"))
def prep8_fill_missing_label(spark, sf):
    s = lineitem_roles(spark, sf).synthetic.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("X")).alias("flag"))
    return prep.fill_missing_label(s, {"flag": "Missing"})


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Missing' ELSE cast(event_id % 2 AS VARCHAR) END AS flag FROM events")
def prep9_boolean_to_label(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 2 == 1).alias("flag"))
    return prep.boolean_to_label(e, "flag")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def prep10_clean_datetime_text(spark, sf):
    day = F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 7 == 0, "NaT").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return prep.clean_datetime_text(table(spark, sf, "events").select("event_id", day.alias("day")), "day")


@query("SELECT p_partkey, p_type FROM part")
def prep11_trim_text(spark, sf):
    return prep.trim_text(table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("p_type")), "p_type")


@query("SELECT event_id, event_id % 2 = 1 AS deceased FROM events")
def prep12_flag_to_boolean(spark, sf):
    return prep.flag_to_boolean(table(spark, sf, "events").select("event_id", (F.col("event_id") % 2).alias("expire_flag")), "expire_flag", "deceased")


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def prep13_select_configured(spark, sf):
    return prep.select_configured(table(spark, sf, "customer"), {"c_custkey": 2, "c_mktsegment": 1, "c_acctbal": 3, "absent": 0})


SYN_COLS = (*CATEGORICAL, *NUMERIC)


@query(with_roles(union_sql([f"SELECT '{c}' AS \"column\", '{'string' if c in CATEGORICAL else 'double'}' AS dtype, count(DISTINCT {c}) AS unique_values, count({c}) AS non_null, "
                             f"count(*) - count({c}) AS nulls, 100.0 * (count(*) - count({c})) / count(*) AS null_pct FROM synthetic" for c in SYN_COLS])))  # fmt: skip
def prep14_column_info(spark, sf):
    return prep.column_info(lineitem_roles(spark, sf).synthetic, SYN_COLS)


@query(with_roles(union_sql([f"SELECT '{c}' AS \"column\", cast({c} AS VARCHAR) AS value, count(*) AS count, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM synthetic GROUP BY {c}" for c in (*CATEGORICAL, "l_quantity")])))
def prep15_value_counts(spark, sf):
    return prep.value_counts(lineitem_roles(spark, sf).synthetic, [*CATEGORICAL, "l_quantity"])


MODE = "(SELECT l_returnflag FROM training WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(with_roles(f"SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'X'), {MODE}) AS l_returnflag, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM training)), 6) AS l_quantity FROM synthetic"))
def prep16_impute(spark, sf):
    r = lineitem_roles(spark, sf)
    s = r.synthetic.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("X")).alias("l_returnflag"), "l_quantity")
    return prep.impute(s, prep.fit_imputer(r.training, ["l_quantity"], ["l_returnflag"])).withColumn("l_quantity", F.round("l_quantity", 6))


@query("WITH a AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), f AS (SELECT event_id, user_id, value FROM events, a WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), "
       "b AS (SELECT quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM f) SELECT f.* FROM f, b WHERE user_id BETWEEN q1 - 0.2 * 0 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")  # fmt: skip
def prep17_outliers_iqr(spark, sf):
    return prep.remove_outliers_iqr(table(spark, sf, "events").select("event_id", "user_id", "value"), ["value", "user_id"])


@query(with_roles("SELECT l_orderkey, l_linenumber, round((l_tax - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS l_tax FROM synthetic, (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS s FROM training)"))
def prep18_standard_scale(spark, sf):
    r = lineitem_roles(spark, sf)
    return prep.standard_scale(r.synthetic.select("l_orderkey", "l_linenumber", "l_tax"), ["l_tax"], r.training).withColumn("l_tax", F.round("l_tax", 6) + 0.0)


@query(with_roles("SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / nullif(hi - lo, 0), 6) AS l_quantity FROM synthetic, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM training)"))
def prep19_minmax_scale(spark, sf):
    r = lineitem_roles(spark, sf)
    return prep.minmax_scale(r.synthetic.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], r.training).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT event_id, CASE WHEN event_type IN ('nan', 'None') THEN NULL ELSE event_type END AS event_type FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'nan' ELSE event_type END AS event_type FROM events)")
def prep20_normalize_categories(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "nan").otherwise(F.col("event_type")).alias("event_type"))
    return prep.normalize_categories(e, ["event_type"])


@query(with_roles(union_sql(
    [f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, cast(NULL AS BIGINT) AS unique_values FROM synthetic" for c in NUMERIC]
    + [f"SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, count(DISTINCT {c}) FROM synthetic" for c in CATEGORICAL])))
def prep21_table_summary(spark, sf):
    out = prep.table_summary(lineitem_roles(spark, sf).synthetic, NUMERIC, CATEGORICAL)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT c_custkey, c_name, cast(NULL AS INTEGER) AS c_nationkey, c_acctbal, cast(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def prep22_align_columns(spark, sf):
    c = table(spark, sf, "customer")
    return prep.align_columns(c, c.select("c_name", "c_custkey", "c_acctbal", F.lit(1).alias("extra")), strict=False)


# Splits


def sql_order(*parts: str, seed: int = 0) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(cast({p} AS VARCHAR), '~')" for p in parts) + f", '{seed}'))"


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY {sql_order('o_custkey', seed=7)}, o_custkey LIMIT 50)")
def spl1_sample_entities(spark, sf):
    return splits.sample_entities(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 50, seed=7)


@query(f"SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_order('o_orderkey', seed=7)}, o_orderkey) <= ceil(0.5 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'train' ELSE 'test' END AS split FROM orders")
def spl2_stratified_split(spark, sf):
    return splits.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", seed=7)


#: The first half of the customers in seeded order, then so many rows of either side in seeded order.
SPLIT = f"""SELECT o_orderkey, o_custkey, o_orderstatus, split AS side, row_number() OVER (PARTITION BY split ORDER BY {sql_order('o_orderkey', 'o_custkey', 'o_orderstatus', seed=7)}) AS place
FROM orders JOIN (SELECT o_custkey, CASE WHEN row_number() OVER (ORDER BY {sql_order('o_custkey', seed=7)}, o_custkey) <= floor(count(*) OVER () / 2) THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT o_custkey FROM orders)) USING (o_custkey)"""
TARGETS = "CASE WHEN side = 'train' AND place > 500 OR side = 'test' AND place > 300 THEN 'unsampled' ELSE side END"


def grouped(spark, sf, **targets):
    return splits.split_by_group(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", seed=7, **targets)


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, side AS split FROM ({SPLIT})")
def spl3_split_by_group(spark, sf):
    return grouped(spark, sf)


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, {TARGETS} AS split FROM ({SPLIT})")
def spl3_split_to_targets(spark, sf):
    return grouped(spark, sf, train_rows=500, test_rows=300)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def spl4_complement(spark, sf):
    cohort = table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return splits.complement(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), cohort, "o_custkey")


PARTS = {"train": "o_orderkey % 3 = 0", "test": "o_orderkey % 3 = 1", "unsampled": "o_orderkey % 3 = 2"}
LEAKS = [(a, b, k) for k in ("o_orderkey", "o_custkey") for a, b in (("train", "test"), ("train", "unsampled"), ("test", "unsampled"))]


@query(f"SELECT *, CASE WHEN overlap = 0 THEN 'ok' ELSE 'leak' END AS verdict FROM (" + union_sql([
    f"SELECT '{k}' AS level, '{a}' AS first, '{b}' AS second, count(*) AS overlap FROM (SELECT DISTINCT {k} FROM orders WHERE {PARTS[a]}) JOIN (SELECT DISTINCT {k} FROM orders WHERE {PARTS[b]}) USING ({k})" for a, b, k in LEAKS]) + ")")
def spl5_leakage_report(spark, sf):
    o = table(spark, sf, "orders")
    return splits.leakage_report({n: o.where(p) for n, p in PARTS.items()}, ["o_orderkey", "o_custkey"])


_RATES = ", ".join(f"avg(CASE WHEN split = '{x}' THEN cast(o_orderstatus = 'F' AS INTEGER) END) AS {x}_rate" for x in ("train", "test", "unsampled"))


@query(f"SELECT *, CASE WHEN gap < 0.001 THEN 'excellent' WHEN gap < 0.02 THEN 'good' ELSE 'warning' END AS verdict FROM (SELECT *, abs(train_rate - test_rate) AS gap FROM (SELECT {_RATES} FROM (SELECT o_orderstatus, {TARGETS} AS split FROM ({SPLIT}))))")
def spl6_target_rate_report(spark, sf):
    return splits.target_rate_report(grouped(spark, sf, train_rows=500, test_rows=300), (F.col("o_orderstatus") == "F").cast("int"))


@query(with_roles("SELECT count(*) AS absent FROM (SELECT * FROM reference EXCEPT SELECT * FROM population)"))
def spl7_absent_rows(spark, sf):
    r = lineitem_roles(spark, sf)
    return splits.absent_rows(r.reference, r.population)


@query(f"SELECT o_orderkey, cast((row_number() OVER (PARTITION BY o_orderstatus, substr(h, 1, 2) ORDER BY h, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM (SELECT o_orderkey, o_orderstatus, {sql_order('o_orderkey', seed=3)} AS h FROM orders)")
def spl8_kfold(spark, sf):
    return splits.kfold(table(spark, sf, "orders"), "o_orderkey", 5, seed=3, by="o_orderstatus").select("o_orderkey", "fold")


# Encoding

INTERVALS = "SELECT p_type AS category, n, cast(hi - n AS DOUBLE) / t AS lo, cast(hi AS DOUBLE) / t AS hi FROM (SELECT *, sum(n) OVER (ORDER BY {order}) AS hi, sum(n) OVER () AS t FROM (SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1))"


def parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_type")


@query(f"SELECT p_partkey, round(lo + (hi - lo) * 0.5, 6) AS p_type FROM part JOIN ({INTERVALS.format(order='n DESC, p_type')}) ON p_type = category")
def enc1_uniform_encode(spark, sf):
    p = parts(spark, sf)
    return encode.uniform_encode(p, "p_type", encode.fit_intervals(p, "p_type"), midpoint=True).withColumn("p_type", F.round("p_type", 6))


@query("SELECT p_partkey, p_type FROM part")
def enc1_uniform_decode(spark, sf):
    p = parts(spark, sf)
    fitted = encode.fit_intervals(p, "p_type")
    return encode.uniform_decode(encode.uniform_encode(p, "p_type", fitted, ["p_partkey"], seed=5), "p_type", fitted)


ORDER = ("STANDARD", "SMALL", "PROMO")


@query(f"SELECT p_partkey, round(lo + (hi - lo) * 0.5, 6) AS p_type FROM part JOIN ({INTERVALS.format(order=chr(39).join(['CASE p_type WHEN ', 'STANDARD', ' THEN 0 WHEN ', 'SMALL', ' THEN 1 WHEN ', 'PROMO', ' THEN 2 ELSE 3 END, p_type']))}) ON p_type = category")
def enc2_ordered_uniform_encode(spark, sf):
    p = parts(spark, sf)
    return encode.uniform_encode(p, "p_type", encode.fit_intervals(p, "p_type", ORDER), midpoint=True).withColumn("p_type", F.round("p_type", 6))


CODES = "SELECT p_type AS category, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_partkey % 2 = 0 AND p_type <> 'PROMO')"


@query(f"SELECT p_partkey, cast(coalesce(code, -1) AS INTEGER) AS p_type FROM part LEFT JOIN ({CODES}) ON p_type = category")
def enc3_label_encode(spark, sf):
    p = parts(spark, sf)
    return encode.label_encode(p, "p_type", encode.fit_labels([p.where("p_partkey % 2 = 0 AND p_type <> 'PROMO'")], "p_type"))


@query("SELECT p_partkey, p_type FROM part")
def enc3_label_decode(spark, sf):
    p = parts(spark, sf)
    fitted = encode.fit_labels([p], "p_type")
    return encode.label_decode(encode.label_encode(p, "p_type", fitted).withColumn("p_type", F.col("p_type") + 0.3), "p_type", fitted)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_custkey, " + ", ".join(f"cast(c_mktsegment = '{s}' AS DOUBLE) AS seg_{s.lower()}" for s in SEGMENTS) + " FROM customer")
def enc4_onehot_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out = encode.onehot_encode(c, "c_mktsegment", list(SEGMENTS))
    return out.select("c_custkey", *[F.col(f"`c_mktsegment.{s}`").alias(f"seg_{s.lower()}") for s in SEGMENTS])


@query("SELECT c_custkey, c_mktsegment FROM customer")
def enc4_onehot_decode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    categories = encode.onehot_categories(c, "c_mktsegment")
    return encode.onehot_decode(encode.onehot_encode(c, "c_mktsegment", categories), "c_mktsegment", categories)


@query("SELECT p_partkey, coalesce(n, 0) AS p_type FROM part p LEFT JOIN (SELECT p_type AS c, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) ON p_type = c")
def enc5_frequency_encode(spark, sf):
    p = parts(spark, sf)
    return encode.frequency_encode(p, "p_type", p.where("p_partkey % 3 = 0"))


@query("SELECT o_orderkey, cast(epoch_us(o_orderdate) AS DOUBLE) / 1e6 AS o_orderdate FROM orders")
def enc6_timestamp_encode(spark, sf):
    return encode.timestamp_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def enc6_timestamp_decode(spark, sf):
    o = encode.timestamp_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return encode.timestamp_decode(o, "o_orderdate", "yyyy-MM-dd")


@query(with_roles("SELECT l_orderkey, l_linenumber, round(round_even(least(greatest(coalesce(l_quantity, m), lo), hi), 0), 6) AS l_quantity FROM synthetic, (SELECT avg(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM reference)"))
def enc7_float_format(spark, sf):
    r = lineitem_roles(spark, sf)
    fitted = encode.fit_float(r.reference, "l_quantity")
    s = r.synthetic.select("l_orderkey", "l_linenumber", "l_quantity")
    return encode.float_decode(encode.float_encode(s, "l_quantity", fitted), "l_quantity", fitted).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT event_id, cast(event_id % 2 AS DOUBLE) AS flag FROM events")
def enc8_binary_encode(spark, sf):
    return encode.binary_encode(table(spark, sf, "events").select("event_id", (F.col("event_id") % 2 == 1).alias("flag")), "flag")


@query("SELECT p_partkey, p_type, p_brand, p_size, p_retailprice FROM part")
def enc9_encoder_round_trip(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice")
    kinds = {"p_type": "uniform", "p_brand": "label", "p_size": "label", "p_retailprice": "float"}
    e = encode.Encoder({c: encode.ColumnPlan(k) for c, k in kinds.items()}, key=["p_partkey"], seed=3).fit(p)
    path = scratch_path(spark, "encoder")
    e.save(path)
    e = encode.Encoder.load(spark, path)
    return e.reverse(e.transform(p)).withColumn("p_size", F.col("p_size").cast("int")).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query()
def enc10_usable_columns(spark, sf):
    c = encode.onehot_encode(table(spark, sf, "customer"), "c_mktsegment", list(SEGMENTS))
    names = encode.usable_columns(c, {"c_custkey": "id", "c_mktsegment": "categorical", "c_acctbal": "numerical", "c_nationkey": "categorical"})
    return c.agg(*[F.avg(f"`{n}`").alias(n.replace(".", "_")) for n in names])


@query(with_roles("SELECT l_orderkey, l_linenumber, md5(concat_ws('|', coalesce(l_returnflag, '~'), coalesce(l_linestatus, '~'), coalesce(cast(l_quantity AS VARCHAR), '~'), coalesce(cast(l_shipdate AS VARCHAR), '~'))) AS key FROM synthetic"))
def set7_row_key(spark, sf):
    s = lineitem_roles(spark, sf).synthetic
    return s.select("l_orderkey", "l_linenumber", row_key(s, ["l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"]).alias("key"))


