"""Queries over row membership, plausibility rules, data quality and schema comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import membership as m
from ..operators import quality, rules, schema_cmp
from .base import query, table, union_sql
from .queries_tables import BINNED, RANGES, sql_bin
from .roles import CATEGORICAL, NUMERIC, lineitem_roles, with_roles

KEYS = [*CATEGORICAL, *NUMERIC]
LIST = ", ".join(KEYS)
SPEC = m.Spec(categorical=CATEGORICAL, numeric=NUMERIC)


def narrow(spark, sf):
    r = lineitem_roles(spark, sf)
    return tuple(getattr(r, n).select(*KEYS) for n in ("synthetic", "population", "training"))


@query(with_roles(f"SELECT {LIST} FROM synthetic INTERSECT SELECT {LIST} FROM population"))
def set1_intersect_rows(spark, sf):
    s, p, _ = narrow(spark, sf)
    return m.intersect_rows(s, p)


@query(with_roles(f"SELECT {LIST} FROM synthetic EXCEPT SELECT {LIST} FROM population"))
def set2_except_rows(spark, sf):
    s, p, _ = narrow(spark, sf)
    return m.except_rows(s, p)


@query(with_roles(f"(SELECT {LIST} FROM synthetic INTERSECT SELECT {LIST} FROM population) EXCEPT SELECT {LIST} FROM training"))
def set3_ddr_rows(spark, sf):
    return m.ddr_rows(*narrow(spark, sf))


@query(with_roles(f"SELECT {LIST}, count(*) AS occurrences FROM synthetic GROUP BY ALL HAVING count(*) > 1"))
def set4_duplicate_rows(spark, sf):
    return m.duplicate_rows(narrow(spark, sf)[0])


@query(with_roles(f"WITH ranges AS ({RANGES}) SELECT l_orderkey, l_linenumber, " + ", ".join(f"{sql_bin(c)} AS {c}" for c in NUMERIC) + " FROM synthetic, ranges"))
def set5_bin_numeric(spark, sf):
    r = lineitem_roles(spark, sf)
    return m.bin_numeric(r.synthetic.select("l_orderkey", "l_linenumber", *NUMERIC), m.numeric_ranges(r.population, NUMERIC), NUMERIC)


@query(with_roles(RANGES))
def set6_numeric_ranges(spark, sf):
    return m.numeric_ranges(lineitem_roles(spark, sf).population, NUMERIC)


def sql_same(a: str, b: str, columns) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns)


CLASS = "CASE WHEN p AND NOT t THEN 'ddr' WHEN p AND t THEN 'training_copy_valid' WHEN NOT p AND t THEN 'training_copy_propagation' ELSE 'new_hallucination' END"
FLAGGED = f"""
SELECT s.*, p.one IS NOT NULL AS p, t.one IS NOT NULL AS t FROM {{s}} s
LEFT JOIN (SELECT DISTINCT {LIST}, 1 AS one FROM {{p}}) p ON {sql_same('s', 'p', KEYS)}
LEFT JOIN (SELECT DISTINCT {LIST}, 1 AS one FROM {{t}}) t ON {sql_same('s', 't', KEYS)}"""


@query(with_roles(f"SELECT l_orderkey, l_linenumber, p AS in_population, t AS in_training, {CLASS} AS class FROM ({FLAGGED.format(s='synthetic', p='population', t='training')})"))
def set8_membership(spark, sf):
    r = lineitem_roles(spark, sf)
    return m.membership(r.synthetic, r.population, r.training, KEYS).select("l_orderkey", "l_linenumber", "in_population", "in_training", "class")


def _rate(x: str, whole: str) -> str:
    return f"100 * (cast({x} AS DOUBLE) / cast({whole} AS DOUBLE))"


DDR_PARTS = {"ddr": "p AND NOT t", "hallucination": "NOT p", "training_copy": "t", "population_match": "p"}
DDR_SQL = (
    f"WITH f AS ({FLAGGED.format(s='synthetic', p='population', t='training')}), k AS (SELECT {LIST}, p, t, count(*) AS n FROM f GROUP BY ALL) SELECT sum(n) AS total_synthetic_records, count(*) AS unique_synthetic_records, "
    f"sum(n) - count(*) AS duplicate_records, {_rate('sum(n) - count(*)', 'sum(n)')} AS duplicate_rate_pct, "
    + ", ".join(f"count(*) FILTER ({c}) AS {k}_unique_count, {_rate(f'count(*) FILTER ({c})', 'count(*)')} AS {k}_unique_rate_pct, coalesce(sum(n) FILTER ({c}), 0) AS {k}_total_count, {_rate(f'coalesce(sum(n) FILTER ({c}), 0)', 'sum(n)')} AS {k}_total_rate_pct" for k, c in DDR_PARTS.items())
    + " FROM k"
)


def _longs(sql: str) -> str:
    """Counts as BIGINT; DuckDB sums to HUGEINT."""
    return f"SELECT cast(COLUMNS('.*(count|records)$') AS BIGINT), COLUMNS('.*pct$') FROM ({sql})"


@query(_longs(with_roles(DDR_SQL)))
def set9_ddr_summary(spark, sf):
    return m.ddr_summary(*narrow(spark, sf), KEYS)


PASSES = " AND ".join([f"coalesce(list_contains((SELECT list(DISTINCT {c}) FROM population), {c}), false)" for c in CATEGORICAL] + [f"({c} IS NULL OR {c} BETWEEN (SELECT min({c}) FROM population) AND (SELECT max({c}) FROM population))" for c in NUMERIC])
#: Rows with their binned key, membership and plausibility.
JUDGED = (
    f"WITH ranges AS ({RANGES}), pb AS ({BINNED['population']}), tb AS ({BINNED['training']}), sb AS (SELECT l_returnflag, l_linestatus, "
    + ", ".join(f"{sql_bin(c)} AS {c}" for c in NUMERIC)
    + f", passes FROM (SELECT *, {PASSES} AS passes FROM synthetic), ranges), f AS ({FLAGGED.format(s='sb', p='pb', t='tb')}), "
    f"j AS (SELECT *, {CLASS} AS class FROM f), k AS (SELECT {LIST}, class, count(*) FILTER (passes) AS good, count(*) FILTER (NOT passes) AS bad, count(*) AS n FROM j GROUP BY ALL)"
)


def _pair(name: str, x: str, whole: str) -> str:
    return f"{x} AS {name}_count, {_rate(x, whole)} AS {name}_rate_pct"


def _sum(x: str, where: str = "true") -> str:
    return f"coalesce(sum({x}) FILTER ({where}), 0)"


SUMMARY = ["(SELECT count(*) FROM population) AS population_total_count", "(SELECT count(*) FROM (SELECT DISTINCT * FROM pb)) AS population_unique_count",
           "(SELECT count(*) FROM training) AS training_total_count", "(SELECT count(*) FROM (SELECT DISTINCT * FROM tb)) AS training_unique_count",
           "sum(n) AS synthetic_total_count", "count(*) AS synthetic_unique_count"]
for _c in m.CLASSES:
    SUMMARY += [_pair(f"{_c}_unique", f"count(*) FILTER (class = '{_c}')", "count(*)"), _pair(f"{_c}_total", _sum("n", f"class = '{_c}'"), "sum(n)")]
    SUMMARY += [_pair(f"{_c}_plausible_total", _sum("good", f"class = '{_c}'"), "sum(n)"), _pair(f"{_c}_implausible_total", _sum("bad", f"class = '{_c}'"), "sum(n)")]
SUMMARY += [_pair("plausible_unique", "count(*) FILTER (good > 0)", "count(*)"), _pair("implausible_unique", "count(*) FILTER (bad > 0)", "count(*)"), _pair("plausible_total", _sum("good"), "sum(n)"), _pair("implausible_total", _sum("bad"), "sum(n)")]
SUMMARY += [_pair("total_factual", _sum("n", "class IN ('ddr', 'training_copy_valid')"), "sum(n)"), _pair("novel_factual", _sum("n", "class = 'ddr'"), "sum(n)"), _pair("total_plausible", _sum("good"), "sum(n)"), _pair("novel_plausible", _sum("good", "class IN ('ddr', 'new_hallucination')"), "sum(n)")]
SUMMARY_SQL = _longs(with_roles(f"{JUDGED} SELECT {', '.join(SUMMARY)} FROM k"))


@query(SUMMARY_SQL)
def set10_validation_summary(spark, sf):
    return m.validation_summary(lineitem_roles(spark, sf), SPEC)


MEASURES = ("total_factual", "novel_factual", "total_plausible", "novel_plausible")


@query(f"WITH s AS ({SUMMARY_SQL}) " + union_sql([f"SELECT '{x}' AS measure, {x}_count AS count, {x}_rate_pct AS rate_pct FROM s" for x in MEASURES]))
def set11_quality_matrix(spark, sf):
    return m.quality_matrix(lineitem_roles(spark, sf), SPEC)


@query(with_roles(f"{JUDGED} SELECT class, cast(sum(good) AS BIGINT) AS plausible, cast(sum(bad) AS BIGINT) AS implausible FROM k GROUP BY 1"))
def set12_class_by_plausibility(spark, sf):
    return m.class_by_plausibility(lineitem_roles(spark, sf), SPEC)


@query("SELECT class, rate, CASE WHEN rate >= 70 THEN 'EXCELLENT' WHEN rate >= 50 THEN 'GOOD' WHEN rate >= 30 THEN 'MODERATE' ELSE 'POOR' END AS grade FROM ("
       + with_roles(f"WITH f AS ({FLAGGED.format(s='synthetic', p='population', t='training')}) SELECT {CLASS} AS class, 100.0 * count(*) / sum(count(*)) OVER () AS rate FROM f GROUP BY 1") + ")")
def set13_ddr_grade(spark, sf):
    s, p, t = narrow(spark, sf)
    counts = m.membership(s, p, t, KEYS).groupBy("class").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rates = counts.crossJoin(F.broadcast(total)).select("class", (100.0 * F.col("n") / F.col("total")).alias("rate"))  # one row
    return rates.withColumn("grade", m.ddr_grade(F.col("rate")))


@query(with_roles("SELECT \"column\", \"distinct\", round(ln(\"distinct\"), 6) AS contribution, round(ln(\"distinct\") / sum(ln(\"distinct\")) OVER (), 6) AS share FROM ("
                  + union_sql([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM synthetic" for c in KEYS]) + ")"))
def set14_complexity(spark, sf):
    return m.complexity(narrow(spark, sf)[0], KEYS).withColumns({c: F.round(c, 6) for c in ("contribution", "share")})


#: Reference and synthetic rows by their order keys, as the roles have them, with another price column.
NEW_ROWS = "SELECT l_returnflag, l_linestatus, l_extendedprice, l_quantity FROM lineitem WHERE l_orderkey % 10 IN ({})"


@query(f"WITH r AS ({NEW_ROWS.format('4, 5')}), s AS ({NEW_ROWS.format('3, 4, 5, 8, 9')}), u AS (SELECT count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.l_returnflag = s.l_returnflag AND r.l_linestatus = s.l_linestatus AND abs(r.l_extendedprice - s.l_extendedprice) <= 0.01 * abs(s.l_extendedprice) AND abs(r.l_quantity - s.l_quantity) <= 0.01 * abs(s.l_quantity))) AS matched FROM s) SELECT total, matched, total - matched AS new_rows, cast(total - matched AS DOUBLE) / total AS score FROM u")
def set15_new_row_synthesis(spark, sf):
    li = table(spark, sf, "lineitem")
    return m.new_row_synthesis(li.where("l_orderkey % 10 IN (4, 5)"), li.where("l_orderkey % 10 IN (3, 4, 5, 8, 9)"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"])


# Rules

RULE_COLS = [*CATEGORICAL, "l_quantity", "l_discount", "l_shipdate"]
_KIND = {"l_returnflag": "categorical", "l_linestatus": "categorical", "l_quantity": "categorical", "l_discount": "categorical", "l_shipdate": "date"}


@query(with_roles(union_sql([
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, " + (f"cast(min({c}) AS VARCHAR) AS low, cast(max({c}) AS VARCHAR) AS high" if k != "categorical" else "cast(NULL AS VARCHAR) AS low, cast(NULL AS VARCHAR) AS high")
    + f", count(*) > count({c}) AS has_null, count(DISTINCT {c}) AS cardinality, " + (f"list_sort(list(DISTINCT cast({c} AS VARCHAR)))" if k == "categorical" else "cast(NULL AS VARCHAR[])") + " AS allowed FROM population" for c, k in _KIND.items()])))
def pla1_generate_rules(spark, sf):
    return rules.generate_rules(lineitem_roles(spark, sf).population, RULE_COLS)


ALLOWED_COLS = ["o_custkey", "o_orderpriority"]
_LEARNT = "(SELECT {0} FROM orders WHERE o_orderkey % 10 < 3)"


@query("SELECT o_orderkey, " + ", ".join(f"coalesce({c} IN {_LEARNT.format(c)}, false) AS categorical_{c}" for c in ALLOWED_COLS) + " FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey) FROM orders)")
def pla2_allowed_values(spark, sf):
    """Value sets learnt from some orders, of any size, as a table; all orders are checked, some with changed customers."""
    o = table(spark, sf, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    changed = o.withColumn("o_custkey", F.when(key % 5 == 0, None).when(key % 7 == 0, -customer).otherwise(customer))
    learnt = rules.allowed_values(o.where("o_orderkey % 10 < 3"), ALLOWED_COLS)
    return rules.check_allowed(changed, learnt, ALLOWED_COLS).select("o_orderkey", *[f"categorical_{c}" for c in ALLOWED_COLS])


RULES = [
    rules.Categorical("l_returnflag", ("A", "N", "R")),
    rules.Range("l_quantity", 1, 50),
    rules.Range("l_shipdate", "1995-06-01", "2001-06-01", data_type="date"),
    rules.Combination("flag_status", ("l_returnflag", "l_linestatus")),
]


#: Ranges with an open end or two; NULLs fail where there is an end.
OPEN = [rules.Range("l_quantity", 10, None), rules.Range("l_quantity", None, 40), rules.Range("l_quantity", None, None), rules.Range("l_quantity", 10, 40, allow_null=True)]


@query(with_roles("SELECT l_orderkey, l_linenumber, coalesce(l_quantity >= 10, false) AS low, coalesce(l_quantity <= 40, false) AS high, true AS neither, l_quantity IS NULL OR l_quantity BETWEEN 10 AND 40 AS nullable FROM synthetic"))
def pla3_open_ranges(spark, sf):
    return lineitem_roles(spark, sf).synthetic.select("l_orderkey", "l_linenumber", *[rules.check_range(r).alias(n) for r, n in zip(OPEN, ("low", "high", "neither", "nullable"), strict=True)])


@query(with_roles("SELECT l_orderkey, l_linenumber, coalesce(l_returnflag IN ('A', 'N', 'R'), false) AS ok FROM synthetic"))
def pla2_check_categorical(spark, sf):
    return lineitem_roles(spark, sf).synthetic.select("l_orderkey", "l_linenumber", rules.check_categorical(RULES[0]).alias("ok"))


@query(with_roles("SELECT l_orderkey, l_linenumber, coalesce(l_quantity BETWEEN 1 AND 50, false) AS strict, coalesce(l_quantity BETWEEN 1 AND 50, true) AS lenient FROM synthetic"))
def pla3_check_range(spark, sf):
    lenient = rules.Range("l_quantity", 1, 50, allow_null=True)
    return lineitem_roles(spark, sf).synthetic.select("l_orderkey", "l_linenumber", rules.check_range(RULES[1]).alias("strict"), rules.check_range(lenient).alias("lenient"))


@query(with_roles("SELECT l_orderkey, l_linenumber, (l_returnflag, l_linestatus) IN (SELECT (l_returnflag, l_linestatus) FROM population) AS flag_status FROM synthetic"))
def pla4_check_combination(spark, sf):
    r = lineitem_roles(spark, sf)
    return rules.check_combination(r.synthetic, RULES[3], r.population).select("l_orderkey", "l_linenumber", "flag_status")


VALID = """
SELECT *, list_filter([CASE WHEN NOT a THEN 'categorical_l_returnflag' END, CASE WHEN NOT b THEN 'range_l_quantity' END, CASE WHEN NOT c THEN 'range_l_shipdate' END, CASE WHEN NOT d THEN 'flag_status' END], lambda x: x IS NOT NULL) AS failed_rules FROM (
SELECT l_orderkey, l_linenumber, coalesce(l_returnflag IN ('A', 'N', 'R'), false) AS a, coalesce(l_quantity BETWEEN 1 AND 50, false) AS b,
coalesce(l_shipdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2001-06-01', false) AS c, (l_returnflag, l_linestatus) IN (SELECT (l_returnflag, l_linestatus) FROM population) AS d FROM synthetic)"""


def validated(spark, sf):
    r = lineitem_roles(spark, sf)
    return rules.validate(r.synthetic, RULES, r.population)


@query(with_roles(f"SELECT l_orderkey, l_linenumber, failed_rules, len(failed_rules) = 0 AS passes_all FROM ({VALID})"))
def pla5_validate(spark, sf):
    return validated(spark, sf).select("l_orderkey", "l_linenumber", "failed_rules", "passes_all")


@query(with_roles(f"SELECT rule, count(*) AS failures, cast(count(*) AS DOUBLE) / (SELECT count(*) FROM synthetic) AS share FROM (SELECT unnest(failed_rules) AS rule FROM ({VALID})) GROUP BY 1"))
def pla6_rule_failures(spark, sf):
    return rules.rule_failures(validated(spark, sf))


@query(with_roles(f"SELECT l_orderkey, l_linenumber, failed_rules FROM ({VALID}) WHERE len(failed_rules) > 0 ORDER BY l_orderkey, l_linenumber, failed_rules LIMIT 20"))
def pla7_failing_samples(spark, sf):
    return rules.failing_samples(validated(spark, sf), ["l_orderkey", "l_linenumber", "failed_rules"], 20).select("l_orderkey", "l_linenumber", "failed_rules")


# Quality

_N = len(KEYS)
COMPLETE = f"SELECT cast(count(*) * {_N} AS BIGINT) AS cells, cast(sum(m) AS BIGINT) AS missing_cells, 1 - cast(sum(m) AS DOUBLE) / (count(*) * {_N}) AS completeness, count(*) FILTER (m = 0) AS complete_rows, cast(count(*) FILTER (m = 0) AS DOUBLE) / count(*) AS complete_row_rate FROM (SELECT " + " + ".join(f"cast({c} IS NULL AS INTEGER)" for c in KEYS) + " AS m FROM {role})"


@query(with_roles(COMPLETE.format(role="synthetic")))
def dq1_completeness(spark, sf):
    return quality.completeness(lineitem_roles(spark, sf).synthetic, KEYS)


@query(with_roles(union_sql([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, cast(count(*) - count({c}) AS DOUBLE) / count(*) AS missing_rate FROM synthetic" for c in KEYS])))
def dq1_missing_by_column(spark, sf):
    return quality.missing_by_column(lineitem_roles(spark, sf).synthetic, KEYS)


def _valid(columns, source: str, of: int) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_1, quantile_cont({c}, 0.99) AS {c}_9" for c in columns)
    far = {c: f"count(*) FILTER ({c} < {c}_1 - 10 * ({c}_9 - {c}_1) OR {c} > {c}_9 + 10 * ({c}_9 - {c}_1))" for c in columns}
    inf = {c: f"count(*) FILTER (isinf(cast({c} AS DOUBLE)))" for c in columns}
    issues = " + ".join(f"CASE WHEN {x} > 0 THEN 1 ELSE 0 END" for x in [*far.values(), *inf.values()])
    return f"SELECT {' + '.join(inf.values())} AS infinite, {' + '.join(far.values())} AS extreme, cast({issues} AS INTEGER) AS issues, 1 - ({issues}) / {2.0 * of} AS validity FROM {source}, (SELECT {qs} FROM {source})"


@query(_valid(["value", "user_id"], "(SELECT event_type, value, user_id FROM events)", 3))
def dq2_validity(spark, sf):
    return quality.validity(table(spark, sf, "events").select("event_type", "value", "user_id"), ["value", "user_id"])


UNIQUE = f"SELECT cast(sum(n) AS BIGINT) AS \"rows\", count(*) AS distinct_rows, cast(sum(n) - count(*) AS BIGINT) AS duplicate_rows, cast(count(*) AS DOUBLE) / sum(n) AS uniqueness FROM (SELECT {LIST}, count(*) AS n FROM {{role}} GROUP BY ALL)"


@query(with_roles(UNIQUE.format(role="synthetic")))
def dq3_uniqueness(spark, sf):
    return quality.uniqueness(narrow(spark, sf)[0])


CONSISTENT = union_sql([f"SELECT '{c}' AS \"column\", count(*) FILTER (regexp_matches({c}, '^-?\\d+\\.?\\d*$')) AS numeric_like, count(*) FILTER (NOT regexp_matches({c}, '^-?\\d+\\.?\\d*$')) AS text_like, min(length({c})) AS min_length, max(length({c})) AS max_length, avg(length({c})) AS avg_length, stddev_samp(length({c})) AS std_length FROM ({{source}}) WHERE {c} IS NOT NULL" for c in ("dirty", "event_type")])
_EV = "SELECT event_type, concat(cast(event_id AS VARCHAR), CASE WHEN event_id % 19 = 0 THEN 'x' ELSE '' END) AS dirty FROM events"


@query("SELECT \"column\", numeric_like, text_like, cast(min_length AS INTEGER) AS min_length, cast(max_length AS INTEGER) AS max_length, round(avg_length, 6) AS avg_length, round(std_length, 6) AS std_length, numeric_like > 0 AND text_like > 0 AS mixed FROM (" + CONSISTENT.format(source=_EV) + ")")
def dq4_consistency(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 19 == 0, "x").otherwise("")).alias("dirty"))
    return quality.consistency(e, ["dirty", "event_type"]).withColumns({c: F.round(c, 6) for c in ("avg_length", "std_length")})


#: A text column in which numbers and other texts are mixed.
_DIRTY = "concat(cast(l_linenumber AS VARCHAR), CASE WHEN l_orderkey % 19 = 0 THEN 'x' ELSE '' END)"
SCORED_KEYS = [*KEYS, "dirty"]


def dirty(df):
    return df.withColumn("dirty", F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_orderkey") % 19 == 0, "x").otherwise("")))


def _scores(role: str) -> str:
    source, n = f"(SELECT *, {_DIRTY} AS dirty FROM {role})", len(SCORED_KEYS)
    complete = complete_sql(source, SCORED_KEYS)
    unique = f"SELECT cast(count(*) AS DOUBLE) / sum(n) AS uniqueness FROM (SELECT {', '.join(SCORED_KEYS)}, count(*) AS n FROM {source} GROUP BY ALL)"
    mixed = " + ".join(f"(SELECT cast(count(*) FILTER (regexp_matches({c}, '^-?\\d+\\.?\\d*$')) > 0 AND count(*) FILTER (NOT regexp_matches({c}, '^-?\\d+\\.?\\d*$')) > 0 AS INTEGER) FROM {source})" for c in (*CATEGORICAL, "dirty"))
    return f"SELECT *, (completeness + validity + uniqueness + consistency) / 4 AS quality FROM (SELECT c.completeness, v.validity, u.uniqueness, 1 - ({mixed}) / {float(n)} AS consistency FROM ({complete}) c, ({_valid(NUMERIC, source, n)}) v, ({unique}) u)"


def complete_sql(source: str, columns) -> str:
    return f"SELECT 1 - sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in columns)}) / cast(count(*) * {len(columns)} AS DOUBLE) AS completeness FROM {source}"


_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("completeness", "validity", "uniqueness", "consistency", "quality"))


@query(with_roles(f"SELECT {_R6} FROM ({_scores('synthetic')})"))
def dq5_quality_score(spark, sf):
    out = quality.quality_score(dirty(lineitem_roles(spark, sf).synthetic), SCORED_KEYS, NUMERIC, [*CATEGORICAL, "dirty"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(with_roles(f"WITH a AS ({_scores('reference')}), b AS ({_scores('synthetic')}) " + union_sql([f"SELECT '{x}' AS measure, round(a.{x}, 6) AS original, round(b.{x}, 6) AS other, round(b.{x} - a.{x}, 6) + 0.0 AS difference, round(b.{x} / a.{x}, 6) AS preservation FROM a, b" for x in ("completeness", "validity", "uniqueness", "consistency", "quality")])))
def dq6_compare_quality(spark, sf):
    r = lineitem_roles(spark, sf)
    out = quality.compare_quality(dirty(r.reference), dirty(r.synthetic), SCORED_KEYS, NUMERIC, [*CATEGORICAL, "dirty"])
    return out.select("measure", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns[1:]])


# Schema


@query()
def sch1_table_structure(spark, sf):
    c = table(spark, sf, "customer")
    return schema_cmp.table_structure(c, c.drop("c_name").withColumn("c_acctbal", F.col("c_acctbal").cast("string")).withColumn("extra", F.lit(1)))


@query()
def sch1_structure_score(spark, sf):
    return schema_cmp.structure_score(sch1_table_structure(spark, sf))


@query()
def sch2_semantic_structure(spark, sf):
    c = table(spark, sf, "customer")
    return schema_cmp.semantic_structure(c, c.drop("c_name").withColumn("c_acctbal", F.col("c_acctbal").cast("string")))
