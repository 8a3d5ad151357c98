"""Queries over similarity of columns, pairs and whole rows, privacy and detectability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as a
from ..operators import detect, multivariate, nn, prep, privacy
from ..operators import univariate as u
from .base import query, table, union_sql
from .registry import Columns, evaluate
from .roles import CATEGORICAL, NUMERIC, lineitem_roles, with_roles

NUM = [*NUMERIC]
CAT = [*CATEGORICAL]


def pair(spark, sf):
    r = lineitem_roles(spark, sf)
    return r.reference, r.synthetic


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def num_long(role: str, columns=NUM) -> str:
    return union_sql([f"SELECT '{c}' AS \"column\", cast({c} AS DOUBLE) AS value FROM {role} WHERE {c} IS NOT NULL" for c in columns])


def cat_long(role: str, columns=CAT) -> str:
    return union_sql([f"SELECT '{c}' AS \"column\", cast({c} AS VARCHAR) AS value FROM {role}" for c in columns])


def values_sql(kind) -> str:
    return f"SELECT \"column\", value, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 's') AS s FROM (SELECT *, 'r' AS side FROM ({kind('reference')}) UNION ALL SELECT *, 's' FROM ({kind('synthetic')})) GROUP BY 1, 2"


ECDF = f"WITH v AS ({values_sql(num_long)}), e AS (SELECT *, sum(r) OVER w / sum(r) OVER (PARTITION BY \"column\") AS fr, sum(s) OVER w / sum(s) OVER (PARTITION BY \"column\") AS fs, lead(value) OVER w AS following FROM v WINDOW w AS (PARTITION BY \"column\" ORDER BY value))"
SHARES = "SELECT *, r / sum(r) OVER (PARTITION BY \"column\") AS p, s / sum(s) OVER (PARTITION BY \"column\") AS q FROM ({})"
JSD = "SELECT \"column\", round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS distance FROM ({}) GROUP BY 1"


@query(with_roles(f"{ECDF} SELECT \"column\", round(1 - max(abs(fr - fs)), 6) AS score FROM e GROUP BY 1"))
def uni1_ks_complement(spark, sf):
    return rounded(u.ks_complement(*pair(spark, sf), NUM), "score")


@query(with_roles("SELECT \"column\", round(1 - sum(abs(p - q)) / 2, 6) AS score FROM (" + SHARES.format(values_sql(cat_long)) + ") GROUP BY 1"))
def uni2_tv_complement(spark, sf):
    return rounded(u.tv_complement(*pair(spark, sf), CAT), "score")


@query(with_roles(f"SELECT s.\"column\", round(avg(CASE WHEN value BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6) AS score FROM ({num_long('synthetic')}) s JOIN (SELECT \"column\", min(value) AS low, max(value) AS high FROM ({num_long('reference')}) GROUP BY 1) e USING (\"column\") GROUP BY 1"))
def uni3_boundary_adherence(spark, sf):
    return rounded(u.boundary_adherence(*pair(spark, sf), NUM), "score")


@query(with_roles(f"SELECT \"column\", round(sum(CASE WHEN r > 0 THEN s ELSE 0 END) / sum(s), 6) AS score FROM ({values_sql(cat_long)}) GROUP BY 1"))
def uni4_category_adherence(spark, sf):
    return rounded(u.category_adherence(*pair(spark, sf), CAT), "score")


def binned_sql(values: str, edges: str, outside: bool) -> str:
    keep = "" if outside else "WHERE value BETWEEN low AND high"
    return f"SELECT \"column\", least(greatest(coalesce(floor((value - low) / nullif(high - low, 0) * bins), 0), 0), bins - 1) AS b, sum(r) AS r, sum(s) AS s FROM ({values}) JOIN ({edges}) USING (\"column\") {keep} GROUP BY 1, 2"


WIDTH_EDGES = f"SELECT \"column\", min(value) AS low, max(value) AS high, 10 AS bins FROM ({values_sql(num_long)}) GROUP BY 1"


@query(with_roles(JSD.format(SHARES.format(binned_sql(values_sql(num_long), WIDTH_EDGES, True)))))
def uni5_jsd_equal_width(spark, sf):
    return rounded(u.jsd_equal_width(*pair(spark, sf), NUM), "distance")


def ev_long(role: str) -> str:
    return f"SELECT 'value' AS \"column\", value FROM events WHERE event_id % 2 = {0 if role == 'reference' else 1}"


DOANE = ("SELECT \"column\", min(value) AS low, max(value) AS high, cast(least(greatest(floor(1 + log2(count(*)) + log2(1 + abs(skewness(value)) / sqrt(6.0 * (count(*) - 2) / ((count(*) + 1.0) * (count(*) + 3.0))))), 10), 50) AS BIGINT) AS bins "
         f"FROM ({ev_long('reference')}) GROUP BY 1")  # fmt: skip


@query(JSD.format(SHARES.format(binned_sql(values_sql(ev_long), DOANE, False))))
def uni6_jsd_adaptive(spark, sf):
    e = table(spark, sf, "events")
    return rounded(u.jsd_adaptive(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["value"]), "distance")


@query(with_roles(JSD.format(SHARES.format(f"SELECT * FROM ({values_sql(cat_long)}) WHERE value IS NOT NULL"))))
def uni7_jsd_categorical(spark, sf):
    return rounded(u.jsd_categorical(*pair(spark, sf), CAT), "distance")


MIXED_EDGES = f"SELECT \"column\", min(value) AS low, max(value) AS high, 10 AS bins, count(*) AS d FROM ({values_sql(num_long)}) GROUP BY 1"


@query(with_roles(JSD.format(SHARES.format(f"SELECT \"column\", value AS b, r, s FROM ({values_sql(num_long)}) WHERE \"column\" IN (SELECT \"column\" FROM ({MIXED_EDGES}) WHERE d <= 10) UNION ALL " + binned_sql(values_sql(num_long), f"SELECT * FROM ({MIXED_EDGES}) WHERE d > 10", True)))))
def uni8_jsd_mixed(spark, sf):
    return rounded(u.jsd_mixed(*pair(spark, sf), NUM), "distance")


@query(with_roles(f"{ECDF} SELECT \"column\", round(coalesce(sum(abs(fr - fs) * (following - value)), 0) / (max(value) FILTER (r > 0) - min(value) FILTER (r > 0)), 6) AS distance FROM e GROUP BY 1"))
def uni9_wasserstein_1d(spark, sf):
    return rounded(u.wasserstein_1d(*pair(spark, sf), NUM), "distance")


def _nulls(c: str, role: str) -> str:
    return f"(SELECT count(*) - count({c}) FROM {role})"


@query(with_roles(union_sql([f"SELECT '{c}' AS \"column\", {_nulls(c, 'reference')} AS real_nulls, cast({_nulls(c, 'reference')} AS DOUBLE) / (SELECT count(*) FROM reference) AS real_rate, {_nulls(c, 'synthetic')} AS synthetic_nulls, cast({_nulls(c, 'synthetic')} AS DOUBLE) / (SELECT count(*) FROM synthetic) AS synthetic_rate" for c in (*CAT, *NUM)])))
def uni10_missingness(spark, sf):
    return u.missingness_compare(*pair(spark, sf), [*CAT, *NUM])


@query(with_roles(f"{ECDF} SELECT \"column\", CASE WHEN s >= 0.9 THEN 'excellent' WHEN s >= 0.8 THEN 'good' WHEN s >= 0.7 THEN 'fair' WHEN s >= 0.5 THEN 'poor' ELSE 'very poor' END AS reading FROM (SELECT \"column\", 1 - max(abs(fr - fs)) AS s FROM e GROUP BY 1)"))
def uni11_shape_interpretation(spark, sf):
    return u.ks_complement(*pair(spark, sf), NUM).select("column", u.shape_interpretation(F.col("score")).alias("reading"))


# Pairs


def sorted_pairs(xs):
    xs = sorted(xs)
    return [(x, y) for i, x in enumerate(xs) for y in xs[i + 1 :]]


def pearson_sql(role: str, signed: bool = True) -> str:
    f = "{}" if signed else "abs({})"
    return union_sql([f"SELECT '{x}' AS column_1, '{y}' AS column_2, {f.format(f'corr({x}, {y})')} AS value, count(*) AS n FROM {role} WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in sorted_pairs(NUM)])


@query(with_roles(f"SELECT column_1, column_2, round(value, 6) AS value, n FROM ({pearson_sql('synthetic', False)})"))
def asc1_pearson_matrix(spark, sf):
    return rounded(a.pearson_matrix(lineitem_roles(spark, sf).synthetic, NUM), "value")


def cramer_sql(x: str, y: str, source: str) -> str:
    """All cells of the table, empty ones too; Yates's correction on two by two."""
    return f"""SELECT '{x}' AS column_1, '{y}' AS column_2, CASE WHEN least(max(rc), max(cc)) = 1 THEN 0 ELSE sqrt(sum(CASE WHEN rc = 2 AND cc = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE pow(o - e, 2) / e END) / (max(n) * nullif(least(max(rc), max(cc)) - 1, 0))) END AS value, max(n) AS n FROM (
SELECT coalesce(o, 0) AS o, na * nb / cast(n AS DOUBLE) AS e, n, rc, cc FROM (SELECT {x} AS ka, count(*) AS na FROM {source} GROUP BY 1), (SELECT {y} AS kb, count(*) AS nb FROM {source} GROUP BY 1), (SELECT count(*) AS n, count(DISTINCT {x}) AS rc, count(DISTINCT {y}) AS cc FROM {source})
LEFT JOIN (SELECT {x} AS oa, {y} AS ob, count(*) AS o FROM {source} GROUP BY 1, 2) ON oa = ka AND ob = kb)"""


PART = "(SELECT p_brand, p_type, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS big, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS even FROM part)"
PART_CATS = ["p_brand", "p_type", "big", "even"]


def part_cats(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type", F.when(F.col("p_size") > 25, "big").otherwise("small").alias("big"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("even"), "p_size", "p_retailprice")


@query("SELECT column_1, column_2, round(value, 6) AS value, n FROM (" + union_sql([cramer_sql(x, y, PART) for x, y in sorted_pairs(PART_CATS)]) + ")")
def asc2_cramers_v(spark, sf):
    return rounded(a.cramers_v_matrix(part_cats(spark, sf), PART_CATS), "value")


def eta_sql(c: str, x: str, role: str, names=None) -> str:
    n1, n2 = names or (c, x)
    return f"SELECT '{n1}' AS column_1, '{n2}' AS column_2, CASE WHEN max(t) > 0 THEN sqrt(sum(k * pow(m - mean, 2)) / max(t)) ELSE 0 END AS value, cast(sum(k) AS BIGINT) AS n FROM (SELECT {c}, count(*) AS k, avg({x}) AS m FROM {role} WHERE {x} IS NOT NULL AND {c} IS NOT NULL GROUP BY 1), (SELECT avg({x}) AS mean, var_pop({x}) * count(*) AS t FROM {role} WHERE {x} IS NOT NULL AND {c} IS NOT NULL)"


@query(with_roles("SELECT column_1, column_2, round(value, 6) AS value, n FROM (" + union_sql([eta_sql(c, x, "synthetic") for c in CAT for x in NUM]) + ")"))
def asc3_correlation_ratio(spark, sf):
    return rounded(a.correlation_ratio_matrix(lineitem_roles(spark, sf).synthetic, CAT, NUM), "value")


def assoc_sql(role: str) -> str:
    mixed = union_sql([eta_sql(c, x, role, sorted((c, x))) for c in CAT for x in NUM])
    return f"SELECT *, 'numeric' AS kind FROM ({pearson_sql(role, False)}) UNION ALL SELECT *, 'categorical' FROM ({cramer_sql('l_linestatus', 'l_returnflag', role)}) UNION ALL SELECT *, 'mixed' FROM ({mixed})"


DATED = union_sql([f"SELECT '{x}' AS column_1, '{y}' AS column_2, cast(NULL AS DOUBLE) AS value, cast(0 AS BIGINT) AS n, 'datetime' AS kind" for x, y in sorted_pairs([*CAT, *NUM, "l_shipdate"]) if "l_shipdate" in (x, y)])


@query(with_roles(f"SELECT column_1, column_2, round(value, 6) AS value, n, kind FROM ({assoc_sql('synthetic')} UNION ALL {DATED})"))
def asc4_association_matrix(spark, sf):
    return rounded(a.association_matrix(lineitem_roles(spark, sf).synthetic, CAT, NUM, ["l_shipdate"]), "value")


CORR_SIM = f"SELECT column_1, column_2, 1 - abs(r.value - s.value) / 2 AS score FROM ({pearson_sql('reference')}) r JOIN ({pearson_sql('synthetic')}) s USING (column_1, column_2)"


@query(with_roles(f"SELECT column_1, column_2, round(score, 6) AS score FROM ({CORR_SIM})"))
def asc5_correlation_similarity(spark, sf):
    return rounded(a.correlation_similarity(*pair(spark, sf), NUM), "score")


def binned_sql(c: str) -> str:
    low, high = f"(SELECT min({c}) FROM reference)", f"(SELECT max({c}) FROM reference)"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(floor(({c} - {low}) / ({high} - {low}) * 10) + 1, 1), 10) END"


def _joint(x: str, y: str) -> str:
    e = {c: binned_sql(c) if c in NUM else c for c in (x, y)}
    side = lambda role: f"SELECT {e[x]} AS a, {e[y]} AS b, count(*) / sum(count(*)) OVER () AS p FROM {role} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2"
    return f"SELECT '{x}' AS column_1, '{y}' AS column_2, 1 - sum(abs(coalesce(r.p, 0) - coalesce(s.p, 0))) / 2 AS score FROM ({side('reference')}) r FULL JOIN ({side('synthetic')}) s ON r.a = s.a AND r.b = s.b"


CONT_SIM = union_sql([_joint(*sorted(p)) for p in [("l_returnflag", "l_linestatus"), *[(c, x) for c in CAT for x in NUM]]])


@query(with_roles(f"SELECT column_1, column_2, round(score, 6) AS score FROM ({CONT_SIM})"))
def asc6_contingency_similarity(spark, sf):
    return rounded(a.contingency_similarity(*pair(spark, sf), CAT, NUM), "score")


KS_TV = f"WITH ks AS ({ECDF} SELECT \"column\", 1 - max(abs(fr - fs)) AS score FROM e GROUP BY 1), tv AS (SELECT \"column\", 1 - sum(abs(p - q)) / 2 AS score FROM ({SHARES.format(values_sql(cat_long))}) GROUP BY 1)"


@query(with_roles(f"{KS_TV} SELECT round(x, 6) AS column_shapes, round(y, 6) AS column_pair_trends, round((x + y) / 2, 6) AS overall FROM (SELECT avg(score) AS x FROM (FROM ks UNION ALL FROM tv)), (SELECT avg(score) AS y FROM (({CORR_SIM}) UNION ALL ({CONT_SIM})))"))
def asc7_quality_report(spark, sf):
    return rounded(a.quality_report(*pair(spark, sf), CAT, NUM), "column_shapes", "column_pair_trends", "overall")


_R, _S, _Q = "real_association", "synthetic_association", "quality"
DIAG = f"""SELECT *, CASE WHEN {_R} IS NULL OR {_S} IS NULL OR {_Q} IS NULL THEN '-' WHEN {_R} >= 0.7 AND {_Q} >= 0.8 THEN '✓' WHEN {_R} < 0.3 AND {_S} < 0.3 THEN '✓' WHEN {_R} >= 0.5 AND {_Q} >= 0.65 THEN '✓' WHEN {_R} >= 0.7 AND {_Q} < 0.6 THEN '✗' ELSE '⚠' END AS flag,
CASE WHEN n >= 1000 THEN '✓' WHEN n >= 500 THEN '⚠' WHEN n >= 50 THEN '✗' ELSE '-' END AS confidence,
CASE WHEN {_R} IS NULL OR {_S} IS NULL OR {_Q} IS NULL THEN 'Insufficient data' WHEN {_R} >= 0.8 AND {_Q} >= 0.85 THEN 'Strong correlation well preserved' WHEN {_R} >= 0.7 AND {_Q} >= 0.75 THEN 'Strong correlation preserved'
WHEN {_R} < 0.25 AND {_S} < 0.25 THEN 'Weak correlation correctly reproduced' WHEN {_R} >= 0.7 AND {_Q} < 0.5 THEN 'Model failed to capture strong trend' WHEN {_S} >= 0.7 AND {_R} < 0.4 AND {_Q} < 0.5 THEN 'Synthetic created spurious correlation'
WHEN {_R} >= 0.5 AND {_Q} >= 0.65 THEN 'Moderate correlation preserved' WHEN {_R} < 0.3 THEN 'Weak correlation correctly reproduced' ELSE 'Mixed quality' END AS diagnosis FROM (
SELECT r.column_1, r.column_2, r.kind, r.value AS real_association, r.n, s.value AS synthetic_association, t.score AS quality FROM ({assoc_sql('reference')}) r JOIN ({assoc_sql('synthetic')}) s USING (column_1, column_2) LEFT JOIN (({CORR_SIM}) UNION ALL ({CONT_SIM})) t USING (column_1, column_2))"""


@query(with_roles(f"SELECT * REPLACE (round(real_association, 6) AS real_association, round(synthetic_association, 6) AS synthetic_association, round(quality, 6) AS quality) FROM ({DIAG})"))
def asc8_pair_diagnostics(spark, sf):
    return rounded(a.pair_diagnostics(*pair(spark, sf), CAT, NUM), "real_association", "synthetic_association", "quality")


@query(with_roles(f"WITH d AS ({DIAG}) SELECT 'lowest' AS \"end\", cast(row_number() OVER (ORDER BY quality, column_1, column_2) AS INTEGER) AS rank, column_1, column_2, round(quality, 6) AS quality FROM d QUALIFY rank <= 3 UNION ALL SELECT 'highest', cast(row_number() OVER (ORDER BY quality DESC, column_1, column_2) AS INTEGER) AS rank, column_1, column_2, round(quality, 6) FROM d QUALIFY rank <= 3"))
def asc9_extreme_pairs(spark, sf):
    return rounded(a.extreme_pairs(a.pair_diagnostics(*pair(spark, sf), CAT, NUM), 3), "quality")


# Vectors


def embedded(spark, sf):
    """Real and synthetic halves of the embeddings."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


VEC = "SELECT vec_id AS id, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 2 = {}"
DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
ALL_PAIRS = f"SELECT a.id, b.id AS other, {DIST} AS d FROM ({{a}}) a, ({{b}}) b"
R, S = VEC.format(0), VEC.format(1)


def knn_sql(a_: str, b_: str, k: int, own: bool = False) -> str:
    return f"SELECT id, cast(rank AS INTEGER) AS rank, other, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM ({ALL_PAIRS.format(a=a_, b=b_)}) {'WHERE id <> other' if own else ''}) WHERE rank <= {k}"


@query(f"SELECT id, rank, other AS neighbour, round(d, 6) AS distance FROM ({knn_sql(S, R, 3)})")
def nn1_knn_join(spark, sf):
    r, s = embedded(spark, sf)
    return rounded(nn.knn_join(s.select("id", "v"), r.select("id", "v"), 3, block_rows=400), "distance")


def customers(spark, sf):
    """Halves of the customers as points that lie in clusters: their nation and segment far apart, and the balance within."""
    point = [F.col("c_nationkey") * 1e6, F.ascii("c_mktsegment") * 1e5, F.col("c_acctbal").cast("double")]
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(*[x.cast("double") for x in point]).alias("v"))
    return c.where("id % 2 = 0"), c.where("id % 2 = 1")


CLUSTERED = "SELECT c_custkey AS id, [c_nationkey * 1e6, ascii(c_mktsegment) * 1e5, cast(c_acctbal AS DOUBLE)] AS v FROM customer WHERE c_custkey % 2 = {}"


@query(f"SELECT id, rank, other AS neighbour, round(d, 4) AS distance FROM ({knn_sql(CLUSTERED.format(0), CLUSTERED.format(1), 4)})")
def nn1_knn_join_by_pivots(spark, sf):
    """Each cell of a pivot meets only the rows that can be neighbours of its own."""
    a_, b_ = customers(spark, sf)
    return rounded(nn.knn_join(a_, b_, 4, block_rows=500, by_pivots=True), "distance", digits=4)


@query(f"WITH rr AS (SELECT id, d AS radius FROM ({knn_sql(R, R, 5, True)}) WHERE rank = 5), ss AS (SELECT id, d AS radius FROM ({knn_sql(S, S, 5, True)}) WHERE rank = 5), sr AS ({ALL_PAIRS.format(a=S, b=R)}), "
       "i AS (SELECT sr.id, count(*) AS inside FROM sr JOIN rr ON sr.other = rr.id AND d <= radius GROUP BY 1), j AS (SELECT other AS id FROM sr JOIN ss ON sr.id = ss.id AND d <= radius GROUP BY 1), "
       "c AS (SELECT other, min(d) AS d FROM sr GROUP BY 1) SELECT round((SELECT count(*) FROM i) / (SELECT count(*) FROM ss), 6) AS precision, round((SELECT count(*) FROM j) / (SELECT count(*) FROM rr), 6) AS recall, "
       "round((SELECT sum(inside) FROM i) / ((SELECT count(*) FROM ss) * 5.0), 6) AS density, round((SELECT count(*) FROM c JOIN rr ON c.other = rr.id AND d <= radius) / (SELECT count(*) FROM rr), 6) AS coverage")  # fmt: skip
def mv1_prdc(spark, sf):
    r, s = embedded(spark, sf)
    return rounded(multivariate.prdc(r.select("id", "v"), s.select("id", "v")), "precision", "recall", "density", "coverage")


GRID = [i / 29 for i in range(30)]
_CENTER = "SELECT list(m ORDER BY k) AS v FROM (SELECT k, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS k FROM {0}) GROUP BY k)"
_LEVELS = f"SELECT unnest(quantile_cont(d, {GRID})) AS q, unnest(range(30)) AS i FROM {{0}}"


@query(f"WITH r AS ({R}), s AS ({S}), cr AS ({_CENTER.format('r')}), cs AS ({_CENTER.format('s')}), rd AS (SELECT a.id, {DIST} AS d FROM r a, cr b), srd AS (SELECT a.id, {DIST} AS d FROM s a, cr b), sd AS (SELECT a.id, {DIST} AS d FROM s a, cs b), "
       f"rq AS ({_LEVELS.format('rd')}), sq AS ({_LEVELS.format('sd')}), own AS ({knn_sql('SELECT * FROM r', 'SELECT * FROM r', 1, True)}), near AS ({knn_sql('SELECT * FROM r', 'SELECT * FROM s', 1)}), back AS ({knn_sql('SELECT * FROM s', 'SELECT * FROM r', 1)}), "
       "covered AS (SELECT sd.d FROM near JOIN own ON near.id = own.id AND near.d <= own.d JOIN sd ON sd.id = near.other), "
       "a AS (SELECT 1 - sum(abs(i / 29.0 - share)) / 15 AS x FROM (SELECT i, avg(cast(d <= q AS INTEGER)) AS share FROM srd, rq GROUP BY i)), "
       "b AS (SELECT 1 - sum(abs(i / 29.0 - share)) / 15 AS x FROM (SELECT i, (SELECT count(*) FROM covered WHERE d <= q) / cast((SELECT count(*) FROM r) AS DOUBLE) AS share FROM sq)) "
       "SELECT round((SELECT x FROM a), 6) + 0.0 AS delta_precision_alpha, round((SELECT x FROM b), 6) + 0.0 AS delta_coverage_beta, round((SELECT avg(cast(back.d > own.d AS INTEGER)) FROM back JOIN own ON own.id = back.other), 6) + 0.0 AS authenticity")  # fmt: skip
def mv2_alpha_precision(spark, sf):
    r, s = embedded(spark, sf)
    return rounded(multivariate.alpha_precision_naive(r.select("id", "v"), s.select("id", "v"), 64), "delta_precision_alpha", "delta_coverage_beta", "authenticity")


def _means(role: str) -> str:
    return "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in NUM) + f" FROM {role}"


@query(with_roles(f"SELECT round({' + '.join(f'pow(r.{c} - s.{c}, 2)' for c in NUM)}, 6) AS mmd FROM ({_means('reference')}) r, ({_means('synthetic')}) s"))
def mv3_mmd_linear(spark, sf):
    return rounded(multivariate.mmd_linear(*pair(spark, sf), NUM), "mmd")


_KERNEL = "pow(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) + 1, 2)"


@query(f"WITH r AS ({R}), s AS ({S}) SELECT round((SELECT avg({_KERNEL}) FROM r a, r b) + (SELECT avg({_KERNEL}) FROM s a, s b) - 2 * (SELECT avg({_KERNEL}) FROM r a, s b), 6) + 0.0 AS mmd")
def mv4_mmd_polynomial(spark, sf):
    r, s = embedded(spark, sf)
    return rounded(multivariate.mmd_polynomial_vectors(r.select("v"), s.select("v")), "mmd")


@query()
def mv5_mmd_rbf_features(spark, sf):
    r, s = (prep.minmax_scale(x.select(*NUM).na.drop(), NUM) for x in pair(spark, sf))
    return multivariate.mmd_rbf_features(r, s, NUM)


_RBF = "exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"WITH r AS ({R}), s AS ({S}) SELECT round((SELECT avg({_RBF}) FROM r a, r b) + (SELECT avg({_RBF}) FROM s a, s b) - 2 * (SELECT avg({_RBF}) FROM r a, s b), 6) + 0.0 AS mmd")
def mv5_mmd_rbf(spark, sf):
    """Over all pairs of rows."""
    return rounded(multivariate.mmd_rbf(*embedded(spark, sf), block_rows=400), "mmd")


@query()
def mv6_sliced_wasserstein(spark, sf):
    r, s = (x.select(*NUM).na.drop() for x in pair(spark, sf))
    return multivariate.sliced_wasserstein(prep.minmax_scale(r, NUM), prep.minmax_scale(s, NUM, r), NUM)


@query(f"SELECT id, round(d, 6) AS distance FROM ({knn_sql(S, R, 1)})")
def mv7_dcr(spark, sf):
    r, s = embedded(spark, sf)
    return rounded(multivariate.dcr(s.select("id", "v"), r.select("id", "v")), "distance")


def halves_of_customers(spark, sf):
    """Real and synthetic customers of numbers and categories, some missing."""
    c = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE cast(c_acctbal AS DOUBLE) END AS balance", "cast(c_nationkey AS DOUBLE) AS nation", "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS segment")
    return c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1")


_CUSTOMERS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE cast(c_acctbal AS DOUBLE) END AS balance, cast(c_nationkey AS DOUBLE) AS nation, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer"
_DRAW = "cast(('0x' || substr(md5(cast(id AS VARCHAR) || '|{c}|0'), 1, 8)) AS BIGINT) / 4294967296.0"
_MIXED_SQL = f"""real AS (SELECT * FROM ({_CUSTOMERS}) WHERE id % 2 = 0), fake AS (SELECT * FROM ({_CUSTOMERS}) WHERE id % 2 = 1),
ends AS (SELECT min(balance) AS bl, max(balance) AS bh, min(nation) AS nl, max(nation) AS nh FROM real),
kinds AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS place FROM (SELECT DISTINCT segment FROM real WHERE segment IS NOT NULL)),
drawn AS (SELECT i.id, bl + (bh - bl) * {_DRAW.format(c='balance')} AS balance, nl + (nh - nl) * {_DRAW.format(c='nation')} AS nation, cast(floor({_DRAW.format(c='segment')} * (SELECT count(*) FROM kinds)) AS BIGINT) AS place FROM (SELECT unnest(range((SELECT count(*) FROM fake))) AS id) i, ends),
random AS (SELECT id, balance, nation, segment FROM drawn JOIN kinds USING (place)),
all_of AS (SELECT 's' AS side, * FROM fake UNION ALL SELECT 'b', * FROM random),
closest AS (SELECT side, a.id, min((CASE WHEN a.balance IS NULL OR r.balance IS NULL THEN cast((a.balance IS NULL) <> (r.balance IS NULL) AS DOUBLE) ELSE least(abs(a.balance - r.balance) / (bh - bl), 1) END + least(abs(a.nation - r.nation) / (nh - nl), 1) + cast(a.segment IS DISTINCT FROM r.segment AS DOUBLE)) / 3) AS d FROM all_of a, real r, ends GROUP BY 1, 2)"""


@query(f"WITH {_MIXED_SQL} SELECT id, round(d, 6) + 0.0 AS distance FROM closest WHERE side = 's'")
def mv7_dcr_mixed(spark, sf):
    """Numbers by their range, categories by equality, a NULL far from all but a NULL."""
    r, s = (multivariate.mixed_vectors(x, "c_custkey", ["balance", "nation"], ["segment"], halves_of_customers(spark, sf)[0]) for x in halves_of_customers(spark, sf))
    return rounded(multivariate.dcr(s, r, metric=("mixed", 2)), "distance")


@query(f"WITH {_MIXED_SQL}, m AS (SELECT median(d) FILTER (side = 's') AS s, median(d) FILTER (side = 'b') AS b FROM closest) SELECT round(s, 6) + 0.0 AS synthetic_median, round(b, 6) + 0.0 AS baseline_median, round(least(1, s / b), 6) AS protection FROM m")
def mv8_dcr_protection(spark, sf):
    real, fake = halves_of_customers(spark, sf)
    numeric, categorical = ["balance", "nation"], ["segment"]
    base = multivariate.random_baseline(real, numeric, categorical, fake.count())
    vectors = [multivariate.mixed_vectors(x, key, numeric, categorical, real) for x, key in ((real, "c_custkey"), (fake, "c_custkey"), (base, "id"))]
    return rounded(multivariate.dcr_baseline_protection(*vectors, metric=("mixed", 2)), "synthetic_median", "baseline_median", "protection")


# Privacy

QI = ["c_nationkey", "c_mktsegment"]
_GROUPS = "SELECT c_nationkey, c_mktsegment, count(*) AS members FROM customer {} GROUP BY 1, 2"


@query(f"SELECT min(members) AS k, count(*) AS classes, cast(coalesce(sum(members) FILTER (members < 10), 0) AS BIGINT) AS rows_below FROM ({_GROUPS.format('')})")
def prv1_k_anonymity(spark, sf):
    return privacy.k_anonymity(table(spark, sf, "customer"), QI, 10)


@query(f"SELECT members, count(*) AS classes FROM ({_GROUPS.format('')}) GROUP BY 1")
def prv1_class_histogram(spark, sf):
    return privacy.class_histogram(table(spark, sf, "customer"), QI)


@query()
def prv2_k_anonymity_clustered(spark, sf):
    return privacy.k_anonymity_clustered(table(spark, sf, "customer"), ["c_nationkey", "c_acctbal"], (5, 10))


CUSTOMER_ROLES = {"population": "true", "training": "c_custkey % 4 < 2", "reference": "c_custkey % 4 = 2", "synthetic": "c_custkey % 4 = 3"}


def customer_roles(spark, sf):
    c = table(spark, sf, "customer")
    return {n: c.where(w) for n, w in CUSTOMER_ROLES.items()}


RATIOS_SQL = union_sql([f"SELECT '{x}' AS numerator, '{y}' AS denominator, (SELECT min(members) FROM ({_GROUPS.format('WHERE ' + CUSTOMER_ROLES[x])})) AS numerator_k, (SELECT min(members) FROM ({_GROUPS.format('WHERE ' + CUSTOMER_ROLES[y])})) AS denominator_k" for x, y in privacy.RATIOS])


@query(f"SELECT *, cast(numerator_k AS DOUBLE) / denominator_k AS ratio FROM ({RATIOS_SQL})")
def prv3_k_ratios(spark, sf):
    return privacy.k_ratios(customer_roles(spark, sf), QI)


@query(f"SELECT numerator, denominator, CASE WHEN numerator_k >= 10 THEN 'Excellent' WHEN numerator_k >= 5 THEN 'Good' WHEN numerator_k >= 3 THEN 'Moderate' ELSE 'Poor' END AS k_reading, CASE WHEN r > 1.5 THEN 'Much better privacy' WHEN r > 1.1 THEN 'Better privacy' WHEN r > 0.9 THEN 'Similar privacy' WHEN r > 0.7 THEN 'Worse privacy' ELSE 'Much worse privacy' END AS ratio_reading FROM (SELECT *, cast(numerator_k AS DOUBLE) / denominator_k AS r FROM ({RATIOS_SQL}))")
def prv4_interpretation(spark, sf):
    out = privacy.k_ratios(customer_roles(spark, sf), QI)
    return out.select("numerator", "denominator", privacy.interpret_k(F.col("numerator_k")).alias("k_reading"), privacy.interpret_ratio(F.col("ratio")).alias("ratio_reading"))


@query()
def prv5_qi_check(spark, sf):
    roles = customer_roles(spark, sf)
    found = privacy.qi_check({**roles, "training": roles["training"].drop("c_mktsegment")}, QI)
    usable = {n: df for n, df in roles.items() if found[n] == "ok"}
    return privacy.k_ratios(usable, QI)


# Detection

SCORED = "SELECT doc_id, cast(n_chars AS DOUBLE) AS score, cast(quality AS DOUBLE) AS label, lang FROM documents JOIN labels USING (doc_id)"
AUC = "SELECT {by} sum(CASE WHEN label = 1 THEN ranks ELSE 0 END) AS rp, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY score) + (count(*) OVER (PARTITION BY {part}, score) - 1) / 2.0 AS ranks FROM ({src})) {group}"


def scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")


@query("SELECT round((rp - p * (p + 1) / 2.0) / (cast(p AS DOUBLE) * n), 6) AS auc, p AS positives, n AS negatives FROM (" + AUC.format(by="", part="1", src=SCORED, group="") + ")")
def auc1_auroc(spark, sf):
    return rounded(detect.auroc(scored(spark, sf), "score", "label"), "auc").withColumns({c: F.col(c).cast("long") for c in ("positives", "negatives")})


def detect_data(spark, sf):
    columns = ["l_quantity", "l_discount", "l_tax"]
    r, s = (x.withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")) for x in pair(spark, sf))
    return detect.labelled(r, s, columns, "row")


@query()
def det1_linear(spark, sf):
    return detect.detect_linear(detect_data(spark, sf), "row")


@query()
def det2_boosted(spark, sf):
    return detect.detect_boosted(detect_data(spark, sf), "row")


@query()
def det3_mlp(spark, sf):
    return detect.detect_mlp(detect_data(spark, sf), "row")


@query()
def det4_gmm(spark, sf):
    return detect.detect_gmm(detect_data(spark, sf), "row", folds=2, components=2)


_LANG_AUC = "SELECT round(avg(auc), 6) AS auc, count(*) AS methods FROM (SELECT (rp - p * (p + 1) / 2.0) / nullif(cast(p AS DOUBLE) * n, 0) AS auc FROM (" + AUC.format(by="lang,", part="lang", src=SCORED, group="GROUP BY lang") + ")) WHERE auc IS NOT NULL"


@query(_LANG_AUC)
def det5_ensemble(spark, sf):
    by = detect.auroc(scored(spark, sf), "score", "label", by=["lang"]).select(F.col("lang").alias("method"), F.lit(0).alias("fold"), "auc")
    return rounded(detect.ensemble_detection(by), "auc")


@query()
def det5_ensemble_of_detectors(spark, sf):
    """Linear and mixture detectors over the roles, put together."""
    data = detect_data(spark, sf)
    found = detect.detect_linear(data, "row", folds=3).withColumn("method", F.lit("linear")).unionByName(detect.detect_gmm(data, "row", folds=3, components=2).withColumn("method", F.lit("mixture")))
    return detect.ensemble_detection(found)


@query()
def exp14_evaluate(spark, sf):
    names = ["ks_complement", "tv_complement", "boundary_adherence", "category_adherence", "jsd_equal_width", "wasserstein_1d", "correlation_similarity", "contingency_similarity", "jsd_adaptive", "jsd_categorical", "jsd_mixed", "mmd_linear", "mmd_polynomial", "mmd_rbf", "sliced_wasserstein", "new_row_synthesis", "structure", "k_anonymity", "absent"]
    return evaluate(lineitem_roles(spark, sf), Columns(CATEGORICAL, NUMERIC, "l_orderkey * 10 + l_linenumber"), names)
