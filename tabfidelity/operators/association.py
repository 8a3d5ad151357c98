"""Association of columns pair by pair, and how well a synthetic table keeps it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.comoments import co_moments, correlation
from ..functions.keys import ratio
from .univariate import ks_complement, tv_complement

#: Pairs in one aggregate, so that generated code stays within limits.
CHUNK = 100


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_1, column_2, value, n): signed correlation over rows where both are there; NULL if constant or n < 2."""
    pairs, out = list(combinations(sorted(columns), 2)), None
    for i in range(0, len(pairs), CHUNK):
        some = pairs[i : i + CHUNK]
        there = {p: F.col(p[0]).isNotNull() & F.col(p[1]).isNotNull() for p in some}
        aggs = []
        for k, p in enumerate(some):
            x, y = (F.when(there[p], F.col(c).cast("double")) for c in p)
            varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
            aggs += [F.when(varies, F.corr(x, y)).alias(f"r{k}"), F.count_if(there[p]).alias(f"n{k}")]
        rows = F.array(*[F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.col(f"r{k}").alias("value"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(some)])
        part = df.agg(*aggs).select(F.inline(rows))
        out = part if out is None else out.unionAll(part)
    return out


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pearson_pairs() without the sign."""
    return pearson_pairs(df, columns).withColumn("value", F.abs("value"))


def _pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_1, column_2, a, b, o): how often two values meet, NULLs left out."""
    cells = F.array(*[F.struct(F.lit(x).alias("column_1"), F.lit(y).alias("column_2"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b")) for x, y in pairs])
    long = df.select(*by, F.inline(cells)).where("a is not null and b is not null")
    return long.groupBy(*by, "column_1", "column_2", "a", "b").agg(F.count("*").alias("o"))


def cramers_v_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_1, column_2, value, n): root of chi-square over n and the smaller side less one; 0 if a side has one value.

    Chi-square is the sum of O^2/E less n, so that empty cells need no rows; two by two tables take Yates's correction.
    """
    pair = ("column_1", "column_2")
    o = _pair_counts(df, list(combinations(sorted(columns), 2)))
    a = o.groupBy(*pair, "a").agg(F.sum("o").alias("na"))
    b = o.groupBy(*pair, "b").agg(F.sum("o").alias("nb"))
    whole = o.groupBy(*pair).agg(F.sum("o").alias("n"), F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("cols"))
    cells = o.join(a, [*pair, "a"]).join(b, [*pair, "b"]).join(whole, list(pair))
    e = F.col("na") * F.col("nb") / F.col("n")
    stats = cells.groupBy(*pair, "n", "rows", "cols").agg(F.sum(F.col("o") * F.col("o") / e).alias("fit"), F.max(F.when((F.col("rows") == 2) & (F.col("cols") == 2), F.abs(F.col("o") - e))).alias("off"), F.sum(1 / e).alias("inverse"), F.count("*").alias("filled"))
    # In a two by two table all four cells are off by the same amount; an empty cell adds its own 1/E.
    margins = a.join(b, list(pair)).join(whole.where("rows = 2 and cols = 2"), list(pair)).groupBy(*pair).agg(F.sum(F.col("n") / (F.col("na") * F.col("nb"))).alias("inverse_all"))
    stats = stats.join(margins, list(pair), "left")
    off = F.col("off") - F.least(F.lit(0.5), F.col("off"))
    chi = F.when(F.col("off").isNotNull(), off * off * F.col("inverse_all")).otherwise(F.greatest(F.col("fit") - F.col("n"), F.lit(0.0)))
    side = F.least("rows", "cols") - 1
    value = F.when(side == 0, 0.0).otherwise(F.sqrt(chi / (F.col("n") * F.nullif(side, F.lit(0)))))
    return stats.select(*pair, value.alias("value"), "n")


def correlation_ratio_matrix(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(column_1, column_2, value, n): the root of the variance between categories over all; 0 for a constant. column_1 is the category."""
    pair = ("column_1", "column_2")
    cells = F.array(*[F.struct(F.lit(c).alias("column_1"), F.lit(x).alias("column_2"), F.col(c).cast("string").alias("a"), F.col(x).cast("double").alias("x")) for c, x in product(categorical, numeric)])
    groups = df.select(F.inline(cells)).where("a is not null and x is not null").groupBy(*pair, "a").agg(F.count("*").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy(*pair)
    groups = groups.withColumn("n", F.sum("k").over(w)).withColumn("mean", F.sum(F.col("k") * F.col("m")).over(w) / F.col("n"))
    between = F.sum(F.col("k") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
    total = between + F.sum(F.col("k") * F.col("v"))
    return groups.groupBy(*pair, "n").agg(F.when(total > 0, F.sqrt(between / F.nullif(total, F.lit(0.0)))).otherwise(0.0).alias("value")).select(*pair, "value", "n")


def association_matrix(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], datetime: Sequence[str] = ()) -> DataFrame:
    """(column_1, column_2, value, n, kind), each pair once, column_1 before column_2; pairs with a date are NULL."""
    parts = []
    if len(numeric) > 1:
        parts.append(pearson_matrix(df, numeric).withColumn("kind", F.lit("numeric")))
    if len(categorical) > 1:
        parts.append(cramers_v_matrix(df, categorical).withColumn("kind", F.lit("categorical")))
    if categorical and numeric:
        mixed = correlation_ratio_matrix(df, categorical, numeric).withColumn("kind", F.lit("mixed"))
        parts.append(mixed.select(F.least("column_1", "column_2").alias("column_1"), F.greatest("column_1", "column_2").alias("column_2"), "value", "n", "kind"))
    dated = [tuple(sorted(p)) for p in combinations([*categorical, *numeric, *datetime], 2) if set(p) & set(datetime)]
    if dated:
        rows = F.array(*[F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n"), F.lit("datetime").alias("kind")) for a, b in dated])
        parts.append(df.sparkSession.range(1, numPartitions=1).select(F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlation_similarity(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_1, column_2, score): one less half the difference of the signed correlations."""
    r, s = pearson_pairs(real, columns), pearson_pairs(synthetic, columns).withColumnsRenamed({"value": "other", "n": "m"})
    return r.join(s, ["column_1", "column_2"]).select("column_1", "column_2", (1 - F.abs(F.col("value") - F.col("other")) / 2).alias("score"))


def column_means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Shifts for co_moments(): 0 for a column without numbers."""
    there = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    means = df.agg(*[F.avg(there(c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return [x if x is not None and abs(x) < float("inf") else 0.0 for x in means]


def correlation_similarity_by(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., column_1, column_2, score): correlation_similarity() of every run of the synthetic table, one pass over either table.

    A real table that has the run columns meets each run with its own rows, one without them serves all runs.
    """
    columns = sorted(columns)
    shifts = column_means(real, columns)
    own = [b for b in by if b in real.columns]
    sides = [co_moments(df, columns, keys, shifts).where("i < j").select(*keys, "i", "j", correlation().alias(side)) for df, keys, side in ((real, own, "r"), (synthetic, [*by], "s"))]
    names = F.array(*[F.lit(c) for c in columns])
    both = sides[1].join(sides[0], [*own, "i", "j"])
    return both.select(*by, F.get(names, F.col("i")).alias("column_1"), F.get(names, F.col("j")).alias("column_2"), (1 - F.abs(F.col("r") - F.col("s")) / 2).alias("score"))


def discretised(df: DataFrame, fit_on: DataFrame, numeric: Sequence[str], bins: int = 10) -> DataFrame:
    """Numbers as bins between the ends of fit_on."""
    from .membership import bin_numeric, numeric_ranges

    return bin_numeric(df, numeric_ranges(fit_on, numeric), numeric, bins)


def contingency_similarity(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str], numeric: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(column_1, column_2, score): one less half the summed differences of joint shares; numbers are binned by the real ends.

    Pairs of two numbers are left to correlation_similarity().
    """
    pairs = [tuple(sorted(p)) for p in [*combinations(categorical, 2), *product(categorical, numeric)]]
    pair, sides, whole = ["column_1", "column_2"], [], Window.partitionBy("column_1", "column_2")
    for df, name in ((real, "r"), (synthetic, "s")):
        df = discretised(df, real, numeric, bins) if numeric else df
        sides.append(_pair_counts(df, pairs).withColumn(f"n_{name}", F.sum("o").over(whole)).withColumnRenamed("o", name))
    both = sides[0].join(sides[1], [*pair, "a", "b"], "full")
    # In whole numbers, so that equal scores are equal whatever the order of the sums; a side without rows has shares of 0.
    number = lambda c, empty: F.coalesce(c, F.lit(empty)).cast("decimal(18,0)")
    both = both.select(*pair, *[number(F.col(c), 0).alias(c) for c in "rs"], *[number(F.max(c).over(whole), 1).alias(c) for c in ("n_r", "n_s")])
    gap = F.sum(F.abs(F.col("r") * F.col("n_s") - F.col("s") * F.col("n_r"))).cast("double")
    return both.groupBy(*pair, "n_r", "n_s").agg(gap.alias("gap")).select(*pair, (1 - F.col("gap") / F.col("n_r").cast("double") / F.col("n_s").cast("double") / 2).alias("score"))


def contingency_similarity_by(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str], numeric: Sequence[str], by: Sequence[str], bins: int = 10) -> DataFrame:
    """(by..., column_1, column_2, score): contingency_similarity() of every run of the synthetic table that has rows of both columns.

    The real shares are counted once, whatever the number of runs: what a run lacks of them is one less those it has. Numbers are binned by
    the ends of all real rows. A real table that has the run columns meets each run with its own rows.
    """
    pair, own = ["column_1", "column_2"], [b for b in by if b in real.columns]
    pairs = [tuple(sorted(p)) for p in [*combinations(categorical, 2), *product(categorical, numeric)]]
    shares = []
    for df, keys, name in ((real, own, "p"), (synthetic, [*by], "q")):
        df = discretised(df, real, numeric, bins) if numeric else df
        o = _pair_counts(df, pairs, keys)
        whole = o.groupBy(*keys, *pair).agg(F.sum("o").alias("whole"))
        shares.append(o.join(whole, [*keys, *pair]).withColumn(name, ratio(F.col("o"), F.col("whole"))).drop("o", "whole"))
    there = shares[0].select(*own, *pair).distinct().withColumn("known", F.lit(1.0))
    both = shares[1].join(shares[0], [*own, *pair, "a", "b"], "left")
    p = F.coalesce("p", F.lit(0.0))
    met = both.groupBy(*by, *pair).agg(F.sum(F.abs(p - F.col("q")) - p).alias("gap")).join(there, [*own, *pair], "left")
    return met.select(*by, *pair, (1 - (F.col("gap") + F.coalesce("known", F.lit(0.0))) / 2).alias("score"))


def pair_trends(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    return correlation_similarity(real, synthetic, numeric).unionByName(contingency_similarity(real, synthetic, categorical, numeric))


def quality_report(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row: column_shapes, column_pair_trends and overall, their mean."""
    shapes = ks_complement(real, synthetic, numeric).unionByName(tv_complement(real, synthetic, categorical)).agg(F.avg("score").alias("column_shapes"))
    trends = pair_trends(real, synthetic, categorical, numeric).agg(F.avg("score").alias("column_pair_trends"))
    return shapes.crossJoin(F.broadcast(trends)).withColumn("overall", (F.col("column_shapes") + F.col("column_pair_trends")) / 2)  # one row each


def _confidence(n: Column) -> Column:
    return F.when(n >= 1000, "✓").when(n >= 500, "⚠").when(n >= 50, "✗").otherwise("-")


#: Rules in order, the first that holds gives the reading: least real and below real, below synthetic (and least), least and below quality; None: any.
#: (reading, real from, real below, synthetic from, synthetic below, quality from, quality below)
FLAGS = (
    ("✓", 0.70, None, None, None, 0.80, None),
    ("✓", None, 0.30, None, 0.30, None, None),
    ("✓", 0.50, None, None, None, 0.65, None),
    ("✗", 0.70, None, None, None, None, 0.60),
)
DIAGNOSES = (
    ("Strong correlation well preserved", 0.80, None, None, None, 0.85, None),
    ("Strong correlation preserved", 0.70, None, None, None, 0.75, None),
    ("Weak correlation correctly reproduced", None, 0.25, None, 0.25, None, None),
    ("Model failed to capture strong trend", 0.70, None, None, None, None, 0.50),
    ("Synthetic created spurious correlation", None, 0.40, 0.70, None, None, 0.50),
    ("Moderate correlation preserved", 0.50, None, None, None, 0.65, None),
    ("Weak correlation correctly reproduced", None, 0.30, None, None, None, None),
)


def _reading(rules: Sequence[tuple], missing: str, otherwise: str) -> Column:
    """The first rule that holds, over real_association, synthetic_association and quality."""
    names = ("real_association", "synthetic_association", "quality")
    unknown = reduce(Column.__or__, [F.col(n).isNull() | F.isnan(n) for n in names])
    out = F.when(unknown, missing)
    for reading, *ends in rules:
        held = [c for n, low, high in zip(names, ends[::2], ends[1::2], strict=True) for c in (low is not None and F.col(n) >= low, high is not None and F.col(n) < high) if c is not False]
        out = out.when(reduce(Column.__and__, held), reading)
    return out.otherwise(otherwise)


def pair_diagnostics(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """A row per pair: real and synthetic association, n, quality, flag, confidence, diagnosis."""
    key = ["column_1", "column_2"]
    r = association_matrix(real, categorical, numeric).select(*key, "kind", F.col("value").alias("real_association"), F.col("n"))
    s = association_matrix(synthetic, categorical, numeric).select(*key, F.col("value").alias("synthetic_association"))
    out = r.join(s, key).join(pair_trends(real, synthetic, categorical, numeric).withColumnRenamed("score", "quality"), key, "left")
    return out.withColumns({"flag": _reading(FLAGS, "-", "⚠"), "confidence": _confidence(F.col("n")), "diagnosis": _reading(DIAGNOSES, "Insufficient data", "Mixed quality")})


def extreme_pairs(diagnostics: DataFrame, n: int = 10) -> DataFrame:
    """The n lowest and n highest pairs by quality, ranked; ties by name. The windows run over pairs of columns."""
    known = diagnostics.where("quality is not null")
    low, high = Window.orderBy("quality", "column_1", "column_2"), Window.orderBy(F.desc("quality"), "column_1", "column_2")
    ranked = known.withColumns({"low": F.row_number().over(low), "high": F.row_number().over(high)})
    cols = ["column_1", "column_2", "quality"]
    return ranked.where(F.col("low") <= n).select(F.lit("lowest").alias("end"), F.col("low").alias("rank"), *cols).unionAll(ranked.where(F.col("high") <= n).select(F.lit("highest"), F.col("high"), *cols))
