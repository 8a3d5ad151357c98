"""Row membership: what of a synthetic table is factual, novel, copied or made up.

Tables are reduced to distinct keys before they meet, and the synthetic table to counts by key, so that the totals and
the unique counts of every class come from one pass and two joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import equal_width_bin, ratio, row_key
from ..functions.scratch import stored

CLASSES = ("ddr", "training_copy_valid", "training_copy_propagation", "new_hallucination")


@dataclass(frozen=True)
class Spec:
    """Columns of a summary: keys as they are, and keys cut into bins."""

    categorical: Sequence[str] = ()
    numeric: Sequence[str] = ()
    bins: int = 20
    #: Columns that plausibility checks by range; the categorical ones are checked by value.
    ranged: Sequence[str] = field(default_factory=tuple)


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.intersect(b)


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b doesn't have."""
    return a.subtract(b)


def ddr_rows(synthetic: DataFrame, population: DataFrame, training: DataFrame) -> DataFrame:
    """Distinct desirable rows: factual and not in training."""
    return synthetic.intersect(population).subtract(training)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with their count."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: c_min and c_max of each column."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def bin_numeric(df: DataFrame, ranges: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """Replaces each column by its equal-width bin of the one-row ranges."""
    joined = df.crossJoin(F.broadcast(ranges))  # one row
    bins = {c: equal_width_bin(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max"), n) for c in columns}
    return joined.withColumns(bins).drop(*ranges.columns)


def membership(synthetic: DataFrame, population: DataFrame, training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """synthetic with in_population, in_training and class."""
    columns = list(columns)
    keys = [df.select(row_key(df, columns).alias("key")).distinct().withColumn(flag, F.lit(True)) for df, flag in ((population, "in_population"), (training, "in_training"))]
    out = synthetic.withColumn("key", row_key(synthetic, columns))
    for k in keys:
        out = out.join(k, "key", "left")
    p, t = F.coalesce("in_population", F.lit(False)), F.coalesce("in_training", F.lit(False))
    return out.withColumns({"in_population": p, "in_training": t, "class": class_of(p, t)}).drop("key")


def class_of(p: Column, t: Column) -> Column:
    return (
        F.when(p & ~t, F.lit("ddr")).when(p & t, F.lit("training_copy_valid")).when(~p & t, F.lit("training_copy_propagation")).otherwise(F.lit("new_hallucination"))
    )


def key_counts(synthetic: DataFrame, population: DataFrame, training: DataFrame) -> DataFrame:
    """By key and passes: rows (n), p and t. All three tables bring a column key, synthetic also passes."""
    return key_memberships(synthetic.groupBy("key", "passes").agg(F.count("*").alias("n")), population, training)


def key_memberships(counts: DataFrame, population: DataFrame, training: DataFrame) -> DataFrame:
    """counts (by key) with p and t: whether population and training have the key."""
    for df, flag in ((population, "p"), (training, "t")):
        counts = counts.join(df.select("key").distinct().withColumn(flag, F.lit(True)), "key", "left")
    return counts.withColumns({"p": F.coalesce("p", F.lit(False)), "t": F.coalesce("t", F.lit(False))})


def ddr_summary(synthetic: DataFrame, population: DataFrame, training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of 20 columns: totals, duplicates, and count and rate of four memberships, unique and total."""
    columns = list(columns)
    keyed = [df.select(row_key(df, columns).alias("key")) for df in (synthetic, population, training)]
    c = key_counts(keyed[0].withColumn("passes", F.lit(True)), *keyed[1:])
    parts = {"ddr": F.col("p") & ~F.col("t"), "hallucination": ~F.col("p"), "training_copy": F.col("t"), "population_match": F.col("p")}
    one = c.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("unique"),
        *[F.count_if(x).alias(f"{k}_unique") for k, x in parts.items()],
        *[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(f"{k}_total") for k, x in parts.items()],
    )
    total, unique = F.col("total"), F.col("unique")
    out = [total.alias("total_synthetic_records"), unique.alias("unique_synthetic_records"), (total - unique).alias("duplicate_records"), (100 * ratio(total - unique, total)).alias("duplicate_rate_pct")]
    for scope, whole in (("unique", unique), ("total", total)):
        for k in parts:
            out += [F.col(f"{k}_{scope}").alias(f"{k}_{scope}_count"), (100 * ratio(F.col(f"{k}_{scope}"), whole)).alias(f"{k}_{scope}_rate_pct")]
    return one.select(*out)


def ddr_grade(rate_pct: Column) -> Column:
    return F.when(rate_pct >= 70, "EXCELLENT").when(rate_pct >= 50, "GOOD").when(rate_pct >= 30, "MODERATE").otherwise("POOR")


def category_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, value): the distinct values of each column, by its place, as text; of any number. One scan, written to the scratch folder."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])))
    return stored(long.where("value is not null").distinct(), "values")


def _binned_keys(roles, spec: Spec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, passes, n) of the synthetic table, and the keys of population and training.

    The synthetic rows are counted by key before their categories meet the population's values (a key settles its categories), which
    Spark broadcasts where they are few and joins by a shuffle otherwise.
    """
    numeric, categorical = list(spec.numeric), list(spec.categorical)
    ranged = list(dict.fromkeys([*numeric, *spec.ranged]))
    ranges = numeric_ranges(roles.population, ranged) if ranged else roles.population.sparkSession.range(1).select(F.lit(0).alias("__none"))

    def keyed(df: DataFrame, extra: list[Column]) -> DataFrame:
        joined = df.crossJoin(F.broadcast(ranges))  # one row
        texts = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([|~\\])", r"\\$1"), F.lit("~")) for c in categorical]
        bins = [F.coalesce(equal_width_bin(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max"), spec.bins).cast("string"), F.lit("~")) for c in numeric]
        return joined.select(F.md5(F.concat_ws("|", *texts, *bins)).alias("key"), *extra)

    inside = F.lit(True)
    for c in ranged:
        inside = inside & (F.col(c).isNull() | F.col(c).between(F.col(f"{c}_min"), F.col(f"{c}_max")))
    texts = [F.col(c).cast("string").alias(f"__c{i}") for i, c in enumerate(categorical)]
    counts = keyed(roles.synthetic, [inside.alias("passes"), *texts]).groupBy("key", "passes").agg(F.count("*").alias("n"), *[F.first(f"__c{i}").alias(f"__c{i}") for i in range(len(texts))])
    if categorical:
        values, passes = category_values(roles.population, categorical), F.coalesce("passes", F.lit(False))
        for i in range(len(categorical)):
            counts = counts.join(values.where(F.col("i") == i).select(F.col("value").alias(f"__v{i}")), F.col(f"__c{i}") == F.col(f"__v{i}"), "left")
            passes = passes & F.col(f"__v{i}").isNotNull()
        counts = counts.select("key", passes.alias("passes"), "n").groupBy("key", "passes").agg(F.sum("n").alias("n"))
    return counts, keyed(roles.population, []), keyed(roles.training, [])


def validation_summary(roles, spec: Spec) -> DataFrame:
    """One row of 54 columns: sizes, four membership classes, plausibility, the 2x2 matrix and the cross-table.

    A key is plausible-unique if any of its rows passes, and implausible-unique if any fails.
    """
    counts, population, training = _binned_keys(roles, spec)
    c = key_memberships(counts, population, training).withColumn("class", class_of(F.col("p"), F.col("t")))
    # One row for each key: rows that pass and rows that fail.
    k = c.groupBy("key", "class").agg(F.sum(F.when(F.col("passes"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("passes"), 0).otherwise(F.col("n"))).alias("bad"))
    n = F.col("good") + F.col("bad")
    add = lambda x: F.coalesce(F.sum(x), F.lit(0))
    one = k.agg(
        add(n).alias("total"),
        F.count("*").alias("unique"),
        *[F.count_if(F.col("class") == x).alias(f"{x}_unique") for x in CLASSES],
        *[add(F.when(F.col("class") == x, n)).alias(f"{x}_total") for x in CLASSES],
        *[add(F.when(F.col("class") == x, F.col(v))).alias(f"{x}_{v}") for x in CLASSES for v in ("good", "bad")],
        F.count_if(F.col("good") > 0).alias("plausible_unique"),
        F.count_if(F.col("bad") > 0).alias("implausible_unique"),
        add(F.col("good")).alias("plausible_total"),
        add(F.col("bad")).alias("implausible_total"),
    )
    sizes = [df.groupBy("key").agg(F.count("*").alias("n")).agg(add(F.col("n")).alias(f"{role}_total_count"), F.count("*").alias(f"{role}_unique_count")) for role, df in (("population", population), ("training", training))]
    row = one.crossJoin(F.broadcast(sizes[0])).crossJoin(F.broadcast(sizes[1]))  # one row each
    total, unique = F.col("total"), F.col("unique")

    def both(name: str, x: Column, whole: Column) -> list[Column]:
        return [x.alias(f"{name}_count"), (100 * ratio(x, whole)).alias(f"{name}_rate_pct")]

    out = [F.col(f"{r}_{s}_count") for r in ("population", "training") for s in ("total", "unique")] + [total.alias("synthetic_total_count"), unique.alias("synthetic_unique_count")]
    for x in (*CLASSES, "plausible", "implausible"):
        out += both(f"{x}_unique", F.col(f"{x}_unique"), unique) + both(f"{x}_total", F.col(f"{x}_total"), total)
    out += both("total_factual", F.col("ddr_total") + F.col("training_copy_valid_total"), total)
    out += both("novel_factual", F.col("ddr_total"), total) + both("total_plausible", F.col("plausible_total"), total)
    out += both("novel_plausible", F.col("ddr_good") + F.col("new_hallucination_good"), total)
    for x in CLASSES:
        out += both(f"{x}_plausible_total", F.col(f"{x}_good"), total) + both(f"{x}_implausible_total", F.col(f"{x}_bad"), total)
    return row.select(*out)


def quality_matrix(roles, spec: Spec) -> DataFrame:
    """Tidy 2x2 matrix: measure, count, rate_pct."""
    s = validation_summary(roles, spec)
    names = ("total_factual", "novel_factual", "total_plausible", "novel_plausible")
    return s.select(F.inline(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(f"{x}_count").alias("count"), F.col(f"{x}_rate_pct").alias("rate_pct")) for x in names])))


def class_by_plausibility(roles, spec: Spec) -> DataFrame:
    """class, plausible, implausible: rows."""
    counts, population, training = _binned_keys(roles, spec)
    c = key_memberships(counts, population, training).withColumn("class", class_of(F.col("p"), F.col("t")))
    add = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return c.groupBy("class").agg(add(F.when(F.col("passes"), F.col("n"))).alias("plausible"), add(F.when(~F.col("passes"), F.col("n"))).alias("implausible"))


def complexity(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """column, distinct, contribution (ln of distinct), share of the sum. Exact counts come from one long table."""
    if approximate:
        counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in columns])))
    else:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
        counts = long.groupBy("column").agg(F.count_distinct("value").alias("distinct"))
    total = counts.agg(F.sum(F.ln(F.greatest("distinct", F.lit(1)))).alias("total"))
    c = F.ln(F.greatest("distinct", F.lit(1)))
    return counts.crossJoin(F.broadcast(total)).select("column", "distinct", c.alias("contribution"), ratio(c, F.col("total")).alias("share"))


def new_row_synthesis(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str], numeric: Sequence[str], tolerance: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each run of by: total, matched, new_rows, score. A synthetic row is matched if a real one has equal categories and
    numbers within the tolerance (relative to the synthetic one); NULL matches NULL. A real table without the run columns serves all runs.

    Both sides are reduced to distinct rows first. Numbers are cut into cells a tolerance wide on a logarithmic scale, and each real row is
    looked for in its own and the neighbouring cells of the two numbers with the most values, so that the join has an equality on both: a value
    that most rows share is split by the other number, and rows that share both by what else they hold (they are distinct).
    """
    by, own = [*by], [b for b in by if b in real.columns]
    columns = [*categorical, *numeric]
    counted = synthetic.groupBy(*by, *columns).agg(F.count("*").alias("__n"))
    real = real.select(*own, *columns).distinct()
    spread = real.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(numeric)]).first() if len(numeric) > 2 else [0] * len(numeric)
    cuts = [c for _, c in sorted(enumerate(numeric), key=lambda x: (-spread[x[0]], x[0]))][:2]

    def cell(c: str) -> Column:
        size = F.log(F.greatest(F.abs(F.col(c)), F.lit(1e-12))) / F.lit(2.1 * tolerance)
        return F.coalesce(F.floor(size) * 4 + F.signum(F.col(c)).cast("long"), F.lit(-(1 << 60)))

    r = real.select(*[F.col(c).alias(f"r_{c}") for c in (*own, *columns)], *[cell(c).alias(f"__r{i}") for i, c in enumerate(cuts)])
    for i in range(len(cuts)):
        r = r.withColumn(f"__r{i}", F.explode(F.array(*[F.col(f"__r{i}") + d for d in (-4, 0, 4)])))
    s = counted.withColumns({f"__s{i}": cell(c) for i, c in enumerate(cuts)})
    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in (*own, *categorical)] + [F.col(f"__s{i}") == F.col(f"__r{i}") for i in range(len(cuts))]
    on += [(F.col(c).isNull() & F.col(f"r_{c}").isNull()) | (F.abs(F.col(f"r_{c}") - F.col(c)) <= tolerance * F.abs(F.col(c))) for c in numeric]
    new = s.join(r, reduce(Column.__and__, on), "left_anti").select(*by, "__n", F.lit(True).alias("__new"))
    marked = counted.select(*by, "__n", F.lit(False).alias("__new")).unionAll(new)
    add = lambda x: F.coalesce(F.sum(F.when(x, F.col("__n"))), F.lit(0))
    one = marked.groupBy(*by).agg(add(~F.col("__new")).alias("total"), add(F.col("__new")).alias("new_rows"))
    return one.select(*by, "total", (F.col("total") - F.col("new_rows")).alias("matched"), "new_rows", ratio(F.col("new_rows"), F.col("total")).alias("score"))
