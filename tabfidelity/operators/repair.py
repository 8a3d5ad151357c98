"""Category repair: values of a synthetic table that the real one doesn't have are replaced by ones it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import ratio, uniform
from .encode import _few, fit_intervals
from .prep import long_form, normalize_categories


def invalid_categories(synthetic: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows, rate): values that real lacks; NULLs are ignored."""
    s = long_form(normalize_categories(synthetic, columns), columns)
    r = long_form(normalize_categories(real, columns), columns).where("value is not null").distinct()
    counts = s.groupBy("column", "value").agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy("column"))
    return counts.withColumn("rate", ratio(F.col("rows"), total)).where("value is not null").join(r, ["column", "value"], "left_anti")


def _marked(synthetic: DataFrame, real: DataFrame, column: str) -> DataFrame:
    """synthetic with __bad: whether the value is there and not among the real ones."""
    known = normalize_categories(real.select(column), [column]).where(F.col(column).isNotNull()).distinct().select(F.col(column).alias("__known"))
    out = normalize_categories(synthetic, [column]).join(known, F.col(column) == F.col("__known"), "left")
    return out.withColumn("__bad", F.col(column).isNotNull() & F.col("__known").isNull()).drop("__known")


def repair_random(synthetic: DataFrame, real: DataFrame, column: str, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Each invalid value by a valid one, all alike likely, by a hash of the row's key."""
    valid = normalize_categories(real.select(column), [column]).where(F.col(column).isNotNull()).distinct()
    index = valid.select((F.row_number().over(Window.orderBy(column)) - 1).alias("__i"), F.col(column).alias("__new"))  # over the categories
    n = valid.agg(F.count("*").alias("__n"))
    marked = _marked(synthetic, real, column).crossJoin(F.broadcast(n))  # one row
    picked = marked.withColumn("__i", F.when(F.col("__bad"), F.floor(uniform(*key, F.lit(column), seed=seed) * F.col("__n")).cast("int")))
    out = picked.join(index, "__i", "left")
    return out.withColumn(column, F.when(F.col("__bad"), F.col("__new")).otherwise(F.col(column))).select(*synthetic.columns)


def repair_weighted(synthetic: DataFrame, real: DataFrame, column: str, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Each invalid value by a valid one, as likely as it is frequent, by a hash of the row's key."""
    cuts = fit_intervals(normalize_categories(real.select(column), [column]), column).select(F.col("category").alias("__new"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    marked = _marked(synthetic, real, column).withColumn("__u", F.when(F.col("__bad"), uniform(*key, F.lit(column), seed=seed)))
    out = marked.join(F.broadcast(_few(cuts)), (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")), "left")
    return out.withColumn(column, F.when(F.col("__bad"), F.col("__new")).otherwise(F.col(column))).select(*synthetic.columns)


def repair_knn(synthetic: DataFrame, real: DataFrame, column: str, others: Sequence[str], key: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Each invalid value by one of its k nearest real rows (share of the other categories that differ), the nearer the likelier.

    Both sides are reduced to distinct tuples first. A tuple of the synthetic side meets real tuples that share at least one
    of the other categories; those without any such go to repair_weighted().
    """
    if not others:
        return repair_weighted(synthetic, real, column, key, seed)
    names = [*others]
    r = normalize_categories(real, [column, *names]).where(F.col(column).isNotNull()).groupBy(column, *names).agg(F.count("*").alias("__w"))
    marked = _marked(normalize_categories(synthetic, names), real, column)
    asked = marked.where("__bad").select(*names).distinct()
    candidates = None
    for c in names:  # equal in c; which other columns agree is counted below
        right = r.select(F.col(column).alias("__new"), "__w", *[F.col(x).alias(f"__{x}") for x in names])
        part = asked.join(right, F.col(c) == F.col(f"__{c}"))
        candidates = part if candidates is None else candidates.unionByName(part)
    differ = sum((F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), 0).otherwise(1) for c in names), F.lit(0)) / F.lit(float(len(names)))
    near = candidates.distinct().withColumn("__d", differ)
    # A tuple stands for __w real rows at one distance: k rows are reached by their running sum.
    by = Window.partitionBy(*names).orderBy("__d", "__new", *[f"__{x}" for x in names])
    upto = F.sum("__w").over(by.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("__before", F.coalesce(upto, F.lit(0))).where(F.col("__before") < k)
    weight = F.least(F.col("__w"), k - F.col("__before")) / (F.col("__d") + F.lit(1e-6))
    picks = near.groupBy(*names, "__new").agg(F.sum(weight).alias("__p"))
    w = Window.partitionBy(*names).orderBy("__new")
    total = F.sum("__p").over(Window.partitionBy(*names))
    hi = F.sum("__p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / total
    picks = picks.withColumns({"__hi": hi, "__lo": hi - F.col("__p") / total}).select(*[F.col(x).alias(f"__k_{x}") for x in names], "__new", "__lo", "__hi")
    on = F.col("__bad") & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))
    for x in names:
        on = on & F.col(x).eqNullSafe(F.col(f"__k_{x}"))
    out = marked.withColumn("__u", uniform(*key, F.lit(column), seed=seed)).join(picks, on, "left")
    out = out.withColumn(column, F.when(F.col("__bad"), F.coalesce("__new", column)).otherwise(F.col(column))).select(*synthetic.columns)
    return repair_weighted(out, real, column, key, seed)


def repair_categories(synthetic: DataFrame, real: DataFrame, columns: Sequence[str], key: Sequence[str], method: str = "knn", k: int = 5, seed: int = 0, fallback: str = "weighted") -> DataFrame:
    """The columns in order, each with the ones before it repaired. A column of which every row is invalid goes to fallback; method none repairs nothing."""
    known = ("random", "weighted", "knn")
    if method == "none":
        return synthetic
    for m in (method, fallback):
        if m not in known:
            raise ValueError(f"unknown method {m}; known: {', '.join(known)}, none")
    rates = {r["column"]: r["invalid_rate"] for r in repair_report(synthetic, real, columns).collect()}  # a row for each column
    for c in columns:
        if c not in rates:
            continue
        chosen = fallback if rates[c] > 1 - 1e-9 else method
        if chosen == "random":
            synthetic = repair_random(synthetic, real, c, key, seed)
        elif chosen == "weighted":
            synthetic = repair_weighted(synthetic, real, c, key, seed)
        else:
            synthetic = repair_knn(synthetic, real, c, [x for x in columns if x != c], key, k, seed)
    return synthetic


def fixed_counts(before: DataFrame, after: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, fixed): how many invalid values of each column are gone; columns without any are left out."""
    left = repair_report(after, real, columns).select("column", F.col("invalid_rows").alias("left"))
    gone = F.col("invalid_rows") - F.coalesce("left", F.lit(0))
    return repair_report(before, real, columns).join(left, "column", "left").select("column", gone.alias("fixed")).where("fixed > 0")


def repair_report(before: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, invalid_values, invalid_rows, invalid_rate)."""
    bad = invalid_categories(before, real, columns)
    return bad.groupBy("column").agg(F.count("*").alias("invalid_values"), F.sum("rows").alias("invalid_rows"), F.sum("rate").alias("invalid_rate"))
