"""Preparation: projections, cleaning, imputation, outliers, scaling, profiles. Fitted values are one-row tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import exact_quantiles


def drop_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Without those of the names that exist, but for the ones to keep."""
    return df.drop(*[n for n in names if n in df.columns and n not in keep])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Aliases to canonical names; two columns for one name are an error."""
    names = [mapping.get(c, c) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several columns would be named {', '.join(twice)}")
    return df.toDF(*names)


def uppercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what doesn't parse is NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def drop_non_numeric(df: DataFrame, column: str) -> DataFrame:
    """Without rows whose value is text that doesn't parse; NULLs stay."""
    return df.where(F.col(column).isNull() | F.col(column).try_cast("double").isNotNull())


def non_numeric_report(df: DataFrame, column: str) -> DataFrame:
    bad = F.col(column).isNotNull() & F.col(column).try_cast("double").isNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("dropped"))


def cast_integral(df: DataFrame, columns: Sequence[str], width: str = "smallint") -> DataFrame:
    """Rounded half to even, then cast; NULL where it doesn't fit."""
    return df.withColumns({c: F.bround(F.col(c).cast("double"), 0).try_cast(width) for c in columns})


def round_columns(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in columns})


def fill_missing_label(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(label)) for c, label in labels.items()})


def boolean_to_label(df: DataFrame, column: str, missing: str = "Missing") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("int").cast("string"), F.lit(missing)))


def clean_datetime_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin("nan", "NaT"), F.lit(None)).otherwise(F.col(column)))


def trim_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.trim(column))


def flag_to_boolean(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new).withColumn(new, F.col(new).cast("boolean"))


def select_configured(df: DataFrame, config: Mapping[str, int]) -> DataFrame:
    """The configured columns that exist, by their order."""
    return df.select(*[c for c in sorted(config, key=lambda c: (config[c], c)) if c in df.columns])


def normalize_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    text = {c: F.col(c).cast("string") for c in columns}
    return df.withColumns({c: F.when(x.isin("nan", "None"), F.lit(None)).otherwise(x) for c, x in text.items()})


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value as text): all columns go through one job."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def long_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """(keep..., column, value as double), NULLs and NaNs left out."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs))).where("value is not null and not isnan(value)")


def column_info(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, dtype, unique_values, non_null, nulls, null_pct."""
    kinds = dict(df.dtypes)
    dtype = F.coalesce(*[F.when(F.col("column") == c, F.lit(kinds[c])) for c in columns])
    out = long_form(df, columns).groupBy("column").agg(F.count_distinct("value").alias("unique_values"), F.count("value").alias("non_null"), F.count("*").alias("rows"))
    nulls = F.col("rows") - F.col("non_null")
    return out.select("column", dtype.alias("dtype"), "unique_values", "non_null", nulls.alias("nulls"), (100.0 * nulls / F.col("rows")).alias("null_pct"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value (NULL counts too), count, pct of the column's rows."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("count"))
    return counts.withColumn("pct", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("column")))


def fit_imputer(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """One row: the mean of each number, the mode of each category (ties: the smallest; none: unknown)."""
    stats = df.agg(F.lit(0).alias("_fit"), *[F.avg(c).alias(f"{c}__fill") for c in numeric])
    if not categorical:
        return stats
    counts = long_form(df, categorical).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
    modes = best.groupBy().agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("mode"))), F.lit(unknown)).alias(f"{c}__fill") for c in categorical])
    return stats.crossJoin(F.broadcast(modes))  # one row


def impute(df: DataFrame, fitted: DataFrame) -> DataFrame:
    columns = [c.removesuffix("__fill") for c in fitted.columns if c.endswith("__fill")]
    out = df.crossJoin(F.broadcast(fitted))  # one row
    return out.withColumns({c: F.coalesce(c, f"{c}__fill") for c in columns if c in df.columns}).select(*df.columns)


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """The ends beyond which values are outliers; None for a column without values."""
    quarts = exact_quantiles(df, columns, (0.25, 0.75))
    return {c: q and (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) for c, q in quarts.items()}


def remove_outliers_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5, fit_on: DataFrame | None = None, sequential: bool = True, keep_null: bool = True) -> DataFrame:
    """Rows within the quartiles widened by k ranges. sequential: each column's quartiles come from rows that passed
    the columns before it (of df, or of fit_on filtered alike); else all come from one pass."""
    fit = df if fit_on is None else fit_on

    def inside(rows: DataFrame, bounds: dict[str, tuple[float, float] | None], some: Sequence[str]) -> DataFrame:
        for c in some:
            ok = F.col(c).cast("double").between(*bounds[c]) if bounds[c] else F.lit(False)
            rows = rows.where(ok | F.col(c).isNull() if keep_null else ok)
        return rows

    if not sequential:
        return inside(df, iqr_bounds(fit, columns, k), columns)
    for c in columns:
        bounds = iqr_bounds(fit, [c], k)
        df, fit = inside(df, bounds, [c]), inside(fit, bounds, [c])
    return df


def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column is divided by 1."""
    stats = (df if fit_on is None else fit_on).agg(*[f.alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg(c)), ("std", F.stddev_pop(c)))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std")) for c in columns}).select(*df.columns)


def minmax_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    stats = (df if fit_on is None else fit_on).agg(*[f.alias(f"{c}__{n}") for c in columns for n, f in (("low", F.min(c)), ("high", F.max(c)))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"{c}__low")) / F.coalesce(F.nullif(F.col(f"{c}__high") - F.col(f"{c}__low"), F.lit(0.0)), F.lit(1.0)) for c in columns}).select(*df.columns)


def table_summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """column, rows, missing, mean, std, min, max, unique_values; what doesn't apply is NULL."""
    none = F.lit(None).cast("double")
    num = long_form(df, numeric).withColumn("value", F.col("value").try_cast("double")).groupBy("column")
    numbers = num.agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.lit(None).cast("long").alias("unique_values"))
    cat = long_form(df, categorical).groupBy("column")
    words = cat.agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), none.alias("mean"), none.alias("std"), none.alias("min"), none.alias("max"), F.count_distinct("value").alias("unique_values"))
    return numbers.unionByName(words)


def align_columns(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """b in the columns of a. strict: missing or extra columns are an error; else they are NULL or dropped."""
    missing, extra = [c for c in a.columns if c not in b.columns], [c for c in b.columns if c not in a.columns]
    if strict and (missing or extra):
        raise ValueError(f"missing: {', '.join(missing) or 'none'}; extra: {', '.join(extra) or 'none'}")
    kinds = dict(a.dtypes)
    return b.select(*[F.col(c) if c in b.columns else F.lit(None).cast(kinds[c]).alias(c) for c in a.columns])
