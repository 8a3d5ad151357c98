"""Plausibility rules: learnt from real data, checked row by row, failures counted and sampled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Categorical:
    column: str
    allowed: tuple[str, ...]
    allow_null: bool = False


@dataclass(frozen=True)
class Range:
    column: str
    #: None: open.
    low: object
    high: object
    #: numeric or date.
    data_type: str = "numeric"
    #: Whether a NULL passes (the summary's rule) or fails (the rule file's).
    allow_null: bool = False


@dataclass(frozen=True)
class Combination:
    name: str
    columns: tuple[str, ...]
    #: Allowed tuples; empty: those of the population.
    tuples: tuple[tuple[str, ...], ...] = ()


def rule_name(rule) -> str:
    return rule.name if isinstance(rule, Combination) else f"{'categorical' if isinstance(rule, Categorical) else 'range'}_{rule.column}"


def generate_rules(df: DataFrame, columns: Sequence[str], max_values: int = 100) -> DataFrame:
    """A row per column: column, kind (categorical, date, numeric), low, high, has_null, cardinality, allowed (sorted).

    Text is categorical, and so is any other column but dates with fewer than max_values values. One aggregate gives
    the sizes; value sets are gathered for the chosen columns alone, each in its own row, and never broadcast.
    """
    kinds = dict(df.dtypes)
    stats = df.agg(*[f.alias(f"{c}__{n}") for c in columns for n, f in (("card", F.count_distinct(c)), ("null", F.count_if(F.col(c).isNull())), ("low", F.min(F.col(c))), ("high", F.max(F.col(c))))])
    first = stats.first()

    def kind(c: str) -> str:
        if kinds[c] in ("date", "timestamp", "timestamp_ntz"):
            return "date"
        return "categorical" if kinds[c] in ("string", "boolean") or first[f"{c}__card"] < max_values else "numeric"

    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kind(c)).alias("kind"),
            (F.lit(None) if kind(c) == "categorical" else F.col(f"{c}__low")).cast("string").alias("low"),
            (F.lit(None) if kind(c) == "categorical" else F.col(f"{c}__high")).cast("string").alias("high"),
            (F.col(f"{c}__null") > 0).alias("has_null"),
            F.col(f"{c}__card").alias("cardinality"),
        )
        for c in columns
    ]
    out = df.sparkSession.createDataFrame([first], stats.schema).select(F.inline(F.array(*rows)))
    chosen = [c for c in columns if kind(c) == "categorical"]
    if not chosen:
        return out.withColumn("allowed", F.lit(None).cast("array<string>"))
    sets = allowed_values(df, chosen).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("allowed"))
    return out.join(sets, "column", "left").withColumn("allowed", F.when(F.col("kind") == "categorical", F.coalesce("allowed", F.array().cast("array<string>"))))


def allowed_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the distinct values as text, in one scan, of any number; what generate_rules() lists in a row for each column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    return long.where("value is not null").distinct()


def check_allowed(df: DataFrame, allowed: DataFrame, columns: Sequence[str], allow_null: bool = False) -> DataFrame:
    """df with a boolean categorical_<column> for each column: whether allowed (column, value) has its value.

    For sets too large for a rule's list: Spark broadcasts a column's set where it is small and joins by a shuffle otherwise.
    """
    out = df
    for c in columns:
        own = allowed.where(F.col("column") == c).select(F.col("value").alias("__allowed")).distinct()
        held = F.when(F.col(c).isNull(), F.lit(allow_null)).otherwise(F.col("__allowed").isNotNull())
        out = out.join(own, F.col(c).cast("string") == F.col("__allowed"), "left").withColumn(f"categorical_{c}", held).drop("__allowed")
    return out


def check_categorical(rule: Categorical) -> Column:
    value = F.col(rule.column).cast("string")
    null_passes = rule.allow_null or "Missing" in rule.allowed
    return F.when(value.isNull(), F.lit(null_passes)).otherwise(value.isin(*rule.allowed) if rule.allowed else F.lit(False))


def check_range(rule: Range) -> Column:
    """An end that is None is no condition; a value that can't be read fails each end that is one."""
    kind = "timestamp" if rule.data_type == "date" else "double"
    value = F.col(rule.column).try_cast(kind)
    ends = [value >= F.lit(rule.low).cast(kind)] * (rule.low is not None) + [value <= F.lit(rule.high).cast(kind)] * (rule.high is not None)
    inside = reduce(Column.__and__, [F.coalesce(x, F.lit(False)) for x in ends], F.lit(True))
    return F.when(F.col(rule.column).isNull(), F.lit(True if rule.allow_null else not ends)).otherwise(inside)


def check_combination(df: DataFrame, rule: Combination, population: DataFrame | None = None) -> DataFrame:
    """df with a boolean column named after the rule."""
    names = [f"__{rule.name}_{c}" for c in rule.columns]
    if rule.tuples:
        rows = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(t, names, strict=True)]) for t in rule.tuples])
        allowed = df.sparkSession.range(1, numPartitions=1).select(F.inline(rows)).distinct()
    else:
        allowed = population.select(*[F.col(c).cast("string").alias(n) for c, n in zip(rule.columns, names, strict=True)]).distinct()
    on = reduce(Column.__and__, [F.col(c).cast("string").eqNullSafe(F.col(n)) for c, n in zip(rule.columns, names, strict=True)])
    marked = df.join(allowed.withColumn("__found", F.lit(True)), on, "left")
    return marked.withColumn(rule.name, F.coalesce("__found", F.lit(False))).drop("__found", *names)


def validate(df: DataFrame, rules: Sequence, population: DataFrame | None = None) -> DataFrame:
    """df with a boolean per rule, passes_all and failed_rules. A rule on a missing column fails everywhere."""
    out = df
    names = [rule_name(r) for r in rules]
    for rule, name in zip(rules, names, strict=True):
        columns = rule.columns if isinstance(rule, Combination) else (rule.column,)
        if not set(columns) <= set(df.columns):
            out = out.withColumn(name, F.lit(False))
        elif isinstance(rule, Combination):
            out = check_combination(out, rule, population)
        else:
            out = out.withColumn(name, check_categorical(rule) if isinstance(rule, Categorical) else check_range(rule))
    failed = F.filter(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return out.withColumn("failed_rules", failed).withColumn("passes_all", F.size("failed_rules") == 0)


def rule_failures(validated: DataFrame) -> DataFrame:
    """rule, failures, share of all rows; only rules that failed."""
    total = validated.agg(F.count("*").alias("total"))
    counts = validated.select(F.explode("failed_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("failures"))
    return counts.crossJoin(F.broadcast(total)).select("rule", "failures", (F.col("failures") / F.col("total")).alias("share"))  # one row


def pass_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("total"), F.count_if("passes_all").alias("passing"), F.avg(F.col("passes_all").cast("double")).alias("pass_rate"))


def failing_samples(validated: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first n failing rows in order, with the rules that they fail."""
    return validated.where("not passes_all").orderBy(*order).limit(n)
