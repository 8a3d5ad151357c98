"""Encoding of categories, dates, numbers and flags. A fit is a small table; both directions are projections and joins."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import uniform


def fit_intervals(df: DataFrame, column: str, order: Sequence[str] | None = None) -> DataFrame:
    """(category, n, lo, hi): the intervals of [0, 1] by cumulative frequency, most frequent first, or in the given order.

    The window runs over categories, not rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    if order is None:
        keys = [F.desc("n"), F.col("category")]
    else:
        place = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(order)], F.lit(len(order)))
        keys = [place, F.col("category")]
    w = Window.orderBy(*keys)
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select("category", "n", ((upto - F.col("n")) / total).alias("lo"), (upto / total).alias("hi"))


def uniform_encode(df: DataFrame, column: str, fitted: DataFrame, key: Sequence[str] = (), seed: int = 0, midpoint: bool = False) -> DataFrame:
    """column as a point of its category's interval: hashed from the key, or the middle. NULLs and unseen categories are NULL."""
    u = F.lit(0.5) if midpoint else uniform(*key, F.lit(column), seed=seed)
    names = {"category": "__category", "lo": "__lo", "hi": "__hi"}
    out = df.join(fitted.select(*names).withColumnsRenamed(names), F.col(column).cast("string") == F.col("__category"), "left")
    return out.withColumn(column, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * u).select(*df.columns)


def uniform_decode(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    """The category whose interval holds the value, clipped to [0, 1]."""
    names = {"category": "__category", "lo": "__lo", "hi": "__hi"}
    x = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(1.0))
    inside = (x >= F.col("__lo")) & ((x < F.col("__hi")) | ((F.col("__hi") == 1.0) & (x == 1.0)))
    out = df.join(F.broadcast(_few(fitted.select(*names))).withColumnsRenamed(names), inside, "left")
    return out.withColumn(column, F.col("__category")).select(*df.columns)


def _few(fitted: DataFrame, most: int = 100_000) -> DataFrame:
    """A dictionary that may be broadcast: its size is checked."""
    if fitted.limit(most + 1).count() > most:
        raise ValueError(f"a range lookup takes {most} categories at most; use label_encode() for more")
    return fitted


def fit_labels(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """(category, code): sorted categories of all tables, numbered from 0."""
    values = tables[0].select(F.col(column).cast("string").alias("category"))
    for t in tables[1:]:
        values = values.unionAll(t.select(F.col(column).cast("string")))
    return values.where("category is not null").distinct().withColumn("code", (F.row_number().over(Window.orderBy("category")) - 1).cast("int"))


def label_encode(df: DataFrame, column: str, fitted: DataFrame, unseen: int = -1) -> DataFrame:
    names = {"category": "__category", "code": "__code"}
    out = df.join(fitted.select(*names).withColumnsRenamed(names), F.col(column).cast("string") == F.col("__category"), "left")
    return out.withColumn(column, F.coalesce("__code", F.lit(unseen))).select(*df.columns)


def label_decode(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    """Rounded half to even and clipped to the codes."""
    top = fitted.agg(F.max("code").alias("__top"))
    names = {"category": "__category", "code": "__code"}
    out = df.crossJoin(F.broadcast(top)).withColumn("__at", F.least(F.greatest(F.rint(F.col(column).cast("double")), F.lit(0.0)), F.col("__top")).cast("int"))  # one row
    out = out.join(fitted.select(*names).withColumnsRenamed(names), F.col("__at") == F.col("__code"), "left")
    return out.withColumn(column, F.col("__category")).select(*df.columns)


def onehot_categories(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The sorted categories, which become columns: their number is checked."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return sorted(values)


def onehot_encode(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """A column `name.category` each, 1.0 or 0.0; NULLs and unseen categories are zeros throughout."""
    flags = {f"{column}.{c}": F.coalesce((F.col(column).cast("string") == c).cast("double"), F.lit(0.0)) for c in categories}
    return df.withColumns(flags).drop(column)


def onehot_decode(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """The category of the largest column, the first if several are; NULL if all are zero."""
    cells = F.array(*[F.col(f"`{column}.{c}`") for c in categories])
    best = F.array_position(cells, F.array_max(cells)).cast("int")
    value = F.when(F.array_max(cells) > 0, F.get(F.array(*[F.lit(c) for c in categories]), best - 1))
    return df.withColumn(column, value).drop(*[f"{column}.{c}" for c in categories])


def frequency_encode(df: DataFrame, column: str, fit_on: DataFrame) -> DataFrame:
    """column as its count in fit_on; 0 for NULL and unseen."""
    counts = fit_on.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("__category")).agg(F.count("*").alias("__n"))
    out = df.join(counts, F.col(column).cast("string") == F.col("__category"), "left")
    return out.withColumn(column, F.coalesce("__n", F.lit(0))).select(*df.columns)


def timestamp_encode(df: DataFrame, column: str) -> DataFrame:
    """Epoch seconds as double."""
    return df.withColumn(column, F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6))


def timestamp_decode(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    back = F.timestamp_micros((F.col(column) * F.lit(1e6)).cast("long"))
    return df.withColumn(column, back if fmt is None else F.date_format(back, fmt))


def fit_float(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, low, high, decimals (the most that any value shows, 6 at most)."""
    shown = F.expr(f"format_number(abs(cast(`{column}` AS double)), '0.######')")
    text = F.regexp_replace(shown, r"^[^.]*\.?", "")
    return df.agg(F.avg(column).alias("mean"), F.min(column).alias("low"), F.max(column).alias("high"), F.coalesce(F.max(F.length(text)), F.lit(0)).alias("decimals"))


def float_encode(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    """Missing as the mean."""
    return df.crossJoin(F.broadcast(fitted.select(F.col("mean").alias("__mean")))).withColumn(column, F.coalesce(F.col(column).cast("double"), "__mean")).drop("__mean")  # one row


def float_decode(df: DataFrame, column: str, fitted: DataFrame, representation: str | None = None) -> DataFrame:
    """Clipped to the learnt range and rounded half to even to the learnt decimals; then to an integer type if one is named."""
    f = fitted.select(F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("decimals").alias("__decimals"))
    x = F.least(F.greatest(F.col(column), F.col("__low")), F.col("__high"))
    scale = F.pow(F.lit(10.0), F.col("__decimals"))
    rounded = F.rint(x * scale) / scale
    return df.crossJoin(F.broadcast(f)).withColumn(column, rounded if representation is None else F.rint(rounded).try_cast(representation)).drop("__low", "__high", "__decimals")  # one row


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("boolean").cast("double"))


def binary_decode(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column) >= 0.5)


KINDS = ("uniform", "ordered_uniform", "label", "onehot", "frequency", "timestamp", "float", "binary")


@dataclass(frozen=True)
class ColumnPlan:
    kind: str
    order: tuple[str, ...] = ()


class Encoder:
    """Several columns at once. fit() makes one table of state, (column, category, n, lo, hi, code, mean, low, high, decimals)."""

    def __init__(self, plans: Mapping[str, ColumnPlan], key: Sequence[str], seed: int = 0):
        if bad := [c for c, p in plans.items() if p.kind not in KINDS]:
            raise ValueError(f"unknown kinds for {', '.join(bad)}; known: {', '.join(KINDS)}")
        self.plans, self.key, self.seed = dict(plans), tuple(key), seed
        self.state: DataFrame | None = None
        self.categories: dict[str, list[str]] = {}

    def fit(self, df: DataFrame) -> Encoder:
        rows = []
        for c, p in self.plans.items():
            if p.kind in ("uniform", "ordered_uniform", "frequency"):
                rows.append(fit_intervals(df, c, p.order or None))
            elif p.kind in ("label", "onehot"):
                rows.append(fit_labels([df], c))
            elif p.kind == "float":
                rows.append(fit_float(df, c))
            else:
                continue
            if p.kind == "onehot":
                self.categories[c] = onehot_categories(df, c)
            rows[-1] = rows[-1].withColumn("column", F.lit(c))
        if rows:
            self.state = rows[0]
            for r in rows[1:]:
                self.state = self.state.unionByName(r, allowMissingColumns=True)
        return self

    def _of(self, column: str) -> DataFrame:
        return self.state.where(F.col("column") == column)

    def transform(self, df: DataFrame) -> DataFrame:
        for c, p in self.plans.items():
            if p.kind in ("uniform", "ordered_uniform"):
                df = uniform_encode(df, c, self._of(c), self.key, self.seed)
            elif p.kind == "frequency":
                df = uniform_encode(df, c, self._of(c), midpoint=True)
            elif p.kind == "label":
                df = label_encode(df, c, self._of(c))
            elif p.kind == "onehot":
                df = onehot_encode(df, c, self.categories[c])
            elif p.kind == "timestamp":
                df = timestamp_encode(df, c)
            elif p.kind == "float":
                df = float_encode(df, c, self._of(c))
            else:
                df = binary_encode(df, c)
        return df

    def reverse(self, df: DataFrame) -> DataFrame:
        for c, p in self.plans.items():
            if p.kind in ("uniform", "ordered_uniform", "frequency"):
                df = uniform_decode(df, c, self._of(c))
            elif p.kind == "label":
                df = label_decode(df, c, self._of(c))
            elif p.kind == "onehot":
                df = onehot_decode(df, c, self.categories[c])
            elif p.kind == "timestamp":
                df = timestamp_decode(df, c)
            elif p.kind == "float":
                df = float_decode(df, c, self._of(c))
            else:
                df = binary_decode(df, c)
        return df

    def save(self, path: str) -> None:
        """State and plans as Parquet below path."""
        spark = self.state.sparkSession
        self.state.write.mode("errorifexists").parquet(f"{path}/state")
        plan = json.dumps({"plans": {c: asdict(p) for c, p in self.plans.items()}, "key": self.key, "seed": self.seed, "categories": self.categories})
        spark.range(1, numPartitions=1).select(F.lit(plan).alias("plan")).write.mode("errorifexists").parquet(f"{path}/plan")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        plan = json.loads(spark.read.parquet(f"{path}/plan").first()["plan"])
        out = cls({c: ColumnPlan(p["kind"], tuple(p["order"])) for c, p in plan["plans"].items()}, plan["key"], plan["seed"])
        out.categories, out.state = plan["categories"], spark.read.parquet(f"{path}/state")
        return out


def usable_columns(encoded: DataFrame, sdtypes: Mapping[str, str]) -> list[str]:
    """Numeric columns of an encoded table whose base column (`city.NYC` -> `city`) isn't an id."""

    def base(c: str) -> str:
        return c if c in sdtypes else c.rpartition(".")[0] or c

    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, kind in encoded.dtypes if (kind in numeric or kind.startswith("decimal")) and sdtypes.get(base(c)) not in (None, "id")]


