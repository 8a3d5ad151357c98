"""Null-safe row keys, equal-width bins and partition-independent pseudo-random numbers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_text(df: DataFrame, column: str) -> Column:
    """Text that is equal just where the values are: -0.0 is 0.0, | ~ and \\ are escaped, NULL is a lone ~."""
    kind = dict(df.dtypes)[column]
    value = F.col(column)
    if kind in ("double", "float"):
        value = (value + F.lit(0.0)).cast("string")
    elif kind == "string":
        value = F.regexp_replace(value, r"([|~\\])", r"\\$1")
    else:
        value = value.cast("string")
    return F.coalesce(value, F.lit("~"))


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """A 128-bit key of the columns; NULLs count as equal to each other and to nothing else."""
    return F.md5(F.concat_ws("|", *[key_text(df, c) for c in columns]))


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the text of the parts and the seed; the same on any partitioning."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("~")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def shuffle_key(*parts: str, seed: int = 0) -> Column:
    """What to sort by for a seeded shuffle."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("~")) for p in parts], F.lit(str(seed))))


def equal_width_bin(value: Column, low: Column, high: Column, n: int) -> Column:
    """Bin 1..n between low and high, clipped; NULL stays NULL; a constant column is bin 1."""
    width = F.nullif(high - low, F.lit(0))
    number = F.floor((value - low) / width * n) + 1
    return F.when(value.isNull(), F.lit(None)).otherwise(F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), F.lit(n))).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL for an empty whole."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
