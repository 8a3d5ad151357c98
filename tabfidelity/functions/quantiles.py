"""Exact quantiles of many columns by refining histograms; no task holds a column's values, distinct ones or sorted ranges.

A quantile needs one or two order statistics. Each of them is sought in an interval of its column: a job counts the values of all intervals
of all columns in equal bins (sums in tasks, so a few numbers for each bin are shuffled), the bin that holds the wanted rank, drawn in to the
smallest and largest value in it, is the next interval, until a bin holds one value. A bin of few rows is read as it is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256


def _value(c: str) -> Column:
    return F.col(c).cast("double") + F.lit(0.0)  # one zero


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]], few: int = 1000, bins: int = BINS) -> dict[tuple[str, int], float]:
    """(column, rank from 0) -> value, of each column's values that are neither NULL nor NaN."""
    found: dict[tuple[str, int], float] = {}
    columns = [c for c, r in ranks.items() if r]
    if not columns:
        return found
    there = {c: F.when(~F.isnan(_value(c)), _value(c)) for c in columns}
    ends = df.agg(*[f(there[c]).alias(f"{x}{i}") for i, c in enumerate(columns) for x, f in (("low", F.min), ("high", F.max), ("n", F.count))]).first()
    #: (column, low, high) -> (rows in it, [(rank in all, rank within)])
    sought = {(c, ends[f"low{i}"], ends[f"high{i}"]): (ends[f"n{i}"], [(r, r) for r in sorted(set(ranks[c]))]) for i, c in enumerate(columns)}
    while sought:
        for (c, low, high), (_, wanted) in list(sought.items()):
            if low == high:
                found |= {(c, r): low for r, _ in wanted}
                del sought[c, low, high]
        small = {k: v for k, v in sought.items() if v[0] <= few}
        if small:
            keys = list(small)
            inside = F.flatten(F.array(*[F.when(there[c].between(low, high), F.array(F.struct(F.lit(i).alias("i"), there[c].alias("v")))).otherwise(F.array().cast("array<struct<i:int,v:double>>")) for i, (c, low, high) in enumerate(keys)]))
            values: dict[int, list[float]] = {}
            for r in df.select(F.explode(inside).alias("x")).select("x.i", "x.v").toLocalIterator():  # at most few for each interval
                values.setdefault(r["i"], []).append(r["v"])
            for i, key in enumerate(keys):
                own = sorted(values[i])
                found |= {(key[0], r): own[at] for r, at in small[key][1]}
                del sought[key]
        if not sought:
            break
        keys = list(sought)
        parts = []
        for i, (c, low, high) in enumerate(keys):
            scaled = (there[c] / 2 - low / 2) / (high / 2 - low / 2) * bins if math.isfinite(high) and math.isfinite(low) else F.when(there[c] == low, 0.0).when(there[c] == high, float(bins)).otherwise(bins / 2.0)
            number = F.least(F.greatest(F.floor(scaled), F.lit(0)), F.lit(bins - 1)).cast("int")
            parts.append(F.when(there[c].between(low, high), F.array(F.struct(F.lit(i).alias("i"), number.alias("bin"), there[c].alias("v")))).otherwise(F.array().cast("array<struct<i:int,bin:int,v:double>>")))
        counted: dict[int, list] = {}
        for r in df.select(F.explode(F.flatten(F.array(*parts))).alias("x")).groupBy("x.i", "x.bin").agg(F.count("*").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high")).collect():  # bins for each interval
            counted.setdefault(r["i"], []).append((r["bin"], r["n"], r["low"], r["high"]))
        narrower = {}
        for i, key in enumerate(keys):
            before, wanted = 0, sought[key][1]
            for _, n, low, high in sorted(counted[i]):
                here = [(r, at - before) for r, at in wanted if before <= at < before + n]
                if here:
                    narrower[key[0], low, high] = (n, here)
                before += n
        sought = narrower
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """Each column's quantiles, in between linearly; None where a column has no values. NaN counts as the largest value.

    Work is a few passes over df, which should be cheap to read again.
    """
    counts = df.agg(*[f.alias(f"{x}{i}") for i, c in enumerate(columns) for x, f in (("n", F.count(c)), ("nan", F.count_if(F.isnan(F.col(c).cast("double")))))]).first()
    places = {c: [s * (counts[f"n{i}"] - 1) for s in shares] for i, c in enumerate(columns) if counts[f"n{i}"]}
    numbers = {c: counts[f"n{i}"] - counts[f"nan{i}"] for i, c in enumerate(columns)}
    values = order_statistics(df, {c: sorted({r for x in at for r in (math.floor(x), math.ceil(x)) if r < numbers[c]}) for c, at in places.items()})
    out: dict[str, list[float] | None] = dict.fromkeys(columns)
    for c, at in places.items():
        out[c] = []
        for x in at:
            low, high = (values.get((c, r), float("nan")) for r in (math.floor(x), math.ceil(x)))
            out[c].append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
    return out
