"""Sums of single columns and of pairs of columns for many runs at once: one pass, added up in Arrow batches and merged by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "x", "y", "xx", "yy", "xy")
ENDS = ("x_low", "x_high", "y_low", "y_high")


def _of_rows(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """n, x, xx, xy, low, high as d by d matrices: of column i over the rows where both i and j are there."""
    there = ~np.isnan(x)
    moved = np.where(there, x - shift, 0.0)
    mask = there.astype(np.float64)
    low, high = np.full((2, x.shape[1], x.shape[1]), [[[np.inf]], [[-np.inf]]])
    for j in range(x.shape[1]):
        both = there & there[:, j : j + 1]
        low[:, j] = np.where(both, moved, np.inf).min(axis=0)
        high[:, j] = np.where(both, moved, -np.inf).max(axis=0)
    return np.stack([mask.T @ mask, moved.T @ mask, (moved * moved).T @ mask, moved.T @ moved, low, high])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a[:4] + b[:4], np.minimum(a[4:5], b[4:5]), np.maximum(a[5:], b[5:])])


def _by_run(batch: pa.RecordBatch, runs: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(a run's values, its rows' places)."""
    if not runs:
        yield (), np.arange(batch.num_rows)
        return
    codes = np.column_stack([pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy() for k in range(runs)])
    _, first, number = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    number = number.ravel()
    places = np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])
    for at, rows in zip(first, places, strict=True):
        yield tuple(batch.column(k)[int(at)].as_py() for k in range(runs)), rows


def co_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), shifts: Sequence[float] = (), most_numbers: int = 1 << 22) -> DataFrame:
    """A row for each run of by and pair of columns (i <= j, their places): n, x, y, xx, yy, xy and the ends of x and y, over the rows where both
    are there (NaN counts as missing), each less its shift.

    Shifts near the means keep what the sums lose to rounding small. A task holds at most most_numbers numbers before it hands its sums on, so
    that few numbers are shuffled however many rows there are.
    """
    d, runs = len(columns), len(by)
    shift = np.array(list(shifts) or [0.0] * d, dtype=np.float64)
    i, j = np.triu_indices(d)
    most = max(1, most_numbers // (6 * d * d))
    names = [*by, "i", "j", *SUMS, *ENDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                keys, m = list(held), np.stack(list(held.values()))
                of = lambda a, b, k: m[:, k, a, b].ravel()
                own = [pa.array([key[k] for key in keys for _ in i], types[k]) for k in range(runs)]
                sums = [of(i, j, 0).astype(np.int64), of(i, j, 1), of(j, i, 1), of(i, j, 2), of(j, i, 2), of(i, j, 3)]
                ends = [of(i, j, 4), of(i, j, 5), of(j, i, 4), of(j, i, 5)]
                places = [np.tile(x, len(keys)).astype(np.int32) for x in (i, j)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x) for x in (*places, *sums, *ends)]], names)

        for b in batches:
            if not b.num_rows:
                continue
            types[:] = [b.column(k).type for k in range(runs)]
            x = np.column_stack([b.column(runs + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(d)])
            for key, rows in _by_run(b, runs):
                part = _of_rows(x[rows], shift)
                held[key] = _merged(held[key], part) if key in held else part
                if len(held) >= most:
                    yield from out()
                    held.clear()
        yield from out()

    kinds = dict(df.select(*by).dtypes) if by else {}
    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "i int, j int, n long", *[f"{c} double" for c in (*SUMS[1:], *ENDS)]])
    parts = df.select(*by, *[F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate(columns)]).mapInArrow(run, schema)
    merged = [F.sum(c).alias(c) for c in SUMS] + [(F.min if c.endswith("low") else F.max)(c).alias(c) for c in ENDS]
    return parts.groupBy(*by, "i", "j").agg(*merged)


def correlation() -> Column:
    """Of a row of co_moments(): NULL if either side is constant."""
    centred = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    varies = (F.col("x_low") < F.col("x_high")) & (F.col("y_low") < F.col("y_high"))
    return F.when(varies, centred("x", "y", "xy") / F.sqrt(centred("x", "x", "xx") * centred("y", "y", "yy")))


def mean_product(shifts: Sequence[float]) -> Column:
    """Of a row of co_moments() with these shifts: the mean of the product of the columns as they were."""
    of = F.array(*[F.lit(float(s)) for s in shifts])
    a, b, n = F.get(of, F.col("i")), F.get(of, F.col("j")), F.nullif(F.col("n"), F.lit(0))
    return F.col("xy") / n + a * F.col("y") / n + b * F.col("x") / n + F.when(F.col("n") > 0, a * b)
