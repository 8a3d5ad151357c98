"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

1. Entries become whole numbers x (scaled, rounded down, shifted). Sums, and the scatter of x less a whole number near each
   dimension's mean, are added up in whole numbers by tasks, so n times the scatter is exact and doesn't depend on partitions.
2. The driver holds dimensions times dimensions and no rows: Cholesky with the largest remaining diagonal as
   the pivot stops where nothing is left (dependent dimensions), and gives a lower triangular factor. Rotations of its columns make them orthogonal;
   their squared norms are the eigenvalues, the normalised columns the components, most precise for the small ones too.
3. One pass projects each row, and a second one measures the whitened columns' covariance, centred within each batch and merged.

Defined results: rows with a null vector or with null or non-finite entries go; shorter vectors count as filled with
zeros; a null vec_id takes part and stays null; repeated rows count each; components of no variance aren't there, so an empty table, one
row or equal rows give no rows; a deviation beyond a long is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import filled, matrix, usable

MOST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    components: int = 8
    scale: float = 1024.0
    shift: int = 100_000
    #: Eigenvalues below this share of the largest one are rounding, not variance.
    least: float = 1e-13


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    #: A row each, by falling eigenvalue.
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole(df: DataFrame, vector: str, p: Whitening) -> tuple[DataFrame, int]:
    """((vec_id, x) of the usable rows, dimensions)."""
    good = df.select("vec_id", F.col(vector).alias("x")).where(usable(F.col("x")))
    return filled(good.withColumn("x", F.transform("x", lambda c: F.floor(c.cast("double") * p.scale).cast("long") + F.lit(p.shift))), "x")


def _exact_sums(y: np.ndarray, products: bool) -> list[int]:
    """Sums of the columns, and of the products of all their pairs, as Python numbers."""
    most = int(np.abs(y).max(initial=0)) or 1
    out = [int(v) for v in y.sum(axis=0)] if most * len(y) <= MOST_LONG else [sum(map(int, c)) for c in y.T]
    if not products:
        return out
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return out + [int(v) for v in (f.T @ f).ravel()]
    o = y.astype(object)
    return out + list((o.T @ o).ravel())


def _sums(rows: DataFrame, d: int, centre: list[int] | None = None) -> list[int]:
    """[rows, sums of x] or, around a centre, those and the products' sums. Numbers travel as decimal text, as they may exceed a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                x = matrix(b.column("x").slice(start, 4096), d)
                y = x if centre is None else x - np.array(centre, dtype=np.int64)
                part = [len(y), *_exact_sums(y, centre is not None)]
                total = part if total is None else [a + c for a, c in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), type=pa.int64()), pa.array(map(str, total))], ["i", "sum"])

    added = rows.select("x").mapInArrow(run, "i long, sum string").groupBy("i").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    return [int(r["sum"]) for r in added.orderBy("i").collect()]  # 1 + d, or 1 + d + d * d numbers


def pivoted_cholesky(a: np.ndarray, least: float) -> np.ndarray:
    """L of rank columns with a = L L^T (rows in a's order); the pivot is the largest diagonal that is left."""
    left, n = a.copy(), len(a)
    columns: list[np.ndarray] = []
    floor = least * max(np.diag(a).max(initial=0), 0)
    for _ in range(n):
        diagonal = np.diag(left)
        k = int(np.argmax(diagonal))
        if diagonal[k] <= floor:
            break
        c = left[:, k] / np.sqrt(diagonal[k])
        left = left - np.outer(c, c)
        left[k, :] = left[:, k] = 0
        columns.append(c)
    return np.array(columns).T.reshape(n, len(columns))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated, pair by pair, until all are orthogonal; larger norms first."""
    c = factor.T.copy()  # a row for each column
    for _ in range(sweeps):
        turned = False
        for i in range(len(c) - 1):
            for j in range(i + 1, len(c)):
                aa, bb, ab = c[i] @ c[i], c[j] @ c[j], c[i] @ c[j]
                if aa < bb:
                    c[[i, j]] = c[[j, i]]
                    aa, bb = bb, aa
                if abs(ab) <= 1e-15 * np.sqrt(aa * bb):
                    continue
                turned = True
                z = (aa - bb) / (2 * ab)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                c[i], c[j] = cos * (c[i] + t * c[j]), cos * (c[j] - t * c[i])
        if not turned:
            break
    return c[np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")].T


def fit(rows: DataFrame, d: int, p: Whitening = Whitening()) -> Model | None:
    """None for an empty table. rows: (vec_id, x)."""
    if not d or not (first := _sums(rows, d)):
        return None
    n, sums = first[0], first[1:]
    centre = [round(s / n) for s in sums]
    around = _sums(rows, d, centre)
    s, products = np.array(around[1 : d + 1], dtype=object), np.array(around[d + 1 :], dtype=object).reshape(d, d)
    exact = n * products - np.outer(s, s)  # n times the centred scatter
    covariance = np.array([[v / (n * n) for v in row] for row in exact], dtype=np.float64)
    rotated = jacobi(pivoted_cholesky(covariance, p.least))
    values = np.einsum("ij,ij->j", rotated, rotated)
    kept = [i for i in range(min(p.components, len(values))) if values[i] > p.least * values[0]]
    parts = (rotated[:, kept] / np.sqrt(values[kept])).T
    for c in parts:
        c *= np.sign(c[np.argmax(np.abs(c))])
    return Model(n, sums, parts, values[kept], float(sum(exact[i, i] for i in range(d)) / (n * n)))


def _project(m: Model, d: int):
    """mapInArrow: (vec_id, x) -> (vec_id, deviation, whitened)."""
    centre = [s // m.n for s in m.sums]
    rest = [s - c * m.n for s, c in zip(m.sums, centre, strict=True)]
    scaled = m.components / np.sqrt(m.eigenvalues)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = matrix(b.column("x"), d) - np.array(centre, dtype=np.int64)  # n x - S = n y - rest
            if (m.n * (int(np.abs(y).max()) + 1)) ** 2 * d <= MOST_LONG:
                gap = m.n * y - np.array(rest, dtype=np.int64)
                deviation = [int(v) for v in np.einsum("ij,ij->i", gap, gap)]
            else:
                deviation = [sum((m.n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
            white = (y - np.array(rest, dtype=np.float64) / m.n) @ scaled.T
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([v if v <= MOST_LONG else None for v in deviation], type=pa.int64()), pa.array(list(white), type=pa.list_(pa.float64()))],
                ["vec_id", "deviation", "white"],
            )

    return run


def _co_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (white) -> (n, mean, products): of each batch, products around the batch's own means."""
    for b in batches:
        if b.num_rows:
            w = matrix(b.column("white"), len(b.column("white")[0]))
            mean = w.mean(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([len(w)], type=pa.int64()), pa.array([mean.tolist()], type=pa.list_(pa.float64())), pa.array([((w - mean).T @ (w - mean)).ravel().tolist()], type=pa.list_(pa.float64()))], ["n", "mean", "products"])


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened columns' covariance less the identity.

    Batches' products around their own means, and what those means add around the common mean, are summed by Spark.
    """
    parts = white.select("white").mapInArrow(_co_moments, "n long, mean array<double>, products array<double>")
    pair = lambda i, j: F.sum(F.get("products", F.lit(i * k + j)) + F.col("n") * F.get("mean", F.lit(i)) * F.get("mean", F.lit(j)))
    means = [F.sum(F.col("n") * F.get("mean", F.lit(i))).alias(f"m{i}") for i in range(k)]
    one = parts.agg(F.sum("n").alias("n"), *means, *[pair(i, j).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(one[f"p{i}_{j}"] / one["n"] - one[f"m{i}"] * one[f"m{j}"] / one["n"] ** 2 - (i == j)) for i in range(k) for j in range(i, k))


def whiten(df: DataFrame, vector: str = "embedding", p: Whitening = Whitening()) -> DataFrame:
    """A row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = whole(df.withColumn("vec_id", F.col("vec_id").cast("long")), vector, p)
    model = fit(rows, d, p)
    if model is None or not len(model.components):
        return df.sparkSession.createDataFrame([], schema)
    k = len(model.components)
    white = written(rows.mapInArrow(_project(model, d), "vec_id long, deviation long, white array<double>"), "whitened")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    long = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(white, k)).alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
