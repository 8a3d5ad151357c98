"""Data valuation: closed-form Shapley values for a nearest-neighbour scorer, and their statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import ratio
from ..functions.quantiles import exact_quantiles
from ..functions.ranks import ranked_within
from .nn import knn_join, meet_all, meeting, pair_distances, slack_of, squares

#: Distances that a task holds.
HELD_PAIRS = 4_000_000
#: Normal quantiles for two-sided levels.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def knn_shapley_near(train: DataFrame, test: DataFrame, k: int = 5, epsilon: float = 0.01, block_rows: int = 5000) -> DataFrame:
    """(id, test_id, value): knn_shapley() within epsilon, from each test row's K = max(k, 1 / epsilon) nearest training rows alone.

    Rows from the K-th on count as 0; their values are at most 1 / K either way, so nearer ones are off by no more. With fewer training rows than K
    values are exact. Pairs beyond the K nearest (value 0) are no rows.
    """
    n = train.count()
    k = max(1, min(k, n))
    most = max(k, math.ceil(1 / epsilon))
    near = knn_join(test.select("id", "v"), train.select("id", "v"), min(most, n) or 1, block_rows=block_rows).select(F.col("id").alias("test_id"), F.col("neighbour").alias("id"), F.col("rank").alias("i"))
    labels = [df.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label")) for df, name in ((test, "test_id"), (train, "id"))]
    rows = near.join(labels[0], "test_id").join(labels[1], "id").withColumn("same", (F.col("id_label") == F.col("test_id_label")).cast("double"))
    order = Window.partitionBy("test_id").orderBy("i")  # at most K rows
    next_same = F.lead("same").over(order)
    # What the last one is worth itself: its own share where it is the farthest of all, 0 where rows were left out.
    last = F.col("same") * F.least(F.lit(k), F.col("i")) / F.col("i") / k if n <= most else F.lit(0.0)
    steps = rows.withColumn("step", F.when(next_same.isNull(), last).otherwise((F.col("same") - next_same) / k * F.least(F.lit(k), F.col("i")) / F.col("i")))
    return steps.select("id", "test_id", F.sum("step").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("value"))


def knn_shapley(train: DataFrame, test: DataFrame, k: int = 5, block_rows: int = 2000, most_test_rows: int = 100_000, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """(id, test_id, value): each training row's share in classifying each test row, exact. Both are (id, v, label).

    For a test side of at most most_test_rows rows, which is checked; knn_shapley_near() is for more. Every test row ranks all training rows, by definition: work is rows times rows.
    A task holds the distances of some test rows to all training rows (held_pairs at most, as the training rows come by block) and sorts them
    there, so pairs are neither shuffled nor stored; with more training rows than held_pairs, pairs are ranked by ranges of their distance instead.
    With y_i whether the i-th nearest row has the test row's label and c_i = min(k, i) / i, values go from the farthest row
    inwards: s_i = s_{i+1} + (y_i - y_{i+1}) c_i / k. With fewer than k training rows, all are neighbours.
    """
    n, k = _shapley_sizes(train, test, k, most_test_rows)
    if n > held_pairs:
        return _shapley_by_ranges(train, test, k, block_rows)
    return _shapley_in_tasks(train, test, n, k, block_rows, held_pairs, False)


def knn_shapley_uncertainty(train: DataFrame, test: DataFrame, k: int = 5, block_rows: int = 2000, most_test_rows: int = 100_000, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """valuation_uncertainty(knn_shapley()): tasks sum up each training row's values over their test rows, so a row for each of them leaves a task."""
    n, k = _shapley_sizes(train, test, k, most_test_rows)
    if n > held_pairs:
        return valuation_uncertainty(_shapley_by_ranges(train, test, k, block_rows))
    part = _shapley_in_tasks(train, test, n, k, block_rows, held_pairs, True)
    one = part.groupBy("id").agg(F.sum("n").cast("long").alias("m"), F.sum(F.col("n") * F.col("mean")).alias("first"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("second"), F.sum("m2").alias("within"))
    mean = F.col("first") / F.nullif(F.col("m"), F.lit(0))
    square = F.greatest(F.col("within") + F.greatest(F.col("second") - F.col("first") * mean, F.lit(0.0)), F.lit(0.0))
    return _with_interval(one.select("id", mean.alias("mean"), "m", F.when(F.col("m") > 1, F.sqrt(square / (F.col("m") - 1))).otherwise(0.0).alias("std")), "id")


def _shapley_sizes(train: DataFrame, test: DataFrame, k: int, most_test_rows: int) -> tuple[int, int]:
    """(training rows, neighbours)"""
    if test.limit(most_test_rows + 1).count() > most_test_rows:
        raise ValueError(f"more than {most_test_rows} test rows: use knn_shapley_near()")
    n = train.count()
    return n, max(1, min(k, n))


def _shapley_in_tasks(train: DataFrame, test: DataFrame, n: int, k: int, block_rows: int, held_pairs: int, summed: bool) -> DataFrame:
    """(id, test_id, value), or (id, n, mean, m2) for the test rows of a task."""
    kind = dict(train.dtypes)["label"]
    digest = F.shiftrightunsigned(F.xxhash64(F.col("label").cast(kind).cast("string")), 11).cast("double")
    sides = [df.select("id", "v", F.when(F.col("label").isNull(), F.lit(float("nan"))).otherwise(digest).alias("radius")) for df in (test, train)]
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism
    few_rows = max(1, min(held_pairs // max(1, n), -(-test.count() // tasks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, few, gaps = {}, {}, {}
        for (block, ids, b, labels), (own, test_ids, a, test_labels) in meeting(batches):
            every.setdefault(block, (ids, b, labels))
            if own not in few:
                few[own] = tuple(x.copy() for x in (test_ids, a, test_labels))
                gaps[own] = []
            gaps[own].append(_gaps(a, b))
        if not every:
            return
        ids, b, labels = (np.concatenate(x) for x in zip(*every.values(), strict=True))
        for own, (test_ids, a, test_labels) in few.items():
            d = np.concatenate(gaps.pop(own), axis=1)
            total = None
            step = max(1, 500_000 // len(ids))
            for i in range(0, len(a), step):
                order = _nearest_first(d[i : i + step], a[i : i + step], b, ids)
                values = _values(labels[order], test_labels[i : i + step], k)
                if not summed:
                    for at in range(len(order)):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[order[at]]), pa.array(np.full(len(ids), test_ids[i + at])), pa.array(values[at], from_pandas=True)], ["id", "test_id", "value"])
                    continue
                by_row = np.empty_like(values)
                np.put_along_axis(by_row, order, values, axis=1)
                total = _merged(total, by_row)
            if summed:
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x) for x in total]], ["id", "n", "mean", "m2"])

    return meet_all(*sides, few_rows, block_rows, run, "id long, n double, mean double, m2 double" if summed else "id long, test_id long, value double")


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by a product; what isn't finite is farthest."""
    with np.errstate(invalid="ignore", over="ignore"):
        d = squares(a, b)
    d[np.isnan(d)] = np.inf
    return d


def _nearest_first(d: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of b's rows for each of a's, by distance, then id: distances too close for the product's precision are taken exactly."""
    order = np.argsort(d, axis=1)
    sorted_d = np.take_along_axis(d, order, axis=1)
    with np.errstate(invalid="ignore"):
        slack = 2 * slack_of(a[np.isfinite(a).all(axis=1)], b[np.isfinite(b).all(axis=1)])
        close = ~(np.diff(sorted_d, axis=1) > slack)
    for row in np.flatnonzero(close.any(axis=1)):
        tied = close[row]
        run = np.concatenate([[0], np.cumsum(~tied)])
        places = np.flatnonzero(np.concatenate([tied, [False]]) | np.concatenate([[False], tied]))
        which = order[row, places]
        with np.errstate(invalid="ignore", over="ignore"):
            gap = a[row] - b[which]
            exact = np.add.accumulate(gap * gap, axis=1)[:, -1] if gap.shape[1] else np.zeros(len(which))
        exact[np.isnan(exact)] = np.inf
        order[row, places] = which[np.lexsort((ids[which], exact, run[places]))]
    return order


def _values(labels: np.ndarray, test_labels: np.ndarray, k: int) -> np.ndarray:
    """The recursion from the farthest row inwards; NaN where a label is missing."""
    known = ~(np.isnan(labels) | np.isnan(test_labels)[:, None])
    same = (labels == test_labels[:, None]).astype(float)
    i = np.arange(1, same.shape[1] + 1)
    step = same / same.shape[1]
    step[:, :-1] = (same[:, :-1] - same[:, 1:]) / float(k) * np.minimum(k, i[:-1]) / i[:-1]
    out = np.cumsum(step[:, ::-1], axis=1)[:, ::-1]
    return out if known.all() else np.where(known, out, np.nan)


def _merged(total: tuple | None, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, squares about the mean) of each column, with those before."""
    known = ~np.isnan(values)
    n = known.sum(axis=0).astype(float)
    mean = np.where(known, values, 0.0).sum(axis=0) / np.maximum(n, 1)
    m2 = np.where(known, (values - mean) ** 2, 0.0).sum(axis=0)
    if total is None:
        return n, mean, m2
    n0, mean0, m20 = total
    both = np.maximum(n0 + n, 1)
    return n0 + n, mean0 + (mean - mean0) * n / both, m20 + m2 + (mean - mean0) ** 2 * n0 * n / both


def _shapley_by_ranges(train: DataFrame, test: DataFrame, k: int, block_rows: int) -> DataFrame:
    """s_i as (y_i c_i + sum of y_j (c_j - c_{j-1}) over j > i) / k, a sum that goes by ranges of rows first, so no task holds a test row's whole order."""
    labels = [df.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label")) for df, name in ((test, "test_id"), (train, "id"))]
    met = pair_distances(test.select("id", "v"), train.select("id", "v"), block_rows).select(F.col("id").alias("test_id"), F.col("other").alias("id"), "distance")
    rows = met.join(labels[0], "test_id").join(labels[1], "id").select("test_id", "id", "distance", (F.col("id_label") == F.col("test_id_label")).cast("double").alias("same"))
    ranked = ranked_within(rows, ["test_id"], ["distance", "id"], "i")
    c = lambda i: F.least(F.lit(k), i) / i
    here = F.col("same") * c(F.col("i"))
    gain = F.when(F.col("i") > 1, F.col("same") * (c(F.col("i")) - c(F.greatest(F.col("i") - 1, F.lit(1))))).otherwise(0.0)
    gained = ranked.withColumns({"here": here, "gain": gain})
    later = Window.partitionBy("test_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = gained.groupBy("test_id", "part").agg(F.sum("gain").alias("sum")).withColumn("after", F.coalesce(F.sum("sum").over(later), F.lit(0.0))).drop("sum")
    within = Window.partitionBy("test_id", "part").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.coalesce(F.sum("gain").over(within), F.lit(0.0))
    return gained.withColumn("beyond", beyond).join(parts, ["test_id", "part"]).select("id", "test_id", ((F.col("here") + F.col("beyond") + F.col("after")) / k).alias("value"))


def valuation_uncertainty(contributions: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """(key, value, m, std, se, ci_lower, ci_upper) with the normal 95 % interval; a single contribution has no spread."""
    return _with_interval(contributions.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std")), key)


def _with_interval(out: DataFrame, key: str) -> DataFrame:
    se = F.col("std") / F.sqrt(F.nullif(F.col("m"), F.lit(0)).cast("double"))
    return out.select(key, F.col("mean").alias("value"), "m", "std", se.alias("se"), (F.col("mean") - 1.96 * se).alias("ci_lower"), (F.col("mean") + 1.96 * se).alias("ci_upper"))


def wilson_interval(count: Column, total: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson's interval of a share in percent, within 0 and 100; (0, 0) for a total of 0."""
    z, n = Z[level], F.nullif(total.cast("double"), F.lit(0.0))
    p = count.cast("double") / n
    middle, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    clip = lambda x: F.when(x.isNull(), 0.0).otherwise(F.least(F.greatest(100 * x, F.lit(0.0)), F.lit(100.0)))
    return clip(middle - spread), clip(middle + spread)


def valuation_summary(values: DataFrame) -> DataFrame:
    """One row over value, se and ci_upper: moments, and negative and reliably negative shares with their intervals."""
    one = values.agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("se").alias("mean_se"), F.max("se").alias("max_se"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("ci_upper") < 0).alias("reliably_negative"),
    )
    out = {}
    for name in ("negative", "reliably_negative"):
        low, high = wilson_interval(F.col(name), F.col("n"))
        out |= {f"{name}_pct": 100 * ratio(F.col(name), F.col("n")), f"{name}_low": low, f"{name}_high": high}
    return one.withColumns(out)


def rank_by_value(values: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """df with value and its rank, most harmful first; ties by key."""
    return ranked_within(df.join(values.select(key, "value"), key), [], ["value", key], "rank").drop("part")


def drop_most_harmful(values: DataFrame, df: DataFrame, share: float, key: str = "id") -> DataFrame:
    """df without the given share of rows with the lowest values; the cut is a quantile, so nothing is sorted globally."""
    cut = exact_quantiles(values, ["value"], [share])["value"]
    kept = values.where(F.col("value") >= cut[0] if cut else F.lit(False)).select(key)
    return df.join(kept, key, "left_semi")
