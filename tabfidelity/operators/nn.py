"""Nearest neighbours, exact: by pivots where those rule rows out, else block by block.

Pivots (a bounded sample of the searched side) cut the asking side into cells of nearest pivots. With U the farthest row of a cell and
t the distance of the pivot's k-th nearest searched row, every row of the cell has its k neighbours within U + t, so by the triangle
inequality only searched rows within 2 U + t of the pivot can be among them: the others never travel to the cell. Cells and what they ask for
are cut into blocks, so a task holds one block of either side, whatever the sizes; blocks' best rows are merged.

What pivots would shuffle and compare is counted first. Where they rule out too little (many dimensions without
clusters), blocks of rows are packed, and every block of one side meets every block of the other in a Cartesian product: a side is shuffled
once, without copies, and a task holds some packed blocks of it. That is work of rows times rows.

Within a task, distances come from a matrix product that finds what can be among the nearest, whose distances are then taken exactly;
in few dimensions, both blocks are cut into boxes first, and boxes too far apart don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import stored

#: "euclidean", "hamming", or ("mixed", p): p numbers in units of their range (NaN for NULL), then codes of categories.
Metric = str | tuple[str, int]
#: A shuffled row costs about as much as so many distances.
ROW_COST = 500


def vectors(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id, v): the columns as one array of doubles; rows with a NULL among them are left out."""
    there = F.lit(True)
    for c in columns:
        there = there & F.col(c).isNotNull()
    return df.where(there).select(F.col(key).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


def _mixed(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """The mean over columns of |difference| up to 1, and of whether categories differ; a NULL is 1 from any value and 0 from a NULL."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        x, y = a[:, i, None], b[None, :, i]
        if i < p:
            gap = np.subtract(np.nan_to_num(x, nan=FAR), np.nan_to_num(y, nan=FAR))
            total += np.minimum(np.abs(gap, out=gap), 1.0, out=gap)
        else:
            total += x != y
    total /= max(1, a.shape[1])
    return total


def _distances(a: np.ndarray, b: np.ndarray, metric: Metric) -> np.ndarray:
    if isinstance(metric, tuple):
        return _mixed(a, b, metric[1])
    if metric == "hamming":
        return (a[:, None, :] != b[None, :, :]).mean(axis=2)
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0)) if a.size * len(b) < 4_000_000 else _by_product(a, b)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances from one matrix product; off by slack_of() at most."""
    one = lambda x: np.ones((len(x), 1))
    norm = lambda x: (x**2).sum(axis=1)[:, None]
    return np.concatenate([-2 * a, norm(a), one(a)], axis=1) @ np.concatenate([b, one(b), norm(b)], axis=1).T


def slack_of(a: np.ndarray, b: np.ndarray) -> float:
    return 4e-16 * (a.shape[1] + 8) * ((a**2).sum(axis=1).max(initial=0) + (b**2).sum(axis=1).max(initial=0))


def _by_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares(a, b), 0))


def _exact(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of a's rows at from b's rows to, summed dimension by dimension."""
    out = np.empty(len(at))
    for i in range(0, len(at), 20_000):
        gap = a[at[i : i + 20_000]] - b[to[i : i + 20_000]]
        out[i : i + 20_000] = np.sqrt(np.add.accumulate(gap * gap, axis=1)[:, -1]) if gap.shape[1] else 0.0
    return out


@dataclass
class Best:
    """Each asking row's k nearest so far, by distance, then id: (rows, k); places not taken are at infinity."""

    ids: np.ndarray
    a: np.ndarray
    k: int
    metric: Metric
    exclude_self: bool

    def __post_init__(self):
        self.distance = np.full((len(self.a), self.k), np.inf)
        self.other = np.full((len(self.a), self.k), np.iinfo(np.int64).max)

    def meet(self, others: np.ndarray, b: np.ndarray) -> None:
        if self.metric == "euclidean":  # what isn't finite is near nothing
            there = np.isfinite(b).all(axis=1)
            others, b = (others, b) if there.all() else (others[there], b[there])
        if not len(b) or not len(self.a):
            return
        if self.a.shape[1] > MOST_BOXED or min(len(self.a), len(b)) <= 2 * LEAF:
            return self._meet(np.arange(len(self.a)), others, b)
        own, far = (_leaves(x, self.metric) for x in (self.a, b))
        ends = [np.array([f(b[i], axis=0) for i in far]) for f in (np.min, np.max)]
        sizes = np.array([len(i) for i in far])
        for rows in own:
            gap = _box_gaps(self.a[rows].min(axis=0), self.a[rows].max(axis=0), *ends, self.metric)
            order = np.argsort(gap)
            first = int(np.searchsorted(np.cumsum(sizes[order]), 2 * (self.k + 1))) + 2
            near = np.concatenate([far[i] for i in order[:first]])
            self._meet(rows, others[near], b[near])
            rest = [far[i] for i in order[first:] if gap[i] <= self.distance[rows, -1].max() * (1 + 1e-12)]
            if rest:
                rest = np.concatenate(rest)
                self._meet(rows, others[rest], b[rest])

    def _meet(self, rows: np.ndarray, others: np.ndarray, b: np.ndarray) -> None:
        step = max(1, 1_000_000 // len(b))
        for i in range(0, len(rows), step):
            self._chunk(rows[i : i + step], others, b)

    def _chunk(self, rows: np.ndarray, others: np.ndarray, b: np.ndarray) -> None:
        a, ids = self.a[rows], self.ids[rows]
        slack = slack_of(a, b) if self.metric == "euclidean" else 0.0
        product = self.metric == "euclidean" and np.isfinite(slack)
        with np.errstate(invalid="ignore", over="ignore"):
            d = squares(a, b) if product else _mixed(a, b, self.metric[1]) if isinstance(self.metric, tuple) else _distances(a, b, self.metric)
        if self.exclude_self and (own := np.isin(ids, others)).any():
            d[own] = np.where(ids[own, None] == others[None, :], np.inf, d[own])
        most = self.distance[rows, -1]
        most = most * most * (1 + 1e-12) if product else most
        if np.isinf(most).any():  # the k-th least of the least of groups of columns is no nearer than the k-th nearest
            groups = min(len(b), max(4 * self.k, 32))
            if groups >= self.k:
                least = np.minimum.reduceat(d, np.arange(groups) * len(b) // groups, axis=1)
                most = np.minimum(most, np.partition(least, self.k - 1, axis=1)[:, self.k - 1] + slack)
        at, to = np.nonzero(d <= most[:, None] + slack)
        found = _exact(a, b, at, to) if product else d[at, to]
        if self.exclude_self:
            found[ids[at] == others[to]] = np.inf
        kept = np.isfinite(found)
        at, to, found = at[kept], to[kept], found[kept]
        if not len(at):
            return
        changed = np.unique(at)
        row = np.concatenate([at, np.repeat(changed, self.k)])
        distance = np.concatenate([found, self.distance[rows[changed]].ravel()])
        other = np.concatenate([others[to], self.other[rows[changed]].ravel()])
        order = np.lexsort((other, distance, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, place = (x[place < self.k] for x in (order, row, place))
        self.distance[rows[row], place], self.other[rows[row], place] = distance[order], other[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.isfinite(self.distance)
        return np.repeat(self.ids, there.sum(axis=1)), self.other[there], self.distance[there]


#: Boxes of so many rows, in so few dimensions.
LEAF, MOST_BOXED = 64, 8


def _leaves(x: np.ndarray, metric: Metric) -> list[np.ndarray]:
    """Rows by boxes: cut in halves along the widest column."""
    numbers = metric[1] if isinstance(metric, tuple) else 0 if metric == "hamming" else x.shape[1]
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        own = x[rows]
        wide = own.max(axis=0) - own.min(axis=0)
        if metric != "euclidean":
            wide = np.where(np.arange(x.shape[1]) < numbers, np.minimum(wide, 1.0), wide > 0)
        if len(rows) <= LEAF or not wide.max(initial=0) > 0:
            out.append(rows)
            continue
        half = len(rows) // 2
        order = np.argpartition(own[:, wide.argmax()], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def _box_gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, metric: Metric) -> np.ndarray:
    """The least distances that rows of a box and rows of other boxes can have."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0)
    if metric == "euclidean":
        return np.sqrt((gap**2).sum(axis=1))
    numbers = metric[1] if isinstance(metric, tuple) else 0
    return np.where(np.arange(gap.shape[1]) < numbers, np.minimum(gap, 1.0), gap > 0).sum(axis=1) / max(1, gap.shape[1])


def _plain(x: np.ndarray, metric: Metric) -> np.ndarray:
    """NULL among numbers as a number far from all but itself."""
    return np.nan_to_num(x, nan=FAR) if isinstance(metric, tuple) else x


FAR = 1e300


def _block_best(k: int, metric: Metric, exclude_self: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []}).astype({"id": "int64", "neighbour": "int64", "distance": "float64"})
        a, b = (_plain(np.stack(x["v"]).astype(float), metric) for x in (left, right))
        best = Best(left["id"].to_numpy(), a, k, metric, exclude_self)
        best.meet(right["id"].to_numpy(), b)
        return pd.DataFrame(dict(zip(("id", "neighbour", "distance"), best.found(), strict=True)))

    return run


def _dealt(a: DataFrame, b: DataFrame, block_rows: int):
    """Both sides grouped by (block of a, block of b)."""
    blocks_a, blocks_b = (max(1, -(-df.count() // block_rows)) for df in (a, b))
    left = a.withColumn("ba", F.pmod(F.xxhash64("id"), F.lit(blocks_a)).cast("int")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(blocks_b - 1))))
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of its own, as a and b may be one table
    right = b.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(blocks_b)).cast("int")).withColumn("ba", F.explode(F.sequence(F.lit(0), F.lit(blocks_a - 1))))
    return left.groupBy("ba", "bb").cogroup(right.groupBy("ba", "bb"))


def pair_distances(a: DataFrame, b: DataFrame, block_rows: int = 2000) -> DataFrame:
    """(id, other, distance): every row of a against every row of b, exact. For what needs the whole order, by definition."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "other": [], "distance": []}).astype({"id": "int64", "other": "int64", "distance": "float64"})
        x, y = np.stack(left["v"]).astype(float), np.stack(right["v"]).astype(float)
        d = np.concatenate([_distances(x[i : i + 200], y, "euclidean") for i in range(0, len(x), 200)])
        return pd.DataFrame({"id": np.repeat(left["id"].to_numpy(), len(y)), "other": np.tile(right["id"].to_numpy(), len(x)), "distance": d.ravel()})

    return _dealt(a, b, block_rows).applyInPandas(run, "id long, other long, distance double")


#: Packed rows that a task holds of the side that meets all blocks of the other, and those it gets of the other.
HELD_BYTES, DEALT_BYTES = 1 << 25, 1 << 28
PACKED = "block long, n int, id binary, v binary, radius binary"


def _packing(block_rows: int):
    """mapInArrow: (id, v[, radius]) -> PACKED, so many rows in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        for own in _rebatched(batches, block_rows):
            radius = own.column("radius").to_numpy() if "radius" in own.schema.names else np.zeros(0)
            parts = [own.column("id").to_numpy().astype(np.int64), _matrix(own).astype(float), radius.astype(float)]
            yield pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([own.num_rows], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["block", "n", "id", "v", "radius"])
            made += 1

    return run


def _rebatched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows, the last of fewer."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while n + b.num_rows >= rows:
            cut = rows - n
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held, n, b = [], 0, b.slice(cut)
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.concat_batches(held)


def _unpacked(b: pa.RecordBatch, row: int, side: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(block, ids, vectors, radii)"""
    n = b.column(f"{side}_n")[row].as_py()
    ids, v, radius = (np.frombuffer(b.column(f"{side}_{c}")[row].as_buffer(), dtype=t) for c, t in (("id", np.int64), ("v", float), ("radius", float)))
    return b.column(f"{side}_block")[row].as_py(), ids, v.reshape(n, -1), radius


def _met(a: DataFrame, b: DataFrame, block_rows: int, run, schema: str) -> DataFrame:
    """run over an iterator of (block number, ids, vectors, radii) of a, and an iterator of those of b, as mapInArrow would.

    Every packed block of a meets every one of b in some task; a task's pairs come by blocks of a.
    """
    size = F.coalesce(F.max(F.size("v")), F.lit(0)) * F.count("*") * 8
    (n_a, bytes_a), (n_b, bytes_b) = (df.agg(F.count("*"), size).first() for df in (a, b))
    up = lambda x, y: max(1, -(-x // y))
    blocks_a, blocks_b, tasks = up(n_a, block_rows), up(n_b, block_rows), 4 * a.sparkSession.sparkContext.defaultParallelism
    parts_b = up(bytes_b, HELD_BYTES)
    parts_a = max(up(bytes_a, DEALT_BYTES), min(blocks_a, up(tasks, parts_b)))
    parts_b = max(parts_b, min(blocks_b, up(tasks, parts_a)))
    left, right = (df.mapInArrow(_packing(block_rows), PACKED).repartition(n).select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "n", "id", "v", "radius")]) for df, n, side in ((a, parts_a, "a"), (b, parts_b, "b")))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)  # packed blocks, not rows
    return pairs.mapInArrow(run, schema)


def meet_all(few: DataFrame, every: DataFrame, few_rows: int, block_rows: int, run, schema: str) -> DataFrame:
    """As _met(), with a = every and b = few: a task has a block of few_rows rows of few, as a rule, and meets all of every, block by block.

    Every is shuffled once, and read again in each task; nothing of the size of their product is stored.
    """
    blocks = max(1, -(-few.count() // few_rows))
    sides = ((every, 1, "a", block_rows), (few, blocks, "b", few_rows))
    left, right = (df.mapInArrow(_packing(rows), PACKED).repartition(n).select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "n", "id", "v", "radius")]) for df, n, side, rows in sides)
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)


def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block of a, block of b), each unpacked; a's is the same object as long as it is the same block."""
    now, a = None, None
    for b in batches:
        for row in range(b.num_rows):
            if (block := b.column("a_block")[row].as_py()) != now:
                now, a = block, tuple(x.copy() if isinstance(x, np.ndarray) else x for x in _unpacked(b, row, "a"))
            yield a, _unpacked(b, row, "b")


def _packed_best(k: int, metric: Metric, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for a, (_, others, b, _) in meeting(batches):
            if a is not now:
                if best is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found()], ["id", "neighbour", "distance"])
                now, best = a, Best(a[1], _plain(a[2], metric), k, metric, exclude_self)
            best.meet(others, _plain(b, metric))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found()], ["id", "neighbour", "distance"])

    return run


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _pivots(sample: np.ndarray, most: int, metric: Metric) -> np.ndarray:
    """Half of them as they come, the others each the farthest row of the sample from those before, so that no cluster is left without."""
    chosen = [*range(-(-min(most, len(sample)) // 2))]
    gap = _distances(sample, sample[chosen], metric).min(axis=1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1:]], metric)[:, 0])
    return np.unique(sample[chosen], axis=0)


def _cells(pivots: np.ndarray, metric: Metric):
    """mapInArrow: (id, v) -> (cell, id, v, far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                own = b.slice(start, 2000)
                d = _distances(_matrix(own), pivots, metric)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), own.column("id"), own.column("v"), pa.array(d[np.arange(len(d)), cell])], ["cell", "id", "v", "far"])

    return run


def _nearest_to_pivots(pivots: np.ndarray, metric: Metric, k: int):
    """mapInArrow: (id, v) -> (cell, d): each pivot's k smallest distances in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(pivots), k), np.inf)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                d = _distances(_matrix(b.slice(start, 2000)), pivots, metric).T
                best = np.partition(np.concatenate([best, d], axis=1), k - 1, axis=1)[:, :k]
        cell, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(best[cell, at])], ["cell", "d"])

    return run


def _asked(pivots: np.ndarray, metric: Metric, reach: np.ndarray, rows: bool):
    """mapInArrow: (id, v) -> (cell, id, v) for every cell whose reach a row is in, or (cell, n): how many those are in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pivots), dtype=np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                own = b.slice(start, 2000)
                at, cell = np.nonzero(_distances(_matrix(own), pivots, metric) <= reach[None, :])
                if rows:
                    for i in range(0, len(at), 20_000):
                        some = pa.array(at[i : i + 20_000])
                        yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 20_000].astype(np.int32)), own.column("id").take(some), own.column("v").take(some)], ["cell", "id", "v"])
                else:
                    n += np.bincount(cell, minlength=len(n))
        if not rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["cell", "n"])

    return run


@dataclass(frozen=True)
class Plan:
    """What a join by pivots needs, and what either way would cost."""

    pivots: np.ndarray
    reach: np.ndarray
    asking: np.ndarray
    asked: np.ndarray
    block_rows: int
    all_asking: int
    all_asked: int

    def blocks(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-n // self.block_rows))

    @property
    def pivot_rows(self) -> int:
        """Rows shuffled by pivots."""
        return int((self.asking * self.blocks(self.asked) + self.asked * self.blocks(self.asking)).sum())

    @property
    def block_rows_total(self) -> int:
        """Rows shuffled block by block."""
        a, b = (max(1, -(-n // self.block_rows)) for n in (self.all_asking, self.all_asked))
        return self.all_asking * b + self.all_asked * a

    @property
    def pairs(self) -> int:
        """Distances by pivots."""
        return int((self.asking * self.asked).sum())

    @property
    def by_pivots(self) -> bool:
        return self.pairs + ROW_COST * self.pivot_rows < self.all_asking * self.all_asked + ROW_COST * self.block_rows_total


def plan_join(a: DataFrame, b: DataFrame, k: int, metric: Metric = "euclidean", exclude_self: bool = False, block_rows: int = 5000, most_pivots: int = 512) -> tuple[Plan, DataFrame]:
    """(the plan, a's rows with their cells). Numbers by pivot reach the driver, never rows but the pivots."""
    n_b = b.count()
    most = int(np.clip(n_b**0.5, 1, most_pivots))
    sample = b.orderBy(F.xxhash64("id"), "id").limit(4 * most).toPandas()
    pivots = _pivots(np.stack(sample["v"]).astype(float), most, metric) if len(sample) else np.zeros((0, 0))
    if not len(pivots):
        return Plan(pivots, np.zeros(0), np.zeros(0, dtype=int), np.zeros(0, dtype=int), block_rows, a.count(), 0), a
    celled = a.mapInArrow(_cells(pivots, metric), "cell int, id long, v array<double>, far double")
    radius, asking = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        radius[r["cell"]], asking[r["cell"]] = r["far"], r["n"]
    need = k + exclude_self
    order = Window.partitionBy("cell").orderBy("d")
    near = b.mapInArrow(_nearest_to_pivots(pivots, metric, need), "cell int, d double").withColumn("i", F.row_number().over(order)).where(F.col("i") == need)
    kth = np.full(len(pivots), np.inf)
    for r in near.collect():
        kth[r["cell"]] = r["d"]
    reach = 2 * radius + kth
    reach += 1e-6 * (1 + reach + np.abs(np.nan_to_num(pivots)).max(initial=0) * pivots.shape[1] ** 0.5)  # for rounding
    reach[asking == 0] = -1
    asked = np.zeros(len(pivots), dtype=np.int64)
    for r in b.mapInArrow(_asked(pivots, metric, reach, False), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        asked[r["cell"]] = r["n"]
    return Plan(pivots, reach, asking, asked, block_rows, int(asking.sum()), n_b), celled


def knn_join(a: DataFrame, b: DataFrame, k: int, metric: Metric = "euclidean", exclude_self: bool = False, block_rows: int = 5000, by_pivots: bool | None = None) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest rows of b for each row of a, ties by id. Both are (id, v).

    by_pivots: None chooses by what either way would shuffle and compare.
    """
    a, b = stored(a.select("id", "v"), "asking"), stored(b.select("id", "v"), "searched")
    plan, celled = plan_join(a, b, k, metric, exclude_self, block_rows)
    best, schema = _block_best(k, metric, exclude_self), "id long, neighbour long, distance double"
    if len(plan.pivots) and (plan.by_pivots if by_pivots is None else by_pivots):
        blocks = a.sparkSession.createDataFrame(list(zip(range(len(plan.pivots)), plan.blocks(plan.asking).tolist(), plan.blocks(plan.asked).tolist(), strict=True)), "cell int, blocks_a long, blocks_b long")
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        asked = b.mapInArrow(_asked(plan.pivots, metric, plan.reach, True), "cell int, id long, v array<double>")
        left, right = (df.join(F.broadcast(blocks), "cell") for df in (celled, asked))  # a row for each pivot
        left = left.withColumn("ba", part("blocks_a")).withColumn("bb", every("blocks_b")).select("cell", "ba", "bb", "id", "v")
        right = right.withColumn("bb", part("blocks_b")).withColumn("ba", every("blocks_a")).select("cell", "ba", "bb", "id", "v")
        found = left.groupBy("cell", "ba", "bb").cogroup(right.groupBy("cell", "ba", "bb")).applyInPandas(best, schema)
    else:
        found = _met(a, b, block_rows, _packed_best(k, metric, exclude_self), schema)
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "distance")


def within_radius(a: DataFrame, balls: DataFrame, block_rows: int = 5000) -> DataFrame:
    """(id, inside): for each row of a, how many balls (id, v, radius) it lies in. Rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside = None, None
        for a, (_, _, q, radius) in meeting(batches):
            if a is not now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(now[1]), pa.array(inside)], ["id", "inside"])
                now, inside = a, np.zeros(len(a[1]), dtype=np.int64)
            inside += _inside(a[2], q, radius)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(now[1]), pa.array(inside)], ["id", "inside"])

    part = _met(a.select("id", "v"), balls.select("id", "v", F.col("radius").cast("double").alias("radius")), block_rows, run, "id long, inside long")
    return part.groupBy("id").agg(F.sum("inside").alias("inside")).where("inside > 0")


def _inside(p: np.ndarray, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many balls each row of p lies in; distances close to a radius are taken exactly."""
    out = np.zeros(len(p), dtype=np.int64)
    finite = np.isfinite(q).all(axis=1)
    q, radius = (q, radius) if finite.all() else (q[finite], radius[finite])
    step = max(1, 1_000_000 // max(1, len(q)))
    for i in range(0, len(p) if len(q) else 0, step):
        own = p[i : i + step]
        slack = slack_of(own, q)
        with np.errstate(invalid="ignore", over="ignore"):
            if np.isfinite(slack):
                room = slack + 1e-12 * radius * radius
                d = squares(own, q) - (radius * radius)[None, :]
                at, to = np.nonzero(np.abs(d) <= room[None, :])
                d[at, to] = np.where(_exact(own, q, at, to) <= radius[to], -1.0, 1.0)
                out[i : i + step] = (d <= 0).sum(axis=1)
            else:
                out[i : i + step] = (_distances(own, q, "euclidean") <= radius[None, :]).sum(axis=1)
    return out


def _kernel_sums(gamma: float):
    """The kernel's values over both blocks, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for (_, _, a, _), (_, _, b, _) in meeting(batches):
            step = max(1, 1_000_000 // len(b))
            for i in range(0, len(a), step):
                d = np.maximum(squares(a[i : i + step], b), 0)
                d *= -gamma
                total += float(np.exp(d, out=d).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    return run


def kernel_mean(a: DataFrame, b: DataFrame, gamma: float, name: str, block_rows: int = 5000) -> DataFrame:
    """One row: the mean of exp(-gamma |x - y|^2) over all rows x of a and y of b (id, v); a number for each task leaves it."""
    pairs = a.count() * b.count()
    sums = _met(a.select("id", "v"), b.select("id", "v"), block_rows, _kernel_sums(gamma), "total double")
    return sums.agg((F.sum("total") / F.lit(pairs or None).cast("double")).alias(name))
