"""Hard-negative mining through an inverted multi-index; exact.

Vectors are cut into two halves. A codebook for each half, fitted on a bounded sample, gives every row a cell (a, b); all
rows are indexed. For an anchor, a code's half-score bound is its dot product with the anchor's half plus the anchor's norm times the code's
radius (the farthest of all rows of the code), so no row of a cell scores above the sum of its two bounds.

Cells are dealt in square groups, whose rows beyond a task's share are salted into parts. A row of the index goes once to
each block of anchors; an anchor goes only to the groups whose bound reaches what it still looks for: rows of the
sample that it has scored give a first floor. In a part, rows come first and anchors stream by. For each anchor a multi-sequence heap visits the
part's cells by falling sum of half-score bounds, starting from the best code of each half, and stops when no cell ahead can change
the windows it has filled (all certified). The best rows of all parts are merged.

Two such searches follow one another: the anchor's positives (its best rows of the same label), then, for each positive, the best rows of
another label whose score lies within a share of the positive's, and not above it.

Defined results: rows with a null vec_id, label or vector, or with null or non-finite components, take no part; shorter vectors
count as filled with zeros; rows that repeat a vec_id are rows of their own (an anchor each, and other rows to one another);
anchors without positives, and positives without negatives, give no rows, and neither does an empty table. Scores are exact while
the largest squared component times dimensions is below 2^63; beyond, a ValueError says so. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .vectors import filled, matrix, usable


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least this many hundredths of the positive's.
    least_percent: int = 80
    scale: float = 256.0
    anchor_every: int = 100
    #: Rows on which codebooks are fitted and first floors are measured; all rows are indexed.
    sample: int = 8192
    most_codes: int = 256
    #: Codes on each side of a group of cells.
    group_codes: int = 4
    #: Rows of a cell that the codebooks aim for, and rows of a group that a task holds at most, roughly.
    cell_rows: int = 64
    part_rows: int = 1536
    #: Anchors for which one copy of the index's rows is dealt.
    block_anchors: int = 65_536


#: Ends of a window that is open: beyond any score.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Codes:
    """Both halves' codebooks, each in the order of its centres' first direction, and their codes' radii."""

    dims: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    #: Whether products and their sums are exact as doubles.
    exact_float: bool


@dataclass(frozen=True)
class Index:
    codes: Codes
    #: (row, vec_id, label, x, a, b, ga, gb, parts, part): codes, groups of cells, and the part of the group's parts.
    rows: DataFrame


def prepared(df: DataFrame, p: Mining, vector: str = "embedding") -> DataFrame:
    """(row, vec_id, label, x): the rows that take part, numbered, with whole components and the shifted labels."""
    kept = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col(vector)))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * p.scale).cast("long"))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    return written(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")


def codebook(half: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centres of the sample's halves, in the order of the centres' first direction, so that neighbours in the list are near."""
    distinct = np.unique(half, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)]
    for _ in range(rounds if len(centres) else 0):
        own = nearest(half, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, half)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    if len(centres) > 1 and centres.shape[1]:
        centred = centres - centres.mean(axis=0)
        centres = centres[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def _assign(d: int, books, ship: list[str]):
    """mapInArrow: adds the two codes and the distances from their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), d).astype(np.float64)
            out = []
            for half, centres in zip((x[:, : d // 2], x[:, d // 2 :]), books, strict=True):
                own = nearest(half, centres)
                out += [pa.array(own.astype(np.int32)), pa.array(np.sqrt(((half - centres[own]) ** 2).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ship], out[0], out[2], out[1], out[3]], [*ship, "a", "b", "ra", "rb"])

    return run


def build(rows: DataFrame, p: Mining) -> tuple[Index, pa.Table]:
    """(the index over all rows, the sample)."""
    rows, d = filled(rows, "x")
    most = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
    size = rows.agg(F.count("*").alias("n"), most.alias("most")).first()
    most = size["most"] or 0
    if most**2 * max(d, 1) >= 1 << 63:
        raise ValueError("the scores of such large components don't fit a long")
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(p.sample).toArrow()
    x = matrix(sample["x"].combine_chunks(), d).astype(np.float64)
    codes = int(np.clip(round((size["n"] / p.cell_rows) ** 0.5), 1, p.most_codes))
    books = (codebook(x[:, : d // 2], codes), codebook(x[:, d // 2 :], codes))
    ship = ["row", "vec_id", "label", "x"]
    coded = written(rows.select(*ship).mapInArrow(_assign(d, books, ship), "row long, vec_id long, label long, x array<long>, a int, b int, ra double, rb double"), "coded")
    radii = tuple(np.zeros(len(b)) for b in books)
    for radius, code, far in zip(radii, "ab", ("ra", "rb"), strict=True):
        for r in coded.groupBy(code).agg(F.max(far).alias("far")).collect():  # a number for each code
            radius[r[code]] = r["far"]
    group = F.struct(F.floor(F.col("a") / p.group_codes).cast("int").alias("ga"), F.floor(F.col("b") / p.group_codes).cast("int").alias("gb"))
    # At most (most_codes / group_codes)^2 rows, whatever the table's size.
    parts = coded.withColumn("group", group).groupBy("group").agg(F.ceil(F.count("*") / p.part_rows).cast("int").alias("parts"))
    dealt = coded.withColumn("group", group).join(F.broadcast(parts), "group").select(*ship, "a", "b", F.col("group.ga").alias("ga"), F.col("group.gb").alias("gb"), "parts", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"))
    return Index(Codes(d, books, radii, most**2 * max(d, 1) < 1 << 53), dealt), sample


def code_bounds(anchors: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and code of a half, what a row of the code scores at most in that half (with room for rounding)."""
    cut, out = codes.dims // 2, []
    for half, centres, radius in zip((anchors[:, :cut], anchors[:, cut:]), codes.books, codes.radii, strict=True):
        norms = np.sqrt((half**2).sum(axis=1))
        reach = norms[:, None] * (radius + np.sqrt((centres**2).sum(axis=1)))[None, :]
        out.append(half @ centres.T + norms[:, None] * radius[None, :] + 1e-9 * reach + 1e-6)
    return out[0], out[1]


class Best:
    """The best rows found so far for one window: scores from low to high, and only those from a floor on."""

    __slots__ = ("floor", "high", "k", "found", "same")

    def __init__(self, floor: int, high: int, k: int, same: bool):
        self.floor, self.high, self.k, self.same = floor, high, k, same
        self.found: list[tuple[int, int, int]] = []

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, alike: np.ndarray) -> None:
        """A row below the floor, or of the other kind, is not for this window."""
        here = np.flatnonzero((scores >= self.floor) & (scores <= self.high) & (alike == self.same))
        if len(here):
            self.found += zip(scores[here].tolist(), (-ids[here]).tolist(), rows[here].tolist(), strict=True)
            if len(self.found) >= self.k:
                self.found = heapq.nlargest(self.k, self.found)
                self.floor = max(self.floor, self.found[-1][0])


def visit(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """The multi-sequence: (bound, a, b) of all cells by falling u[a] + v[b], cells made as they are asked for."""
    order_u, order_v = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    heap = [(-(u[order_u[0]] + v[order_v[0]]), 0, 0)]
    seen = {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(order_u[i]), int(order_v[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(u) and y < len(v) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(u[order_u[x]] + v[order_v[y]]), x, y))


class Part:
    """A part of the index in a task: its rows by cell."""

    def __init__(self, batches: list[pa.RecordBatch], codes: Codes):
        t = pa.Table.from_batches(batches)
        take = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        self.codes_a, self.codes_b = (np.unique(take(c)) for c in "ab")
        cell = np.searchsorted(self.codes_a, take("a")) * len(self.codes_b) + np.searchsorted(self.codes_b, take("b"))
        order = np.argsort(cell, kind="stable")
        x = matrix(t["x"].combine_chunks(), codes.dims)[order]
        self.x = x.astype(np.float64) if codes.exact_float else x
        self.ids, self.labels, self.rows = (take(c)[order] for c in ("vec_id", "label", "row"))
        ends = np.cumsum(np.bincount(cell, minlength=len(self.codes_a) * len(self.codes_b)))
        self.cells = [slice(int(s), int(e)) for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def search(self, x: np.ndarray, u: np.ndarray, v: np.ndarray, row: int, label: int, windows: list[Best], batch: int = 256) -> None:
        """Fills the windows. Rows of several cells are scored at once; the bound that counts is that of the next cell."""
        waiting: list[slice] = []
        n = 0

        def score() -> None:
            at = np.concatenate([np.arange(s.start, s.stop) for s in waiting])
            scores = (self.x[at] @ x).astype(np.int64)
            other = self.rows[at] != row
            scores, ids, rows, alike = scores[other], self.ids[at][other], self.rows[at][other], (self.labels[at] == label)[other]
            for w in windows:
                w.take(scores, ids, rows, alike)

        for bound, a, b in visit(u[self.codes_a], v[self.codes_b]):
            if bound < min(w.floor for w in windows):
                break
            cell = self.cells[a * len(self.codes_b) + b]
            if cell.stop > cell.start:
                waiting.append(cell)
                n += cell.stop - cell.start
            if n >= batch:
                score()
                waiting, n = [], 0
        if waiting:
            score()


#: What travels: rows of the index (kind 0), then the anchors that ask (kind 1), with the windows they look for: floors and ends from above.
SHIP = "key long, kind int, row long, vec_id long, label long, x array<long>, a int, b int, floors array<long>, highs array<long>"


def _asks(codes: Codes, parts: dict[tuple[int, int], int], p: Mining, blocks: int, sample: pa.Table, positives: bool):
    """mapInArrow: anchors (row, vec_id, label, x[, highs]) -> SHIP: one for each part whose group's bound reaches the lowest floor."""
    groups = sorted(parts)
    ga, gb = (np.array([g[i] for g in groups], dtype=int) for i in (0, 1))
    rows, ids, labels = (sample[c].to_numpy() for c in ("row", "vec_id", "label"))
    held = matrix(sample["x"].combine_chunks(), codes.dims)
    held = held.astype(np.float64) if codes.exact_float else held
    starts = [np.arange(0, len(b), p.group_codes) for b in codes.books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                yield from asked(b.slice(start, 256))

    def asked(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(b.column("x"), codes.dims)
        bounds = [np.maximum.reduceat(c, s, axis=1) for c, s in zip(code_bounds(x.astype(np.float64), codes), starts, strict=True)]
        scores = (x.astype(held.dtype) @ held.T).astype(np.int64)
        own, label = b.column("row").to_numpy(), b.column("label").to_numpy()
        out: dict[str, list] = {"key": [], "at": [], "floors": [], "highs": []}
        for i in range(len(x)):
            other = rows != own[i]
            if positives:
                windows = [Best(LOW, HIGH, p.positives, True)]
            else:
                windows = [Best(-(-p.least_percent * int(h) // 100), h, p.negatives, False) for h in b.column("highs")[i].as_py()]
            for w in windows:
                w.take(scores[i][other], ids[other], rows[other], (labels == label[i])[other])
            floors, lowest = [w.floor for w in windows], min(w.floor for w in windows)
            for g in np.flatnonzero(bounds[0][i][ga] + bounds[1][i][gb] >= lowest):
                for part in range(parts[groups[g]]):
                    out["key"].append(part_key(int(ga[g]), int(gb[g]), part) * blocks + int(own[i] % blocks))
                    out["at"].append(i)
                    out["floors"].append(floors)
                    out["highs"].append([w.high for w in windows])
        at = pa.array(out["at"], type=pa.int64())
        none = pa.nulls(len(at), pa.int32())
        columns = [pa.array(out["key"], type=pa.int64()), pa.array([1] * len(at), type=pa.int32()), *[b.column(c).take(at) for c in ("row", "vec_id", "label", "x")], none, none]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(out[c], type=pa.list_(pa.int64())) for c in ("floors", "highs")]], ["key", "kind", "row", "vec_id", "label", "x", "a", "b", "floors", "highs"])

    return run


def part_key(ga, gb, part):
    """One number; for columns as well."""
    return (ga * 4096 + gb) * (1 << 24) + part


def _search(codes: Codes, k: int, same: bool):
    """mapInArrow over SHIP sorted by (key, kind): (row, vec_id, label, x, window, score, found_id, found_row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, [], None
        for b in batches:
            keys = b.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if start == stop:
                    continue
                if keys[start] != key:
                    key, held, part = keys[start], [], None
                own = b.slice(start, stop - start)
                n = int((own.column("kind").to_numpy() == 0).sum())
                if n:
                    held.append(own.slice(0, n))
                if n < own.num_rows and held:  # a group that has anchors has rows, unless the block has none of it
                    part = part or Part(held, codes)
                    yield from answered(part, own.slice(n))

    def answered(part: Part, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(asks.column("x"), codes.dims)
        u, v = code_bounds(x.astype(np.float64), codes)
        x = x.astype(part.x.dtype)
        rows, labels = asks.column("row").to_numpy(), asks.column("label").to_numpy()
        floors, highs = asks.column("floors").to_pylist(), asks.column("highs").to_pylist()
        at, found = [], []
        for i in range(len(x)):
            windows = [Best(f, h, k, same) for f, h in zip(floors[i], highs[i], strict=True)]
            part.search(x[i], u[i], v[i], int(rows[i]), int(labels[i]), windows)
            for j, w in enumerate(windows):
                at += [i] * len(w.found)
                found += [(j, s, -d, r) for s, d, r in w.found]
        at = pa.array(at, type=pa.int64())
        new = [pa.array([f[c] for f in found], type=pa.int64()) for c in range(4)]
        yield pa.RecordBatch.from_arrays([asks.column("row").take(at), *new], ["row", "window", "score", "found_id", "found_row"])

    return run


def _searched(index: Index, anchors: DataFrame, sample: pa.Table, p: Mining, positives: bool) -> DataFrame:
    """(row, window, place, score, found_id): the best rows of each anchor's windows, place from 1."""
    spark = anchors.sparkSession
    groups = index.rows.groupBy("ga", "gb").agg(F.max("parts").alias("parts")).collect()  # bounded by the codes
    parts = {(r["ga"], r["gb"]): r["parts"] for r in groups}
    blocks = max(1, -(-anchors.count() // p.block_anchors))
    none = F.lit(None).cast("array<long>")
    key: Column = part_key(F.col("ga").cast("long"), F.col("gb"), F.col("part")) * blocks
    dealt = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select((key + F.col("block")).alias("key"), F.lit(0).alias("kind"), "row", "vec_id", "label", "x", "a", "b", none.alias("floors"), none.alias("highs"))
    asks = anchors.mapInArrow(_asks(index.codes, parts, p, blocks, sample, positives), SHIP)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sum(parts.values()) * blocks, 4096))
    met = dealt.unionByName(asks).repartition(tasks, "key").sortWithinPartitions("key", "kind")
    best = p.positives if positives else p.negatives
    found = met.mapInArrow(_search(index.codes, best, positives), "row long, window long, score long, found_id long, found_row long")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best).select("row", "window", "place", "score", "found_id")


def mine(df: DataFrame, vector: str = "embedding", p: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index, sample = build(prepared(df, p, vector), p)
    anchors = index.rows.where(F.col("vec_id") % p.anchor_every == 0).select("row", "vec_id", "label", "x")
    positives = written(_searched(index, anchors, sample, p, True).select("row", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    # Below 0 a share of a score is above the score, so such positives have no negatives. By place, a window each.
    highs = positives.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("all"))
    asking = anchors.join(highs.select("row", F.transform("all", lambda s: s["positive_score"]).alias("highs")), "row")
    negatives = _searched(index, asking, sample, p, False).select("row", (F.col("window") + 1).alias("place"), F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        negatives.join(positives, ["row", "place"])
        .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
