"""Removal of repeated word sequences (substrings) by recompression.

A text's words become symbols that rounds make fewer: a round names runs of one symbol, then splits the symbols in two sides by a bit of
their names and names each pair of a left one and a right one. A name is a digest of what it stands for and of the round,
so it is the same for all texts of the corpus without an exchange, and equal sequences get equal symbols in their interior: what a symbol at
the edge becomes may depend on what stands beyond. Spark's shuffles find which names the corpus shares.

1. High levels: symbols of at least a window's words, at every few rounds up to the whole text. Where the same symbol (its name, its words'
   own digest and length) also occurs earlier, all its words are repeated; long repeats, copies above all, take a row per symbol.
2. Every window that isn't inside such a span has one key: the first symbol of its interior at the highest level that still has an interior.
   The interior (what no context can change) is worked out from the window alone, so equal windows have equal keys, runs
   included. Names that only one place of the corpus has can't be repeated: their windows go no further.
3. Windows under shared names are verified: a window is repeated where the digest of its words (96 bits) also occurs earlier.

Keys that a sample shows in many documents are known as shared without a shuffle, and windows under them are compared in salted
parts first, so a passage of a third of all documents is no hot task. The tables of spans and keys are deleted once they are used.

Defined results: null, empty and short texts have no windows and keep all words; documents come in the order of doc_id, null first, and those that repeat a
doc_id in the order of a digest of their texts; rows equal in both are one document and give equal rows each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_paths, new_path, table, written


@dataclass(frozen=True)
class Repeats:
    window: int = 20
    #: Rounds that windows' keys may come from.
    key_rounds: int = 9
    #: From this round on, and every so many, symbols are compared as whole spans.
    span_round: int = 14
    span_every: int = 4
    most_rounds: int = 80
    #: Key rows that are sampled for keys of many documents, and how many times one must be seen.
    sample: int = 200_000
    often: int = 20
    #: Keys of many documents that are broadcast.
    most_hot: int = 10_000
    #: Parts in which windows under such keys are compared first.
    salts: int = 64
    #: Characters of texts that a task works on at a time (a longer text alone), and bytes whose words' digests come from one running sum.
    slice_chars: int = 1_500_000
    chunk_bytes: int = 1_000_000


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], dtype=np.uint64)
#: An odd multiplier and its inverse among 64-bit numbers, for digests of spans.
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)


def _named(a: np.ndarray, b: np.ndarray, rank: int) -> np.ndarray:
    """A digest of (a, b, rank)."""
    x = a * _ODD[0] + (b ^ b >> np.uint64(31)) * _ODD[1] + np.array([rank * 2 + 1], dtype=np.uint64) * _ODD[2]
    x ^= x >> np.uint64(29)
    x *= _ODD[3]
    return x ^ x >> np.uint64(32)


@dataclass
class Symbols:
    """The texts' symbols at a level, one text after another."""

    names: np.ndarray
    #: Number of each symbol's first word.
    start: np.ndarray
    #: Whether it begins a text.
    first: np.ndarray

    def runs(self, rank: int) -> tuple[Symbols, np.ndarray]:
        """(with maximal runs named by symbol and length, each symbol's run)."""
        head = np.ones(len(self.names), dtype=bool)
        head[1:] = (self.names[1:] != self.names[:-1]) | self.first[1:]
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(head)))
        names = self.names[at]
        long = length > 1
        names[long] = _named(names[long], length[long].astype(np.uint64), 2 * rank)
        return Symbols(names, self.start[at], self.first[at]), np.cumsum(head, dtype=np.int32) - 1

    def pairs(self, rank: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
        """(with pairs of a left and a right symbol named, which symbols are left ones, each symbol's place among the new ones)."""
        left = (self.names * (_ODD[0] + np.array([2 * rank * 0x61C88647], dtype=np.uint64)) >> np.uint64(63)) == 0
        second = np.zeros(len(left), dtype=bool)
        second[1:] = left[:-1] & ~left[1:] & ~self.first[1:]
        at = np.flatnonzero(~second)
        names = self.names[at]
        joined = np.append(second, False)[at + 1]
        names[joined] = _named(names[joined], self.names[at[joined] + 1], 2 * rank + 1)
        return Symbols(names, self.start[at], self.first[at]), left, np.cumsum(~second, dtype=np.int32) - 1


def _powers(of: int, n: int) -> np.ndarray:
    """1, of, of^2 ... among 64-bit numbers."""
    out = np.full(n, of, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


#: White space between words, and for either digest a random number for each byte.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(12).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_digests(data: np.ndarray, offsets: np.ndarray, chunk_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(two digests of each word of 64 bits, each text's number of words); data: the texts' bytes, one after another.

    A digest is the sum of the bytes' numbers times powers of _BASE, from a running sum; chunks end at white space.
    """
    space = _SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin, end = ~space, ~space
    begin[1:] &= space[:-1] | edge[1:n]
    end[:-1] &= space[1:] | edge[1:n]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    digests = np.empty((2, len(start)), dtype=np.uint64)
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(stop, start[low] + chunk_bytes)))
        a, b = start[low], stop[high - 1]
        up, back = _powers(_BASE, b - a), _powers(_BACK, b - a)
        first, last = start[low:high] - a, stop[low:high] - a
        for side in range(2):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[side][data[a:b]] * up)])
            digests[side, low:high] = _named((sums[last] - sums[first]) * back[first], (last - first).astype(np.uint64), side)
        low = high
    return digests, np.diff(np.searchsorted(start, offsets))


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Texts:
    """Some texts' words (as digests), one after another, and their first round's symbols."""

    def __init__(self, column: pa.Array, p: Repeats):
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.digests, self.lengths = word_digests(data, offsets - offsets[0], p.chunk_bytes)
        self.begin = np.cumsum(self.lengths) - self.lengths
        first = np.zeros(self.digests.shape[1], dtype=bool)
        first[self.begin[self.lengths > 0]] = True
        self.text = np.repeat(np.arange(len(column)), self.lengths)
        self.words = Symbols(self.digests[0].copy(), np.arange(len(first)), first)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows."""
        end = (self.begin + self.lengths)[self.text]
        return np.flatnonzero(np.arange(len(end)) + size <= end)

    def keys(self, windows: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, Symbols]:
        """(each window's key, the key's first word, the symbols after the last of key_rounds)."""
        keys, begin = np.zeros(len(windows), dtype=np.uint64), np.zeros(len(windows), dtype=np.int64)
        who, level = np.arange(len(windows), dtype=np.int32), self.words
        low, high = windows.astype(np.int32), (windows + p.window - 1).astype(np.int32)

        def chosen(of: np.ndarray, at: np.ndarray) -> None:
            keys[of], begin[of] = level.names[at], level.start[at]

        def narrowed(up: np.ndarray, down: np.ndarray) -> None:
            """Interiors become [up[low], down[high]]; windows whose interior that ends take their key from the level before."""
            nonlocal who, low, high
            new_low, new_high = up[low], down[high]
            going = new_low <= new_high
            if not going.all():
                chosen(who[~going], low[~going])
                who, new_low, new_high = who[going], new_low[going], new_high[going]
            low, high = new_low, new_high

        for r in range(p.key_rounds):
            if r == 0:
                new, run = level.runs(r)  # a run at the edge may go on beyond
                narrowed(run + 1, run - 1)
                level = new
            new, left, place = level.pairs(r)  # a right symbol at the left edge may have a partner beyond, and the other way round
            beyond = np.append(place, place[-1] + 1)
            narrowed(np.where(left, place, beyond[1:]), np.where(left, np.append(np.int32(-1), place[:-1]), place))
            level = new
        chosen(who, low)
        return keys, begin, level

    def spans(self, level: Symbols, p: Repeats) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(name, first word, length): symbols of at least a window's words, at rising levels up to whole texts."""
        last, n = None, len(self.text)
        for r in range(p.key_rounds, p.most_rounds):
            level = level.runs(r)[0].pairs(r)[0]
            done = len(level.names) == np.count_nonzero(level.first) or r == p.most_rounds - 1
            if done or r >= p.span_round and (r - p.span_round) % p.span_every == 0:
                length = np.diff(np.append(level.start, n))
                whole = length >= p.window
                fresh = whole if last is None else whole & ~np.isin(level.names, last)
                yield level.names[fresh], level.start[fresh], length[fresh]
                last = level.names
            if done:
                return

    def contents(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A digest of each span's words that doesn't depend on how they were paired."""
        n = len(self.text)
        up, back = _powers(_BASE, n), _powers(_BACK, n)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.digests[1] * up)])
        return (sums[start + length] - sums[start]) * back[start]

    def verified(self, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of a digest of each window's words."""
        sums = [np.zeros(len(windows), dtype=np.uint64) for _ in range(2)]
        for i in range(size):
            for s, h in zip(sums, self.digests, strict=True):
                s *= np.uint64(_BASE)
                s += h[windows + i]
        return sums[0], (sums[1] >> np.uint64(32)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[pa.RecordBatch]:
    for b in batches:
        start, chars = 0, 0
        for i, n in enumerate(b.column("text").to_pandas().str.len().fillna(0)):
            if chars and chars + n > p.slice_chars:
                yield b.slice(start, i - start)
                start, chars = i, 0
            chars += n
        if start < b.num_rows:
            yield b.slice(start)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


MADE = "kind int, doc_id long, digest long, name long, content long, start long, length long, sha string"


def _made(p: Repeats):
    """mapInArrow: (doc_id, digest, text) -> MADE: a row per text (kind 0: length its words), span (1) and distinct key of a text (2: start 1 if it has it at several places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, p):
            t = Texts(b.column("text"), p)

            def rows(kind: int, text: np.ndarray, name, content, start, length, sha=None, b=b) -> pa.RecordBatch:
                at, n = pa.array(text), len(text)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, kind, dtype=np.int32)), b.column("doc_id").take(at), b.column("digest").take(at), *[pa.nulls(n, pa.int64()) if c is None else _signed(np.ascontiguousarray(c)) for c in (name, content, start, length)], pa.nulls(n, pa.string()) if sha is None else pa.array(sha, type=pa.string())],
                    ["kind", "doc_id", "digest", "name", "content", "start", "length", "sha"],
                )

            yield rows(0, np.arange(b.num_rows), None, None, None, t.lengths, [hashlib.sha256(b" ".join(split(x))).hexdigest() for x in b.column("text").to_pylist()])
            windows = t.windows(p.window)
            if not len(windows):
                continue
            keys, begin, level = t.keys(windows, p)
            name, start, length = map(np.concatenate, zip(*t.spans(level, p), strict=True))
            text = t.text[start]
            yield rows(1, text, name, t.contents(start, length), start - t.begin[text], length)
            # Distinct keys of each text, and whether a key is at several places.
            order = np.lexsort((begin, keys, t.text[windows]))
            text, key, at = t.text[windows][order], keys[order], begin[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            moved = np.zeros(len(key), dtype=np.int64)
            moved[1:] = ~new[1:] & (at[1:] != at[:-1])
            group = np.flatnonzero(new)
            several = np.add.reduceat(moved, group) > 0
            yield rows(2, text[group], key[group], None, several.astype(np.int64), None)

    return run


def place(start: Column) -> Column:
    """Orders places of the corpus: (doc_id, 32 bits of the text's digest and the word's number)."""
    return F.struct("doc_id", (F.shiftleft(F.col("digest").bitwiseAND(F.lit(0xFFFFFFFF)), 31) + start).alias("mark"))


#: mapInArrow: candidates for verification.
CANDIDATES = "salt int, d1 long, d2 long, doc_id long, digest long, start long"


def _candidates(p: Repeats):
    """(doc_id, digest, text, spans, names, hot_names) -> CANDIDATES: windows under the names, but those within the spans. salt: 0, or the text's part for frequent names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, p):
            t = Texts(b.column("text"), p)
            windows = t.windows(p.window)
            if not len(windows):
                continue
            keys = t.keys(windows, p)[0]
            text, start = t.text[windows], windows - t.begin[t.text[windows]]
            ends = np.append(np.searchsorted(text, np.arange(b.num_rows)), len(text))
            salts = 1 + np.array([zlib.crc32(str(d).encode()) % p.salts for d in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), strict=True)])
            wanted, hot = np.zeros(len(windows), dtype=bool), np.zeros(len(windows), dtype=bool)
            for i in range(b.num_rows):
                own = slice(ends[i], ends[i + 1])
                shared, often = ((x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, dtype=np.int64)) for x in (b.column("names")[i], b.column("hot_names")[i]))
                signed = keys[own].view(np.int64)
                hot[own] = np.isin(signed, often)
                wanted[own] = hot[own] | np.isin(signed, shared)
                for s in b.column("spans")[i].as_py() or ():
                    wanted[own] &= ~((start[own] >= s["start"]) & (start[own] + p.window <= s["start"] + s["length"]))
            at = np.flatnonzero(wanted)
            for k in range(0, len(at), 100_000):
                some = at[k : k + 100_000]
                d1, d2 = t.verified(windows[some], p.window)
                of = pa.array(text[some])
                salt = np.where(hot[some], salts[text[some]], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(salt), _signed(d1), pa.array(d2), b.column("doc_id").take(of), b.column("digest").take(of), pa.array(start[some])], ["salt", "d1", "d2", "doc_id", "digest", "start"])

    return run


def _kept(p: Repeats):
    """mapInArrow: (doc_id, text, spans, starts) -> (doc_id, n_words, n_removed, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, starts in zip(b.column("text"), b.column("spans"), b.column("starts"), strict=True):
                words = split(text.as_py())
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                if starts.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + p.window, -1)
                for s in spans.as_py() or ():
                    edge[s["start"]] += 1
                    edge[s["start"] + s["length"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest()))
            n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(sha, type=pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _earlier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (with doc_id, digest, start) whose keys also occur at an earlier place. They are dealt first, so that places aren't shuffled too."""
    here = place(F.col("start"))
    return rows.repartition(*keys).withColumn("first", F.min(here).over(Window.partitionBy(*keys))).where(~here.eqNullSafe(F.col("first"))).drop("first")


def _by_text(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """(doc_id, digest, values of each text)."""
    return rows.groupBy("doc_id", "digest").agg(F.collect_list(value).alias(name))


def _met(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """a joined to b by text."""
    b = b.withColumnsRenamed({"doc_id": "__doc", "digest": "__digest"})
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("digest") == F.col("__digest")), how).drop("__doc", "__digest")


def _spans(made: DataFrame) -> DataFrame:
    """(doc_id, digest, spans): the spans of each text whose symbol occurs earlier."""
    rows = made.where("kind = 1").select("name", "content", "length", "doc_id", "digest", "start")
    return written(_by_text(_earlier(rows, ["name", "content", "length"]), "spans", F.struct("start", "length")), "spans")


def _shared(made: DataFrame, texts: DataFrame, spans: DataFrame, p: Repeats) -> DataFrame:
    """(doc_id, digest, names, hot_names, spans): the keys of each text that the corpus has at several places; not of texts that a span covers as a whole."""
    keys = made.where("kind = 2").select("doc_id", "digest", "name", (F.col("start") == 1).alias("several"))
    sampled = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(max(1, keys.count() // p.sample))) == 0
    often = keys.where(sampled).groupBy("name").count().where(F.col("count") >= p.often)
    hot = F.broadcast(often.orderBy(F.desc("count"), "name").limit(p.most_hot).select(F.col("name").alias("hot_name")))  # others go the ordinary way
    marked = keys.join(hot, F.col("name") == F.col("hot_name"), "left")
    cold = marked.where("hot_name is null").withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n > 1 or several")
    shared = cold.select("doc_id", "digest", "name", F.lit(False).alias("hot")).unionByName(marked.where("hot_name is not null").select("doc_id", "digest", "name", F.lit(True).alias("hot")))
    shared = shared.groupBy("doc_id", "digest").agg(F.collect_list(F.when(~F.col("hot"), F.col("name"))).alias("names"), F.collect_list(F.when(F.col("hot"), F.col("name"))).alias("hot_names"))
    begins = spans.select("doc_id", "digest", F.array_max(F.transform("spans", lambda s: F.when(s["start"] == 0, s["length"]))).alias("reach")).where("reach is not null")
    whole = _met(begins, texts.select("doc_id", "digest", "n_words").distinct(), "inner").where("reach >= n_words")
    return written(_met(_met(shared, whole, "left_anti"), spans, "left"), "shared-keys")


def _starts(candidates: DataFrame, p: Repeats) -> DataFrame:
    """(doc_id, digest, start) of the windows that occur earlier. Windows under frequent keys are salted by their text: the first ones of all salts are compared once more."""
    here = place(F.col("start"))
    first = candidates.repartition("d1", "d2", "salt").withColumn("first", F.min(here).over(Window.partitionBy("d1", "d2", "salt")))
    later = first.select("salt", (~here.eqNullSafe(F.col("first"))).alias("later"), "d1", "d2", "doc_id", "digest", "start").where("later or salt > 0")
    some = written(later.select("later", *[F.when(~F.col("later"), F.col(c)).alias(c) for c in ("d1", "d2")], "doc_id", "digest", "start"), "repeated-windows")
    text = ["doc_id", "digest", "start"]
    return some.where("later").select(text).unionByName(_earlier(some.where("not later"), ["d1", "d2"]).select(text))


def repeats(docs: DataFrame, p: Repeats = Repeats()) -> tuple[DataFrame, DataFrame]:
    """((doc_id, digest, n_words, sha) of each row, (doc_id, digest, spans, starts): what goes of each text that loses words)."""
    spark = docs.sparkSession
    keyed, repeated = _keyed(docs)
    path = new_path(spark, "symbols")
    keyed.mapInArrow(_made(p), MADE).write.partitionBy("kind").parquet(path)
    made = spark.read.schema(MADE).parquet(path)
    texts = made.where("kind = 0").select("doc_id", "digest", F.col("length").alias("n_words"), "sha")
    spans = _spans(made)
    shared = _shared(made, texts, spans, p)
    drop_paths(spark, f"{path}/kind=1", f"{path}/kind=2")
    asked = _met(keyed.where("text is not null").dropDuplicates(["doc_id", "digest"]) if repeated else keyed, shared, "inner")
    starts = _by_text(_starts(asked.select("doc_id", "digest", "text", "spans", "names", "hot_names").mapInArrow(_candidates(p), CANDIDATES), p), "starts", F.col("start"))
    both = spans.select("doc_id", "digest", "spans", F.lit(None).cast("array<bigint>").alias("starts")).unionByName(starts.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    lost = both.groupBy("doc_id", "digest").agg(F.first("spans", ignorenulls=True).alias("spans"), F.first("starts", ignorenulls=True).alias("starts"))
    return texts, written(lost, "lost-words")


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """((doc_id, digest, text), whether rows repeat a doc_id). Where none does, no digest is needed, and it is 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())
    return docs.select("doc_id", (F.coalesce(F.xxhash64("text"), F.lit(0)) if repeated else F.lit(0).cast("long")).alias("digest"), "text"), repeated


def deduplicated(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    texts, lost = repeats(docs, p)
    whole = _met(texts, lost, "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    cut = _met(_keyed(docs)[0], lost, "inner").select("doc_id", "text", "spans", "starts").mapInArrow(_kept(p), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return whole.unionByName(cut)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
