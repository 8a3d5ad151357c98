"""LM scoring by cross-entropy difference: matched target and background n-gram models over one vocabulary.

Both models are interpolated bigram models with the same vocabulary (every word of the corpus) and the same smoothing;
they differ only in the texts they count. Counts of words and pairs cover every document, are exact, grow with the corpus
and stay on the executors. A document's score is the mean over its tokens of the target loss minus the background loss; the
lower, the more it resembles the target.

1. Words are counted by tasks and summed by Spark. The most frequent ones (2^18 by default) get numbers, and their counts
   (24 bytes a word) are broadcast; any other word is known by its digest. How many have numbers changes no result.
2. Pairs of very frequent words are counted in a dense table of bounded size, which is broadcast with its losses. What is
   left has a word that is not very frequent in each pair.
3. Every document's other distinct pairs are dealt once: by pair where both words have numbers, else by the word without
   one. A task takes the pairs of some documents at a time, deals them to parts by a hash, and lists each pair once with the
   documents that hold it. All that concerns a pair, and all of a word without a number, meets in one part, which sums it
   and hands each document's losses back to where the documents that were dealt together meet again. A pair of two words without
   numbers is dealt to both, and its two halves meet there.

Words travel as 63-bit digests; that no two words of the corpus share one is checked, and another seed is taken
otherwise. Losses are summed in units of 2^-32, so that sums don't depend on their order.

Defined results: null and wordless texts have no tokens and null losses and score; an empty target scores with its
smoothing alone; rows that repeat a doc_id are scored each; a document counts for the target if its
doc_id is in it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_paths, new_path, sized_broadcast, table
from .tokens import split_words, text_slices

_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Numbers of the boundary before a text and of the most frequent word; the others follow by falling frequency.
BOUNDARY, FIRST = 0, 1
UNIT = float(1 << 32)
#: A pair of numbered words is first << SHIFT | second; that << DOCS | document's place holds both.
SHIFT, DOCS = 24, 15


@dataclass(frozen=True)
class LmParams:
    #: The most frequent words, whose counts are broadcast (24 bytes each). Results don't depend on it.
    numbered: int = 1 << 18
    #: Weight of the bigram estimate.
    mix: float = 0.6
    #: Added to each word's count in both models.
    add: float = 0.1
    #: Target documents whose ids (about 30 bytes each) are broadcast; a shuffled join beyond.
    broadcast_ids: int = 500_000
    #: Distinct words that a task holds at once, at most about: it takes texts of 64 bytes for each (12, where it deals pairs).
    most_words: int = 500_000
    #: Cells of the dense table, whose losses (16 bytes each) are broadcast.
    hot_pairs: int = 1 << 18
    #: Words of the corpus for each part that pairs are dealt to; bounds a task's memory.
    part_words: int = 2_000_000

    def __post_init__(self) -> None:
        if self.numbered >= (1 << SHIFT) - FIRST:
            raise ValueError(f"numbered must be below {(1 << SHIFT) - FIRST}")

    @property
    def dense(self) -> int:
        """Words on either side of the dense table."""
        return int(self.hot_pairs**0.5)


def tokens(text: str | None) -> list[bytes]:
    """White-space separated words, A-Z lower-cased."""
    return (text or "").encode().translate(_LOW).split()


def word_digests(words: pa.Array, seed: int) -> np.ndarray:
    """63 bits each, as negative numbers."""
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist(), repeat(seed)), dtype=np.uint64, count=len(words))
    return -1 - (found >> np.uint64(1)).astype(np.int64)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, as tokens() has them; how many each text has)."""
    return split_words(pc.ascii_lower(texts))


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _count_words(p: LmParams, seed: int):
    """(text, target) -> (word, digest, n, n_target); the empty word counts the texts that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 64 * p.most_words, 1 << DOCS):
            words, lengths = _split(b.column("text"))
            coded, target = words.dictionary_encode(), _flags(b.column("target"))
            known, at = pa.concat_arrays([coded.dictionary, pa.array([""], coded.dictionary.type)]), coded.indices.to_numpy()
            n, inside = (np.bincount(x, minlength=len(known)) for x in (at, at[np.repeat(target, lengths)]))
            n[-1], inside[-1] = np.count_nonzero(lengths), np.count_nonzero(lengths[target])
            if n[-1]:
                yield from pa.table({"word": known, "digest": word_digests(known, seed), "n": n, "n_target": inside}).to_batches(max_chunksize=100_000)

    return run


class Numbers:
    """Words to their numbers, or to their digests where they have none. Numbered words are given by their digests in order."""

    def __init__(self, digests: np.ndarray, seed: int):
        self.order = np.argsort(digests, kind="stable")
        self.sorted, self.seed = digests[self.order], seed

    def of(self, words: pa.Array) -> np.ndarray:
        digests = word_digests(words, self.seed)
        at = np.searchsorted(self.sorted, digests)
        found = np.append(self.sorted, 0)[at] == digests
        return np.where(found, np.append(self.order, 0)[at] + FIRST, digests)

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, second words of the texts' pairs, one text after another; how many each text has)."""
        words, lengths = _split(texts)
        coded = words.dictionary_encode()
        second = self.of(coded.dictionary)[coded.indices.to_numpy()]
        return _before(second, lengths), second, lengths


def _before(second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each word, or the boundary."""
    first = np.concatenate([[BOUNDARY], second[:-1]])[: len(second)]
    starts = np.cumsum(lengths) - lengths
    first[starts[lengths > 0]] = BOUNDARY
    return first


def _dense_cells(first: np.ndarray, second: np.ndarray, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs are of two very frequent words, their cells)."""
    there = (first >= 0) & (first < dense) & (second >= 0) & (second < dense)
    return there, first[there] * dense + second[there]


def _count_dense(p: LmParams, frequent: list[str]):
    """mapInArrow: (text, target) -> (cell, n, n_target): a task's own sums. frequent: the words of the dense table in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(frequent, pa.string()), p.dense**2
        sums = np.zeros((2, size), dtype=np.int64)
        for b in text_slices(batches, 12 * p.most_words, 1 << DOCS):
            words, lengths = _split(b.column("text"))
            second = pc.fill_null(pc.index_in(words, value_set=known), -1 - FIRST).to_numpy().astype(np.int64) + FIRST
            there, cells = _dense_cells(_before(second, lengths), second, p.dense)
            inside = np.repeat(_flags(b.column("target")), lengths)[there]
            for side, own in enumerate((cells, cells[inside])):
                sums[side] += np.bincount(own, minlength=size)
        there = np.flatnonzero(sums[0])
        yield from pa.table({"cell": there, "n": sums[0][there], "n_target": sums[1][there]}).to_batches(max_chunksize=100_000)

    return run


DEALT = (
    "part int, start long, size int, inside int, keys array<long>, held array<int>, docs array<short>, times array<int>, "
    "words array<long>, others array<long>, seconds array<boolean>, rare_docs array<short>, rare_times array<int>, slots array<int>, "
    "doc_ids array<long>, n_tokens array<long>, target_sums array<long>, background_sums array<long>"
)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where the tuples of sorted columns change."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(the distinct tuples in order, how often each occurs)."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    starts = _heads(*columns)
    return [c[starts] for c in columns], np.diff(np.append(starts, len(order)))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """By a hash of the key."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)


def _lists(part: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """A list for each part, and an empty one at the end, of each column."""
    order = np.argsort(part, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts + 1))]).astype(np.int32)
    return {name: pa.ListArray.from_arrays(pa.array(ends), pa.array(c[order])) for name, c in columns.items()}


def _deal(p: LmParams, vocabulary, seed: int, losses, parts: int):
    """mapInArrow: (doc_id, text, target) -> DEALT. From some documents at a time, those of the target first, a row for each part:
    keys, the pairs of numbered words outside the dense table, with the number of documents that each is held in, those
    documents' places and how often it occurs in them; and for each word without a number in any other distinct pair of a
    document, that word, the other one, whether the word is the second one, the place, how often, and a slot for pairs of two such words
    (else -1). One more row has the documents' ids and the sums over their dense pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tables = Numbers(vocabulary.value, seed), losses.value
        number = TaskContext.get().partitionId() << 40
        for b in text_slices(batches, 12 * p.most_words, 1 << DOCS):
            b = b.take(pa.array(np.argsort(~_flags(b.column("target")), kind="stable")))
            n = b.num_rows
            first, second, lengths = numbers.pairs(b.column("text"))
            there, cells = _dense_cells(first, second, p.dense)
            text = np.repeat(np.arange(n), lengths)
            sums = np.zeros((2, n), dtype=np.int64)
            for own, t in zip(sums, tables, strict=True):
                np.add.at(own, text[there], t[cells])
            rare = (first < 0) | (second < 0)
            usual = ~there & ~rare
            found = np.sort((first[usual] << SHIFT | second[usual]) << DOCS | text[usual])
            starts = _heads(found)
            times, found = np.diff(np.append(starts, len(found))), found[starts]
            keys, docs = found >> DOCS, found & ((1 << DOCS) - 1)
            starts = _heads(keys)
            held, keys = np.diff(np.append(starts, len(keys))), keys[starts]
            part = _part(keys, parts)
            lists = _lists(part, parts, {"keys": keys, "held": held.astype(np.int32)}) | _lists(np.repeat(part, held), parts, {"docs": docs.astype(np.int16), "times": times.astype(np.int32)})

            (text, first, second), times = _distinct(text[rare], first[rare], second[rare])
            slots = np.where((first < 0) & (second < 0), np.arange(len(first)), -1)
            ends, begins = np.flatnonzero(second < 0), np.flatnonzero(first < 0)
            at = np.concatenate([ends, begins])
            words, others, seconds = np.concatenate([second[ends], first[begins]]), np.concatenate([first[ends], second[begins]]), np.repeat([True, False], [len(ends), len(begins)])
            lists |= _lists(_part(words, parts), parts, {"words": words, "others": others, "seconds": seconds, "rare_docs": text[at].astype(np.int16), "rare_times": times[at].astype(np.int32), "slots": slots[at].astype(np.int32)})

            last = pa.array(np.append(np.zeros(parts + 1, dtype=np.int32), np.int32(n)))
            own = {"doc_ids": b.column("doc_id"), "n_tokens": pa.array(lengths), "target_sums": pa.array(sums[0]), "background_sums": pa.array(sums[1])}
            lists |= {name: pa.ListArray.from_arrays(last, c) for name, c in own.items()}
            lists["part"] = pa.array([*range(parts), int(_part(np.array([number]), parts)[0])], pa.int32())
            for name, kind, value in (("start", np.int64, number), ("size", np.int32, n), ("inside", np.int32, _flags(b.column("target")).sum())):
                lists[name] = pa.array(np.full(parts + 1, value, dtype=kind))
            number += n
            filled = np.diff(lists["keys"].offsets.to_numpy()) + np.diff(lists["words"].offsets.to_numpy()) > 0
            filled[-1] = True
            yield pa.RecordBatch.from_pydict({c: lists[c] for c in _names(DEALT)}).filter(pa.array(filled))

    return run


#: What the two halves of a pair know of it; the counts of the other half's word are 0.
HALF = ["times", *[f"{side}{c}" for side in ("", "first_", "second_") for c in ("n_target", "n")]]
OWN = ["doc_ids", "n_tokens", "target_sums", "background_sums"]
RETURNED = ", ".join(["start long, docs array<short>, target array<long>, background array<long>, half_docs array<short>, slots array<int>", *[f"{c} array<long>" for c in (*HALF, *OWN)]])


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    """The lists of a column, one after another."""
    return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sum_part(p: LmParams, single, totals: dict, n_words: int):
    """applyInArrow: a part's rows of DEALT -> RETURNED, for each of them: the documents' losses over this part's pairs, what is
    known here of pairs of two words without numbers, and the documents' own columns as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        size, inside = (rows[c].to_numpy().astype(np.int64) for c in ("size", "inside"))
        entries: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []  # rows of the part in order, documents, losses
        halves = {"half_docs": np.zeros(0, np.int16), "slots": np.zeros(0, np.int32), **{c: np.zeros(0, np.int64) for c in HALF}}
        halves_at = np.zeros(0, dtype=np.int64)

        def flat(name: str) -> np.ndarray:
            return _flat(rows, name)

        def lengths(name: str) -> np.ndarray:
            return pc.list_value_length(rows[name]).to_numpy()

        def losses(pair: list, context: list, one: list) -> list[np.ndarray]:
            return [_losses(p, *x, totals[c], n_words) for *x, c in zip(pair, context, one, ("n_target", "n"), strict=True)]

        keys, held, docs, times = flat("keys"), flat("held"), flat("docs"), flat("times").astype(np.int64)
        if len(keys):
            at = np.repeat(np.arange(len(size)), lengths("docs"))
            begins = np.cumsum(held, dtype=np.int64) - held
            counts = [np.add.reduceat(np.where(docs < inside[at], times, 0), begins), np.add.reduceat(times, begins)]
            order = np.argsort(keys)
            heads = _heads(keys[order])
            pair, of = keys[order][heads], np.empty(len(keys), dtype=np.int64)
            of[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
            first, second = pair >> SHIFT, pair & ((1 << SHIFT) - 1)
            known = single.value
            loss = losses([np.add.reduceat(c[order], heads) for c in counts], [c[first] for c in known], [c[second] for c in known])
            of = np.repeat(of, held)
            entries.append((at, docs, [x[of] * times for x in loss]))

        words, others, seconds, docs, times, slots = flat("words"), flat("others"), flat("seconds").astype(bool), flat("rare_docs"), flat("rare_times").astype(np.int64), flat("slots")
        if len(words):
            at = np.repeat(np.arange(len(size)), lengths("words"))
            counts = [np.where(docs < inside[at], times, 0), times]
            order = np.lexsort((seconds, others, words))
            # A word is the second one of a pair wherever it occurs.
            ways = ((_heads(words[order], others[order], seconds[order]), True), (_heads(words[order]), seconds))
            pair, own = ([np.add.reduceat(np.where(which, c, 0)[order], heads) for c in counts] for heads, which in ways)
            spread = [np.empty(len(words), dtype=np.int64) for _ in range(4)]
            for x, (heads, c) in zip(spread, [(ways[0][0], pair[0]), (ways[0][0], pair[1]), (ways[1][0], own[0]), (ways[1][0], own[1])], strict=True):
                x[order] = np.repeat(c, np.diff(np.append(heads, len(words))))
            pair, own = spread[:2], spread[2:]
            half = slots >= 0
            other = [c[np.where(half, 0, others)] for c in single.value]
            first, second = ([np.where(seconds == is_own, o, x) for o, x in zip(own, other, strict=True)] for is_own in (False, True))
            loss = losses(pair, first, second)
            entries.append((at[~half], docs[~half], [(x * times)[~half] for x in loss]))
            known = (times, *pair, *[np.where(seconds, 0, x) for x in first], *[np.where(seconds, x, 0) for x in second])
            halves_at = at[half]
            halves = {"half_docs": docs[half], "slots": slots[half], **{c: x[half] for c, x in zip(HALF, known, strict=True)}}

        base = np.cumsum(size) - size
        some = base >> 20  # documents at a time
        for k in np.unique(some):
            lo, hi = np.searchsorted(some, [k, k + 1])
            sums, seen = np.zeros((2, size[lo:hi].sum()), dtype=np.int64), np.zeros(size[lo:hi].sum(), dtype=bool)
            for at, docs, loss in entries:
                cut = slice(*np.searchsorted(at, [lo, hi]))
                places = base[at[cut]] - base[lo] + docs[cut]
                seen[places] = True
                for own, x in zip(sums, loss, strict=True):
                    np.add.at(own, places, x[cut])
            found = np.flatnonzero(seen)
            of = np.repeat(np.arange(hi - lo), size[lo:hi])[found]
            columns = {"start": rows["start"].slice(lo, hi - lo).combine_chunks()}
            columns |= _lists(of, hi - lo - 1, {"docs": (found - (base[lo:hi] - base[lo])[of]).astype(np.int16), "target": sums[0][found], "background": sums[1][found]})
            cut = slice(*np.searchsorted(halves_at, [lo, hi]))
            columns |= _lists(halves_at[cut] - lo, hi - lo - 1, {c: x[cut] for c, x in halves.items()})
            columns |= {c: rows[c].slice(lo, hi - lo).combine_chunks() for c in OWN}
            yield from pa.table({c: columns[c] for c in _names(RETURNED)}).to_batches()

    return run


SCORED = "doc_id long, n_tokens long, target long, background long"


def _sum_documents(p: LmParams, totals: dict, n_words: int):
    """applyInArrow: all rows of RETURNED of the documents dealt together -> SCORED, sums of losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        sums = {"target": _flat(rows, "target_sums").copy(), "background": _flat(rows, "background_sums").copy()}
        docs = _flat(rows, "docs")
        for c, own in sums.items():
            np.add.at(own, docs, _flat(rows, c))
        slots = _flat(rows, "slots")
        if len(slots):
            order = np.argsort(slots)  # each occurs twice
            docs = _flat(rows, "half_docs")[order[::2]]
            whole = {c: np.max(_flat(rows, c)[order].reshape(-1, 2), axis=1) for c in HALF}
            for m, c in (("target", "n_target"), ("background", "n")):
                np.add.at(sums[m], docs, whole["times"] * _losses(p, whole[c], whole[f"first_{c}"], whole[f"second_{c}"], totals[c], n_words))
        doc_ids = pa.concat_arrays([c.flatten() for c in rows["doc_ids"].chunks])
        yield from pa.table({"doc_id": doc_ids, "n_tokens": _flat(rows, "n_tokens"), **sums}).to_batches(max_chunksize=10_000)

    return run


def _losses(p: LmParams, pair: np.ndarray, context: np.ndarray, single: np.ndarray, total: int, words: int) -> np.ndarray:
    """In units, for the dense table."""
    one = (single + p.add) / (total + p.add * words)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(context > 0, p.mix * pair / np.maximum(context, 1) + (1 - p.mix) * one, one)
        return np.rint(-np.log(mean) * UNIT).astype(np.int64)


def score(docs: DataFrame, target_ids: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, target_loss, background_loss, score. target_ids: the doc_id of the target's documents."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    sums = [F.sum("n").alias("n"), F.sum("n_target").alias("n_target")]
    chosen = sized_broadcast(target_ids.select(F.col("doc_id").alias("chosen")).where("chosen is not null").distinct(), p.broadcast_ids)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("chosen"), "left").select("doc_id", "text", F.col("chosen").isNotNull().alias("target"))

    for seed in count():
        counted = marked.select("text", "target").mapInArrow(_count_words(p, seed), "word string, digest long, n long, n_target long").groupBy("word", "digest").agg(*sums)
        path = new_path(spark, "words")
        counted.write.parquet(path)
        counts = spark.read.schema(counted.schema).parquet(path)
        if not counts.groupBy("digest").count().where("count > 1").limit(1).count():
            break
        drop_paths(spark, path)
    words = counts.where("word != ''")
    n_docs = counts.where("word = ''").agg(*sums).first().asDict()
    totals = words.agg(*sums, F.count("*").alias("words")).first().asDict()
    order = (F.desc("n"), "begins", "digest")
    begun = words.withColumn("begins", F.substring("word", 1, 32))
    top = begun.select("n", "begins", "digest", "n_target").orderBy(*order).limit(p.numbered).drop("begins").toArrow()
    frequent = begun.select("n", "begins", "digest", "word").orderBy(*order).limit(max(0, min(p.numbered, p.dense - FIRST))).toArrow()["word"].to_pylist()
    vocabulary = sc.broadcast(top["digest"].to_numpy())
    single = {c: np.concatenate([[n_docs[c] or 0], top[c].to_numpy()]).astype(np.int64) for c in ("n_target", "n")}
    n_words, totals = max(1, totals["words"]), {c: totals[c] or 0 for c in single}
    drop_paths(spark, path)

    cells = marked.select("text", "target").mapInArrow(_count_dense(p, frequent), "cell long, n long, n_target long").groupBy("cell").agg(*sums).toArrow()
    dense, tables = p.dense, []
    for c in single:
        pair = np.zeros(dense * dense, dtype=np.int64)
        pair[cells["cell"].to_numpy()] = cells[c].to_numpy()
        own = np.zeros(dense, dtype=np.int64)
        own[: len(single[c])] = single[c][:dense]
        tables.append(_losses(p, pair, np.repeat(own, dense), np.tile(own, dense), totals[c], n_words))
    parts = max(sc.defaultParallelism, -(-totals["n"] // p.part_words))
    dealt = marked.mapInArrow(_deal(p, vocabulary, seed, sc.broadcast(tables), parts), DEALT)
    summed = dealt.groupBy("part").applyInArrow(_sum_part(p, sc.broadcast(list(single.values())), totals, n_words), RETURNED)
    done = summed.groupBy("start").applyInArrow(_sum_documents(p, totals, n_words), SCORED)
    mean = [F.when(F.col("n_tokens") > 0, F.col(m) / UNIT / F.col("n_tokens")).alias(f"{m}_loss") for m in ("target", "background")]
    return done.select("doc_id", "n_tokens", *mean).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of high quality. Background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good)
