"""Lexical retrieval packing: training sequences filled with documents that resemble each other.

Documents are tokenized once and dealt by content: ordered by their characteristic tokens (frequent in the document, and long in
coming in the tokenizer's merges, so rare), cut into ranges, and each range into shards of a bounded size. Each shard builds
a BM25 inverted index over its token ids, with document frequencies and mean length of the whole table; for a seed document the index returns
unused neighbours, best first, by all of the seed's terms, which greedily fill the seed's window. What fills the
window only in part is cut, and the rest opens the next window as its seed. The last, unfilled window of a shard is cut into
sequences whose lengths are powers of two, which need no padding.

Defined results: null and empty texts are one document token (the separator); rows that repeat a doc_id are packed
each; null doc_ids stay null; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, written
from .tokens import encoder, text_slices


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    window: int = 2048
    separator: int = 1
    #: Tokens of a shard, at most (but for a longer document); bounds a task's memory.
    shard_tokens: int = 1_200_000
    #: Shards in a range, on average.
    range_shards: int = 2
    k1: float = 1.2
    b: float = 0.75


class Bm25:
    """Inverted lists of one shard: term -> documents and their weights."""

    def __init__(self, ids: list[np.ndarray], p: Packing, idf: np.ndarray, mean_size: float):
        n = len(ids)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        key = np.repeat(np.arange(n, dtype=np.int64), sizes) << 32 | np.concatenate(ids).astype(np.int64)
        key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([heads, [len(key)]]))
        docs, terms = key[heads] >> 32, key[heads] & 0xFFFFFFFF
        _, term, seen = np.unique(terms, return_inverse=True, return_counts=True)
        weight = idf[terms] * counts * (p.k1 + 1) / (counts + p.k1 * (1 - p.b + p.b * sizes[docs] / mean_size))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = docs[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(seen)])
        self.by_doc = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])
        self.term_of = term
        self.n = self.unused = n

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents that share a term with the seed, best first; ties by their number."""
        left = self.n - int(used.sum())
        if left < self.unused // 2:  # used documents leave the lists
            kept = ~used[self.docs]
            self.starts = np.concatenate([[0], np.cumsum(kept)])[self.starts]
            self.docs, self.weights, self.unused = self.docs[kept], self.weights[kept], left
        own = self.term_of[self.by_doc[seed] : self.by_doc[seed + 1]]
        starts, lengths = self.starts[own], self.starts[own + 1] - self.starts[own]
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        scores = np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)
        scores[used] = 0
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")].tolist()


def fill_windows(ids: list[np.ndarray], p: Packing, idf: np.ndarray, mean_size: float) -> Iterator[list[tuple[int, int, int]]]:
    """The sequences of a shard, each a list of (document, start, length)."""
    if not ids:
        return
    sizes = [len(x) for x in ids]
    index = Bm25(ids, p, idf, mean_size)
    used = np.zeros(len(ids), dtype=bool)
    fresh = 0
    rest: tuple[int, int] | None = None  # a cut document and where it goes on
    while True:
        if rest is None:
            while fresh < len(ids) and used[fresh]:
                fresh += 1
            if fresh == len(ids):
                return
            rest, used[fresh] = (fresh, 0), True
        seed, start = rest
        take = min(p.window, sizes[seed] - start)
        pieces, room = [(seed, start, take)], p.window - take
        rest = (seed, start + take) if start + take < sizes[seed] else None
        while room:
            first_cut = -1
            for d in index.neighbours(seed, used):
                if sizes[d] <= room:
                    pieces.append((d, 0, sizes[d]))
                    used[d], room = True, room - sizes[d]
                    if not room:
                        break
                elif first_cut < 0:
                    first_cut = d
            if room and first_cut < 0:  # no neighbour is left: the next unused document follows
                while fresh < len(ids) and used[fresh]:
                    fresh += 1
                if fresh == len(ids):
                    break
                first_cut = fresh
            if room:
                used[first_cut] = True
                take = min(room, sizes[first_cut])
                pieces.append((first_cut, 0, take))
                room -= take
                if take < sizes[first_cut]:
                    rest = (first_cut, take)
                else:
                    seed = first_cut
        if room:
            yield from _powers(pieces)
            return
        yield pieces


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cuts the pieces into sequences whose lengths are powers of two, the longest first."""
    total = sum(x[2] for x in pieces)
    pieces = pieces[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            d, start, length = pieces.pop()
            take = min(size, length)
            out.append((d, start, take))
            size -= take
            if take < length:
                pieces.append((d, start + take, length - take))
        yield out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


TOKENISED = "doc_id long, text_digest long, key_1 int, key_2 int, key_3 int, ids binary, n_tokens long, terms array<int>, documents array<long>"


def _tokenised(p: Packing):
    """mapInArrow: (doc_id, text_digest, text) -> TOKENISED: a row per document, and one for each batch (ids null) with the terms of its documents and in how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(p.tokenizer).encode_all
        for b in batches:
            blobs, keys, tokens, terms = [], [], [], []
            for part in text_slices(iter([b]), 1 << 23, 10_000):
                ids, sizes = encode_all(part.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), p.separator)
                sizes = sizes + 1
                pair = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 32 | ids)
                heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                doc, own = pair[heads] >> 32, pair[heads] & 0xFFFFFFFF
                strength = np.sqrt(np.diff(np.append(heads, len(pair)))) * (1.0 + own)
                starts = np.searchsorted(doc, np.arange(len(sizes)))
                best = np.full((len(sizes), 3), -1, dtype=np.int32)
                for k in range(3):  # the strongest left, the first one of equals
                    most = np.maximum.reduceat(strength, starts)
                    at = np.flatnonzero((strength == most[doc]) & (strength > 0))
                    at = at[np.append(True, doc[at][1:] != doc[at][:-1])] if len(at) else at
                    best[doc[at], k], strength[at] = own[at], 0
                keys.append(best)
                terms.append(own)
                tokens.extend(sizes.tolist())
                short = np.maximum.reduceat(own, starts) < 1 << 16
                ends = np.cumsum(sizes).tolist()
                narrow = ids.astype("<u2")
                blobs.extend((narrow if s else ids)[end - n : end].tobytes() for end, n, s in zip(ends, sizes.tolist(), short.tolist(), strict=True))
            seen, documents = np.unique(np.concatenate(terms), return_counts=True) if terms else (np.zeros(0, int), np.zeros(0, int))
            n, key = len(blobs), np.concatenate([np.zeros((0, 3), dtype=np.int32), *keys])
            none = lambda kind: pa.nulls(1, kind)
            columns = [
                pa.concat_arrays([b.column("doc_id"), none(pa.int64())]), pa.concat_arrays([b.column("text_digest"), none(pa.int64())]),
                *[pa.array([*key[:, i].tolist(), None], pa.int32()) for i in range(3)], pa.array([*blobs, None], pa.binary()), pa.array([*tokens, None], pa.int64()),
                pa.array([None] * n + [seen.astype(np.int32)], pa.list_(pa.int32())), pa.array([None] * n + [documents.astype(np.int64)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TOKENISED.split(", ")])

    return run


def _pack_range(p: Packing, idf, mean_size: float):
    """mapInArrow over a range in order: cuts it into shards and packs each."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40

        def shards() -> Iterator[tuple[list, list[np.ndarray]]]:
            doc_ids, ids, size = [], [], 0
            for b in batches:
                for doc_id, blob, n in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("n_tokens").to_pylist(), strict=True):
                    if ids and size + n > p.shard_tokens:
                        yield doc_ids, ids
                        doc_ids, ids, size = [], [], 0
                    raw = blob.as_buffer()
                    ids.append(np.frombuffer(raw, dtype="<u4" if raw.size == 4 * n else "<u2").astype("<u4"))
                    doc_ids.append(doc_id)
                    size += n
            if ids:
                yield doc_ids, ids

        for doc_ids, ids in shards():
            out = []
            for pieces in fill_windows(ids, p, idf.value, mean_size):
                offset = 0
                for d, start, length in pieces:
                    out.append((doc_ids[d], start, length, zlib.crc32(ids[d][start : start + length]), len(ids[d]), number, offset))
                    offset += length
                number += 1
            yield from pa.table({name: pa.array([r[i] for r in out], type=pa.int64()) for i, name in enumerate(names)}).to_batches()

    return run


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(*row_key(), "text")
    rows = written(keyed.mapInArrow(_tokenised(p), TOKENISED), "tokens")
    total = rows.agg(F.count("ids").alias("documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    # A row for each token of the vocabulary, at most.
    seen = rows.where("ids is null").select(F.inline(F.arrays_zip("terms", "documents"))).groupBy("terms").agg(F.sum("documents").alias("documents")).toArrow()
    terms, documents = (seen[c].to_numpy() for c in ("terms", "documents"))
    frequency = np.zeros(int(terms.max(initial=0)) + 1)
    frequency[terms] = documents
    idf = docs.sparkSession.sparkContext.broadcast(np.log(1 + (total["documents"] - frequency + 0.5) / (frequency + 0.5)))
    ranges = max(1, -(-total["tokens"] // (p.shard_tokens * p.range_shards)))
    order = ["key_1", "key_2", "key_3", "doc_id", "text_digest"]
    dealt = rows.where("ids is not null").select(*order, "ids", "n_tokens").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids", "n_tokens").mapInArrow(_pack_range(p, idf, total["tokens"] / max(1, total["documents"])), PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Packing(default_tokenizer()))
