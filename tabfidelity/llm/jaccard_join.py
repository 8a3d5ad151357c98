"""N-gram Jaccard join by T-occurrence search (DivideSkip), with its inverted lists dealt out over the cluster.

Two documents link when their sets of distinct 4-word shingles have a Jaccard similarity of at least
85/100. Copies of a set are one *class*. The steps:

1. Sets: shingles are hashed to 64 bits; a class is the digest of a sorted set.
2. Groups, exact by the pigeonhole principle: the hash range is cut into more parts than two linked sets can differ
   in, so that linked sets agree wholly on a part. A signature is the sum of a part's hashes. Classes that
   share a signature are all in the group of the smallest of them. A signature that many classes of a slice of a task share is hot:
   its classes are pre-aggregated there, and groups that hot signatures join are one.
3. T-occurrence search in each group's inverted lists: of a query's lists, T - 1 of the longest are set aside, T being
   the least overlap of any partner; the short ones are merged with a heap (with counters, where they are long as well),
   and what they hold is looked up in the long ones by bisection as long as it can still reach its overlap. Long lists
   that are shorter than the lookups they would take (those of a group of near copies) are counted as they are.
   Every pair that links is found, in one place: in the first of the groups that both are in.
4. Groups of more than a block of shingles: classes most of whose shingles occur nowhere else in the group go, the others
   are dealt by level (linked sets are at most one apart) and into blocks, and each block meets each.

A task hands on links that span the components of what it saw, and of all links their number for each class; so what
is shuffled is linear in the classes. No partner, candidate or bucket is capped.

Defined results: null, empty and wordless texts have the empty set, link with nothing and are their own
component; fewer than four words are one shingle; a null doc_id takes part and carries the smallest id
of its component, null if there is none; rows that repeat a doc_id are each judged by their own text. n_class_links counts the
other classes that a row's class links with, n_links the other rows (copies of its own set included).
one_of_each() keeps one row of each component: that of the smallest doc_id (nulls last), of its texts the one with the
smallest digest, and of equal rows any one; rows without words all stay. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, connected_components, sized_broadcast, table, written


@dataclass(frozen=True)
class JoinParams:
    shingle_words: int = 4
    #: Links need num * |union| <= den * |intersection|.
    num: int = 85
    den: int = 100
    #: Shingles in a block of the search; bounds a task's memory.
    block_shingles: int = 1_000_000
    #: Rows (about 30 bytes each) up to which a side is broadcast; a shuffled join beyond.
    broadcast_rows: int = 50_000
    #: Signatures are made of so many shingles at a time; one that more than `hot` classes share there is hot.
    slice_shingles: int = 500_000
    hot: int = 32
    #: Entries of short lists that go through a heap; more are counted in an array.
    heap_entries: int = 2_000
    #: Long lists that candidates are looked up in before those that cannot reach their overlap go.
    probes: int = 32
    #: A lookup costs as much as counting so many entries of a list.
    lookup_entries: int = 16
    #: Classes with more than this share of all rows are broadcast where rows meet their classes.
    hot_share: float = 1 / 2000

class _WordHashes(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_hashes = _WordHashes()
_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; bytes.split() cuts at just the contract's white space."""
    words = (text or "").encode().translate(_LOW).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(k, len(words))
    mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        mixed = mixed * _MIX[0] + hashed[j : len(words) - size + 1 + j]
    mixed = (mixed ^ (mixed >> _MIX[2])) * _MIX[1]
    return np.unique(mixed ^ (mixed >> _MIX[2]))


def _class(shingles: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


def _classes(p: JoinParams):
    """mapInArrow: (doc_id, text_digest, text) -> (doc_id, text_digest, n_shingles, class); class is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), p.shingle_words) for t in b.column("text")]
            sizes, classes = pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_digest"), sizes, classes], ["doc_id", "text_digest", "n_shingles", "class"])

    return run


def _sets(p: JoinParams):
    """mapInArrow: text -> (class, n, shingles), each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            found = {_class(s): s for t in b.column("text") if len(s := shingle_set(t.as_py(), p.shingle_words))}
            found = {c: s for c, s in found.items() if c not in seen}
            seen.update(found)
            sizes, lists = pa.array([len(s) for s in found.values()], pa.int64()), pa.array([s.view(np.int64) for s in found.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), sizes, lists], ["class", "n", "shingles"])

    return run


def _levels(p: JoinParams, sizes: np.ndarray) -> np.ndarray:
    """Sizes of one level differ by a factor of den/num at most; linked sets are at most a level apart."""
    return np.floor(np.log(sizes) / np.log(p.den / p.num) + 1e-9).astype(np.int64)


def _parts(p: JoinParams, level: int) -> tuple[int, int]:
    """(parts, slack): of that many parts, two linked sets below the level's upper size have at least slack in common."""
    top = (p.den / p.num) ** (level + 1) + 1
    differ = int((p.den - p.num) / (p.den + p.num) * 2 * top + 1e-6)
    slack = 1 + (1 + -(-differ // 4) if differ else 0)
    return differ + slack, slack


def signatures(sets: list[np.ndarray], p: JoinParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, number of the set that each is of), for the level of each set and the one above."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    place = flat >> np.uint64(32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(flat, dtype=np.uint64)])
    own = _levels(p, sizes)
    for levels in (own, own + 1):
        known, which = np.unique(levels, return_inverse=True)
        parts, slack = np.array([_parts(p, int(x)) for x in known], dtype=np.int64).T[:, which]
        start = np.concatenate([[0], np.cumsum(parts)])
        part = (place * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + start[owner]
        filled = np.bincount(part, minlength=start[-1])
        ends = np.cumsum(filled)
        total = sums[ends] - sums[ends - filled]
        whose = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(start[-1]) - start[whose]
        # Few elements are weak evidence: parts of fewer than `enough` are left out if there are less than slack of
        # them, as one of the common parts is then larger. Of two sets, the stricter one's bound holds for both.
        enough = np.zeros(len(sizes), dtype=np.int64)
        for e in (1, 2, 3):
            enough[np.bincount(whose, weights=filled < e, minlength=len(sizes)) < slack] = e
        use = filled >= enough[whose]
        mixed = (total ^ (number.astype(np.uint64) << np.uint64(20)) ^ levels[whose].astype(np.uint64)) * _MIX[0]
        mixed = (mixed ^ (mixed >> _MIX[2])) * _MIX[1]
        yield mixed[use].view(np.int64), whose[use]


def _signed(p: JoinParams):
    """mapInArrow: text -> (signature, class, to, hot).

    A row with a null `to` says that the class has the signature; a row with one says that the class belongs with
    another (and has a signature of its own, so that such rows spread). Of a hot signature's classes only the smallest goes on.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, np.ndarray]]:
        """Sets by class, of so many shingles that the arrays of a slice stay small."""
        found, n = {}, 0
        for b in batches:
            for t in b.column("text"):
                if len(s := shingle_set(t.as_py(), p.shingle_words)):
                    found[_class(s)] = s
                    n += len(s)
                    if n > p.slice_shingles:
                        yield found
                        found, n = {}, 0
        if found:
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in slices(batches):
            classes = np.array(sorted(found), dtype=np.int64)
            for marks, whose in signatures([found[c] for c in classes.tolist()], p):
                order = np.lexsort((whose, marks))
                marks, mine = marks[order], classes[whose[order]]
                heads = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
                sizes = np.diff(np.concatenate([heads, [len(marks)]]))
                hot, head = np.repeat(sizes > p.hot, sizes), np.repeat(mine[heads], sizes)
                goes_on = ~hot | (head == mine)
                tied = np.unique(np.column_stack([mine[~goes_on], head[~goes_on]]), axis=0)
                own = (tied[:, 0] ^ tied[:, 1]).view(np.uint64) * _MIX[0]
                whole, none = np.concatenate([marks[goes_on], own.view(np.int64)]), np.ones(int(goes_on.sum()), dtype=bool)
                to = pa.array(np.concatenate([mine[goes_on], tied[:, 1]]), mask=np.concatenate([none, np.zeros(len(tied), dtype=bool)]))
                columns = [pa.array(whole), pa.array(np.concatenate([mine[goes_on], tied[:, 0]])), to, pa.array(np.concatenate([hot[goes_on], np.ones(len(tied), dtype=bool)]))]
                yield pa.RecordBatch.from_arrays(columns, ["signature", "class", "to", "hot"])

    return run


class _Labels:
    """Components of the numbers below n, each with its members; the smaller one is relabelled when two are joined."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1]
        order = np.argsort(self.of, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(self.of))[:-1])

    def join(self, a: int, b: int) -> None:
        a, b = self.of[a], self.of[b]
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a], self.members[b] = np.concatenate([self.members[a], self.members[b]]), self.members[b][:0]

    def span(self, a: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Joins a with others; the links that joined two components."""
        links = []
        for b in others[self.of[others] != self.of[a]].tolist():
            if self.of[b] != self.of[a]:
                links.append((a, b))
                self.join(a, b)
        return links


def partners(sets: list[np.ndarray], asking: np.ndarray, p: JoinParams, each_other: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(an asking set, all sets that link with it). A pair that both ask comes once, with the first one, and only if they ask each_other."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets) if n else np.empty(0, dtype=np.int64)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, dtype=np.int64)
    grams, tails = flat[heads], np.concatenate([heads[1:], [len(flat)]])
    # The inverted lists end to end, as one sorted array of (list, owner).
    entries = np.repeat(np.arange(len(grams)), tails - heads) * n + owner
    for q in np.flatnonzero(asking):
        at = np.searchsorted(grams, sets[q])
        length = tails[at] - heads[at]
        by_length = np.argsort(length, kind="stable")
        at, length = at[by_length], length[by_length]
        # The least overlap of any partner: with fewer lists set aside, a partner is in a short one.
        least = max(1, -(-p.num * int(sizes[q]) // p.den))
        alone = int(np.searchsorted(length, 1, side="right"))
        if len(at) - alone < least:
            continue  # too few of its shingles occur elsewhere
        short, long = at[alone : len(at) - least + 1], at[len(at) - least + 1 :]
        runs = [owner[heads[x] : tails[x]] for x in short]
        if sum(map(len, runs)) <= p.heap_entries:
            merged = Counter(heapq.merge(*[x.tolist() for x in runs]))
            others, overlap = np.array(list(merged), dtype=np.int64), np.array(list(merged.values()), dtype=np.int64)
        else:
            counts = np.bincount(np.concatenate(runs), minlength=n)
            others = np.flatnonzero(counts)
            overlap = counts[others]
        need = -(-p.num * (sizes[others] + sizes[q]) // (p.num + p.den))
        able = (overlap + len(long) >= need) & (others != q) & (~asking[others] | (each_other & (others > q)))
        others, overlap, need = others[able], overlap[able], need[able]
        while len(others) and len(long):
            probed, long = long[: p.probes], long[p.probes :]
            if len(others) * len(probed) * p.lookup_entries > (tails[probed] - heads[probed]).sum():
                overlap = overlap + np.bincount(np.concatenate([owner[heads[x] : tails[x]] for x in probed]), minlength=n)[others]
            else:
                wanted = (probed[:, None] * n + others[None, :]).ravel()
                place = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
                overlap = overlap + (entries[place] == wanted).reshape(len(probed), -1).sum(axis=0)
            able = overlap + len(long) >= need
            others, overlap, need = others[able], overlap[able], need[able]
        if len(found := others[overlap >= need]):
            yield int(q), found


def search(sets: list[np.ndarray], labels: np.ndarray, asking: np.ndarray, p: JoinParams) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that join sets of different labels, enough to span all that link; the labels that follow)."""
    found, links = _Labels(labels), []
    for q, others in partners(sets, asking, p):
        links += found.span(q, others)
    return links, found.of


def _members(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """value -> the numbers of the lists that hold it."""
    values, whose = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if not len(values):
        return {}
    order = np.argsort(values, kind="stable")
    known, heads = np.unique(values[order], return_index=True)
    return dict(zip(known.tolist(), np.split(whose[order], heads[1:]), strict=True))


#: Links (a, b) that span components, and rows without b: in how many links a class is, with how many rows.
FOUND = "a long, b long, links long, rows long"


def _search_group(p: JoinParams):
    """applyInArrow: class, rows, earlier, asking, block, part, shingles -> FOUND, of all links of classes that share none of their earlier groups."""

    def column(rows: pa.Table, name: str) -> list[np.ndarray]:
        lists = rows[name].combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        return [flat[bounds[i] : bounds[i + 1]] for i in range(len(lists))]

    def run(rows: pa.Table) -> pa.Table:
        # Each class once, also where rows repeat a doc_id and its text.
        classes, first = np.unique(rows["class"].to_numpy(), return_index=True)
        copies, asking = (rows[c].to_numpy()[first] for c in ("rows", "asking"))
        sets, earlier = ([x[i] for i in first] for x in (column(rows, "shingles"), column(rows, "earlier")))
        met, seen = _members(earlier), np.zeros(len(classes), dtype=bool)
        found, links = _Labels(np.arange(len(classes))), []
        n_links, n_rows = np.zeros((2, len(classes)), dtype=np.int64)
        for q, others in partners(sets, asking, p, rows["block"][0] == rows["part"][0]):
            if len(earlier[q]):
                there = np.concatenate([met[g] for g in earlier[q].tolist()])
                seen[there] = True
                others, seen[there] = others[~seen[others]], False
            n_links[q] += len(others)
            n_links[others] += 1
            n_rows[q] += copies[others].sum()
            n_rows[others] += copies[q]
            links += found.span(q, others)
        linked = np.flatnonzero(n_links)
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        none = [pa.nulls(len(x), pa.int64()) for x in (a, linked)]
        columns = [(classes[a], classes[linked]), (classes[b], none[1]), (none[0], n_links[linked]), (none[0], n_rows[linked])]
        return pa.table({name: pa.chunked_array([pa.array(x, pa.int64()) for x in both]) for name, both in zip(("a", "b", "links", "rows"), columns, strict=True)})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_digest"), "text")


def classes(docs: DataFrame, p: JoinParams) -> DataFrame:
    """A row per row of docs: doc_id, text_digest, n_shingles, class."""
    return _keyed(docs).mapInArrow(_classes(p), "doc_id long, text_digest long, n_shingles long, class long")


def groups(docs: DataFrame, p: JoinParams) -> DataFrame:
    """(group, class), distinct: classes that share a signature share a group."""
    signed = docs.select("text").mapInArrow(_signed(p), "signature long, class long, to long, hot boolean")
    ahead = Window.partitionBy("signature").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    ties = signed.select("class", F.coalesce("to", F.first("class").over(ahead)).alias("first"), "hot").where("first != class")
    ties = written(ties.groupBy("first", "class").agg(F.max("hot").alias("hot")), "ties")
    joined = connected_components(ties.where("hot"), "first", "class", p.broadcast_rows).select(F.col("node").alias("first"), F.col("component").alias("group"))
    # The smallest class is in its own group.
    both = ties.select("first", "class").unionAll(ties.select("first", F.col("first").alias("class")))
    return both.join(joined, "first", "left").select(F.coalesce("group", "first").alias("group"), "class").distinct()


def class_links(docs: DataFrame, rows: DataFrame, p: JoinParams) -> DataFrame:
    """All links between classes, as FOUND: those that span every component, and their numbers by class. rows: classes(docs, p), written."""
    shared = written(groups(docs, p), "groups").groupBy("class").agg(F.sort_array(F.collect_list("group")).alias("groups"))
    # One row of each class that has company tells its set.
    known = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_digest")).alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    reps = written(known.join(shared, "class").select("class", "n", "rows", "groups", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_digest").alias("r_digest")), "representatives")
    texts = _keyed(docs).join(sized_broadcast(reps.select("r_id", "r_digest"), p.broadcast_rows), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_digest") == F.col("r_digest")), "left_semi")
    sets = written(texts.select("text").mapInArrow(_sets(p), "class long, n long, shingles array<long>"), "sets").select("class", "shingles")

    members = reps.select("class", "n", "rows", "groups", F.posexplode("groups").alias("at", "group")).withColumn("earlier", F.slice("groups", F.lit(1), F.col("at"))).drop("groups", "at")
    wide = written(members.groupBy("group").agg(F.sum("n").alias("total")).where(F.col("total") > p.block_shingles).select("group"), "wide-groups")
    tasks = members.withColumns({"asking": F.lit(True), "level": F.lit(0), "block": F.lit(0), "part": F.lit(0)})
    if wide.limit(1).count():
        wide = sized_broadcast(wide, p.broadcast_rows)
        tasks = tasks.join(wide, "group", "left_anti").unionByName(_blocks(members.join(wide, "group"), sets, p))
    tasks = tasks.select("group", "level", "block", "part", "class", "rows", "earlier", "asking").join(sets, "class")
    return written(tasks.groupBy("group", "level", "block", "part").applyInArrow(_search_group(p), FOUND), "links")


def _blocks(members: DataFrame, sets: DataFrame, p: JoinParams) -> DataFrame:
    """Members of wide groups with level, block, part, asking: in a level's task, those of a block ask those of a part."""
    lists = members.select("group", "class").join(sets, "class").select("group", "class", F.explode("shingles").alias("shingle"))
    alone = lists.groupBy("group", "shingle").agg(F.first("class").alias("class"), F.count("*").alias("sets")).where("sets = 1").groupBy("group", "class").agg(F.count("*").alias("alone"))
    able = members.join(alone, ["group", "class"], "left").where(p.den * (F.col("n") - F.coalesce("alone", F.lit(0))) >= p.num * F.col("n")).drop("alone")
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(p.den / p.num)) + 1e-9).cast("int")
    # A set asks those of its own level and of the one below.
    able = able.withColumn("own", own).withColumn("level", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("asking", F.col("own") == F.col("level"))
    able = written(able, "wide-members")
    many = able.groupBy("group", "level").agg(F.ceil(F.sum("n") / p.block_shingles).cast("int").alias("blocks"), F.max("asking").alias("asked")).where("asked").drop("asked")
    able = able.join(sized_broadcast(many, p.broadcast_rows), ["group", "level"]).withColumn("own_block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    last = F.col("blocks") - 1
    asking = able.where("asking").withColumns({"block": F.col("own_block"), "part": F.explode(F.sequence(F.lit(0), last))})
    # Of two blocks whose sets both ask, the first one asks.
    asked = able.withColumn("block", F.explode(F.sequence(F.lit(0), last))).where(~F.col("asking") | (F.col("block") < F.col("own_block")))
    asked = asked.withColumns({"part": F.col("own_block"), "asking": F.lit(False)})
    return asking.unionByName(asked).drop("own", "own_block", "blocks")


def components(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """A row per row of docs: doc_id, text_digest, n_shingles, component_id, class, component (a class; both null for the empty set), n_class_links, n_links."""
    rows = written(classes(docs, p), "classes")
    found = class_links(docs, rows, p)
    degree = found.where("links is not null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("n_class_links"), F.sum("rows").alias("elsewhere"))
    joined = connected_components(found.where("links is null"), broadcast_rows=p.broadcast_rows).select(F.col("node").alias("class"), "component")
    known = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    labelled = known.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    counts = [F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"), (F.coalesce("elsewhere", F.lit(0)) + F.col("rows") - 1).alias("n_links")]
    named = labelled.join(least, "component").join(degree, "class", "left").select("class", "component", "component_id", *counts, "rows")
    named = written(named, "named-classes")
    # Rows of the commonest classes meet them by a broadcast of bounded size, so no class is a hot key.
    most = p.hot_share * rows.count()
    hot = F.broadcast(named.where(F.col("rows") > most))
    cold = named.where(F.col("rows") <= most)
    alone = rows.where("class is null").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id"), "n_class_links": F.lit(0).cast("long"), "n_links": F.lit(0).cast("long")})
    linked = rows.join(hot, "class").unionByName(rows.where("class is not null").join(hot, "class", "left_anti").join(cold, "class")).drop("rows")
    return linked.unionByName(alone).select("doc_id", "text_digest", "n_shingles", "component_id", "class", "component", "n_class_links", "n_links")


def one_of_each(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """docs with one row of each component. Columns as they are."""
    found = written(components(docs, p), "components")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_digest")
    chosen = found.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    copies = found.groupBy("doc_id", "text_digest").agg(F.count("*").alias("__n"))
    keep = chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.text_digest").alias("__digest"))
    keep = copies.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_digest") == F.col("__digest"))).select("__id", "__digest", "__n")
    keep = sized_broadcast(written(keep, "kept"), p.broadcast_rows)
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    digest = F.xxhash64("text")
    kept = docs.where(~wordless).withColumn("__text", digest).join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")))
    again = kept.where("__n > 1").dropDuplicates(["__id", "__digest"])
    return docs.where(wordless).unionByName(kept.where("__n = 1").select(*docs.columns)).unionByName(again.select(*docs.columns))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class", "n_class_links", "n_links")
