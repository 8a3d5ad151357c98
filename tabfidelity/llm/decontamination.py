"""Benchmark decontamination (JVM-side only): a hash set of normalised test n-grams is scanned for in the
windows of the training texts; hits are verified word by word, then spans or documents are removed.

The scan reads each text once and splits it into words once. A window of L consecutive words, wherever it starts,
holds a whole part of L - s + 1 words whose place is a multiple of s = L // 2. So the parts at those places are looked up in the
broadcast hash set of the parts of all test n-grams; only texts with a part in common go on to have every window compared. Both
sides lower-case A-Z alone and cut words the same way, as what other letters become can depend on their neighbours.

Parts and n-grams are broadcast up to a checked number of rows; beyond it they meet the texts' in a shuffled join.

Defined results: null and wordless texts and items have no windows; an item of fewer words than a window is one
window; items that repeat a text are all reported, null item_ids are not named; rows that repeat a doc_id
are scanned each by their own text; extra columns are ignored, or kept by the removers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, checkpointed, let, lower_ascii, row_key, sized_broadcast, small_enough, table, words_of, written


@dataclass(frozen=True)
class Contamination:
    window: int = 10
    #: N-grams (about 200 bytes each) up to which they are broadcast.
    broadcast_rows: int = 200_000
    #: Parts of n-grams (a number each), and keys of documents that go on, up to which they are broadcast.
    broadcast_keys: int = 1_000_000
    #: remove(): documents with more than this share of their words hit go, the others lose the hit words.
    max_hit_share: float = 0.5


def item_windows(benchmark: DataFrame, p: Contamination) -> DataFrame:
    """(hash, gram, length, items): the distinct windows, and the sorted ids of the items that have them."""
    items = benchmark.select("item_id", words_of(lower_ascii(F.col("text")), ALNUM_WORD).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - p.window + 1, F.lit(1)))
    grams = items.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.expr(f"slice(words, start, {int(p.window)})").alias("gram"))
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(
        F.xxhash64("gram").alias("hash"), "gram", F.size("gram").alias("length"), "items"
    )


def _stride(length: int) -> int:
    return max(1, length // 2)


def _parts(length: int, step: int) -> Callable[[Column], Column]:
    """words -> hashes of the parts for windows of that length, at every step-th place."""
    size = length - _stride(length) + 1

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - size + 1, F.lit(step))
        return F.when(F.size(words) >= length, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))

    return of


@dataclass(frozen=True)
class Scan:
    #: A row per row of the documents: doc_id, text_digest, n_words.
    rows: DataFrame
    #: A row per document with hits: doc_id, text_digest, places (sorted numbers of hit words, from 0), items (distinct).
    found: DataFrame


def hits(docs: DataFrame, benchmark: DataFrame, p: Contamination = Contamination()) -> Scan:
    grams = checkpointed(item_windows(benchmark, p))
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect()) or [p.window]  # at most p.window numbers

    words = words_of(lower_ascii(F.col("text")), ALNUM_WORD)
    summary = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.array_distinct(F.concat(*[_parts(n, _stride(n))(w) for n in lengths])).alias("parts")))
    rows = docs.select(*row_key(), summary.alias("summary")).select("doc_id", "text_digest", "summary.*")
    rows = written(rows, "text-parts")
    item_parts = F.coalesce(*[F.when(F.col("length") == n, _parts(n, 1)(F.col("gram"))) for n in lengths])
    item_parts = checkpointed(grams.select(F.explode(item_parts).alias("part")).distinct())
    near = rows.select("doc_id", "text_digest", F.explode("parts").alias("part")).join(sized_broadcast(item_parts, p.broadcast_keys), "part", "left_semi")
    near = checkpointed(near.select("doc_id", "text_digest").distinct())
    keys = sized_broadcast(near.select(F.col("doc_id").alias("near_id"), F.col("text_digest").alias("near_digest")), p.broadcast_keys)
    keyed = docs.select(*row_key(), "text").where("text is not null")
    texts = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("text_digest") == F.col("near_digest")), "left_semi")

    broadcast = small_enough(grams, p.broadcast_rows)
    grams = grams.select("hash", F.col("gram").alias("item_gram"), "items")
    grams = F.broadcast(grams) if broadcast else grams
    words = texts.select("doc_id", "text_digest", words_of(lower_ascii(F.col("text")), ALNUM_WORD).alias("words"))
    found = None
    for length in lengths:
        starts = words.where(F.size("words") >= length).select("doc_id", "text_digest", "words", F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("start"))
        gram = F.expr(f"slice(words, start, {length})")
        if broadcast:
            met = starts.join(grams, (F.xxhash64(gram) == F.col("hash")) & (gram == F.col("item_gram")))
        else:  # only the window itself is shuffled
            met = starts.select("doc_id", "text_digest", "start", gram.alias("gram")).join(grams, (F.xxhash64("gram") == F.col("hash")) & (F.col("gram") == F.col("item_gram")))
        part = met.select("doc_id", "text_digest", (F.col("start") - 1).alias("at"), F.lit(length).alias("length"), "items")
        found = part if found is None else found.unionAll(part)
    found = found.groupBy("doc_id", "text_digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "length")), lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return Scan(rows.select("doc_id", "text_digest", F.col("n_words").cast("long").alias("n_words")), found)


def scan(docs: DataFrame, benchmark: DataFrame, p: Contamination = Contamination()) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    scanned = hits(docs, benchmark, p)
    found = scanned.found.select(F.col("doc_id").alias("hit_id"), F.col("text_digest").alias("hit_digest"), F.size("places").cast("long").alias("n_hit"), "items")
    joined = scanned.rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_digest") == F.col("hit_digest")), "left")
    names = F.coalesce(F.array_sort(F.transform("items", lambda i: i.cast("string"))), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _without(text: Column, places: Column) -> Column:
    """text without the words at places; what stands between words stays."""
    gaps = F.split(text, ALNUM_WORD, -1)
    left = F.transform(words_of(text, ALNUM_WORD), lambda w, i: F.when(F.array_contains(places, i), F.lit("")).otherwise(w))
    return F.array_join(F.zip_with(gaps, left, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def remove(docs: DataFrame, benchmark: DataFrame, p: Contamination = Contamination()) -> DataFrame:
    """docs without the hit words, and without documents that are mostly hits. Columns as they are (n_chars, if there, renewed)."""
    found = hits(docs, benchmark, p).found.select(F.col("doc_id").alias("__hit_id"), F.col("text_digest").alias("__hit_digest"), F.col("places").alias("__places"))
    joined = docs.join(
        found, F.col("doc_id").eqNullSafe(F.col("__hit_id")) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("__hit_digest")), "left"
    )
    n_words = F.regexp_count("text", F.lit(ALNUM_WORD))
    kept = joined.where(F.col("__places").isNull() | (F.size("__places") <= p.max_hit_share * n_words))
    out = kept.withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__places"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB: windows are compared as text.
OP3_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(w[s:s + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, length, array_to_string(w[s:s + length - 1], ' ') AS gram
  FROM (SELECT doc_id, w, length, unnest(generate_series(1, len(w) - length + 1)) AS s FROM dw, (SELECT DISTINCT length FROM grams) WHERE len(w) >= length)
), met AS (SELECT doc_id, s, w.length, item_id FROM windows w JOIN grams g ON w.gram = g.gram AND w.length = g.length),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + length - 1)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS names FROM met GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
