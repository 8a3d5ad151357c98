"""Quality rules: cross-document line frequency (JVM-side only).

Lines are normalised and hashed; for each host the documents that hold a line are counted, lines above
the host's limit are removed, and a document that loses too much is rejected.

Copies: documents count by their distinct texts, so that a text does not turn into boilerplate by being
copied exactly; documents that differ anywhere count each, however much they share.

Defined results: a null or empty text has no words (base_failed, not kept); a null host is a host of its
own; rows that repeat a doc_id are judged each by their own text; extra columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, checkpointed, let, row_key, sized_broadcast, table, words_of


@dataclass(frozen=True)
class LineRules:
    #: A line is removed if more than this share of the host's documents hold it ...
    max_share: float = 0.05
    #: ... and more than this number do.
    min_documents: int = 20
    #: A document is depleted if fewer than this share of its words remain.
    min_left: float = 0.3
    #: Removed lines are broadcast up to this many (about 40 bytes each), joined by a shuffle beyond.
    broadcast_rows: int = 500_000


def normalised_lines(text: Column) -> Column:
    """Lower-cased lines, digits as 0, white space collapsed; those without a word are left out."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[0-9]", "0")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " "))), lambda x: x != "")


def window_hashes(words: Column) -> Column:
    """A hash for each three-word window; words are hashed once each, and windows from their words' hashes."""

    def of_three(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    return F.when(F.size(words) >= 3, let(F.transform(words, lambda w: F.xxhash64(w)), of_three)).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """Words in windows found twice or more. Windows are sorted by hash, so equal ones are neighbours."""

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
            F.lit(0),
            lambda acc, n: acc + n,
        )

    def places(s: Column) -> Column:
        same = F.filter(s, lambda e, k: (e["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (e["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ranked, places), covered))


def base_statistics(docs: DataFrame) -> DataFrame:
    """Keeps doc_id and source and adds text_digest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(*row_key(), "source", text.alias("text"), words_of(F.col("text"), SPACE_WORD).alias("words"), lines.alias("lines"))
    rows = rows.select(
        "doc_id",
        "text_digest",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.char_length(w)).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(window_hashes(F.col("words")), repeated_words).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line of a document: key, source, hash of the normalised line, words."""
    rows = docs.where("text is not null").select(*row_key(), "source", normalised_lines(F.col("text")).alias("lines"))
    # A select of its own: beside explode() the digest would be worked out anew for every line.
    rows = rows.select("doc_id", "text_digest", "source", F.explode("lines").alias("line"))
    return rows.select("doc_id", "text_digest", "source", F.xxhash64("line").alias("line"), F.regexp_count("line", F.lit(SPACE_WORD)).cast("long").alias("words"))


def frequent_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(source, line, documents): the hashes of lines above their host's limit.

    The distinct texts are dealt by (host, line, text) and summed afterwards, so a line that
    most documents share is spread over all tasks.
    """
    lines = _lines(docs)
    counts = lines.groupBy("source", "line").agg(F.count_distinct("text_digest").alias("documents")).where(F.col("documents") > rules.min_documents)
    hosts = (
        docs.where("text is not null")
        .select(F.col("source").alias("host"), F.xxhash64("text").alias("text_digest"))
        .groupBy("host")
        .agg(F.count_distinct("text_digest").alias("host_documents"))
    )
    return (
        counts.join(hosts, F.col("source").eqNullSafe(F.col("host")))
        .where(F.col("documents") > rules.max_share * F.col("host_documents"))
        .select("source", "line", "documents")
    )


def judge_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """base_statistics() plus removed_words, removed_lines (hashes) and kept."""
    bad = checkpointed(frequent_lines(docs, rules)).select(F.col("source").alias("bad_source"), F.col("line").alias("bad_line"))
    bad = sized_broadcast(bad, rules.broadcast_rows)
    lost = (
        _lines(docs)
        .join(bad, (F.col("line") == F.col("bad_line")) & F.col("source").eqNullSafe(F.col("bad_source")))
        .groupBy(F.col("doc_id").alias("lost_id"), F.col("text_digest").alias("lost_digest"), F.col("source").alias("lost_source"))
        .agg(F.sum("words").alias("lost_words"), F.collect_set("line").alias("removed_lines"))
    )
    base = base_statistics(docs)
    # Equal rows count their lines once each: the sum holds as many copies as there are rows.
    copies = base.groupBy("doc_id", "text_digest", "source").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    )
    joined = copies.join(
        lost,
        F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_digest") == F.col("lost_digest")) & F.col("source").eqNullSafe(F.col("lost_source")),
        "left",
    )
    removed = F.coalesce(F.col("lost_words") / F.col("copies"), F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "text_digest",
        "source",
        "copies",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        removed.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        (~F.col("base_failed") & ((F.col("n_words") - removed) >= rules.min_left * F.col("n_words"))).alias("kept"),
    )


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents, their frequent lines removed, in the columns of docs (n_chars, if there, renewed)."""
    verdict = judge_lines(docs, rules).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_digest").alias("_digest"), F.col("source").alias("_source"), F.col("removed_lines").alias("_lines")
    )
    joined = docs.join(
        verdict,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest")) & F.col("source").eqNullSafe(F.col("_source")),
    )

    def hash_of(line: Column) -> Column:
        plain = F.regexp_replace(F.lower(line), r"[0-9]", "0")
        return F.xxhash64(F.trim(F.regexp_replace(plain, r"[\x20\x09\x0B-\x0D]+", " ")))

    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_lines"), hash_of(x))), "\n")
    out = joined.withColumn("text", F.when(F.size("_lines") == 0, F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = judge_lines(docs)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    return rows.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_one")).drop("_one")


#: The same in DuckDB, for tables whose doc_ids are unique: lines and windows are compared as text.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text IS NULL AS missing, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS lines FROM documents
), places AS (SELECT doc_id, i, words[i:i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM places) WHERE times > 1) GROUP BY 1
), base AS (
  SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (doc_id)
), plain AS (
  SELECT doc_id, source, text, trim(regexp_replace(unnest(string_split(regexp_replace(lower(text), '[0-9]', '0', 'g'), chr(10))), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS line FROM d WHERE NOT missing
), lines AS (SELECT *, len(regexp_extract_all(line, '[^\x09-\x0D\x20]+')) AS words FROM plain WHERE line <> ''),
hosts AS (SELECT source, count(DISTINCT text) AS documents FROM d WHERE NOT missing GROUP BY 1),
bad AS (
  SELECT l.source, line FROM (SELECT source, line, count(DISTINCT text) AS documents FROM lines GROUP BY 1, 2) l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE l.documents > 20 AND l.documents > 0.05 * h.documents
), lost AS (SELECT doc_id, sum(words) AS n FROM lines l JOIN bad b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source GROUP BY 1),
judged AS (SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, cast(coalesce(n, 0) AS BIGINT) AS removed_words FROM base b LEFT JOIN lost USING (doc_id))
SELECT *, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept FROM judged
"""
