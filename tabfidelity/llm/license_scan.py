"""License scans (JVM-side only): ordered signature rules over the words of a text.

The rules (license_rules.py) are written by hand. A prefilter picks those whose keyword and cue occur among a text's
words; only their regexes run. Whatever a regex matches holds both as whole words, so the prefilter loses nothing.
Each detection is an interval with the rule's priority; one that lies within an interval of
higher priority, or within a longer one of the same priority, is suppressed. What remains gives the labels.

Defined results: null and wordless texts have no detections, no places and empty labels; equal intervals of one
priority all stay; rows that repeat a doc_id are scanned each by their own text; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM_WORD, let, lower_ascii, row_key, table, words_of
from .license_rules import PRIORITIES, rule_rows

#: The phrases of the contract and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

BASE_CONFIDENCE = 0.6


def rules(spark: SparkSession) -> DataFrame:
    """(keywords, cues, pattern, label, priority, confidence) of every rule."""
    words = lambda x: F.array(*map(F.lit, x))
    structs = [
        F.struct(words(k).alias("keywords"), words(cues).alias("cues"), F.lit(f"(?<= )(?:{t})(?= )").alias("pattern"), F.lit(label).alias("label"), F.lit(n).alias("priority"), F.lit(float(c)).alias("confidence"))
        for k, cues, t, label, n, c in rule_rows()
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def _places(text: Column, pattern: Column) -> Column:
    """Array of (start, end) of the matches."""

    def folded(found: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.char_length(m["gap"])
            end = start + F.char_length(m["whole"])
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

        nothing = F.array().cast("array<struct<start:int,end:int>>")
        return F.aggregate(F.arrays_zip(found["gap"], found["whole"]), F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step)["spans"]

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(F.struct(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole")), folded)


def detections(docs: DataFrame, prefilter: bool = True) -> DataFrame:
    """(doc_id, text_digest, start, end, label, priority, confidence): what no other detection contains.

    Places count characters of the text's lower-cased words with single spaces between and around them. Without
    prefilter all rules run on all texts, with the same result.
    """
    ruled = rules(docs.sparkSession)
    read = docs.where("text is not null").select(*row_key(), words_of(lower_ascii(F.col("text")), ALNUM_WORD).alias("words"))
    plain = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("plain")
    if prefilter:
        keys, cues = (F.array(*[F.lit(k) for k in sorted({k for row in rule_rows() for k in row[at]})]) for at in (0, 1))
        held = read.select("doc_id", "text_digest", "words", F.array_intersect(cues, "words").alias("held_cues"), F.array_intersect(keys, "words").alias("held"))
        held = held.where((F.size("held_cues") > 0) & (F.size("held") > 0)).select("doc_id", "text_digest", plain, "held_cues", F.explode("held").alias("keyword"))
        named = ruled.withColumn("keyword", F.explode("keywords"))
        asked = held.join(F.broadcast(named), "keyword").where(F.arrays_overlap("held_cues", "cues"))  # a few hundred rules at any size of docs
    else:
        asked = read.select("doc_id", "text_digest", plain).crossJoin(F.broadcast(ruled))
    found = asked.where(F.expr("rlike(plain, pattern)"))
    found = found.select("doc_id", "text_digest", "label", "priority", "confidence", F.inline(_places(F.col("plain"), F.col("pattern"))))
    found = found.distinct()  # of equal rows, and of rules found by two of their keywords
    doc = ("doc_id", "text_digest")
    upto = Window.partitionBy(*doc).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(*doc, "priority").orderBy("start")
    reach = {n: F.max(F.when(F.col("priority") > n, F.col("end"))).over(upto) for n in PRIORITIES}
    stronger = F.coalesce(*[F.when(F.col("priority") == n, reach[n]) for n in PRIORITIES], F.lit(-1))
    before = F.coalesce(F.max("end").over(own.rangeBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    peers = F.max("end").over(own.rangeBetween(Window.currentRow, Window.currentRow))
    marked = found.withColumns({"stronger": stronger, "before": before, "peers": peers})
    return marked.where((F.col("stronger") < F.col("end")) & (F.col("before") < F.col("end")) & (F.col("peers") <= F.col("end"))).drop("stronger", "before", "peers")


def _phrase_places(words: Column, phrase: str, label: str) -> Column:
    parts = phrase.split()

    def whole(i: Column) -> Column:
        return reduce(Column.__and__, [F.get(words, i + j) == w for j, w in enumerate(parts)])

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), whole)
    places = F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    return F.when(F.size(words) >= len(parts), places).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def _base_places(words: Column) -> Column:
    """Array of (start, label) for the phrases of the contract."""
    return F.concat(*[_phrase_places(words, phrase, label) for phrase, label in BASE_PHRASES])


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    low = lower_ascii(F.col("text"))
    nothing = F.array().cast("array<struct<start:int,label:string>>")
    base = F.when(F.coalesce(low, F.lit("")).contains("license"), let(words_of(low, ALNUM_WORD), _base_places)).otherwise(nothing)
    rows = docs.select(*row_key(), F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORD)), F.lit(0)).cast("long").alias("n_words"), base.alias("base"))
    found = (
        detections(docs)
        .groupBy(F.col("doc_id").alias("d_id"), F.col("text_digest").alias("d_digest"))
        .agg(F.collect_set("label").alias("found"), F.max("confidence").alias("best"))
    )
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_digest") == F.col("d_digest")), "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("found", F.array().cast("array<string>"))))
    place = F.transform("base", lambda b: b["start"])
    return joined.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(place).cast("long").alias("first_word"),
        F.array_max(place).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
