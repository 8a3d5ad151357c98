"""Token counts through a digest cache.

Counts are stored in a Parquet table by content digest and tokenizer digest. A run joins its digests to the
stored ones, encodes only the distinct misses, appends their counts, and reads every document's count from the cache.

The content that is digested has runs of ASCII white space collapsed to a space, which the tokenizer drops
anyhow, so texts that differ in spacing alone share an entry. Appends are files of their own: a lost executor's task is
written anew, and two runs that race append the same counts twice, which reading evens out.

Defined results: null and empty texts have no tokens; rows that repeat a doc_id are counted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, written
from .packing import default_tokenizer
from .tokens import encoder, file_digest

CACHE = "digest string, tokenizer string, n_tokens long"
#: A text is frequent from one in so many rows; at most so many digests are broadcast.
FREQUENT = 10_000


def content(text: Column) -> Column:
    """What is digested and encoded."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that isn't there yet is empty."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            counts = [len(encode(x.as_py())) // 4 for x in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, type=pa.int64())], ["digest", "n_tokens"])

    return run


def spread(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (doc_id, n_bytes, digest, row number) with their n_tokens, the copies of a frequent text dealt over many tasks.

    Frequent are digests of more than one in FREQUENT of all rows, so there are at most FREQUENT of them and they can be
    broadcast at any size; their counts are repeated once for each such share.
    """
    share = -(-rows.count() // FREQUENT) or 1
    often = rows.groupBy("digest").count().where(F.col("count") > share)
    parts = F.broadcast(often.select("digest", F.ceil(F.col("count") / share).cast("int").alias("parts")))
    dealt = rows.join(parts, "digest", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
    asked = counts.join(parts, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.drop("parts").join(asked.drop("parts"), ["digest", "part"]).select("doc_id", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_tokens. Appends the misses to the table at cache."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    version = file_digest(tokenizer)
    digested = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content(F.col("text")).alias("content"))
    digested = digested.withColumn("digest", F.sha2("content", 256))
    rows = written(digested.select("doc_id", "n_bytes", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    misses = digested.select("digest", "content").dropDuplicates(["digest"]).join(stored, "digest", "left_anti")
    counted = misses.mapInArrow(_count(tokenizer), "digest string, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return spread(rows, counts)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query starts from an empty cache of its own, so it encodes every distinct text."""
    rows = count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 2048)
