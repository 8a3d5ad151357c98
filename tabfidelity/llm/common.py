"""Helpers shared by the training-data operators: tables, shared folders, text splitting, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Java patterns of the two kinds of words: without the ASCII white space, and without all ASCII but letters and digits
#: (which is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in a text whose A-Z are lower-cased). Classes by name are looked up in a table.
SPACE_WORD = r"\S+"
ALNUM_WORD = r"[\p{Alnum}\P{ASCII}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (local runs only) a fresh temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that no later step reads, also after a lost executor; shuffle files of plans that are gone follow."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for _ in range(2):  # what has just run is let go of a moment later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept; lower() does just that where each character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, pattern: str) -> Column:
    """All matches of a word pattern in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key() -> list[Column]:
    """Tells rows apart that repeat a doc_id: the id and a digest of the text."""
    return [F.col("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_digest")]


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; reads no further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def sized_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def settled(df: DataFrame, rows_each: int = 200_000) -> tuple[DataFrame, int]:
    """(df checkpointed and in partitions of about rows_each rows, its number of rows)."""
    df = checkpointed(df)
    n = df.count()
    most = max(1, -(-n // rows_each))
    return df.coalesce(most), n


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", broadcast_rows: int = 50_000) -> DataFrame:
    """(node, component): the smallest node reachable over edges. Nodes without edges don't occur.

    By contraction: each node points to its smallest neighbour, pointers are followed to their ends by doubling, and
    the edges are redrawn between those ends, until none is left. Each round is checkpointed to
    the shared folder; only row counts reach the driver. Pointers are broadcast up to broadcast_rows (16 bytes
    each), and joined by a shuffle beyond.
    """
    left, n = settled(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct())
    labels = None
    while n:
        both = left.unionAll(left.select("v", "u"))
        near, nodes = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("to")))
        small = F.broadcast if nodes <= broadcast_rows else (lambda df: df)
        moved = True
        while moved:
            near = near.join(small(near.select(F.col("node").alias("to"), F.col("to").alias("further"))), "to").select("node", F.col("further").alias("to"))
            ahead = small(near.select(F.col("node").alias("to"), F.col("to").alias("further")))
            near, _ = settled(near.join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
            moved = near.where("moved").limit(1).count()
            near = near.select("node", "to")
        ends = [small(near.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to"))) for x in "uv"]
        redrawn = left.join(ends[0], "u").join(ends[1], "v")
        left, n = settled(redrawn.select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).where("u != v").distinct())
        if labels is None:
            labels = checkpointed(near.select("node", F.col("to").alias("component")))
        else:
            step = small(near.select(F.col("node").alias("component"), "to"))
            labels = checkpointed(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
