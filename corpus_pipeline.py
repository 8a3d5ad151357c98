"""A training corpus in five stages: quality rules, near duplicates, decontamination, secrets, packing.

Defined results: null and wordless texts fail the quality rules and go; a null doc_id or source takes part as one of its own; of
equal rows and of near copies one stays; an empty table gives no rows; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabfidelity.llm.common import table, written
from tabfidelity.llm.decontamination import remove
from tabfidelity.llm.jaccard_join import one_of_each
from tabfidelity.llm.packing import Packing, default_tokenizer, pack
from tabfidelity.llm.quality_rules import clean_documents
from tabfidelity.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected and depleted documents go; lines that are frequent on their host are removed from the others."""
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly that."""
    return remove(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents that are left."""
    return pack(docs, Packing(default_tokenizer()))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets),
    ("packing", packed),
]

#: Tokenizing and component search are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
