"""Places for intermediate tables: below spark.checkpoint.dir, which executors share; a temporary folder in local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path; never used before."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _local:
            _local[sc.applicationId] = tempfile.mkdtemp(prefix="spark-scratch-")
        base = _local[sc.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table below the scratch folder, for what reads them several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
