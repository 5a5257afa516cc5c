"""Intermediate tables, written once and read by all that need them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a temporary one where none is set and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: what is read several times is computed once, and lost executors repeat only their own part."""
    path = f"{staging_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
