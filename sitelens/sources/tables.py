"""Durable intermediate tables: what many checks read is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a fresh folder in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sitelens-"))
    return _local[0]


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the plans of its readers start there."""
    path = f"{shared_folder(df.sparkSession)}/sitelens-audit/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
