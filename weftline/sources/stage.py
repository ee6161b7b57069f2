"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a temporary folder kept for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.weftline.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.weftline.dir", made)
    return made


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
