"""Written intermediate tables: they cut lineage and outlive lost executors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def folder(spark) -> str:
    """The folder that spark.checkpoint.dir names; in local sessions without it one of the session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    os.makedirs(own.removeprefix("file://"), exist_ok=True)
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in that folder, and read it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows, else df itself."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
