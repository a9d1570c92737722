"""Shared staging folder, size-checked broadcasts and distributed connected components."""

from __future__ import annotations

import os
import uuid

import pyarrow.parquet as pq
from pyarrow import ArrowInvalid, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows that a task that writes a table should have: each file costs its opening and, on a local file system, some processes.
FILE_ROWS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    os.makedirs(own.removeprefix("file://"), exist_ok=True)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dense(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than rows fill, the rows that its last step reads at most; a table of many rows stays as it is."""
    return df.coalesce(max(1, min(-(-rows // FILE_ROWS), 1 << 30)))


def _plain(kind: DataType) -> bool:
    """Whether Arrow and Spark write the type to Parquet alike."""
    if isinstance(kind, StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return kind.typeName() in ("long", "integer", "double", "boolean", "string", "binary")


def _folder(spark: SparkSession, path: str):
    """pyarrow's file system and path, as Hadoop's default one reads it, or None where it knows none: only Spark's writers reach it."""
    if path.startswith("/"):
        path = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").rstrip("/") + path
    try:
        return fs.FileSystem.from_uri(path)
    except (ArrowInvalid, OSError):
        return None


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts lineage, survives lost executors.

    rows: how many it has at most, if known; of these see dense. A table of so few that it may be broadcast is written by the driver
    as one file, through pyarrow: Hadoop's local file system starts a process for each file and folder, and until such a child of
    an executor is another program, it shares all memory of the JVM and counts as much once more.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df = df if rows is None else dense(df, rows)
    if rows is not None and rows <= BROADCAST_ROWS and _plain(df.schema) and (at := _folder(spark, path)):
        at[0].create_dir(at[1])
        pq.write_table(df.toArrow(), f"{at[1]}/part-0.parquet", filesystem=at[0])
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most that many rows, else df itself (a shuffled join follows)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free(name: str, columns: list[str]) -> str:
    """name, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Connected components of an edge table (a, b), both of one orderable type: rows (v, root), root the least member.

    Minimum labels spread along the edges, then each vertex jumps to its label's label; both steps are equi-joins and
    minima that combine before the shuffle, repeated on written tables until nothing changes. A jump joins only the labels that
    have moved themselves, one row each, broadcast if few; else a third of all vertices under one label is a skewed side that
    adaptive execution splits, as is a hub's edges. Vertices without edges do not appear. rows: how many edges there are at most,
    if known; once the edges are written they are counted, and no later table has more rows.
    """
    both = stage(edges.select("a", "b").where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", None if rows is None else 2 * rows)
    n = both.count()
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-labels", n)
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "root")
        best = stage(near.unionByName(labels.select("v", "root")).groupBy("v").agg(F.min("root").alias("root")), f"{name}-labels", 2 * n)
        moved = best.select("root").distinct().join(best.select(F.col("v").alias("root"), F.col("root").alias("next")), "root").where("root <> next")
        jumped = best.join(small(stage(moved, f"{name}-moved", n)), "root", "left").select("v", F.least("root", "next").alias("root"))
        after = stage(jumped, f"{name}-labels", n)
        changed = after.join(labels.withColumnRenamed("root", "was"), "v").where("root <> was").limit(1).count()
        labels = after
        if not changed:
            return labels
