"""Skylines, masks and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def skyline(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rows of least y among all with x no greater, one for equal (x, y): a running minimum in order of x."""
    w = W.partitionBy(*group).orderBy(x, y).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_b", F.min(y).over(w)).where(F.col(y).isNotNull() & F.col(x).isNotNull() & (F.col("_b").isNull() | (F.col(y) < F.col("_b")))).drop("_b")


def mask(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """df with column frontier: no row of the group is at least as good in both and better in one; null axes are never on it."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = whole.groupBy(*group, x).agg(F.min(y).alias("_y"))
    best = at.withColumn("_m", F.min("_y").over(W.partitionBy(*group).orderBy(x).rowsBetween(W.unboundedPreceding, -1)))
    on = best.where("_m IS NULL OR _y < _m").select(*group, x, F.col("_y").alias(y)).withColumn("frontier", F.lit(True))
    return df.join(on, [*group, x, y], "left").withColumn("frontier", F.coalesce("frontier", F.lit(False)))


def least(df: DataFrame, group: list[str], objective: str, time: str, within: int | None = None) -> DataFrame:
    """Per group the row of least objective, ties to the shorter time; rows without the objective never qualify."""
    q = df.where(F.col(objective).isNotNull())
    q = q if within is None else q.where(F.col(time) <= within)
    own = [c for c in df.columns if c not in group]
    return q.groupBy(*group).agg(F.min_by(F.struct(*own), F.struct(objective, time)).alias("r")).select(*group, "r.*")


def mask3(df: DataFrame, group: list[str], x: str, y: str, z: str) -> DataFrame:
    """As mask, over three axes: for each level of z, a running minimum over the rows that cost no more; z has few values (fares)."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*group, x, y, z).distinct()
    levels = whole.select(*group, F.col(z).alias("_z")).distinct()
    # A row counts at its own level and all above; it stays if at its own level none before it in order of x has as little y.
    at = whole.join(levels, group).where(F.col("_z") >= F.col(z))
    w = W.partitionBy(*group, "_z").orderBy(x, y, z).rowsBetween(W.unboundedPreceding, -1)
    on = at.withColumn("_m", F.min(y).over(w)).where((F.col("_z") == F.col(z)) & (F.col("_m").isNull() | (F.col(y) < F.col("_m")))).select(*group, x, y, z).withColumn("frontier", F.lit(True))
    return df.join(on, [*group, x, y, z], "left").withColumn("frontier", F.coalesce("frontier", F.lit(False)))


def relaxed(df: DataFrame, group: list[str], slack: int) -> DataFrame:
    """Rows (arrival, penalty, measure, rides, grams) that no other of the group beats: one that has no more of measure and rides,
    arrives no later, and whose arrival with its penalty is at least slack earlier; of rows equal in all four the least grams."""
    key = ["arrival", "penalty", "measure", "rides"]
    one = df.groupBy(*group, *key).agg(F.min("grams").alias("grams"))
    b = one.select(*group, *[F.col(c).alias(f"_{c}") for c in key])
    same = " AND ".join(f"{c} = _{c}" for c in key)
    beaten = one.join(b, group).where(f"_measure <= measure AND _rides <= rides AND _arrival <= arrival AND _arrival + _penalty + {slack} <= arrival + penalty AND NOT ({same})")
    return one.join(beaten.select(*group, *key).distinct(), [*group, *key], "left_anti")
