"""Street operators: permissions, arc times, snapping, bounded shortest paths, transfer sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine
from ..sources.staging import stage

#: Who may use a highway type by default (foot, bicycle, car).
ALL = "track primary primary_link secondary secondary_link tertiary tertiary_link service living_street road unclassified residential".split()
FOOT = "footway pedestrian steps corridor platform bridleway".split()
CAR = "trunk trunk_link motorway motorway_link".split()


def permissions(highway: Column) -> dict[str, Column]:
    """Default access of a highway type by mode; unknown types admit none."""
    return {
        "foot": highway.isin(*ALL, *FOOT, "path", "elevator"),
        "bicycle": highway.isin(*ALL, "path", "cycleway", "elevator"),
        "car": highway.isin(*ALL, *CAR),
    }


def arc_ms(metres: Column, kmh: Column) -> Column:
    """Whole milliseconds of an arc, rounded up, at least one for a positive length; null where the mode may not go: without a
    speed or a length."""
    ms = F.when(metres > 0, F.greatest(F.ceil(metres / (kmh / 3.6) * 1000), F.lit(1))).otherwise(F.lit(0))
    return F.when(metres.isNotNull() & (kmh > 0), ms)


def shortest(arcs: DataFrame, seeds: DataFrame, limit_ms: int) -> DataFrame:
    """(source, v, ms) of least ms up to limit_ms over arcs (u, v, ms) from seeds (source, v, ms), for all sources at once:
    vertices improved in a round are relaxed in the next, on written tables, until none is."""
    best = stage(seeds.groupBy("source", "v").agg(F.min("ms").alias("ms")).where(F.col("ms") <= limit_ms), "paths")
    new = best
    while True:
        step = new.withColumnRenamed("v", "u").withColumnRenamed("ms", "so_far").join(arcs, "u").select("source", "v", (F.col("so_far") + F.col("ms")).alias("ms")).where(F.col("ms") <= limit_ms)
        step = step.groupBy("source", "v").agg(F.min("ms").alias("ms")).join(best.withColumnRenamed("ms", "was"), ["source", "v"], "left")
        new = stage(step.where("was IS NULL OR ms < was").drop("was"), "paths-new")
        if not new.limit(1).count():
            return best
        best = stage(best.unionByName(new).groupBy("source", "v").agg(F.min("ms").alias("ms")), "paths")


def within(points: DataFrame, stops: DataFrame, metres: float, cell: float = 0.01) -> DataFrame:
    """(point, stop, metres) of all stops within reach; both sides meet in grid cells only.
    cell, in degrees, must be at least `metres` wide in both directions."""
    at = lambda c: F.floor(F.col(c) / cell)
    p = points.withColumn("_y", at("plat")).withColumn("_x", at("plon"))
    reach = max(1, -(-int(metres) // 500))
    s = stops.withColumn("_y", F.explode(F.sequence(at("lat") - reach, at("lat") + reach))).withColumn("_x", F.explode(F.sequence(at("lon") - reach, at("lon") + reach)))
    return p.join(s, ["_y", "_x"]).withColumn("metres", haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))).where(F.col("metres") <= metres).select("point", "stop", "metres")


def snap(points: DataFrame, stops: DataFrame, metres: float, cell: float = 0.01) -> DataFrame:
    """(point, stop, metres): the nearest stop within reach, ties to the lower."""
    near = within(points, stops, metres, cell)
    return near.groupBy("point").agg(F.min(F.struct("metres", "stop")).alias("m")).selectExpr("point", "m.stop AS stop", "m.metres AS metres")


def fastest_transfers(transfers: DataFrame) -> DataFrame:
    """One transfer for each pair of stops: the fastest, then the shortest."""
    return transfers.groupBy("from_stop", "to_stop").agg(F.min(F.struct("seconds", "metres")).alias("m")).select("from_stop", "to_stop", "m.*")


def closed_transfers(transfers: DataFrame) -> DataFrame:
    """The transitive closure of a transfer set by least seconds; each round doubles the hops, until nothing is faster."""
    best = stage(transfers.groupBy("from_stop", "to_stop").agg(F.min("seconds").alias("seconds")), "closure")
    while True:
        two = best.select("from_stop", F.col("to_stop").alias("via"), F.col("seconds").alias("a")).join(best.select(F.col("from_stop").alias("via"), "to_stop", F.col("seconds").alias("b")), "via")
        more = two.where("from_stop <> to_stop").select("from_stop", "to_stop", (F.col("a") + F.col("b")).alias("seconds"))
        after = stage(best.unionByName(more).groupBy("from_stop", "to_stop").agg(F.min("seconds").alias("seconds")), "closure")
        if not after.join(best.withColumnRenamed("seconds", "was"), ["from_stop", "to_stop"], "left").where("was IS NULL OR seconds < was").limit(1).count():
            return after
        best = after


def merged_modes(walks: DataFrame, rides: DataFrame, budget: int) -> DataFrame:
    """Shared-vehicle transfers: an optional walk, one ride, an optional walk within the budget; the fastest of it and walking."""
    still = rides.select("from_stop").union(rides.select("to_stop")).distinct().selectExpr("from_stop", "from_stop AS to_stop", "0L AS seconds")
    legs = walks.select("from_stop", "to_stop", "seconds").unionByName(still)
    a, r, b = legs.alias("a"), rides.alias("r"), legs.alias("b")
    whole = a.join(r, F.expr("a.to_stop = r.from_stop")).join(b, F.expr("r.to_stop = b.from_stop")).selectExpr("a.from_stop", "b.to_stop", "a.seconds + r.seconds + b.seconds AS seconds", "1 AS rentals")
    both = whole.where(f"seconds <= {budget} AND from_stop <> to_stop").unionByName(walks.selectExpr("from_stop", "to_stop", "seconds", "0 AS rentals"))
    return both.groupBy("from_stop", "to_stop").agg(F.min(F.struct("seconds", "rentals")).alias("m")).select("from_stop", "to_stop", "m.*")
