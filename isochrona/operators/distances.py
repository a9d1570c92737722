"""Distances along trips: what the feed says, the stops' places on the trip's shape, or straight lines and a detour.

Trips of equal stops, shape, mode and stated distances are one unit of work; their cumulative metres are joined back to the trips.
Shapes are measured on a plane around each unit's first stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import base_route_type, haversine, metres_per_degree

NEAR_M = 100.0


def detour(route_type: Column) -> Column:
    """1.2 for rail, metro and ferry, 1.25 for tram, 1.4 for all else."""
    base = base_route_type(route_type)
    ferry = (route_type == 4) | route_type.between(1000, 1099)
    return F.when(base.isin(1, 2) & ~route_type.between(200, 299) | ferry, 1.2).when(base == 0, 1.25).otherwise(1.4)


def crow_fly(stops: Column) -> Column:
    """Cumulative great-circle metres of an array of (lat, lon)."""
    def step(acc, i):
        hop = haversine(F.get(stops, i - 1)["lat"], F.get(stops, i - 1)["lon"], F.get(stops, i)["lat"], F.get(stops, i)["lon"])
        return F.concat(acc, F.array(F.element_at(acc, -1) + hop))

    return F.aggregate(F.when(F.size(stops) > 1, F.sequence(F.lit(1), F.size(stops) - 1)).otherwise(F.expr("cast(array() AS array<int>)")), F.array(F.lit(0.0)), step)


def stated(raw: Column, crow: Column) -> Column:
    """Metres of stated distances, or null: none may lack or fall; a total of 0.8 to 5 crow flights is metres, a thousandth of that
    kilometres, anything else no distance."""
    total, flown = F.element_at(raw, -1) - F.element_at(raw, 1), F.element_at(crow, -1)
    whole = ~F.exists(raw, lambda x: x.isNull() | F.isnan(x)) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(raw) - 1, F.lit(1))), lambda i: F.coalesce(F.get(raw, i) >= F.get(raw, i - 1), F.lit(True)))
    ratio = total / flown
    scale = F.when(ratio.between(0.8, 5), 1.0).when(ratio.between(0.8e-3, 5e-3), 1000.0)
    ok = F.when(whole & (total > 0) & (flown > 0), scale)
    return F.when(ok.isNotNull(), F.transform(raw, lambda x: (x - F.element_at(raw, 1)) * ok))


def on_shape(units: DataFrame, points: DataFrame) -> DataFrame:
    """(unit, along): absolute metres of each stop along the unit's shape, for units whose stops all lie within NEAR_M of it in
    order, the last beyond the first. units: unit, shape, stops (array of lat, lon); points: shape, seq, lat, lon."""
    line = points.where("shape IS NOT NULL AND seq IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("shape").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p")).where("size(p) > 1")
    u = units.join(line, "shape").withColumn("o", F.get("stops", 0))
    kx, ky = metres_per_degree(F.col("o.lat"))
    flat = lambda a: F.transform(a, lambda q: F.struct(((q["lon"] - F.col("o.lon")) * kx).alias("x"), ((q["lat"] - F.col("o.lat")) * ky).alias("y")))
    u = u.select("unit", flat(F.col("p")).alias("p"), flat(F.col("stops")).alias("s"))
    hops = F.expr("transform(sequence(1, size(p) - 1), i -> sqrt(pow(p[i].x - p[i - 1].x, 2) + pow(p[i].y - p[i - 1].y, 2)))")
    u = u.withColumn("m", F.aggregate(hops, F.array(F.lit(0.0)), lambda acc, h: F.concat(acc, F.array(F.element_at(acc, -1) + h))))
    # A row for each stop and piece: the nearest place, ties to the least distance along.
    pairs = u.select("unit", F.posexplode("s").alias("i", "q"), "p", "m").select("unit", "i", "q", F.expr("inline(transform(sequence(1, size(p) - 1), k -> named_struct('a', p[k - 1], 'b', p[k], 'm0', m[k - 1])))"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((F.col("q.x") - F.col("a.x")) * dx + (F.col("q.y") - F.col("a.y")) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    off = F.sqrt(F.pow(F.col("q.x") - F.col("a.x") - t * dx, 2) + F.pow(F.col("q.y") - F.col("a.y") - t * dy, 2))
    best = pairs.groupBy("unit", "i").agg(F.min(F.struct(off.alias("off"), (F.col("m0") + t * F.sqrt(square)).alias("along"))).alias("n"))
    placed = best.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("n"))
    placed = placed.selectExpr("unit", "transform(n, x -> x.n.along) AS along", "exists(n, x -> x.n.off IS NULL OR x.n.off > " + str(NEAR_M) + ") AS far")
    return placed.where("NOT far AND element_at(along, -1) > along[0] AND forall(sequence(1, greatest(size(along) - 1, 1)), i -> coalesce(get(along, i) >= get(along, i - 1), true))").select("unit", "along")


def ladder(trips: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """(trip, cum, provenance): cumulative metres of each trip's calls by the first rung that holds: shape_dist, shape_linref (the
    shape must have more points than the trip has stops), crow_fly. trips: trip, shape, route_type, stops (array of lat, lon), raw
    (array of stated distances). A stop without coordinates is an error of the feed: such trips have null distances."""
    key = F.sha2(F.to_json(F.struct("shape", "route_type", "stops", "raw"), {"ignoreNullFields": "false"}), 256)
    t = trips.withColumn("unit", key)
    units = t.groupBy("unit").agg(*[F.first(c, ignorenulls=False).alias(c) for c in ("shape", "route_type", "stops", "raw")])
    sound = ~F.exists("stops", lambda s: s["lat"].isNull() | s["lon"].isNull())
    units = units.withColumn("crow", F.when(sound, crow_fly(F.col("stops"))))
    units = units.withColumn("said", stated(F.col("raw"), F.col("crow")))
    if shapes is not None:
        rest = units.where(F.col("said").isNull() & F.col("crow").isNotNull() & F.col("shape").isNotNull())
        dense = shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n_points"))
        rest = rest.join(dense, "shape").where("n_points > size(stops)").select("unit", "shape", "stops")
        units = units.join(on_shape(rest, shapes).selectExpr("unit", "transform(along, x -> x - along[0]) AS ref"), "unit", "left")
    else:
        units = units.withColumn("ref", F.lit(None).cast("array<double>"))
    cum = F.coalesce("said", "ref", F.transform("crow", lambda x: x * detour(F.col("route_type"))))
    name = F.when(F.col("said").isNotNull(), "shape_dist").when(F.col("ref").isNotNull(), "shape_linref").when(F.col("crow").isNotNull(), "crow_fly")
    return t.select("trip", "unit").join(units.select("unit", cum.alias("cum"), name.alias("provenance")), "unit").drop("unit")


def provenance_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("provenance").agg(F.count(F.lit(1)).alias("n_trips"))


def faulty(found: DataFrame) -> DataFrame:
    """Trips of given distances (trip, cum) that are named twice, hold a distance that is not finite, or fall."""
    bad = F.col("cum").isNull() | F.exists("cum", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.forall(F.sequence(F.lit(1), F.greatest(F.size("cum") - 1, F.lit(1))), lambda i: F.coalesce(F.get("cum", i) >= F.get("cum", i - 1), F.lit(True)))
    return found.groupBy("trip").agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad")).where("n > 1 OR bad").select("trip")


def sliced(points: Column, measures: Column, start: Column, end: Column) -> Column:
    """Points (x, y) of a polyline with measures between two of them: the ends interpolated, consecutive equal points once."""
    def at(m):
        k = F.greatest(F.least(F.size(F.filter(measures, lambda x: x <= m)), F.size(measures) - 1), F.lit(1))
        a, b, m0, m1 = F.element_at(points, k), F.element_at(points, k + 1), F.element_at(measures, k), F.element_at(measures, k + 1)
        t = F.when(m1 > m0, (m - m0) / (m1 - m0)).otherwise(0.0)
        return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

    inner = F.filter(points, lambda p, i: (F.get(measures, i) > start) & (F.get(measures, i) < end))
    return once(F.concat(F.array(at(start)), F.transform(inner, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array(at(end))))


def once(points: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))
