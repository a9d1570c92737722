"""Street networks: pieces of edges, places of points on them, directed searches with their paths, walks between places.

Arcs are directed (u, v, edge, cost[, metres]); a search relaxes, for all its sources at once, the vertices that the round before
improved, on written tables, up to a limit. Points are snapped in grid cells to pieces of at most MAX_PIECE metres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import foot_on_segment, segment_metres, walk_seconds
from ..sources.staging import small, stage

MAX_PIECE = 100.0


def pieces(lines: DataFrame) -> DataFrame:
    """(edge, lon1, lat1, lon2, lat2, start, end) of edges' polylines (edge, points: array of lon, lat): equal pieces of at most
    MAX_PIECE metres, start and end in metres from the edge's first point."""
    s = lines.where("size(points) > 1").select("edge", F.expr("posexplode(transform(sequence(1, size(points) - 1), i -> named_struct('a', points[i - 1], 'b', points[i]))) AS (seg, s)"))
    s = s.withColumn("m", segment_metres(F.col("s.a.lon"), F.col("s.a.lat"), F.col("s.b.lon"), F.col("s.b.lat"))).withColumn("n", F.greatest(F.ceil(F.col("m") / MAX_PIECE), F.lit(1)).cast("int"))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("m").over(W.partitionBy("edge").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("before", before).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, k: F.col(f"s.a.{c}") + (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")) * k / F.col("n")
    k = F.col("k")
    return s.select("edge", at("lon", k).alias("lon1"), at("lat", k).alias("lat1"), at("lon", k + 1).alias("lon2"), at("lat", k + 1).alias("lat2"), (F.col("before") + F.col("m") * k / F.col("n")).alias("start"), (F.col("before") + F.col("m") * (k + 1) / F.col("n")).alias("end"))


def snaps(points: DataFrame, parts: DataFrame, metres: float, cell: float = 0.01) -> DataFrame:
    """(point, edge, along, connector): the nearest place on an edge within reach, ties to the lower edge and the nearer to its
    start. points: point, lon, lat; parts: as of pieces(), of the edges that the traveller may use. Cells in degrees."""
    reach = max(1, int(metres // (cell * 50_000)) + 1)  # a degree of longitude has at least 50 km up to 63 degrees of latitude
    across = max(1, int((metres + MAX_PIECE) // (cell * 110_000)) + 1)  # and one of latitude 110 km
    at = lambda c: F.floor(c / cell)
    # Each place once, and dealt out: a small file of points has many cells and pieces to meet.
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = points.select("lon", "lat").distinct().repartition(spread)
    p = places.withColumn("_x", F.explode(F.sequence(at(F.col("lon")) - reach, at(F.col("lon")) + reach))).withColumn("_y", F.explode(F.sequence(at(F.col("lat")) - across, at(F.col("lat")) + across)))
    s = parts.withColumn("_x", at((F.col("lon1") + F.col("lon2")) / 2)).withColumn("_y", at((F.col("lat1") + F.col("lat2")) / 2))
    # By the size of its file alone, a table of points would be broadcast with all its cells.
    met = p.hint("merge").join(few, ["_x", "_y"]) if (few := small(s)) is s else p.join(few, ["_x", "_y"])
    off, t = foot_on_segment(*[F.col(c) for c in ("lon", "lat", "lon1", "lat1", "lon2", "lat2")])
    found = met.select("lon", "lat", F.struct(off.alias("connector"), "edge", (F.col("start") + t * (F.col("end") - F.col("start"))).alias("along")).alias("s")).where(F.col("s.connector") <= metres)
    found = found.groupBy("lon", "lat").agg(F.min("s").alias("s"))
    return points.select("point", "lon", "lat").hint("merge").join(found, ["lon", "lat"]).groupBy("point").agg(F.min("s").alias("s")).select("point", "s.edge", "s.along", "s.connector")


def shortest_paths(arcs: DataFrame, seeds: DataFrame, limit: float, reverse: bool = False) -> DataFrame:
    """(source, v, cost, pred, edge): least cost up to the limit from seeds (source, v, cost), of equal ones that of the least
    predecessor and edge (null at a seed). reverse: along arcs backwards, costs to the seeds."""
    a = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), "edge", F.col("cost").alias("step")) if reverse else arcs.select("u", "v", "edge", F.col("cost").alias("step"))
    a = small(a)
    own = seeds.groupBy("source", "v").agg(F.min("cost").alias("cost")).where(F.col("cost") <= limit)
    best = stage(own.select("source", "v", "cost", F.lit(None).cast("long").alias("pred"), F.lit(None).cast("long").alias("edge")), "paths")
    new = best
    while True:
        step = new.select("source", F.col("v").alias("u"), F.col("cost").alias("far")).join(a, "u").select("source", "v", (F.col("far") + F.col("step")).alias("cost"), F.col("u").alias("pred"), F.col("edge").cast("long").alias("edge")).where(F.col("cost") <= limit)
        label = F.struct("cost", "pred", "edge")
        both = best.select("source", "v", label.alias("l"), F.lit(False).alias("n")).unionByName(step.select("source", "v", label.alias("l"), F.lit(True).alias("n")))
        # At an equal cost a seed stays, else the least predecessor and edge.
        both = both.groupBy("source", "v").agg(F.min(F.expr("IF(n, null, l)")).alias("was"), F.min(F.expr("IF(n, l, null)")).alias("now"))
        better = "now IS NOT NULL AND (was IS NULL OR now.cost < was.cost OR (now.cost = was.cost AND was.pred IS NOT NULL AND (now.pred < was.pred OR (now.pred = was.pred AND now.edge < was.edge))))"
        after = stage(both.withColumn("moved", F.expr(better)), "paths")
        best = after.select("source", "v", F.expr("IF(moved, now, was)").alias("l")).select("source", "v", "l.*")
        new = after.where("moved AND (was IS NULL OR now.cost < was.cost)").select("source", "v", "now.cost")
        if not new.limit(1).count():
            return best


def path_edges(best: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, edges): edges in order of travel from the source to each target vertex (source, target)."""
    at = targets.select("source", "target", F.col("target").alias("v"), F.expr("cast(array() AS array<bigint>)").alias("edges"))
    done = None
    while True:
        here = stage(at.join(best.select("source", "v", "pred", "edge"), ["source", "v"]), "path-steps")
        ended = here.where("pred IS NULL").select("source", "target", "edges")
        done = ended if done is None else done.unionByName(ended)
        at = here.where("pred IS NOT NULL").select("source", "target", F.col("pred").alias("v"), F.concat(F.array("edge"), "edges").alias("edges"))
        if not at.limit(1).count():
            return done


def undirected(edges: DataFrame, per_metre: float = 1.0) -> DataFrame:
    """Arcs both ways of edges (edge, u, v, length)."""
    cost = (F.col("length") * per_metre).alias("cost")
    return edges.select("u", "v", "edge", cost).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "edge", cost))


def walks_between(places: DataFrame, targets: DataFrame, edges: DataFrame, limit_s: float, kmh: float = 3.6, connectors: bool = True) -> DataFrame:
    """(source, target, seconds, metres): walks of at most limit_s between snapped places (point, edge, along, connector) over
    edges (edge, u, v, length): by the network from either end of an edge, or along the edge that both lie on; seconds rounded up."""
    speed = kmh / 3.6
    e = edges.select("edge", "u", "v", "length")
    on = places.join(e, "edge").withColumn("c", F.col("connector") if connectors else F.lit(0.0))
    seeds = on.select(F.col("point").alias("source"), F.expr("inline(array(named_struct('v', u, 'cost', c + along), named_struct('v', v, 'cost', c + length - along)))"))
    best = shortest_paths(undirected(edges), seeds, limit_s * speed)
    there = targets.join(e, "edge").withColumn("c", F.col("connector") if connectors else F.lit(0.0))
    ends = there.select(F.col("point").alias("target"), F.expr("inline(array(named_struct('v', u, 'last', c + along), named_struct('v', v, 'last', c + length - along)))"))
    by_network = best.join(small(ends), "v").select("source", "target", (F.col("cost") + F.col("last")).alias("metres"))
    a, b = on.select(F.col("point").alias("source"), "edge", F.col("along").alias("x"), F.col("c").alias("cx")), there.select(F.col("point").alias("target"), "edge", F.col("along").alias("y"), F.col("c").alias("cy"))
    by_edge = a.join(b, "edge").select("source", "target", F.expr("cx + cy + abs(x - y) AS metres"))
    whole = by_network.unionByName(by_edge).groupBy("source", "target").agg(F.min("metres").alias("metres")).where(F.col("metres") / speed <= limit_s + 1e-9)
    return whole.select("source", "target", walk_seconds(F.col("metres") / speed).alias("seconds"), "metres")


def cheapest_edges(edges: DataFrame) -> DataFrame:
    """Of edges between the same two vertices, in either direction, the shortest; loops go."""
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("length", "edge")).alias("m")).select("u", "v", "m.edge", "m.length")


def path_costs(best: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, cost, network_m): least cost of each pair, and the metres of the edges on its path."""
    steps = path_edges(best, targets).select("source", "target", F.explode_outer("edges").alias("edge"))
    metres = steps.join(edges.select("edge", F.col("length")), "edge", "left").groupBy("source", "target").agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("network_m"))
    return metres.join(best.select("source", F.col("v").alias("target"), "cost"), ["source", "target"])
