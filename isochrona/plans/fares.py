"""Fare queries: structures over the fixture's routes, zone tickets, and the fare frontier."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import fares
from .journeys import SHORT, _from_all, _net, morning_sql
from ..sources import fixtures as fx
from .registry import _query, _with


def _routes(spark, sf_dir):
    return fx.trips(spark, sf_dir).select("route").distinct().selectExpr("cast(route AS string) AS route_id", "concat('L', route) AS route_short_name", "cast(route % 4 AS int) AS route_type")


@_query("fare_setup", _with("SELECT t.type, count(*) AS n_routes, min(p.n) AS n_pairs, sum(2.5) AS fares FROM (SELECT DISTINCT route, CASE route % 4 WHEN 0 THEN 'TRAM' WHEN 1 THEN 'SUBWAY' WHEN 2 THEN 'RAIL' ELSE 'BUS' END AS type FROM trips) t, (SELECT 4 AS n) p GROUP BY 1").replace("min(p.n) AS n_pairs", "min(p.n)::BIGINT AS n_pairs").replace("sum(2.5)", "sum(2.5::DOUBLE)"))
def fare_setup(spark, sf_dir):
    s = fares.setup(_routes(spark, sf_dir), 2.5)
    pairs = s.pairs.groupBy(F.col("first_leg").alias("type")).agg(F.count(F.lit(1)).alias("n_pairs"))
    return fares.route_fares(s).groupBy("type").agg(F.count(F.lit(1)).alias("n_routes"), F.sum("fare").alias("fares")).join(pairs, "type").select("type", "n_routes", "n_pairs", "fares")


PRODUCTS = [
    {"price": 3.0, "zones": ["A", "B"], "duration": 3600, "transfers": 2}, {"price": 5.0, "zones": None, "duration": 5400, "agency_routes": ["r0", "r1", "r2"]},
    {"price": 2.0, "routes": ["r1"], "transfers": 0}, {"price": 1.5, "clauses": [("C", "A", None)], "duration": 1800},
]


def _two_rides(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    zone = lambda x: f"get(array('A', 'B', 'C', null), cast({x} AS int))"
    return o.selectExpr("o_orderkey AS journey", f"""filter(array(
      named_struct('route', concat('r', o_orderkey % 4), 'dep', 0L, 'board_zone', {zone('o_orderkey % 3')}, 'alight_zone', {zone('o_orderkey div 3 % 4')}),
      IF(o_orderkey % 7 = 0, null, named_struct('route', concat('r', o_orderkey div 4 % 4), 'dep', o_orderkey % 6000, 'board_zone', {zone('o_orderkey div 3 % 4')}, 'alight_zone', {zone('o_orderkey div 5 % 3')}))), r -> r IS NOT NULL) AS rides""")


@_query("zone_fares", """WITH j AS (SELECT o_orderkey AS journey, 'r' || (o_orderkey % 4) AS r1, 'r' || (o_orderkey // 4 % 4) AS r2, o_orderkey % 6000 AS dep, ['A', 'B', 'C', NULL][o_orderkey % 3 + 1] AS z0, ['A', 'B', 'C', NULL][o_orderkey // 3 % 4 + 1] AS z1, ['A', 'B', 'C', NULL][o_orderkey // 5 % 3 + 1] AS z2, o_orderkey % 7 <> 0 AS two FROM orders),
one AS (SELECT *, least(if(z0 IN ('A', 'B') AND z1 IN ('A', 'B'), 3, NULL), if(r1 IN ('r0', 'r1', 'r2'), 5, NULL), if(r1 = 'r1', 2, NULL), if(z0 = 'C' AND z1 = 'A', 1.5, NULL)) AS a,
  least(if(z1 IN ('A', 'B') AND z2 IN ('A', 'B'), 3, NULL), if(r2 IN ('r0', 'r1', 'r2'), 5, NULL), if(r2 = 'r1', 2, NULL), if(z1 = 'C' AND z2 = 'A', 1.5, NULL)) AS b,
  least(if(z0 IN ('A', 'B') AND z1 IN ('A', 'B') AND z2 IN ('A', 'B') AND dep <= 3600, 3, NULL), if(r1 IN ('r0', 'r1', 'r2') AND r2 IN ('r0', 'r1', 'r2') AND dep <= 5400, 5, NULL), if(z0 = 'C' AND z2 = 'A' AND dep <= 1800, 1.5, NULL)) AS joint FROM j)
SELECT journey, (CASE WHEN two THEN least(a + b, joint) ELSE a END)::DOUBLE AS fare FROM one""")
def zone_fares(spark, sf_dir):
    j = _two_rides(spark, sf_dir)
    return j.select("journey", fares.cheapest_tickets(F.col("rides"), PRODUCTS).alias("fare"))


#: Bus and tram fares with a discounted bus pair; the rest is not priced.
def _structure(spark, sf_dir):
    s = fares.setup(_routes(spark, sf_dir).where("route_type IN (0, 1, 3)"), 3.0)
    types = s.types.withColumn("fare", F.expr("CASE type WHEN 'BUS' THEN 4.0D WHEN 'TRAM' THEN 6.0D ELSE 3.0D END")).withColumn("unlimited_transfers", F.col("type") == "SUBWAY")
    pairs = s.pairs.where("first_leg = 'BUS' AND second_leg = 'BUS'").withColumn("fare", F.lit(5.0))
    return fares.Structure(types, pairs, s.routes, discounts=1, allowance=10.0, cap=9.0)


_KIND = "CASE route % 4 WHEN 0 THEN 6.0 WHEN 1 THEN 3.0 WHEN 3 THEN 4.0 END::DOUBLE"


@_query("fare_frontier", _with(f"""SELECT o AS from_id, stop AS to_id, cutoff::DOUBLE AS cutoff, m[1] AS travel_time_s, m[2] AS fare, m[3] AS rides FROM (SELECT o, stop, cutoff, min((a - 28800, least(t, 9.0::DOUBLE), rides)) AS m FROM f, (VALUES (0.0), (4.0), (6.0), (9.0)) c(cutoff) WHERE least(t, 9) <= cutoff + 1e-9 GROUP BY ALL)""", morning_sql(SHORT),
    f"q AS (SELECT *, {_KIND} AS fare, route % 4 AS kind FROM mc WHERE route % 4 IN (0, 1, 3))",
    "f0 AS (SELECT stop AS o, stop, 28800::BIGINT AS a, 0.0::DOUBLE AS t, 0 AS rides FROM stops)",
    "f1 AS (SELECT x.stop AS o, y.stop, y.arr AS a, x.fare AS t, 1 AS rides, x.kind, x.route, x.dep AS clock, x.line FROM (SELECT *, row_number() OVER (PARTITION BY stop, pos, line ORDER BY dep, trip) AS first FROM (SELECT q.*, dense_rank() OVER (ORDER BY q.route, hop) AS line FROM q JOIN trips USING (trip)) WHERE dep >= 28800) x JOIN q y ON y.trip = x.trip AND y.pos > x.pos WHERE first = 1)",
    """f2 AS (SELECT o, y.stop, y.arr AS a, CASE WHEN x.kind = 1 AND b.kind = 1 THEN t WHEN x.kind = 3 AND b.kind = 3 AND x.route <> b.route AND x.dep - clock <= 600 THEN 5.0 ELSE t + x.fare END::DOUBLE AS t, 2 AS rides FROM f1 b JOIN q x ON x.stop = b.stop AND x.dep >= b.a JOIN q y ON y.trip = x.trip AND y.pos > x.pos)""",
    "f AS (FROM f0 UNION ALL SELECT o, stop, a, t, rides FROM f1 UNION ALL FROM f2)"))
def fare_frontier(spark, sf_dir):
    found = fares.fare_frontier(_net(spark, sf_dir, SHORT), _from_all(spark, sf_dir), _structure(spark, sf_dir), [0.0, 4.0, 6.0, 9.0], 2)
    return found.selectExpr("origin AS from_id", "stop AS to_id", "cutoff", "travel_time_s", "fare", "rides")


