"""Street path, place and policy queries; the street grid has a vertex for each part, so it grows with the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import paths, policies
from ..sources import fixtures as fx
from .journeys import SHORT, _from_all, _net, morning_sql
from .registry import WALKS_SQL, _query, _walks, _with

LIMIT = 6000
GRID_SQL = """w AS (SELECT ceil(sqrt(count(*)))::BIGINT AS w, count(*) AS n FROM part), vert AS (SELECT i AS id FROM w, (SELECT unnest(range((SELECT count(*) FROM part))) AS i)),
arcs AS (SELECT id AS u, id + 1 AS v, 2 * id AS edge, 1000 + (id * 31) % 7 * 100 AS cost FROM vert, w WHERE id % w < w - 1 AND id + 1 < n UNION ALL SELECT id, id + w, 2 * id + 1, 1000 + (id * 57) % 9 * 100 FROM vert, w WHERE id + w < n)"""
_SOURCES = "src AS (SELECT DISTINCT s_suppkey * 7 % n AS source FROM supplier, w)"
_BEST = f"""d AS (SELECT source, source AS v, 0::BIGINT AS cost FROM src UNION SELECT source, arcs.v, d.cost + arcs.cost FROM d JOIN arcs ON arcs.u = d.v WHERE d.cost + arcs.cost <= {LIMIT}),
best AS (SELECT source, v, min(cost) AS cost FROM d GROUP BY ALL),
pred AS (SELECT b.source, b.v, b.cost, min((a.u, a.edge)) AS p FROM best b LEFT JOIN (SELECT x.source, arcs.u, arcs.v, arcs.edge, x.cost + arcs.cost AS cost FROM best x JOIN arcs ON arcs.u = x.v) a ON a.source = b.source AND a.v = b.v AND a.cost = b.cost AND b.v <> b.source GROUP BY ALL)"""


def _grid(spark, sf_dir):
    n = fx.table(spark, sf_dir, "part").count()
    w = math.ceil(math.sqrt(n))
    v = spark.range(n)
    right = v.where(f"id % {w} < {w - 1} AND id + 1 < {n}").selectExpr("id AS u", "id + 1 AS v", "2 * id AS edge", "1000 + (id * 31) % 7 * 100 AS cost")
    return n, right.unionByName(v.where(f"id + {w} < {n}").selectExpr("id AS u", f"id + {w} AS v", "2 * id + 1 AS edge", "1000 + (id * 57) % 9 * 100 AS cost"))


def _best(spark, sf_dir, reverse=False):
    n, arcs = _grid(spark, sf_dir)
    seeds = fx.table(spark, sf_dir, "supplier").selectExpr(f"s_suppkey * 7 % {n} AS source").distinct().selectExpr("source", "source AS v", "0L AS cost")
    return paths.shortest_paths(arcs, seeds, LIMIT, reverse)


def _recursive(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


@_query("street_paths", _recursive("SELECT source, v, cost, CASE WHEN v <> source THEN p[1] END AS pred, CASE WHEN v <> source THEN p[2] END AS edge FROM pred", GRID_SQL, _SOURCES, _BEST))
def street_paths(spark, sf_dir):
    return _best(spark, sf_dir).select("source", "v", "cost", "pred", "edge")


@_query("street_paths_reverse", _recursive("SELECT source, v, min(cost) AS cost FROM d GROUP BY ALL", GRID_SQL, _SOURCES, f"d AS (SELECT source, source AS v, 0::BIGINT AS cost FROM src UNION SELECT source, arcs.u, d.cost + arcs.cost FROM d JOIN arcs ON arcs.v = d.v WHERE d.cost + arcs.cost <= {LIMIT})"))
def street_paths_reverse(spark, sf_dir):
    return _best(spark, sf_dir, True).select("source", "v", "cost")


@_query("street_path_edges", _recursive("SELECT source, target, count(edge) AS n_edges, coalesce(string_agg(edge::VARCHAR, '-' ORDER BY k DESC), '') AS edges FROM back GROUP BY ALL", GRID_SQL, _SOURCES, _BEST,
    "back AS (SELECT source, v AS target, v AS at, NULL::BIGINT AS edge, 0 AS k FROM pred UNION ALL SELECT b.source, target, p[1], p[2], k + 1 FROM back b JOIN pred ON pred.source = b.source AND pred.v = b.at WHERE b.at <> b.source)"))
def street_path_edges(spark, sf_dir):
    best = _best(spark, sf_dir)
    found = paths.path_edges(best, best.select("source", F.col("v").alias("target")))
    return found.select("source", "target", F.size("edges").cast("long").alias("n_edges"), F.array_join("edges", "-").alias("edges"))


_PLACES = "pl AS (SELECT c_custkey AS point, u, v, cost / 20.0 AS length, edge, (c_custkey % 5) * cost / 100.0 AS along, (c_custkey % 7)::DOUBLE AS c FROM customer, w JOIN arcs ON arcs.edge = 2 * (c_custkey % (w - 1))), tg AS (SELECT s_suppkey AS point, u, v, cost / 20.0 AS length, edge, (s_suppkey % 4) * cost / 100.0 AS along, 2.5 AS c FROM supplier, w JOIN arcs ON arcs.edge = 2 * (s_suppkey % (w - 1)))"


def _place(df, key, edges, w, share, connector):
    return df.selectExpr(f"{key} AS point", f"2 * ({key} % {w - 1}) AS edge").join(edges.select("edge", "cost"), "edge").selectExpr("point", "edge", f"(point % {share}) * cost / 100.0D AS along", f"{connector} AS connector")


@_query("street_walks", _recursive("SELECT source, target, greatest(ceil(min(m) / 1.0 - 1e-6), 0)::BIGINT AS seconds, round(min(m), 6) AS metres FROM (SELECT point AS source, target, r.m + last AS m FROM r JOIN ends USING (node) UNION ALL SELECT p.point, t.point, p.c + t.c + abs(p.along - t.along) FROM pl p JOIN tg t USING (edge)) WHERE m <= 120 + 1e-9 GROUP BY ALL", GRID_SQL, _PLACES,
    "two AS (SELECT u AS a, v AS b, cost / 20.0 AS m FROM arcs UNION ALL SELECT v, u, cost / 20.0 FROM arcs)",
    "r AS (SELECT point, u AS node, (c + along)::DOUBLE AS m FROM pl UNION SELECT point, v, (c + length - along)::DOUBLE FROM pl UNION SELECT r.point, b, (r.m + two.m)::DOUBLE FROM r JOIN two ON a = node WHERE r.m + two.m <= 120)",
    "ends AS (SELECT point AS target, u AS node, (c + along)::DOUBLE AS last FROM tg UNION ALL SELECT point, v, c + length - along FROM tg)"))
def street_walks(spark, sf_dir):
    n, arcs = _grid(spark, sf_dir)
    w = math.ceil(math.sqrt(n))
    places = _place(fx.table(spark, sf_dir, "customer"), "c_custkey", arcs, w, 5, "cast(point % 7 AS double)")
    targets = _place(fx.table(spark, sf_dir, "supplier"), "s_suppkey", arcs, w, 4, "2.5D")
    out = paths.walks_between(places, targets, arcs.selectExpr("edge", "u", "v", "cost / 20.0D AS length"), 120)
    return out.select("source", "target", "seconds", F.round("metres", 6).alias("metres"))


_FOOT = """f AS (SELECT p.id AS point, s.stop AS edge, 111412.84 * cos(radians(p.lat)) - 93.5 * cos(3 * radians(p.lat)) + 0.118 * cos(5 * radians(p.lat)) AS kx, 111132.954 - 559.822 * cos(2 * radians(p.lat)) + 1.175 * cos(4 * radians(p.lat)) AS ky, p.lat, p.lon, s.lat AS lat1, s.lon AS lon1, t.lat AS lat2, t.lon AS lon2
  FROM (SELECT c_custkey AS id, 60 + (c_custkey * 17 % 1000) / 10000.0::DOUBLE AS lat, 24 + (c_custkey * 29 % 1000) / 5000.0::DOUBLE AS lon FROM customer) p, stops s JOIN stops t ON t.stop = s.stop + 1 WHERE s.stop % 2 = 0),
g AS (SELECT point, edge, (lon1 - lon) * kx AS x1, (lat1 - lat) * ky AS y1, (lon2 - lon) * kx AS x2, (lat2 - lat) * ky AS y2 FROM f),
h AS (SELECT *, least(greatest(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) AS t FROM g),
o AS (SELECT point, edge, sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)) AS m FROM h)"""


@_query("snapped_edges", _with("SELECT point, arg_min(edge, (m, edge)) AS edge, round(min(m), 3) AS metres FROM o WHERE m <= 800 GROUP BY 1", _FOOT))
def snapped_edges(spark, sf_dir):
    s = fx.stops(spark, sf_dir)
    nxt = s.selectExpr("stop - 1 AS stop", "lat AS lat2", "lon AS lon2")
    lines = s.join(nxt, "stop").where("stop % 2 = 0").selectExpr("stop AS edge", "array(named_struct('lon', lon, 'lat', lat), named_struct('lon', lon2, 'lat', lat2)) AS points")
    points = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS point", "60 + (c_custkey * 17 % 1000) / 10000.0D AS lat", "24 + (c_custkey * 29 % 1000) / 5000.0D AS lon")
    return paths.snaps(points, paths.pieces(lines), 800).select("point", "edge", F.round("connector", 3).alias("metres"))


@_query("piece_counts", _with("SELECT s.stop AS edge, greatest(ceil(m / 100), 1)::BIGINT AS n, round(m, 3) AS metres FROM (SELECT s.stop, sqrt(pow((t.lon - s.lon) * (111412.84 * cos(radians((s.lat + t.lat) / 2)) - 93.5 * cos(3 * radians((s.lat + t.lat) / 2)) + 0.118 * cos(5 * radians((s.lat + t.lat) / 2))), 2) + pow((t.lat - s.lat) * (111132.954 - 559.822 * cos(2 * radians((s.lat + t.lat) / 2)) + 1.175 * cos(4 * radians((s.lat + t.lat) / 2))), 2)) AS m FROM stops s JOIN stops t ON t.stop = s.stop + 1) s"))
def piece_counts(spark, sf_dir):
    s = fx.stops(spark, sf_dir)
    lines = s.join(s.selectExpr("stop - 1 AS stop", "lat AS lat2", "lon AS lon2"), "stop").selectExpr("stop AS edge", "array(named_struct('lon', lon, 'lat', lat), named_struct('lon', lon2, 'lat', lat2)) AS points")
    return paths.pieces(lines).groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("end"), 3).alias("metres"))


_OPTIONS = "opt AS (SELECT o_custkey % 20 AS source, o_orderkey % 12 AS stop, ['walk', 'bicycle', 'e_scooter'][o_orderkey % 3 + 1] AS mode, round(o_totalprice / 1000)::BIGINT AS seconds, if(o_orderkey % 3 = 2, 1, 0) AS rentals, (o_orderkey % 17)::DOUBLE AS grams FROM orders WHERE o_orderkey % 12 < 10)"


def _options(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").where("o_orderkey % 12 < 10").selectExpr("o_custkey % 20 AS source", "o_orderkey % 12 AS stop", "element_at(array('walk', 'bicycle', 'e_scooter'), cast(o_orderkey % 3 + 1 AS int)) AS mode", "cast(round(o_totalprice / 1000) AS bigint) AS seconds", "IF(o_orderkey % 3 = 2, 1, 0) AS rentals", "cast(o_orderkey % 17 AS double) AS grams")


_CHOICE_WALKS = "hops AS (SELECT i AS from_stop, (i + 1) % 12 AS to_stop, 20 + i AS seconds FROM (SELECT unnest(range(12)) AS i))"


@_query("street_choice", f"WITH {_OPTIONS}, {_CHOICE_WALKS}, o AS (SELECT *, CASE mode WHEN 'bicycle' THEN 1 WHEN 'walk' THEN 2 ELSE 3 END AS rank FROM opt WHERE stop <> 4), one AS (SELECT source, stop, seconds, rentals, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, stop ORDER BY seconds, rentals, rank) AS r FROM o) WHERE r = 1), two AS (SELECT * FROM one UNION ALL SELECT source, to_stop, one.seconds + hops.seconds, rentals, rank FROM one JOIN hops ON from_stop = stop WHERE to_stop <> 4) SELECT source, stop, seconds, rentals, CASE rank WHEN 1 THEN 'bicycle' WHEN 2 THEN 'walk' ELSE 'e_scooter' END AS mode FROM (SELECT *, row_number() OVER (PARTITION BY source, stop ORDER BY seconds, rentals, rank) AS r FROM two) WHERE r = 1")
def street_choice(spark, sf_dir):
    hops = spark.range(12).selectExpr("id AS from_stop", "(id + 1) % 12 AS to_stop", "20 + id AS seconds")
    return policies.street_choice(_options(spark, sf_dir), ["bicycle", "walk", "e_scooter"], hops, closed=spark.createDataFrame([(4,)], "stop long"))


@_query("street_frontier", f"WITH {_OPTIONS} SELECT DISTINCT source, stop, seconds, grams FROM opt x WHERE NOT EXISTS (SELECT 1 FROM opt y WHERE y.source = x.source AND y.stop = x.stop AND y.seconds <= x.seconds AND y.grams <= x.grams AND (y.seconds < x.seconds OR y.grams < x.grams))")
def street_frontier(spark, sf_dir):
    return policies.street_frontier(_options(spark, sf_dir).select("source", "stop", "seconds", "grams"))


@_query("slower_band", "WITH j AS (SELECT o_orderkey AS id, o_custkey % 50 AS cell, round(o_totalprice)::BIGINT AS arrival, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.0 END AS grams FROM orders) SELECT id, cell, arrival FROM j JOIN (SELECT cell, min(arrival) AS first FROM j WHERE grams IS NOT NULL GROUP BY 1) USING (cell) WHERE grams IS NOT NULL AND arrival <= first + 20000")
def slower_band(spark, sf_dir):
    j = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 50 AS cell", "cast(round(o_totalprice) AS bigint) AS arrival", "IF(o_orderkey % 3 = 0, null, 1.0D) AS grams")
    return policies.within_band(j, ["cell"], 20000).select("id", "cell", "arrival")


def _carriage_round(k: int) -> list[str]:
    p = k - 1
    ride = "SELECT {x}.o, y.stop, min(y.arr) AS a FROM {x} JOIN mc x ON x.stop = {x}.stop AND x.dep >= {x}.a {where} JOIN mc y ON y.trip = x.trip AND y.pos > x.pos GROUP BY ALL"
    least = "SELECT o, stop, min(a) AS a FROM ({}) GROUP BY ALL"
    return [
        f"cr{k} AS ({ride.format(x=f'nc{p}', where='AND x.route % 2 = 0')})", f"fr{k} AS ({ride.format(x=f'nf{p}', where='')})",
        f"cy{k} AS ({least.format(f'FROM cr{k} UNION ALL SELECT o, to_stop, a + seconds FROM cr{k} JOIN bikes ON from_stop = stop')})",
        f"pk{k} AS (SELECT o, stop, a + 60 AS a FROM cy{k} WHERE stop % 3 = 0)",
        f"ff{k} AS ({least.format(f'FROM fr{k} UNION ALL FROM pk{k} UNION ALL SELECT o, to_stop, a + seconds FROM (FROM fr{k} UNION ALL FROM pk{k}) JOIN walks ON from_stop = stop')})",
        f"nc{k} AS (SELECT c.* FROM cy{k} c LEFT JOIN bc{p} b USING (o, stop) WHERE b.a IS NULL OR c.a < b.a)", f"nf{k} AS (SELECT c.* FROM ff{k} c LEFT JOIN bf{p} b USING (o, stop) WHERE b.a IS NULL OR c.a < b.a)",
        f"bc{k} AS ({least.format(f'FROM bc{p} UNION ALL FROM nc{k}')})", f"bf{k} AS ({least.format(f'FROM bf{p} UNION ALL FROM nf{k}')})",
    ]


@_query("carriage_arrivals", _with("SELECT o AS origin, stop, 'carry' AS plane, a AS arrival FROM bc2 UNION ALL SELECT o, stop, 'free', a FROM bf2", WALKS_SQL, morning_sql(SHORT), "bikes AS (SELECT from_stop, to_stop, seconds // 3 AS seconds FROM walks)", "bc0 AS (SELECT stop AS o, stop, 28800::BIGINT AS a FROM stops)", "nc0 AS (FROM bc0)",
    "bf0 AS (SELECT o, stop, min(a) AS a FROM (SELECT o, stop, a + 60 AS a FROM bc0 WHERE stop % 3 = 0 UNION ALL SELECT o, to_stop, a + 60 + seconds FROM bc0 JOIN walks ON from_stop = stop WHERE stop % 3 = 0) GROUP BY ALL)", "nf0 AS (FROM bf0)", *_carriage_round(1), *_carriage_round(2)))
def carriage_arrivals(spark, sf_dir):
    from dataclasses import replace

    net, walks = _net(spark, sf_dir, SHORT), _walks(spark, sf_dir)
    aboard = replace(net, lines=net.lines.where("route % 2 = 0"))
    seeds = _from_all(spark, sf_dir)
    parks = spark.range(fx.n_stops(spark, sf_dir)).where("id % 3 = 0").selectExpr("id AS stop", "60L AS seconds")
    found = policies.carriage(net, aboard, seeds, seeds.where("false"), walks.selectExpr("from_stop", "to_stop", "seconds div 3 AS seconds"), walks, parks, 2)
    return found.groupBy("origin", "stop", "plane").agg(F.min("arrival").alias("arrival"))
