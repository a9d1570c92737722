"""Queries of heights, lattices and further frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pareto, paths, surfaces
from ..sources import fixtures as fx
from .places import _BEST, _SOURCES, GRID_SQL, _best, _grid, _recursive
from .registry import _query

_CELLS = "cells AS (SELECT r.i AS row, c.i AS col, CASE WHEN (r.i * 7 + c.i) % 13 = 0 THEN NULL ELSE r.i * 2.5 + c.i * c.i / 8.0 END::DOUBLE AS value FROM (SELECT unnest(range(20)) AS i) r, (SELECT unnest(range(25)) AS i) c)"
_POINTS = "p AS (SELECT c_custkey AS point, 10 + (c_custkey % 101) / 4.0::DOUBLE AS x, 50 - (c_custkey % 83) / 4.0::DOUBLE AS y FROM customer)"


@_query("point_heights", f"""WITH {_CELLS}, {_POINTS}, g AS (SELECT point, floor(x - 10)::BIGINT AS c, floor(50 - y)::BIGINT AS r, (x - 10) - floor(x - 10) AS u, (50 - y) - floor(50 - y) AS v FROM p)
SELECT point, round(CASE WHEN a.value IS NULL OR (u > 0 AND b.value IS NULL) OR (v > 0 AND d.value IS NULL) OR (u > 0 AND v > 0 AND e.value IS NULL) THEN NULL ELSE a.value * (1 - u) * (1 - v) + coalesce(b.value, 0) * u * (1 - v) + coalesce(d.value, 0) * (1 - u) * v + coalesce(e.value, 0) * u * v END, 6) AS height
FROM g LEFT JOIN cells a ON a.row = r AND a.col = c LEFT JOIN cells b ON b.row = r AND b.col = c + 1 LEFT JOIN cells d ON d.row = r + 1 AND d.col = c LEFT JOIN cells e ON e.row = r + 1 AND e.col = c + 1""")
def point_heights(spark, sf_dir):
    return _heights(spark, sf_dir).select("point", F.round("height", 6).alias("height"))


def _heights(spark, sf_dir):
    cells = spark.range(20).selectExpr("id AS row", "explode(sequence(0L, 24L)) AS col").selectExpr("row", "col", "IF((row * 7 + col) % 13 = 0, null, row * 2.5D + col * col / 8.0D) AS value")
    points = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS point", "10 + (c_custkey % 101) / 4.0D AS x", "50 - (c_custkey % 83) / 4.0D AS y")
    return surfaces.heights(points, cells, 10.0, 50.0, 1.0, -1.0)


@_query("height_coverage", f"""WITH {_CELLS}, {_POINTS}, g AS (SELECT point, floor(x - 10)::BIGINT AS c, floor(50 - y)::BIGINT AS r, x - 10 > floor(x - 10) AS u, 50 - y > floor(50 - y) AS v FROM p),
n AS (SELECT point, count(cells.value) AS known, any_value((u::INT + 1) * (v::INT + 1)) AS needed FROM g LEFT JOIN cells ON row BETWEEN r AND r + v::INT AND col BETWEEN c AND c + u::INT GROUP BY 1) SELECT round(avg((known = needed)::INT), 9) AS coverage FROM n""")
def height_coverage(spark, sf_dir):
    return surfaces.coverage(_heights(spark, sf_dir)).select(F.round("coverage", 9).alias("coverage"))


@_query("structure_heights", """WITH p AS (SELECT l_orderkey AS edge, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_quantity AS x, l_orderkey % 7 = 0 AS structure, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice * 1.0001234567::DOUBLE END AS h FROM lineitem),
s AS (SELECT *, sum(step) OVER (PARTITION BY edge ORDER BY i) AS along, sum(step) OVER (PARTITION BY edge) AS total, first(h) OVER w AS a, last(h) OVER w AS b, max(i) OVER (PARTITION BY edge) AS n FROM (SELECT *, coalesce(abs(x - lag(x) OVER (PARTITION BY edge ORDER BY i)), 0) AS step FROM p) WINDOW w AS (PARTITION BY edge ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT edge, i, round(CASE WHEN structure AND i > 1 AND i < n THEN a + if(total > 0, along / total, 0) * (b - a) ELSE h END, 4) AS height FROM s""")
def structure_heights(spark, sf_dir):
    p = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS edge", "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS bigint) AS i", "l_quantity AS x", "0.0D AS y", "IF(l_partkey % 11 = 0, null, l_extendedprice * 1.0001234567D) AS height", "l_orderkey % 7 = 0 AS structure")
    return surfaces.over_structures(p).select("edge", "i", F.round("height", 4).alias("height"))


@_query("lattice_cells", "SELECT c.i || '_' || r.i AS id, (c.i + 0.5) * 250.0::DOUBLE AS x, (r.i + 0.5) * 250.0::DOUBLE AS y FROM (SELECT floor(min(s_suppkey) * 40 / 250)::BIGINT AS c0, greatest(ceil((max(s_suppkey) * 40 + 10) / 250), 1)::BIGINT AS c1 FROM supplier) b, LATERAL (SELECT unnest(range(c0, c1)) AS i) c, (SELECT unnest(range(-2, 3)) AS i) r")
def lattice_cells(spark, sf_dir):
    box = fx.table(spark, sf_dir, "supplier").selectExpr("min(s_suppkey) * 40.0D AS a", "max(s_suppkey) * 40.0D + 10 AS b")
    areas = box.selectExpr("array(named_struct('x', a, 'y', -500.0D), named_struct('x', b, 'y', -500.0D), named_struct('x', b, 'y', 740.0D), named_struct('x', a, 'y', 740.0D)) AS ring")
    return surfaces.square_cells(areas, 250.0).select("id", "x", "y")


_J3 = "j AS (SELECT DISTINCT o_custkey % 10 AS cell, (o_orderkey * 37 % 211)::BIGINT AS t, (o_orderkey % 97)::DOUBLE AS g, (o_orderkey % 5)::DOUBLE AS f FROM orders)"


@_query("fare_frontier_mask", f"WITH {_J3} SELECT *, NOT EXISTS (SELECT 1 FROM j k WHERE k.cell = j.cell AND k.t <= j.t AND k.g <= j.g AND k.f <= j.f AND (k.t < j.t OR k.g < j.g OR k.f < j.f)) AS frontier FROM j")
def fare_frontier_mask(spark, sf_dir):
    j = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 AS cell", "o_orderkey * 37 % 211 AS t", "cast(o_orderkey % 97 AS double) AS g", "cast(o_orderkey % 5 AS double) AS f").distinct()
    return pareto.mask3(j, ["cell"], "t", "g", "f").select("cell", "t", "g", "f", "frontier")


@_query("relaxed_frontier", """WITH j AS (SELECT o_custkey % 20 AS cell, (o_orderkey * 37 % 311)::BIGINT AS arrival, (o_orderkey % 3 * 20)::BIGINT AS penalty, (o_orderkey % 7)::BIGINT AS measure, (o_orderkey % 2 + 1)::BIGINT AS rides, min(o_orderkey % 97)::DOUBLE AS grams FROM orders GROUP BY ALL)
SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM j k WHERE k.cell = j.cell AND k.measure <= j.measure AND k.rides <= j.rides AND k.arrival <= j.arrival AND k.arrival + k.penalty + 15 <= j.arrival + j.penalty AND (k.arrival, k.penalty, k.measure, k.rides) <> (j.arrival, j.penalty, j.measure, j.rides))""")
def relaxed_frontier(spark, sf_dir):
    j = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey % 20 AS cell", "o_orderkey * 37 % 311 AS arrival", "o_orderkey % 3 * 20 AS penalty", "o_orderkey % 7 AS measure", "o_orderkey % 2 + 1 AS rides", "cast(o_orderkey % 97 AS double) AS grams")
    return pareto.relaxed(j, ["cell"], 15)


@_query("street_cost_matrix", _recursive("SELECT source, target, any_value(cost) AS cost, round(sum(m), 6) AS network_m FROM (SELECT b.source, target, k, b.cost, coalesce(a.cost / 7.0, 0) AS m FROM back b LEFT JOIN arcs a ON a.edge = b.edge) GROUP BY ALL", GRID_SQL, _SOURCES, _BEST,
    "back AS (SELECT source, v AS target, v AS at, NULL::BIGINT AS edge, 0 AS k, cost FROM pred UNION ALL SELECT b.source, target, p[1], p[2], k + 1, b.cost FROM back b JOIN pred ON pred.source = b.source AND pred.v = b.at WHERE b.at <> b.source)").replace("SELECT source, target, any_value(cost) AS cost, round(sum(m), 6) AS network_m FROM (SELECT b.source, target, k, b.cost,", "SELECT source, target, max(cost) AS cost, round(sum(m), 6) AS network_m FROM (SELECT b.source, target, b.cost,"))
def street_cost_matrix(spark, sf_dir):
    best, (_, arcs) = _best(spark, sf_dir), _grid(spark, sf_dir)
    out = paths.path_costs(best, best.select("source", F.col("v").alias("target")), arcs.selectExpr("edge", "cost / 7.0D AS length"))
    return out.select("source", "target", "cost", F.round("network_m", 6).alias("network_m"))
