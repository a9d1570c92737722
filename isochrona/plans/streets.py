"""Street queries: ways are made of `part`, their tags by the key; a ring-and-chord network of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, osm
from ..sources import fixtures as fx
from .registry import _query

#: tag: (values, divisor): the way's value is values[key div divisor % len(values)].
TAGS = {
    "highway": (["footway", "cycleway", "residential", "motorway", "path", "steps", "primary", "busway", "trunk_link", "rocket"], 1),
    "oneway": ([None, "yes", "-1", "no", None], 10), "access": ([None, "private", "yes", "odd"], 3), "bicycle": ([None, "yes", "no", "dismount", None, None], 7),
    "cycleway": ([None, "opposite_lane", None], 5), "cycleway:left": ([None, "lane", "separate"], 2), "cycleway:left:oneway": ([None, "no", "-1", "yes"], 4),
    "oneway:bicycle": ([None, None, "no", "-1", None, "yes"], 11), "junction": ([None, None, None, "roundabout"], 9), "motorcar": ([None, None, "yes", "no"], 6),
    "vehicle": ([None, None, "no", None, "yes"], 13), "foot": ([None, None, None, "no", "yes", "strange"], 17), "bridge": ([None, "yes", "no"], 8), "surface": (["asphalt", None, "mud", "sand"], 3),
    "maxspeed": ([None, "50", "30 mph", "signals", " 20.5 ", "-3", "0", None], 7), "maxspeed:forward": ([None, None, "60"], 19),
}


def _picked(values: list, divisor: int, key: str = "p_partkey") -> str:
    return f"CASE ({key} DIV {divisor}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


def _ways(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").selectExpr("p_partkey AS edge", "p_size", *[f"{_picked(*v)} AS `{k}`" for k, v in TAGS.items()])


WAYS_SQL = "ways AS (SELECT p_partkey AS edge, p_size, " + ", ".join(f'{_picked(*v).replace(" DIV ", " // ")} AS "{k}"' for k, v in TAGS.items()) + " FROM part)"


def _tags():
    return {k: F.col(f"`{k}`") for k in TAGS}


_ALLOW, _DENY = (", ".join(f"'{x}'" for x in v) for v in (osm.ALLOWED, osm.DENIED))
_DIRECTED = """CASE WHEN bicycle = 'dismount' OR "oneway:bicycle" IN ('no', 'false', '0') THEN true WHEN "oneway:bicycle" = '-1' THEN {own_back} WHEN "oneway:bicycle" IN ('yes', 'true', '1') THEN {own_on}
  WHEN NOT {blocked} THEN true WHEN cycleway = 'opposite_lane' THEN true WHEN coalesce("cycleway:left", '') <> 'lane' THEN false WHEN "cycleway:left:oneway" = 'no' THEN true ELSE {lane} END"""
_ACCESS = [
    """t AS (SELECT *, coalesce(highway, '') AS hw, coalesce(oneway, '') AS ow FROM ways)""",
    f"""d AS (SELECT *, hw IN ('footway', 'residential', 'path', 'steps', 'primary') AS f0, hw IN ('cycleway', 'residential', 'path', 'primary') AS b0, hw IN ('residential', 'motorway', 'primary', 'trunk_link') AS c0,
      (ow IN ('yes', '-1') OR ((coalesce(junction, '') = 'roundabout' OR hw = 'motorway') AND ow <> 'no')) AS one FROM t)""",
    f"""m AS (SELECT *, CASE WHEN foot IN ({_ALLOW}) THEN true WHEN foot IN ({_DENY}) OR access IN ({_DENY}) THEN false ELSE f0 END AS walk,
      CASE WHEN bicycle IN ('yes', 'dismount') THEN true WHEN bicycle = 'no' THEN false WHEN vehicle = 'no' THEN false WHEN vehicle = 'yes' THEN b0 WHEN access = 'private' THEN false ELSE b0 END AS ride,
      CASE motorcar WHEN 'yes' THEN true WHEN 'no' THEN false ELSE CASE WHEN vehicle = 'no' THEN false WHEN vehicle = 'yes' THEN c0 WHEN access = 'private' THEN false ELSE c0 END END AS drive FROM d)""",
    f"""a AS (SELECT edge, walk::INT + 6 * (ride AND {_DIRECTED.format(own_back='false', own_on='true', blocked="(one AND ow = '-1')", lane='coalesce("cycleway:left:oneway", \'\') = \'yes\'')})::INT + 8 * (drive AND NOT (one AND ow = '-1'))::INT AS access_forward,
      walk::INT + 6 * (ride AND {_DIRECTED.format(own_back='true', own_on='false', blocked="(one AND ow <> '-1')", lane='coalesce("cycleway:left:oneway", \'\') = \'-1\'')})::INT + 8 * (drive AND NOT (one AND ow <> '-1'))::INT AS access_reverse,
      coalesce(bicycle = 'dismount', false)::INT AS flags, coalesce(access = 'odd', false) OR coalesce(foot = 'strange', false) AS unknown_access, hw = 'rocket' AS unknown_highway FROM m)""",
]


@_query("way_access", "WITH " + ", ".join([WAYS_SQL, *_ACCESS]) + " SELECT * FROM a")
def way_access(spark, sf_dir):
    return _ways(spark, sf_dir).select("edge", *[c.alias(k) for k, c in osm.access(_tags()).items()])


@_query("way_diagnostics", "WITH " + ", ".join([WAYS_SQL, *_ACCESS]) + " SELECT count(*) FILTER (unknown_access) AS unknown_access, count(*) FILTER (unknown_highway) AS unknown_highway FROM a")
def way_diagnostics(spark, sf_dir):
    return osm.diagnostics(_ways(spark, sf_dir), _tags())


@_query("way_codes", f"WITH {WAYS_SQL} SELECT edge, CASE highway WHEN 'footway' THEN 16 WHEN 'cycleway' THEN 18 WHEN 'residential' THEN 12 WHEN 'motorway' THEN 1 WHEN 'path' THEN 17 WHEN 'steps' THEN 21 WHEN 'primary' THEN 5 WHEN 'busway' THEN 26 WHEN 'trunk_link' THEN 4 ELSE 0 END AS highway_code, CASE surface WHEN 'asphalt' THEN 2 WHEN 'sand' THEN 14 ELSE 0 END AS surface_code, 0 AS smoothness_code, (highway = 'steps')::INT * 16 + (coalesce(junction, '') = 'roundabout')::INT * 128 + (coalesce(bridge, 'no') = 'yes')::INT * 2 AS facility_flags FROM ways")
def way_codes(spark, sf_dir):
    return _ways(spark, sf_dir).select("edge", *[c.alias(k) for k, c in osm.codes(_tags()).items()])


_MAXSPEED = "CASE maxspeed WHEN '50' THEN 50.0 WHEN '30 mph' THEN 30 * 1.609344 WHEN ' 20.5 ' THEN 20.5 END"
_DEFAULTS = "CASE highway WHEN 'residential' THEN {r} WHEN 'motorway' THEN 110 WHEN 'primary' THEN {p} WHEN 'trunk_link' THEN 80 ELSE 50 END"


@_query("car_speeds", f"WITH {WAYS_SQL} SELECT edge, round(coalesce(CASE WHEN \"maxspeed:forward\" = '60' THEN 60.0 END, {_MAXSPEED}, {_DEFAULTS.format(r=44, p='CASE WHEN p_size % 2 = 0 THEN 50 ELSE 90 END')}), 6)::DOUBLE AS forward_kmh, round(coalesce({_MAXSPEED}, {_DEFAULTS.format(r=44, p='CASE WHEN p_size % 2 = 0 THEN 50 ELSE 90 END')}), 6)::DOUBLE AS reverse_kmh FROM ways")
def car_speeds(spark, sf_dir):
    speeds = osm.car_speeds(_tags(), F.expr("p_size % 2 = 0"), {"residential_inside": 44, "residential_outside": 44})
    return _ways(spark, sf_dir).select("edge", *[F.round(c, 6).alias(k) for c, k in zip(speeds, ("forward_kmh", "reverse_kmh"), strict=True)])


def _network(spark, sf_dir):
    """edge, u, v, way, highway, car, metres: a ring over the parts with chords, every seventh a link."""
    n = fx.table(spark, sf_dir, "part").count()
    e = fx.table(spark, sf_dir, "part").selectExpr("p_partkey AS edge", "p_partkey AS u", f"CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 7 + 5) % {n} ELSE (p_partkey + 1) % {n} END AS v", "p_partkey div 4 AS way", "p_size * 12.37D + 0.123D AS metres")
    return e.selectExpr("*", "CASE WHEN edge % 7 = 0 THEN 'primary_link' WHEN edge % 2 = 0 THEN 'primary' ELSE 'tertiary' END AS highway", "edge % 5 <> 4 AS car")


NETWORK_SQL = "n0 AS (SELECT count(*) AS n FROM part), net AS (SELECT p_partkey AS edge, p_partkey AS u, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 7 + 5) % n ELSE (p_partkey + 1) % n END AS v, p_partkey // 4 AS way, p_size * 12.37::DOUBLE + 0.123::DOUBLE AS metres, CASE WHEN p_partkey % 7 = 0 THEN 'primary_link' WHEN p_partkey % 2 = 0 THEN 'primary' ELSE 'tertiary' END AS highway, p_partkey % 5 <> 4 AS car FROM part, n0)"
_NODES = "CASE node % 6 WHEN 1 THEN 'traffic_signals' WHEN 2 THEN 'stop' WHEN 4 THEN 'give_way' END AS control, CASE node % 4 WHEN 0 THEN 'forward' WHEN 2 THEN 'backward' END AS direction"
_JUNCTIONS = """inc AS (SELECT u AS node, way, highway, car FROM net UNION ALL SELECT v, way, highway, car FROM net),
deg AS (SELECT node, count(*) FILTER (car) AS degree, count(*) FILTER (car AND highway = 'primary_link') AS ramps, count(*) FILTER (car AND highway <> 'primary_link') AS others, count(DISTINCT way) FILTER (car) AS ways, min(way) FILTER (car) AS way FROM inc GROUP BY 1),
cls AS (SELECT node, degree, ways, way, CASE node % 4 WHEN 0 THEN 'forward' WHEN 2 THEN 'backward' ELSE '' END AS direction, node % 6 IN (2, 4) AS sign, CASE WHEN node % 6 = 1 THEN 3 WHEN ramps > 0 AND others > 0 THEN 4 WHEN degree > 2 THEN 1 ELSE 0 END AS class FROM deg),
jc AS (SELECT edge, CASE WHEN h.class = 0 AND h.sign AND (h.ways <> 1 OR (h.way = net.way AND h.direction <> 'backward')) THEN 2 ELSE h.class END AS forward_head, CASE WHEN t.class = 0 AND t.sign AND (t.ways <> 1 OR (t.way = net.way AND t.direction <> 'forward')) THEN 2 ELSE t.class END AS reverse_head FROM net JOIN cls h ON h.node = v JOIN cls t ON t.node = u)"""


def _junctions(spark, sf_dir):
    net = _network(spark, sf_dir)
    return osm.junction_classes(net, net.select(F.col("u").alias("node")).distinct().selectExpr("node", *_NODES.split(", ")))


@_query("junction_classes", f"WITH {NETWORK_SQL}, {_JUNCTIONS} SELECT * FROM jc")
def junction_classes(spark, sf_dir):
    return _junctions(spark, sf_dir)


_B = "CASE WHEN highway = 'primary' THEN 9.979 WHEN highway = 'tertiary' THEN 6.650 ELSE 7.752 END"
_SHARE = "(CASE {c} WHEN 1 THEN 0.5 WHEN 3 THEN 0.5 WHEN 4 THEN CASE WHEN highway <> 'primary_link' THEN 0.25 WHEN kmh >= 70 THEN 0.75 ELSE 0.5 END ELSE 0 END)"


@_query("car_arc_times", f"""WITH {NETWORK_SQL}, {_JUNCTIONS}, x AS (SELECT net.*, forward_head AS h, reverse_head AS t, 40.0 + edge % 5 * 10 AS kmh, edge % 11 = 0 AS ring, {_B} AS b FROM net JOIN jc USING (edge)),
y AS (SELECT *, metres / (kmh / 3.6) AS free, {_SHARE.format(c='h')} AS sh, {_SHARE.format(c='t')} AS st FROM x),
z AS (SELECT *, CASE WHEN ring THEN free + b / 4 WHEN sh + st > 0 THEN free WHEN kmh >= 70 AND highway = 'primary_link' THEN free * 1.66775 ELSE free END AS base, if(ring, 0, b * sh) AS hs, if(ring, 0, b * st) AS ts FROM y)
SELECT edge, ceil((base + hs + ts) * 1000)::BIGINT AS ms, least(floor(hs * 1000 + 0.5), ceil((base + hs + ts) * 1000))::BIGINT AS head_ms, ceil(free * 1000)::BIGINT AS free_ms FROM z""")
def car_arc_times(spark, sf_dir):
    x = _network(spark, sf_dir).join(_junctions(spark, sf_dir), "edge").withColumn("kmh", F.expr("40 + edge % 5 * 10.0D"))
    with_delays, free = (osm.car_ms(osm.car_seconds(F.col("metres"), F.col("kmh"), F.col("highway"), F.expr("edge % 11 = 0"), F.col("forward_head"), F.col("reverse_head"), m), F.col("metres")) for m in (osm.delay_model(True), None))
    return x.select("edge", with_delays["ms"].cast("long").alias("ms"), with_delays["head_ms"].cast("long").alias("head_ms"), free["ms"].cast("long").alias("free_ms"))


@_query("slope_means", "WITH p AS (SELECT l_partkey AS edge, l_quantity * 4 AS metres, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 100 - 5 END AS rise FROM lineitem), s AS (SELECT *, least(greatest(rise / metres, -1), 1) AS g FROM p) SELECT edge, round(sum(metres * CASE WHEN rise IS NULL THEN 1 WHEN g > 0 THEN 1 + g ELSE greatest(1 + 0.3 * g, 0.1) END) / sum(metres), 9) AS forward, round(sum(metres * CASE WHEN rise IS NULL THEN 1 WHEN g < 0 THEN 1 - g ELSE greatest(1 - 0.3 * g, 0.1) END) / sum(metres), 9) AS reverse FROM s GROUP BY 1")
def slope_means(spark, sf_dir):
    p = fx.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS edge", "l_quantity * 4 AS metres", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 100 - 5 END AS rise")
    return osm.slope_means(p, 1.0, 0.3).select("edge", F.round("forward", 9).alias("forward"), F.round("reverse", 9).alias("reverse"))


@_query("profile_arcs", f"WITH {', '.join([WAYS_SQL, *_ACCESS])}, x AS (SELECT ways.edge, p_size * 10.0 AS m, access_forward AS a, flags AS f, if(surface = 'sand', 0.5, 1.0) AS s FROM ways JOIN a USING (edge)) SELECT edge, if(a & 1 > 0, ceil(m * 1000), NULL)::BIGINT AS walk_ms, if(a & 2 > 0, ceil(round(m / if(f & 1 > 0, 1.0, 4.0 * coalesce(s, 1.0)) * 1000, 6)), NULL)::BIGINT AS bicycle_ms FROM x")
def profile_arcs(spark, sf_dir):
    a = osm.access(_tags())
    x = _ways(spark, sf_dir).select("edge", (F.col("p_size") * 10.0).alias("m"), a["access_forward"].alias("a"), a["flags"].alias("f"), F.expr("IF(surface = 'sand', 0.5D, 1.0D)").alias("s"))
    return x.select("edge", osm.profile_ms(F.col("m"), F.col("a"), F.col("f"), "walk").cast("long").alias("walk_ms"), osm.profile_ms(F.col("m"), F.col("a"), F.col("f"), "bicycle", multipliers=[F.col("s")]).cast("long").alias("bicycle_ms"))


_CUT_SQL = "net AS (SELECT p_partkey AS edge, p_partkey AS u, CASE WHEN p_partkey % 50 = 49 THEN p_partkey ELSE p_partkey + 1 END AS v, CASE WHEN p_partkey % 30 = 7 THEN 1 ELSE 9 END AS access_forward, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 9 END AS access_reverse FROM part)"


def _cut(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").selectExpr("p_partkey AS edge", "p_partkey AS u", "CASE WHEN p_partkey % 50 = 49 THEN p_partkey ELSE p_partkey + 1 END AS v", "CASE WHEN p_partkey % 30 = 7 THEN 1 ELSE 9 END AS access_forward", "CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 9 END AS access_reverse")


@_query("pruned_ways", f"""WITH {_CUT_SQL}, car AS (SELECT *, (access_forward | access_reverse) & 8 > 0 AS ok FROM net), g AS (SELECT *, u // 50 AS chain, sum((NOT ok)::INT) OVER (PARTITION BY u // 50 ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cuts FROM car),
p AS (SELECT *, count(*) FILTER (ok AND u <> v) OVER (PARTITION BY chain, coalesce(cuts, 0)) + 1 AS size FROM g)
SELECT edge, CASE WHEN ok AND size < 25 THEN access_forward & 247 ELSE access_forward END AS access_forward, CASE WHEN ok AND size < 25 THEN access_reverse & 247 ELSE access_reverse END AS access_reverse FROM p""")
def pruned_ways(spark, sf_dir):
    return osm.pruned(_cut(spark, sf_dir), [osm.CAR], 25).select("edge", "access_forward", "access_reverse")


@_query("component_sizes", f"WITH {_CUT_SQL} SELECT min(u) AS root, count(*) AS n_vertices FROM net GROUP BY u // 50")
def component_sizes(spark, sf_dir):
    return graph.component_sizes(_cut(spark, sf_dir).selectExpr("u AS a", "v AS b"))
