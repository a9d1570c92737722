"""Journey queries over all stops as origins: paths, costs, profiles and frontiers, on trips of the morning with distances and
factors, and on days whose trips run past midnight."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journeys as jn
from ..operators import timetable
from ..sources import fixtures as fx
from .registry import DEPARTURE, WALKS_SQL, _query, _walks, _with, prepared


def _measured(spark, sf_dir):
    """All calls with metres along the route and the route's factor; every tenth route has none."""
    more = ["pos * (400.0D + route * 10) AS cum", "CASE WHEN route % 10 = 9 THEN null WHEN route % 4 = 3 THEN 92.0D ELSE 25.0D + route % 3 END AS factor"]
    return fx.stop_times(spark, sf_dir).selectExpr("*", *more)


def morning(spark, sf_dir, minutes: int = 60):
    c = _measured(spark, sf_dir)
    return c.join(c.groupBy("trip").agg(F.min("arr").alias("_a"), F.max("dep").alias("_z")).where(f"_a >= {DEPARTURE - 1800} AND _z < {DEPARTURE + 1800 + minutes * 60}").select("trip"), "trip", "left_semi")


def _net(spark, sf_dir, minutes: int = 60):
    return prepared(spark, sf_dir, f"morning-{minutes}", lambda s, d: morning(s, d, minutes))


def morning_sql(minutes: int = 60) -> str:
    return f"""mc AS (SELECT calls.*, 0 AS day, pos * (400.0::DOUBLE + route * 10) AS cum, CASE WHEN route % 10 = 9 THEN NULL WHEN route % 4 = 3 THEN 92.0 ELSE 25.0 + route % 3 END::DOUBLE AS factor
  FROM calls WHERE trip IN (SELECT trip FROM calls GROUP BY 1 HAVING min(arr) >= {DEPARTURE - 1800} AND max(dep) < {DEPARTURE + 1800 + minutes * 60}))"""


def path_rounds(rounds: int, seeds: str, table: str = "mc", walk: str = "") -> list[str]:
    """Earliest arrivals with paths as lists of five numbers a step, over all later trips. seeds: SELECT of o, d, stop, a."""
    out = [f"b0 AS (SELECT o, d, stop, a, [2, stop, a - d, 0, 0] AS p FROM ({seeds}))", "x0 AS (SELECT * FROM b0)"]
    for k in range(1, rounds + 1):
        out.append(f"r{k} AS (SELECT o, d, y.stop, min((y.arr, [0, x.trip, x.day, x.pos, y.pos] || p)) AS v FROM x{k - 1} JOIN {table} x ON x.stop = x{k - 1}.stop AND x.dep >= x{k - 1}.a JOIN {table} y ON y.trip = x.trip AND y.day = x.day AND y.pos > x.pos GROUP BY ALL)")
        out.append(f"t{k} AS (SELECT r.o, r.d, r.stop, r.v[1] AS a, r.v[2] AS p FROM r{k} r LEFT JOIN b{k - 1} b USING (o, d, stop) WHERE b.a IS NULL OR r.v[1] < b.a)")
        src = f"t{k}"
        if walk:
            out.append(f"w{k} AS (SELECT o, d, stop, v[1] AS a, v[2] AS p FROM (SELECT o, d, stop, min((a, p)) AS v FROM (SELECT * FROM t{k} UNION ALL SELECT o, d, to_stop, a + seconds, [1, stop, to_stop, seconds, 0] || p FROM t{k} JOIN {walk} ON from_stop = stop) GROUP BY ALL))")
            src = f"w{k}"
        out.append(f"x{k} AS (SELECT r.* FROM {src} r LEFT JOIN b{k - 1} b USING (o, d, stop) WHERE b.a IS NULL OR r.a < b.a)")
        out.append(f"b{k} AS (SELECT * FROM x{k} UNION ALL SELECT b.* FROM b{k - 1} b LEFT JOIN x{k} x USING (o, d, stop) WHERE x.a IS NULL)")
    out.append("found AS (" + " UNION ALL ".join(f"SELECT {k} AS rides, * FROM x{k}" for k in range(rounds + 1)) + ")")
    return out


def _from_all(spark, sf_dir, departure: int = DEPARTURE):
    return spark.range(fx.n_stops(spark, sf_dir)).selectExpr("id AS origin", f"{departure}L AS departure", "id AS stop", f"{departure}L AS arrival")


_ALL = f"SELECT stop AS o, {DEPARTURE}::BIGINT AS d, stop, {DEPARTURE}::BIGINT AS a FROM stops"


def _late(spark, sf_dir):
    return fx.stop_times(spark, sf_dir).selectExpr("trip", "route", "service", "pos", "stop", "arr + 5400 AS arr", "dep + 5400 AS dep")


def _night(spark, sf_dir):
    day = lambda i: spark.createDataFrame([(i,)], "service int")
    return timetable.day_view(_late(spark, sf_dir), day(1), day(0))


_NIGHT_SQL = "late AS (SELECT trip, service, pos, stop, arr + 5400 AS arr, dep + 5400 AS dep FROM calls), night AS (SELECT trip, 0 AS day, pos, stop, arr, dep FROM late WHERE service = 1 UNION ALL SELECT trip, -1, pos, stop, arr - 86400, dep - 86400 FROM late WHERE service = 0)"


@_query("over_midnight_view", _with("SELECT day, count(DISTINCT trip) AS trips, count(*) AS n_calls, min(dep) AS first_dep, max(dep) AS last_dep FROM night WHERE day = 0 OR trip IN (SELECT trip FROM late GROUP BY 1 HAVING max(dep) >= 86400) GROUP BY 1", _NIGHT_SQL))
def over_midnight_view(spark, sf_dir):
    return _night(spark, sf_dir).groupBy("day").agg(F.countDistinct("trip").alias("trips"), F.count(F.lit(1)).alias("n_calls"), F.min("dep").alias("first_dep"), F.max("dep").alias("last_dep"))


@_query("arrivals_over_midnight", _with("SELECT o AS from_id, stop AS to_id, rides, a AS arrival, p[3] AS last_day FROM found WHERE rides > 0", _NIGHT_SQL, *path_rounds(3, "SELECT stop AS o, 300::BIGINT AS d, stop, 300::BIGINT AS a FROM stops", "night")))
def arrivals_over_midnight(spark, sf_dir):
    net = prepared(spark, sf_dir, "night", _night)
    found = jn.earliest(net, _from_all(spark, sf_dir, 300), 3, paths=True).where("rides > 0")
    return found.selectExpr("origin AS from_id", "stop AS to_id", "rides", "arrival", "path[0].b AS last_day")


_LEGS_SQL = """steps AS (SELECT o, stop, rides, i, p[5 * i + 1] AS kind, p[5 * i + 2] AS a, p[5 * i + 3] AS b, p[5 * i + 4] AS c, p[5 * i + 5] AS e, len(p) // 5 AS n FROM (SELECT o, stop, rides, p, unnest(range(len(p) // 5)) AS i FROM found)),
legs AS (SELECT s.o AS from_id, s.stop AS to_id, s.rides, n - 1 - i AS segment, CASE kind WHEN 0 THEN 'transit' WHEN 1 THEN 'transfer' ELSE 'access' END AS leg_type, CASE kind WHEN 0 THEN x.stop WHEN 1 THEN s.a END AS from_stop, CASE kind WHEN 0 THEN y.stop WHEN 1 THEN s.b ELSE s.a END AS to_stop,
  CASE WHEN kind = 0 THEN s.a END AS trip, x.route, x.dep, y.arr, y.cum - x.cum AS m, CASE WHEN kind = 0 THEN (y.cum - x.cum) / 1000 * x.factor ELSE 0 END AS g, c, kind FROM steps s LEFT JOIN mc x ON kind = 0 AND x.trip = s.a AND x.pos = s.c LEFT JOIN mc y ON kind = 0 AND y.trip = s.a AND y.pos = s.e)"""


@_query("itinerary_legs", _with("SELECT from_id, to_id, rides, segment, leg_type, from_stop, to_stop, trip, route, dep, arr, round(m, 6) AS metres, round(g, 6) AS emissions FROM legs WHERE leg_type = 'transit'", WALKS_SQL, morning_sql(), *path_rounds(3, _ALL, walk="walks"), _LEGS_SQL))
def itinerary_legs(spark, sf_dir):
    found = jn.earliest(_net(spark, sf_dir), _from_all(spark, sf_dir), 3, transfers=_walks(spark, sf_dir), paths=True)
    out = jn.legs(found).where("leg_type = 'transit'").selectExpr("origin AS from_id", "stop AS to_id", "rides", "cast(segment AS bigint) AS segment", "leg_type", "from_stop", "to_stop", "trip", "route", "dep", "arr", "round(metres, 6) AS metres", "round(grams, 6) AS emissions")
    return out


@_query("itinerary_shapes", _with("SELECT o AS from_id, stop AS to_id, rides, a AS arrival, string_agg(kind::VARCHAR, '' ORDER BY i DESC) AS kinds FROM (SELECT f.o, f.stop, f.rides, f.a, i, kind FROM found f JOIN steps s USING (o, stop, rides)) GROUP BY ALL", WALKS_SQL, morning_sql(), *path_rounds(3, _ALL, walk="walks"), _LEGS_SQL))
def itinerary_shapes(spark, sf_dir):
    found = jn.earliest(_net(spark, sf_dir), _from_all(spark, sf_dir), 3, transfers=_walks(spark, sf_dir), paths=True)
    return found.selectExpr("origin AS from_id", "stop AS to_id", "rides", "arrival", "array_join(transform(reverse(path), s -> s.kind), '') AS kinds")


_FASTEST_SQL = "fast AS (SELECT o, d, stop, arg_min(rides, (a, rides)) AS rides, min(a) AS a, arg_min(p, (a, rides)) AS p FROM found GROUP BY ALL)"


@_query("cost_matrix", _with("SELECT f.o AS from_id, f.stop AS to_id, a - d AS travel_time_s, greatest(f.rides, 1) - 1 AS transfers, round(coalesce(sum(m) FILTER (kind = 0), 0), 4) AS transit_distance_m, CASE WHEN bool_or(kind = 0 AND g IS NULL) THEN NULL ELSE round(coalesce(sum(g) FILTER (kind = 0), 0), 4) END AS emissions FROM fast f JOIN legs l ON l.from_id = f.o AND l.to_id = f.stop AND l.rides = f.rides GROUP BY ALL", WALKS_SQL, morning_sql(), *path_rounds(3, _ALL, walk="walks"), _FASTEST_SQL, _LEGS_SQL))
def cost_matrix(spark, sf_dir):
    found = jn.earliest(_net(spark, sf_dir), _from_all(spark, sf_dir), 3, transfers=_walks(spark, sf_dir), paths=True)
    c = jn.costs(jn.fastest(found))
    return c.selectExpr("origin AS from_id", "stop AS to_id", "arrival - departure AS travel_time_s", "greatest(rides, 1) - 1 AS transfers", "round(transit_m, 4) AS transit_distance_m", "round(grams, 4) AS emissions")


WINDOW = 300
_CANDIDATES = f"cand AS (SELECT DISTINCT stop AS o, dep AS d FROM mc WHERE pos < 9 AND dep >= {DEPARTURE} AND dep < {DEPARTURE + WINDOW} UNION SELECT stop, {DEPARTURE + WINDOW - 1} FROM stops)"


def _candidates(spark, sf_dir):
    access = spark.range(fx.n_stops(spark, sf_dir)).selectExpr("id AS origin", "id AS stop", "0L AS seconds")
    return jn.departure_candidates(_net(spark, sf_dir), access, DEPARTURE, WINDOW)


@_query("departure_candidates_all_stops", _with("SELECT o AS origin, d AS departure FROM cand", morning_sql(), _CANDIDATES))
def departure_candidates_all_stops(spark, sf_dir):
    return _candidates(spark, sf_dir)


@_query("range_profile", _with("SELECT o AS from_id, stop AS to_id, d AS departure, rides, a AS arrival FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.o = f.o AND g.stop = f.stop AND g.rides <= f.rides AND g.a <= f.a AND (g.d > f.d OR (g.d = f.d AND g.rides < f.rides)))", morning_sql(), _CANDIDATES, *path_rounds(2, "SELECT o, d, o AS stop, d AS a FROM cand")))
def range_profile(spark, sf_dir):
    seeds = _candidates(spark, sf_dir).selectExpr("origin", "departure", "origin AS stop", "departure AS arrival")
    found = jn.undominated(jn.earliest(_net(spark, sf_dir), seeds, 2), 2)
    return found.selectExpr("origin AS from_id", "stop AS to_id", "departure", "rides", "arrival")


#: Minutes of trips for the exhaustive search.
SHORT = 10
_EXHAUSTIVE = [
    "e0 AS (SELECT stop AS o, stop, 28800::BIGINT AS a, 0.0::DOUBLE AS g, 0 AS rides FROM stops)",
    *[f"e{k} AS (SELECT DISTINCT o, y.stop, y.arr AS a, round(g + (y.cum - x.cum) / 1000 * x.factor, 6) AS g, {k} AS rides FROM e{k - 1} e JOIN mc x ON x.stop = e.stop AND x.dep >= e.a AND x.factor IS NOT NULL JOIN mc y ON y.trip = x.trip AND y.pos > x.pos)" for k in (1, 2)],
    "e AS (SELECT o, stop, a, g, min(rides) AS rides FROM (FROM e0 UNION ALL FROM e1 UNION ALL FROM e2) GROUP BY ALL)",
]


def _frontier(spark, sf_dir, **options):
    return jn.frontier(_net(spark, sf_dir, SHORT), _from_all(spark, sf_dir), 2, **options)


@_query("frontier_table", _with("SELECT o AS from_id, stop AS to_id, a - 28800 AS travel_time_s, rides, g AS emissions FROM (SELECT *, min(g) OVER (PARTITION BY o, stop ORDER BY a, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE before IS NULL OR g < before", morning_sql(SHORT), *_EXHAUSTIVE))
def frontier_table(spark, sf_dir):
    return _frontier(spark, sf_dir).selectExpr("origin AS from_id", "stop AS to_id", "arrival - departure AS travel_time_s", "rides", "grams AS emissions")


@_query("bucket_frontier", _with("SELECT DISTINCT o AS from_id, stop AS to_id, a - 28800 AS travel_time_s, rides, floor(g / 50)::BIGINT AS bucket FROM e_all x WHERE NOT EXISTS (SELECT 1 FROM e_all y WHERE y.o = x.o AND y.stop = x.stop AND y.a <= x.a AND floor(y.g / 50) <= floor(x.g / 50) AND y.rides <= x.rides AND (y.a < x.a OR floor(y.g / 50) < floor(x.g / 50) OR y.rides < x.rides))", morning_sql(SHORT), *_EXHAUSTIVE, "e_all AS (SELECT DISTINCT o, stop, a, rides, floor(g / 50) * 50 + 1 AS g FROM (FROM e0 UNION ALL FROM e1))"))
def bucket_frontier(spark, sf_dir):
    found = jn.frontier(_net(spark, sf_dir, SHORT), _from_all(spark, sf_dir), 1, bucket=50.0)
    return found.selectExpr("origin AS from_id", "stop AS to_id", "arrival - departure AS travel_time_s", "rides", "floor(grams / 50) AS bucket")


@_query("least_emissions_matrix", _with("SELECT o AS from_id, stop AS to_id, min(g) AS emissions, arg_min(a, (g, a)) - 28800 AS travel_time_s FROM e WHERE a - 28800 <= 1500 GROUP BY ALL", morning_sql(SHORT), *_EXHAUSTIVE))
def least_emissions_matrix(spark, sf_dir):
    from ..operators import pareto

    f = _frontier(spark, sf_dir, horizon=1500).selectExpr("origin AS from_id", "stop AS to_id", "grams AS emissions", "arrival - departure AS travel_time_s")
    return pareto.least(f, ["from_id", "to_id"], "emissions", "travel_time_s", 1500).select("from_id", "to_id", "emissions", "travel_time_s")


_POINT_SQL = """p AS (SELECT c_custkey AS point, 60 + (c_custkey * 17 % 1000) / 10000.0::DOUBLE AS lat, 24 + (c_custkey * 29 % 1000) / 5000.0::DOUBLE AS lon FROM customer WHERE c_custkey % 3 = 0),
link AS (SELECT point, stop, greatest(ceil({hav} - 1e-6), 0)::BIGINT AS seconds FROM p, stops s WHERE {hav} <= 700),
src AS (SELECT stop AS o, 28800::BIGINT AS d, stop, 28800::BIGINT AS a FROM stops)"""


def _links(spark, sf_dir):
    from ..functions.scalars import walk_seconds
    from ..operators import street

    p = fx.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS point", "60 + (c_custkey * 17 % 1000) / 10000.0D AS plat", "24 + (c_custkey * 29 % 1000) / 5000.0D AS plon")
    return street.within(p, fx.stops(spark, sf_dir), 700).select("point", "stop", walk_seconds(F.col("metres")).alias("seconds"))


def _hav():
    from .registry import _HAV

    return _HAV.format(a="p", b="s")


@_query("point_time_matrix", _with("SELECT o AS from_id, point AS to_id, min(least(a + l.seconds - 28800, coalesce(w.seconds, 99999999)))::BIGINT AS travel_time_s FROM b3 JOIN link l USING (stop) LEFT JOIN (SELECT stop AS o, point, seconds FROM link) w USING (o, point) GROUP BY ALL", _POINT_SQL.replace("{hav}", _hav()), morning_sql(), *path_rounds(3, "SELECT * FROM src")))
def point_time_matrix(spark, sf_dir):
    links = _links(spark, sf_dir)
    found = jn.fastest(jn.earliest(_net(spark, sf_dir), _from_all(spark, sf_dir), 3))
    out = jn.to_points(found, links, links.selectExpr("stop AS origin", "point", "seconds"))
    return out.selectExpr("origin AS from_id", "point AS to_id", "seconds AS travel_time_s")


@_query("capped_options", """WITH o AS (SELECT o_orderkey AS id, o_custkey % 20 AS cell, o_orderkey % 50 AS departure, round(o_totalprice / 100)::BIGINT AS arrival, (o_orderkey % 97)::DOUBLE AS grams FROM orders),
b AS (SELECT x.id, min(x.arrival - y.arrival) AS gap, count(y.id) AS beaten FROM o x LEFT JOIN o y ON y.cell = x.cell AND y.departure >= x.departure AND y.arrival <= x.arrival AND y.grams <= x.grams AND (y.departure > x.departure OR y.arrival < x.arrival OR y.grams < x.grams) GROUP BY 1),
f AS (SELECT o.*, beaten = 0 AS frontier FROM o JOIN b USING (id)),
g AS (SELECT x.id, min(x.arrival - y.arrival) AS gap FROM f x JOIN f y ON y.frontier AND y.cell = x.cell AND y.departure >= x.departure AND y.arrival <= x.arrival AND y.grams <= x.grams AND (y.departure > x.departure OR y.arrival < x.arrival OR y.grams < x.grams) GROUP BY 1)
SELECT cell, count(*) AS n, count(*) FILTER (frontier) AS n_frontier, sum(gap) AS gaps FROM (SELECT f.*, coalesce(gap, 0) AS gap, row_number() OVER (PARTITION BY cell ORDER BY frontier DESC, coalesce(gap, 0), grams) AS r FROM f LEFT JOIN g USING (id)) WHERE frontier OR r <= 12 GROUP BY 1""")
def capped_options(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey % 20 AS cell", "o_orderkey % 50 AS departure", "cast(round(o_totalprice / 100) AS bigint) AS arrival", "cast(o_orderkey % 97 AS double) AS grams")
    kept = jn.capped(o, ["cell"], 12)
    return kept.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("frontier"), 1)).alias("n_frontier"), F.sum("behind").alias("gaps"))
