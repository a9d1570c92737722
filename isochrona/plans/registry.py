"""All queries over the driver's tables by name, each with the same in DuckDB's SQL, worded independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import accounts, journeys, pareto, street, timetable
from ..sources import fixtures as fx

DEPARTURE, ROUNDS = 28800, 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries that SQL does not express; tests hold their operators to plain versions.
ROWS_ONLY: dict = {}


#: Networks prepared in this application, by what they are made of: a network is prepared once, not once a query.
_PREPARED: dict = {}


def prepared(spark, sf_dir, name: str, calls) -> journeys.Network:
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _PREPARED:
        _PREPARED[key] = journeys.prepare(calls(spark, sf_dir))
    return _PREPARED[key]


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _with(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([fx.SQL.strip(), *more]) + "\n" + sql


def rounds_sql(seeds: str, rounds: int = ROUNDS, ban: str = "true", shut: str = "true", walk: str = "") -> list[str]:
    """CTEs of earliest arrivals: all later trips joined, round by round. seeds: SELECT of o, d, stop, a."""
    out = [f"c AS (SELECT * FROM calls WHERE {ban})", f"b0 AS ({seeds})", "x0 AS (SELECT * FROM b0)"]
    for k in range(1, rounds + 1):
        out.append(f"r{k} AS (SELECT o, d, y.stop, min(y.arr) AS a FROM x{k - 1} JOIN c x ON x.stop = x{k - 1}.stop AND x.dep >= x{k - 1}.a AND {shut.replace('STOP', 'x.stop')} JOIN c y ON y.trip = x.trip AND y.pos > x.pos AND {shut.replace('STOP', 'y.stop')} GROUP BY ALL)")
        out.append(f"t{k} AS (SELECT r.* FROM r{k} r LEFT JOIN b{k - 1} b USING (o, d, stop) WHERE b.a IS NULL OR r.a < b.a)")
        if walk:
            out.append(f"w{k} AS (SELECT o, d, stop, min(a) AS a FROM (SELECT * FROM t{k} UNION ALL SELECT o, d, to_stop, a + seconds FROM t{k} JOIN {walk} ON from_stop = stop) GROUP BY ALL)")
        src = f"w{k}" if walk else f"t{k}"
        out.append(f"x{k} AS (SELECT r.* FROM {src} r LEFT JOIN b{k - 1} b USING (o, d, stop) WHERE b.a IS NULL OR r.a < b.a)")
        out.append(f"b{k} AS (SELECT o, d, stop, min(a) AS a FROM (SELECT * FROM b{k - 1} UNION ALL SELECT * FROM x{k}) GROUP BY ALL)")
    return out


def _seeds(spark, origins):
    return spark.createDataFrame([(o, DEPARTURE, o, DEPARTURE) for o in origins], "origin long, departure long, stop long, arrival long")


def _values(origins) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({o}::BIGINT, {DEPARTURE}::BIGINT, {o}::BIGINT, {DEPARTURE}::BIGINT)" for o in origins) + ") v(o, d, stop, a)"


def _arrivals(spark, sf_dir, origins=(0,), where="true", **more):
    return journeys.earliest(prepared(spark, sf_dir, where, lambda s, d: fx.stop_times(s, d).where(where)), _seeds(spark, origins), ROUNDS, **more)


BY_RIDES = "SELECT k AS rides, stop, a AS arrival FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, stop, a FROM b{k}" for k in range(1, ROUNDS + 1)) + ")"


def _by_rides(found):
    """Best arrival with at most k rides, k = 1 to ROUNDS."""
    k = found.withColumn("k", F.explode(F.sequence(F.greatest("rides", F.lit(1)), F.lit(ROUNDS))))
    return k.groupBy(F.col("k").alias("rides"), "stop").agg(F.min("arrival").alias("arrival"))


@_query("one_to_all_arrivals", _with(BY_RIDES, *rounds_sql(_values([0]))))
def one_to_all_arrivals(spark, sf_dir):
    return _by_rides(_arrivals(spark, sf_dir))


@_query("arrivals_excluding_route", _with(BY_RIDES, *rounds_sql(_values([0]), ban="route NOT IN (0, 3, 5)")))
def arrivals_excluding_route(spark, sf_dir):
    return _by_rides(_arrivals(spark, sf_dir, where="route NOT IN (0, 3, 5)"))


@_query("arrivals_excluding_stop", _with(BY_RIDES, *rounds_sql(_values([0]), shut="STOP NOT IN (1, 7)")))
def arrivals_excluding_stop(spark, sf_dir):
    return _by_rides(_arrivals(spark, sf_dir, closed=spark.createDataFrame([(1,), (7,)], "stop long")))


WALKS_SQL = "walks AS (SELECT stop AS from_stop, (stop + 1) % m AS to_stop, 90 + (stop % 7) * 20 AS seconds FROM stops, n UNION ALL SELECT stop, (stop + 10) % m, 400 + stop % 11 FROM stops, n WHERE m > 10)"


def _walks(spark, sf_dir):
    m = fx.n_stops(spark, sf_dir)
    s = spark.range(m)
    one = s.selectExpr("id AS from_stop", f"(id + 1) % {m} AS to_stop", "90 + (id % 7) * 20 AS seconds")
    return one.unionByName(s.selectExpr("id AS from_stop", f"(id + 10) % {m} AS to_stop", "400 + id % 11 AS seconds").where(F.lit(m > 10)))


@_query("arrivals_with_walks", _with(BY_RIDES, WALKS_SQL, *rounds_sql(_values([0]), walk="walks")))
def arrivals_with_walks(spark, sf_dir):
    return _by_rides(_arrivals(spark, sf_dir, transfers=_walks(spark, sf_dir)))


#: Rides of the reference's default of 7 transfers.
ALL_ROUNDS = 8


def _all_values(departures=(DEPARTURE,)) -> str:
    return "SELECT stop AS o, d, stop, d AS a FROM stops, (VALUES " + ", ".join(f"({d}::BIGINT)" for d in departures) + ") v(d)"


def _all_arrivals(spark, sf_dir, departures=(DEPARTURE,)):
    """From all stops, with the reference's rounds."""
    seeds = spark.range(fx.n_stops(spark, sf_dir)).withColumn("departure", F.explode(F.array(*[F.lit(d).cast("long") for d in departures])))
    seeds = seeds.select(F.col("id").alias("origin"), "departure", F.col("id").alias("stop"), F.col("departure").alias("arrival"))
    return journeys.earliest(prepared(spark, sf_dir, "true", fx.stop_times), seeds, ALL_ROUNDS)


def _times(found):
    return found.groupBy(F.col("origin").alias("from_id"), F.col("stop").alias("to_id")).agg(F.min(F.col("arrival") - F.col("departure")).alias("travel_time_s"))


TIMES_SQL = _with(f"SELECT o AS from_id, stop AS to_id, a - d AS travel_time_s FROM b{ALL_ROUNDS}", *rounds_sql(_all_values(), ALL_ROUNDS))


# Two names of the whole matrix.
@_query("time_matrix_all_stops", TIMES_SQL)
@_query("time_matrix", TIMES_SQL)
def time_matrix(spark, sf_dir):
    return _times(_all_arrivals(spark, sf_dir))


MINUTES = tuple(DEPARTURE + 60 * i for i in range(5))
_RANK = "list_sort(list(t))[CASE WHEN floor({p} / 100.0 * 4 + 0.5)::INT < count(t) THEN floor({p} / 100.0 * 4 + 0.5)::INT + 1 END]"


def _percentiles(found):
    each = found.groupBy("origin", "stop", "departure").agg(F.min(F.col("arrival") - F.col("departure")).alias("t"))
    # A minute that reaches nothing is later than all that do.
    all_minutes = each.groupBy("origin", "stop").agg(F.collect_list("t").alias("l")).withColumn("l", F.expr(f"concat(l, array_repeat(cast(null AS bigint), {len(MINUTES)} - size(l)))"))
    return all_minutes.select(F.col("origin").alias("from_id"), F.col("stop").alias("to_id"), *[scalars.nearest_rank(F.col("l"), p).alias(f"travel_time_p{p}_s") for p in (25, 50, 75)])


PERCENTILES_SQL = _with(f"SELECT o AS from_id, stop AS to_id, {_RANK.format(p=25)} AS travel_time_p25_s, {_RANK.format(p=50)} AS travel_time_p50_s, {_RANK.format(p=75)} AS travel_time_p75_s FROM (SELECT o, stop, a - d AS t FROM b{ALL_ROUNDS}) GROUP BY ALL", *rounds_sql(_all_values(MINUTES), ALL_ROUNDS))


# Two names of the whole matrix.
@_query("time_matrix_percentiles_all_stops", PERCENTILES_SQL)
@_query("time_matrix_percentiles", PERCENTILES_SQL)
def time_matrix_percentiles(spark, sf_dir):
    return _percentiles(_all_arrivals(spark, sf_dir, MINUTES))


@_query("pareto_rides", _with("SELECT rides, stop, arrival FROM (" + " UNION ALL ".join(f"SELECT {k} AS rides, stop, a AS arrival FROM x{k}" for k in range(1, ROUNDS + 1)) + ")", *rounds_sql(_values([2]))))
def pareto_rides(spark, sf_dir):
    return pareto.skyline(_arrivals(spark, sf_dir, (2,)), ["origin", "departure", "stop"], "rides", "arrival").where("rides > 0").select("rides", "stop", "arrival")


def _calendar(spark):
    days = ["array(" + ",".join("true" if d == i or (d == 0 and i == 6) else "false" for d in range(7)) + ")" for i in range(7)]
    rows = " UNION ALL ".join(f"SELECT {i} AS service_id, {d} AS days, date'1992-01-01' AS start_date, date'1998-12-31' AS end_date" for i, d in enumerate(days))
    ex = spark.sql("SELECT * FROM VALUES (0, date'1995-06-05', false), (0, date'1995-06-05', true), (3, date'1995-06-05', true), (9, date'1995-06-05', true) AS t(service_id, date, added)")
    return spark.sql(rows), ex


@_query("active_services", "SELECT * FROM (VALUES (3), (6), (9)) t(service_id)")
def active_services(spark, sf_dir):
    return timetable.active_services(*_calendar(spark), "1995-06-05")


@_query("day_view_trips", _with("SELECT day, count(DISTINCT trip) AS trips, count(*) AS n_calls, min(dep) AS first_dep FROM (SELECT 0 AS day, trip, dep FROM calls WHERE service = 1 UNION ALL SELECT -1, trip, dep - 86400 FROM calls WHERE service = 0 AND trip IN (SELECT trip FROM calls GROUP BY 1 HAVING max(dep) >= 86400)) GROUP BY 1"))
def day_view_trips(spark, sf_dir):
    day = lambda i: spark.createDataFrame([(i,)], "service int")
    v = timetable.day_view(fx.stop_times(spark, sf_dir), day(1), day(0))
    return v.groupBy("day").agg(F.countDistinct("trip").alias("trips"), F.count(F.lit(1)).alias("n_calls"), F.min("dep").alias("first_dep"))


_BAD = "CASE WHEN trip % 97 = 5 AND pos = 0 THEN NULL WHEN trip % 89 = 7 AND pos = 4 THEN {t} - 5000 WHEN trip % 3 = 1 AND pos IN (2, 3, 6) THEN NULL ELSE {t} END AS {t}"
_BAD_CALLS = f"bad AS (SELECT trip, pos, stop, {_BAD.format(t='arr')}, {_BAD.format(t='dep')} FROM calls)"


def _bad(spark, sf_dir):
    return fx.stop_times(spark, sf_dir).selectExpr("trip", "pos", "stop", _BAD.format(t="arr"), _BAD.format(t="dep"))


@_query("quarantined_trips", _with("SELECT trip, CASE WHEN trip % 97 = 5 THEN 'missing end time' ELSE 'backwards' END AS reason FROM trips WHERE trip % 97 = 5 OR trip % 89 = 7"))
def quarantined_trips(spark, sf_dir):
    return timetable.quarantined(_bad(spark, sf_dir))


@_query("interpolated_times", _with("""SELECT b.trip, b.pos, b.stop, coalesce(b.arr, p.dep + ((q.arr - p.dep) * (b.pos - p.pos)) // nullif(q.pos - p.pos, 0)) AS arr, coalesce(b.dep, p.dep + ((q.arr - p.dep) * (b.pos - p.pos)) // nullif(q.pos - p.pos, 0)) AS dep
FROM bad b LEFT JOIN bad p ON p.trip = b.trip AND p.pos = (CASE b.pos WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 6 THEN 5 ELSE b.pos END) LEFT JOIN bad q ON q.trip = b.trip AND q.pos = (CASE b.pos WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 6 THEN 7 ELSE b.pos END)
WHERE b.trip NOT IN (SELECT trip FROM trips WHERE trip % 97 = 5 OR trip % 89 = 7)""", _BAD_CALLS))
def interpolated_times(spark, sf_dir):
    bad = _bad(spark, sf_dir)
    return timetable.interpolated(bad.join(timetable.quarantined(bad), "trip", "left_anti"))


@_query("pattern_sizes", _with("SELECT route, n_trips, array_to_string(stops, '-') AS stops FROM (SELECT route, stops, count(*) AS n_trips FROM (SELECT trip, route, list(stop ORDER BY pos) AS stops FROM calls GROUP BY ALL) GROUP BY ALL)"))
def pattern_sizes(spark, sf_dir):
    return timetable.patterns(fx.stop_times(spark, sf_dir)).selectExpr("route", "n_trips", "array_join(stops, '-') AS stops")


@_query("line_counts", _with("SELECT route, count(DISTINCT (hop, service)) AS n_lines, count(*) AS n_trips FROM trips GROUP BY 1"))
def line_counts(spark, sf_dir):
    return timetable.lines(fx.stop_times(spark, sf_dir))[1].groupBy("route").agg(F.countDistinct("line").alias("n_lines"), F.count(F.lit(1)).alias("n_trips"))


@_query("departure_candidates", _with("SELECT DISTINCT dep AS departure FROM calls WHERE stop = 0 AND pos < 9 AND dep >= 28800 AND dep < 32400 UNION SELECT 32399"))
def departure_candidates(spark, sf_dir):
    c = fx.stop_times(spark, sf_dir).where("stop = 0 AND pos < 9 AND dep >= 28800 AND dep < 32400").select(F.col("dep").alias("departure"))
    return c.union(spark.sql("SELECT 32399L AS departure")).distinct()


@_query("transfer_closure", _with("SELECT a AS from_stop, b AS to_stop, min(s) AS seconds FROM r GROUP BY ALL", "walks AS (SELECT stop AS from_stop, stop + 1 AS to_stop, 90 + (stop % 7) * 20 AS seconds FROM stops WHERE stop % 12 < 11 AND stop + 1 < (SELECT m FROM n))", "RECURSIVE_MARK").replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK", "r AS (SELECT from_stop AS a, to_stop AS b, seconds AS s FROM walks UNION ALL SELECT a, to_stop, s + seconds FROM r JOIN walks ON from_stop = b)"))
def transfer_closure(spark, sf_dir):
    m = fx.n_stops(spark, sf_dir)
    w = spark.range(m).where(f"id % 12 < 11 AND id + 1 < {m}").selectExpr("id AS from_stop", "id + 1 AS to_stop", "90 + (id % 7) * 20 AS seconds")
    return street.closed_transfers(w)


@_query("transfer_dedupe", "SELECT l_suppkey AS from_stop, l_partkey % 50 AS to_stop, min(l_quantity)::BIGINT AS seconds, arg_min(l_extendedprice, (l_quantity, l_extendedprice)) AS metres FROM lineitem GROUP BY ALL")
def transfer_dedupe(spark, sf_dir):
    return street.fastest_transfers(fx.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS from_stop", "l_partkey % 50 AS to_stop", "cast(l_quantity AS bigint) AS seconds", "l_extendedprice AS metres"))


_HAV = "2 * 6371000.0 * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)))"


@_query("trip_distances", _with(f"SELECT route, pos, round(sum(m) OVER (PARTITION BY route ORDER BY pos) * CASE route % 4 WHEN 3 THEN 1.4 WHEN 0 THEN 1.25 ELSE 1.2 END, 3) AS metres FROM (SELECT x.route, x.pos, coalesce({_HAV.format(a='p', b='s')}, 0) AS m FROM (SELECT DISTINCT route, pos, stop FROM calls) x LEFT JOIN (SELECT DISTINCT route, pos, stop FROM calls) y ON y.route = x.route AND y.pos = x.pos - 1 JOIN stops s ON s.stop = x.stop LEFT JOIN stops p ON p.stop = y.stop)"))
def trip_distances(spark, sf_dir):
    from pyspark.sql import Window as W

    c = fx.stop_times(spark, sf_dir).select("route", "pos", "stop").distinct().join(F.broadcast(fx.stops(spark, sf_dir)), "stop")
    w = W.partitionBy("route").orderBy("pos")
    c = c.withColumn("m", F.coalesce(scalars.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0)))
    detour = F.expr("CASE route % 4 WHEN 3 THEN 1.4D WHEN 0 THEN 1.25D ELSE 1.2D END")
    return c.select("route", "pos", F.round(F.sum("m").over(w.rowsBetween(W.unboundedPreceding, 0)) * detour, 3).alias("metres"))


_FACTORS = [(None, None, None, 2, 3.0, None, 1.0, None), (None, 7, None, None, 10.0, 20.0, None, 0.0), (None, None, "A1", 3, 5.0, 6.0, 7.0, 8.0), (11, None, None, None, 1.0, 1.0, 1.0, 1.0)]


@_query("factor_ladder", _with("SELECT trip, (CASE WHEN trip = 11 THEN 4.0 WHEN route = 7 THEN 30.0 WHEN route % 3 = 1 AND route % 5 = 3 THEN 26.0 WHEN route % 5 = 2 THEN 4.0 WHEN route % 5 IN (0, 1) THEN 25.0 WHEN route % 5 = 3 THEN 92.0 END)::DOUBLE AS factor FROM trips"))
def factor_ladder(spark, sf_dir):
    t = fx.trips(spark, sf_dir).selectExpr("trip", "route", "concat('A', route % 3) AS agency", "cast(route % 5 AS int) AS route_type")
    u = spark.createDataFrame(_FACTORS, "trip_id long, route_id long, agency_id string, route_type int, vehicle double, fuel double, infrastructure double, operations double")
    return accounts.factor_ladder(t, u)


_J = "SELECT o_custkey % 20 AS cell, (o_totalprice / 10)::BIGINT AS travel_time_s, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 977 END AS emissions FROM orders"


def _journeys(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.selectExpr("o_custkey % 20 AS cell", "cast(round(o_totalprice / 10) AS bigint) AS travel_time_s", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 977 END AS emissions")


_J = _J.replace("(o_totalprice / 10)::BIGINT", "round(o_totalprice / 10)::BIGINT")


@_query("frontier_mask", f"WITH j AS ({_J}) SELECT *, (emissions IS NOT NULL AND NOT EXISTS (SELECT 1 FROM j k WHERE k.cell = j.cell AND k.emissions IS NOT NULL AND k.travel_time_s <= j.travel_time_s AND k.emissions <= j.emissions AND (k.travel_time_s < j.travel_time_s OR k.emissions < j.emissions))) AS frontier FROM j")
def frontier_mask(spark, sf_dir):
    return pareto.mask(_journeys(spark, sf_dir), ["cell"], "travel_time_s", "emissions").select("cell", "travel_time_s", "emissions", "frontier")


@_query("least_emissions", f"WITH j AS ({_J}) SELECT cell, min(emissions) AS emissions, arg_min(travel_time_s, (emissions, travel_time_s)) AS travel_time_s FROM j WHERE emissions IS NOT NULL AND travel_time_s <= 20000 GROUP BY 1")
def least_emissions(spark, sf_dir):
    return pareto.least(_journeys(spark, sf_dir), ["cell"], "emissions", "travel_time_s", 20000).select("cell", "emissions", "travel_time_s")


@_query("exact_frontier", f"WITH j AS ({_J}), d AS (SELECT DISTINCT * FROM j WHERE emissions IS NOT NULL) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d k WHERE k.cell = d.cell AND k.travel_time_s <= d.travel_time_s AND k.emissions <= d.emissions AND (k.travel_time_s < d.travel_time_s OR k.emissions < d.emissions))")
def exact_frontier(spark, sf_dir):
    return pareto.skyline(_journeys(spark, sf_dir).distinct(), ["cell"], "travel_time_s", "emissions")


@_query("fare_cutoffs", f"WITH j AS (SELECT o_custkey % 20 AS cell, round(o_totalprice / 10)::BIGINT AS travel_time_s, (o_orderkey % 9)::DOUBLE AS fare, (o_orderkey % 4)::BIGINT AS rides FROM orders), m AS (SELECT cell, cutoff, min((travel_time_s, fare, rides)) AS m FROM j, (VALUES (0.0), (2.0), (5.0)) c(cutoff) WHERE fare <= cutoff + 1e-9 GROUP BY ALL) SELECT cell, cutoff::DOUBLE AS cutoff, m[1] AS travel_time_s, m[2] AS fare, m[3] AS rides FROM m")
def fare_cutoffs(spark, sf_dir):
    j = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey % 20 AS cell", "cast(round(o_totalprice / 10) AS bigint) AS travel_time_s", "cast(o_orderkey % 9 AS double) AS fare", "o_orderkey % 4 AS rides")
    return accounts.cutoff_minima(j, ["cell"], [0.0, 2.0, 5.0])


@_query("rental_fares", "SELECT o_orderkey AS trip, round(CASE o_orderkey % 3 WHEN 0 THEN 1.0 + ceil((60 + o_orderkey % 1800) / 60.0) * 0.25 WHEN 1 THEN 0.5 + ceil((60 + o_orderkey % 1800) / 60.0) * 0.2 END, 6)::DOUBLE AS fare FROM orders")
def rental_fares(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS trip", "60 + o_orderkey % 1800 AS s", "o_orderkey % 3 AS k")
    tariffs = spark.createDataFrame([(0, 1.0, 0.25), (1, 0.5, 0.2)], "k long, unlock double, per_minute double")
    return o.join(F.broadcast(tariffs), "k", "left").select("trip", F.round(accounts.rental_fare(F.col("s"), F.col("unlock"), F.col("per_minute")), 6).alias("fare"))


@_query("rule_fares", """SELECT o_orderkey AS journey, round(CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5000 <= 3600 AND (o_orderkey % 4) <> (o_orderkey // 4 % 4) THEN 7.2 ELSE 9.6 END WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 5000 <= 3600 THEN 8.37 ELSE 9.3 END ELSE 4.5 END, 6)::DOUBLE AS fare FROM orders""")
def rule_fares(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    first = "CASE WHEN o_orderkey % 5 = 4 THEN 'ferry' WHEN o_orderkey % 3 = 2 THEN 'rail' ELSE 'bus' END"
    second = "CASE WHEN o_orderkey % 3 = 0 THEN 'bus' ELSE 'rail' END"
    rides = F.expr(f"array(named_struct('type', {first}, 'route', o_orderkey % 4, 'board', 0L), named_struct('type', {second}, 'route', o_orderkey div 4 % 4, 'board', o_orderkey % 5000))")
    rules = F.expr("map('bus', named_struct('fare', 4.8D, 'unlimited', false, 'same_route', false), 'rail', named_struct('fare', 4.5D, 'unlimited', true, 'same_route', false))")
    pairs = F.expr("map('bus|bus', 7.2D, 'bus|rail', 8.37D, 'rail|bus', 8.37D)")
    return o.select(F.col("o_orderkey").alias("journey"), F.round(accounts.rule_fare(rides, rules, pairs, 3600, 1), 6).alias("fare"))


_TYPES = "footway cycleway residential motorway path steps primary busway".split()


@_query("edge_permissions", "SELECT p_partkey AS edge, p_partkey % 8 IN (0, 2, 4, 5, 6) AS foot, p_partkey % 8 IN (1, 2, 4, 6) AS bicycle, p_partkey % 8 IN (2, 3, 6) AS car FROM part")
def edge_permissions(spark, sf_dir):
    highway = F.get(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % 8).cast("int"))
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge"), *[c.alias(k) for k, c in street.permissions(highway).items()])


@_query("arc_costs", "SELECT p_partkey AS edge, CASE WHEN p_size = 1 THEN 0 ELSE greatest(ceil((p_size - 1) * 7.5 / (14.4 / 3.6) * 1000), 1) END::BIGINT AS ms FROM part")
def arc_costs(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge"), street.arc_ms((F.col("p_size") - 1) * F.lit(7.5), F.lit(14.4)).cast("long").alias("ms"))


def _grid(spark, n=12):
    v = spark.range(n * n)
    right = v.where(f"id % {n} < {n - 1}").selectExpr("id AS u", "id + 1 AS v", "1000 + (id * 31) % 700 AS ms")
    down = v.where(f"id < {n * (n - 1)}").selectExpr("id AS u", f"id + {n} AS v", "1000 + (id * 57) % 900 AS ms")
    return right.unionByName(down)


@_query("street_time_matrix", """WITH RECURSIVE v AS (SELECT unnest(range(144)) AS id), arcs AS (SELECT id AS u, id + 1 AS v, 1000 + (id * 31) % 700 AS ms FROM v WHERE id % 12 < 11 UNION ALL SELECT id, id + 12, 1000 + (id * 57) % 900 FROM v WHERE id < 132),
d AS (SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 0::BIGINT), (5, 5, 0)) s(source, v, ms) UNION SELECT source, arcs.v, d.ms + arcs.ms FROM d JOIN arcs ON arcs.u = d.v WHERE d.ms + arcs.ms <= 9000) SELECT source, v, min(ms)::BIGINT AS ms FROM d GROUP BY ALL""")
def street_time_matrix(spark, sf_dir):
    return street.shortest(_grid(spark), spark.createDataFrame([(0, 0, 0), (5, 5, 0)], "source long, v long, ms long"), 9000)


@_query("snap_points", _with(f"SELECT point, arg_min(stop, (metres, stop)) AS stop, round(min(metres), 3) AS metres FROM (SELECT p.point, s.stop, {_HAV.format(a='p', b='s')} AS metres FROM (SELECT c_custkey AS point, 60 + (c_custkey * 17 % 1000) / 10000.0::DOUBLE AS lat, 24 + (c_custkey * 29 % 1000) / 5000.0::DOUBLE AS lon FROM customer) p, stops s) WHERE metres <= 500 GROUP BY 1"))
def snap_points(spark, sf_dir):
    p = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS point", "60 + (c_custkey * 17 % 1000) / 10000.0D AS plat", "24 + (c_custkey * 29 % 1000) / 5000.0D AS plon")
    return street.snap(p, fx.stops(spark, sf_dir), 500).withColumn("metres", F.round("metres", 3))


@_query("monetary_costs", "SELECT o_orderkey AS trip, round(o_totalprice / 1000.0 * CASE o_orderkey % 3 WHEN 0 THEN 0.108 WHEN 1 THEN -0.184 ELSE -0.370 END, 8)::DOUBLE AS cost FROM orders")
def monetary_costs(spark, sf_dir):
    per_km = spark.createDataFrame(accounts.STREET_COSTS, "perspective string, mode string, component string, per_km double").where("perspective = 'societal'").groupBy("mode").agg(F.sum("per_km").alias("per_km"))
    o = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS trip", "o_totalprice / 1000 AS km", "CASE o_orderkey % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'bicycle' ELSE 'walk' END AS mode")
    return o.join(F.broadcast(per_km), "mode", "left").select("trip", F.round(F.col("km") * F.col("per_km"), 8).alias("cost"))


@_query("merged_mode_transfers", _with("SELECT from_stop, to_stop, m[1] AS seconds, m[2] AS rentals FROM (SELECT from_stop, to_stop, min((seconds, rentals)) AS m FROM (SELECT a.from_stop, b.to_stop, (a.seconds + r.seconds + b.seconds)::BIGINT AS seconds, 1 AS rentals FROM legs a JOIN rides r ON a.to_stop = r.from_stop JOIN legs b ON r.to_stop = b.from_stop WHERE a.seconds + r.seconds + b.seconds <= 600 AND a.from_stop <> b.to_stop UNION ALL SELECT from_stop, to_stop, seconds, 0 FROM walks) GROUP BY ALL)", WALKS_SQL, "rides AS (SELECT stop AS from_stop, (stop + 3) % m AS to_stop, 100 + stop % 13 AS seconds FROM stops, n WHERE stop % 2 = 0)", "legs AS (SELECT * FROM walks UNION ALL SELECT stop, stop, 0 FROM stops WHERE stop IN (SELECT from_stop FROM rides UNION SELECT to_stop FROM rides))"))
def merged_mode_transfers(spark, sf_dir):
    m = fx.n_stops(spark, sf_dir)
    rides = spark.range(m).where("id % 2 = 0").selectExpr("id AS from_stop", f"(id + 3) % {m} AS to_stop", "100 + id % 13 AS seconds")
    return street.merged_modes(_walks(spark, sf_dir), rides, 600)


@_query("route_types", "SELECT p_partkey AS id, CASE WHEN t BETWEEN 100 AND 199 THEN 2 WHEN t BETWEEN 200 AND 299 THEN 3 WHEN t BETWEEN 400 AND 499 THEN 1 WHEN t BETWEEN 700 AND 899 THEN 3 WHEN t BETWEEN 900 AND 999 THEN 0 WHEN t BETWEEN 1000 AND 1099 OR t BETWEEN 1200 AND 1299 THEN 4 WHEN t BETWEEN 1300 AND 1399 THEN 6 WHEN t BETWEEN 1400 AND 1499 THEN 7 ELSE t END AS base FROM (SELECT p_partkey, p_partkey % 1600 AS t FROM part)")
def route_types(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.base_route_type(F.col("p_partkey") % 1600).alias("base"))


@_query("clock_times", "SELECT event_id, (event_id % 30 * 3600 + event_id % 60 * 60 + event_id % 59)::INT AS seconds FROM events")
def clock_times(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").selectExpr("event_id", "concat_ws(':', lpad(event_id % 30, 2, '0'), lpad(event_id % 60, 2, '0'), lpad(event_id % 59, 2, '0')) AS t")
    return e.select("event_id", scalars.clock_seconds(F.col("t")).alias("seconds"))


@_query("square_grid", _with("SELECT concat(floor(lon / 0.05)::BIGINT, '_', floor(lat / 0.02)::BIGINT) AS id, count(*) AS n_stops FROM stops GROUP BY 1"))
def square_grid(spark, sf_dir):
    return fx.stops(spark, sf_dir).groupBy(F.concat_ws("_", F.floor(F.col("lon") / 0.05), F.floor(F.col("lat") / 0.02)).alias("id")).agg(F.count(F.lit(1)).alias("n_stops"))


from . import fares, feeds, places, streets, surfaces  # noqa: E402, F401
from . import journeys as _journey_queries  # noqa: E402, F401
