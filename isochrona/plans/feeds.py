"""Feed, distance, table and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import accounts, chains, distances, tables, timetable
from ..operators import journeys as jn
from ..sources import artifact, gtfs, staging
from ..sources import fixtures as fx
from ..streaming import sink
from .journeys import _from_all, _net, morning_sql
from .registry import _BAD_CALLS, ROWS_ONLY, _bad, _query, _with, rounds_sql

_FEEDS: dict = {}


def _clock(c: str) -> str:
    return f"concat_ws(':', lpad({c} div 3600, 2, '0'), lpad({c} div 60 % 60, 2, '0'), lpad({c} % 60, 2, '0'))"


def _folder(spark, sf_dir) -> str:
    """The fixture as a feed's text files, written once an application."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _FEEDS:
        folder = f"{staging.folder(spark)}/feed-{uuid.uuid4().hex}"
        calls = _bad(spark, sf_dir).where("trip % 101 <> 0")
        t = fx.trips(spark, sf_dir)
        gtfs.write({
            "agency": spark.sql("SELECT 'A' AS agency_id, 'One' AS agency_name, 'UTC' AS agency_timezone"),
            "stops": fx.stops(spark, sf_dir).selectExpr("concat('S', stop) AS stop_id", "concat('Stop \"', stop, '\", north') AS stop_name", "IF(stop % 10 = 3, null, lat) AS stop_lat", "IF(stop % 10 = 3, null, lon) AS stop_lon"),
            "routes": t.select("route").distinct().selectExpr("concat('R', route) AS route_id", "concat('L', route) AS route_short_name", "route % 4 AS route_type", "'not a colour' AS route_color"),
            "trips": t.selectExpr("concat('T', trip) AS trip_id", "concat('R', route) AS route_id", "IF(trip % 50 = 1, 'X', concat('W', service)) AS service_id", "trip % 4 AS bikes_allowed"),
            "stop_times": calls.selectExpr("concat('T', trip) AS trip_id", "concat('S', stop) AS stop_id", "pos * 10 + 1 AS stop_sequence", f"{_clock('arr')} AS arrival_time", f"{_clock('dep')} AS departure_time"),
            "calendar": spark.range(7).selectExpr("concat('W', id) AS service_id", *[f"IF(id = {i}, 1, 0) AS {d}" for i, d in enumerate(gtfs.DAYS)], "'19920101' AS start_date", "'19981231' AS end_date"),
            "calendar_dates": spark.sql("SELECT * FROM VALUES ('W0', '19950605', 2), ('W3', '19950605', 1), ('W0', '19950605', 1) AS t(service_id, date, exception_type)"),
        }, folder)
        _FEEDS[key] = folder
    return _FEEDS[key]


def _feed(spark, sf_dir):
    return gtfs.read(spark, _folder(spark, sf_dir))


@_query("feed_calls", _with("SELECT 'T' || b.trip AS trip, 'R' || (b.trip % 41) AS route, CASE WHEN b.trip % 50 = 1 THEN 'X' ELSE 'W' || service END AS service, b.pos, 'S' || b.stop AS stop, if(b.arr < 0, NULL, b.arr)::BIGINT AS arr, if(b.dep < 0, NULL, b.dep)::BIGINT AS dep FROM bad b JOIN trips USING (trip) WHERE b.trip % 101 <> 0", _BAD_CALLS))
def feed_calls(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    gtfs.check_references(feed)
    return gtfs.calls(feed)


@_query("feed_findings", _with("SELECT 'stop without coordinates' AS kind, 'S' || stop AS id FROM stops WHERE stop % 10 = 3 UNION ALL SELECT 'service never runs', 'T' || trip FROM trips WHERE trip % 50 = 1"))
def feed_findings(spark, sf_dir):
    return gtfs.findings(_feed(spark, sf_dir), spark)


@_query("feed_unusable_trips", _with("SELECT 'T' || trip AS trip, CASE WHEN trip % 101 = 0 THEN 'no stop times' WHEN trip % 97 = 5 THEN 'missing end time' ELSE 'backwards' END AS reason FROM trips WHERE trip % 101 = 0 OR trip % 97 = 5 OR trip % 89 = 7"))
def feed_unusable_trips(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    return timetable.quarantined(gtfs.calls(feed)).unionByName(gtfs.without_calls(feed))


@_query("feed_counts", _with("SELECT * FROM (SELECT 'agency' AS name, 1::BIGINT AS n UNION ALL SELECT 'stops', count(*) FROM stops UNION ALL SELECT 'routes', count(DISTINCT route) FROM trips UNION ALL SELECT 'trips', count(*) FROM trips UNION ALL SELECT 'stop_times', count(*) FROM calls WHERE trip % 101 <> 0 UNION ALL SELECT 'calendar', 7 UNION ALL SELECT 'calendar_dates', 3)"))
def feed_counts(spark, sf_dir):
    return gtfs.counts(_feed(spark, sf_dir))


@_query("feed_active_services", "SELECT * FROM (VALUES ('W3')) t(service)")
def feed_active_services(spark, sf_dir):
    return timetable.active_services(*gtfs.services(_feed(spark, sf_dir), spark), "1995-06-05").selectExpr("service_id AS service")


@_query("merged_feed_stops", _with("SELECT id AS stop_id, feed, row_number() OVER (ORDER BY id) - 1 AS number FROM (SELECT f || ':S' || stop AS id, f AS feed FROM stops, (VALUES (0), (1)) v(f))"))
def merged_feed_stops(spark, sf_dir):
    folder = _folder(spark, sf_dir)
    return gtfs.numbered(gtfs.read(spark, folder, folder)["stops"], "stop_id", name="number").select("stop_id", "feed", "number")


def fifo_chains(spark, sf_dir):
    """First fit takes a pattern's trips one after another, so SQL has no form for it."""
    return chains.fifo_chains(fx.stop_times(spark, sf_dir)).select("trip", "route", "chain", "rank")


ROWS_ONLY["fifo_chains"] = fifo_chains


@_query("chain_trip_counts", _with("SELECT route, count(*) AS n_trips, true AS in_order, min(trip) AS least FROM trips GROUP BY 1"))
def chain_trip_counts(spark, sf_dir):
    """Trips by route; whether within each chain none overtakes the one before."""
    from pyspark.sql import Window as W

    c = chains.fifo_chains(fx.stop_times(spark, sf_dir), times=True)
    w = W.partitionBy("route", "stops", "chain").orderBy("rank")
    after = lambda t: F.forall(F.zip_with(t, F.lag(t).over(w), lambda x, y: x >= y), lambda ok: ok)
    ok = F.coalesce(after("arrs") & after("deps"), F.lit(True))
    return c.withColumn("ok", ok).groupBy("route").agg(F.count(F.lit(1)).alias("n_trips"), F.min("ok").alias("in_order"), F.min("trip").alias("least"))


@_query("dense_trip_numbers", _with("SELECT count(*) AS n, min(number) AS least, max(number) AS most, count(DISTINCT number) AS distinct_numbers FROM (SELECT row_number() OVER (ORDER BY route, trip) - 1 AS number FROM trips)"))
def dense_trip_numbers(spark, sf_dir):
    d = chains.dense_trips(chains.fifo_chains(fx.stop_times(spark, sf_dir)))
    return d.agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("least"), F.max("number").alias("most"), F.countDistinct("number").alias("distinct_numbers"))


_LADDER_SQL = """seq AS (SELECT DISTINCT route, pos, stop FROM calls), geo AS (SELECT route, pos, lat, lon, seq.stop FROM seq JOIN stops USING (stop)),
once AS (SELECT route, count(DISTINCT stop) = count(*) AND route % 3 = 0 AS shaped, arg_min(lat, pos) AS lat0 FROM geo GROUP BY 1),
hop AS (SELECT g.route, g.pos, coalesce(2 * 6371000.0 * asin(sqrt(pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(p.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2))), 0) AS crow,
  coalesce(sqrt(pow((g.lon - p.lon) * (111412.84 * cos(radians(lat0)) - 93.5 * cos(3 * radians(lat0)) + 0.118 * cos(5 * radians(lat0))), 2) + pow((g.lat - p.lat) * (111132.954 - 559.822 * cos(2 * radians(lat0)) + 1.175 * cos(4 * radians(lat0))), 2)), 0) AS flat
  FROM geo g JOIN once USING (route) LEFT JOIN geo p ON p.route = g.route AND p.pos = g.pos - 1),
cum AS (SELECT route, pos, sum(crow) OVER w AS crow, sum(flat) OVER w AS flat FROM hop WINDOW w AS (PARTITION BY route ORDER BY pos))"""


@_query("distance_ladder", _with("""SELECT route AS trip, pos, round(CASE WHEN route % 4 < 2 THEN crow * 1.3 WHEN shaped THEN flat ELSE crow * CASE route % 4 WHEN 2 THEN 1.2 ELSE 1.4 END END, 4) AS cum, CASE WHEN route % 4 < 2 THEN 'shape_dist' WHEN shaped THEN 'shape_linref' ELSE 'crow_fly' END AS provenance FROM cum JOIN once USING (route)""", _LADDER_SQL))
def distance_ladder(spark, sf_dir):
    seq = fx.stop_times(spark, sf_dir).select("route", "pos", "stop").distinct().join(F.broadcast(fx.stops(spark, sf_dir)), "stop")
    t = seq.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("pos", "stop", "lat", "lon"))).alias("c"))
    t = t.selectExpr("route AS trip", "IF(route % 3 = 0 AND size(array_distinct(transform(c, x -> x.stop))) = size(c), concat('P', route), null) AS shape", "cast(route % 4 AS int) AS route_type", "transform(c, x -> named_struct('lat', x.lat, 'lon', x.lon)) AS stops")
    crow = distances.crow_fly(F.col("stops"))
    raw = F.when(F.col("route_type") == 0, F.transform(crow, lambda x: x * 1.3 + 7)).when(F.col("route_type") == 1, F.transform(crow, lambda x: x * 1.3 / 1000)).when(F.col("route_type") == 2, F.transform(crow, lambda x: -x)).otherwise(F.transform(crow, lambda x: F.lit(None).cast("double")))
    t = t.withColumn("raw", raw)
    # Shapes go through the stops, and through the middle between two.
    points = t.where("shape IS NOT NULL").selectExpr("shape", "inline(transform(stops, (s, i) -> named_struct('seq', 2 * i, 'lat', s.lat, 'lon', s.lon)))")
    middle = t.where("shape IS NOT NULL").selectExpr("shape", "inline(transform(sequence(1, size(stops) - 1), i -> named_struct('seq', 2 * i - 1, 'lat', (stops[i].lat + stops[i - 1].lat) / 2, 'lon', (stops[i].lon + stops[i - 1].lon) / 2)))")
    found = distances.ladder(t, points.unionByName(middle))
    return found.selectExpr("trip", "provenance", "posexplode(cum) AS (pos, cum)").select("trip", "pos", F.round("cum", 4).alias("cum"), "provenance")


@_query("plane_geometry", """WITH p AS (SELECT c_custkey AS id, 60 + (c_custkey % 97) / 500.0::DOUBLE AS lat, 179.9 + (c_custkey % 50) / 250.0::DOUBLE AS lon FROM customer),
q AS (SELECT *, if(lon > 180, lon - 360, lon) AS l FROM p), k AS (SELECT *, 111412.84 * cos(radians(lat)) - 93.5 * cos(3 * radians(lat)) + 0.118 * cos(5 * radians(lat)) AS kx, 111132.954 - 559.822 * cos(2 * radians(lat)) + 1.175 * cos(4 * radians(lat)) AS ky FROM q),
xy AS (SELECT *, (if(179.95 - l > 180, 179.95 - l - 360, if(179.95 - l < -180, 179.95 - l + 360, 179.95 - l))) * kx AS x1, (60.1 - lat) * ky AS y1, (if(-179.95 - l < -180, -179.95 - l + 360, if(-179.95 - l > 180, -179.95 - l - 360, -179.95 - l))) * kx AS x2, (60.12 - lat) * ky AS y2 FROM k),
t AS (SELECT *, least(greatest(-(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0), 1) AS t FROM xy)
SELECT id, round(sqrt(pow(x1 + t * (x2 - x1), 2) + pow(y1 + t * (y2 - y1), 2)), 5) AS metres, round(t, 9) AS share FROM t""")
def plane_geometry(spark, sf_dir):
    p = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "60 + (c_custkey % 97) / 500.0D AS lat", "179.9D + (c_custkey % 50) / 250.0D AS lon").withColumn("lon", F.expr("IF(lon > 180, lon - 360, lon)"))
    far, t = scalars.foot_on_segment(F.col("lon"), F.col("lat"), F.lit(179.95), F.lit(60.1), F.lit(-179.95), F.lit(60.12))
    return p.select("id", F.round(far, 5).alias("metres"), F.round(t, 9).alias("share"))


@_query("scalar_keys", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN (event_id // 7)::VARCHAR WHEN 2 THEN 'x' || event_id ELSE event_id::VARCHAR || '.5' END AS key, floor(value / 2.5)::BIGINT AS bucket, round(value, 6) AS grams, CASE event_id % 5 WHEN 0 THEN 'tram' WHEN 3 THEN 'bus' WHEN 1 THEN 'subway' WHEN 2 THEN 'rail' ELSE 'ferry' END AS mode, CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'yes' END AS tag FROM events")
def scalar_keys(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").selectExpr("event_id", "value", "CASE event_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN concat(event_id div 7, '.0') WHEN 2 THEN concat(' x', event_id) ELSE concat(event_id, '.5') END AS k", "IF(event_id % 3 = 0, 'stop', '') AS h", "IF(event_id % 3 = 1, '{\"highway\": \"yes\"}', '{broken') AS tags")
    return e.select(F.col("event_id").alias("id"), scalars.key_text(F.col("k")).alias("key"), scalars.grams_bucket(F.col("value"), 2.5).alias("bucket"), scalars.quantised_grams(F.col("value")).alias("grams"), scalars.route_type_name(F.col("event_id") % 5).alias("mode"), scalars.tag_of(F.col("h"), F.col("tags"), "highway").alias("tag"))


@_query("null_rules", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE greatest(ceil(p_size / 3.0 - 1e-6), 0)::BIGINT END AS walk_s, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN NULL ELSE greatest(ceil(p_size * 10 / (14.4 / 3.6) * 1000), 1)::BIGINT END AS ms, CASE WHEN p_size % 7 = 0 THEN NULL ELSE least(p_size, 9)::DOUBLE END AS fare FROM part")
def null_rules(spark, sf_dir):
    """Unknown seconds, speeds, lengths and fares stay unknown."""
    from ..operators import street

    x = fx.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "IF(p_size % 5 = 0, null, p_size / 3.0D) AS s", "IF(p_size % 5 = 0, null, p_size * 10.0D) AS m", "IF(p_size % 7 = 0, null, 14.4D) AS kmh", "array(named_struct('type', IF(p_size % 7 = 0, 'none', 'bus'), 'route', 1L, 'board', 0L)) AS rides", "map('bus', named_struct('fare', cast(p_size AS double), 'unlimited', false, 'same_route', false)) AS rules")
    fare = accounts.rule_fare(F.col("rides"), F.col("rules"), F.expr("cast(map() AS map<string, double>)"), 0, 0, cap=9.0)
    return x.select("id", scalars.walk_seconds(F.col("s")).alias("walk_s"), street.arc_ms(F.col("m"), F.col("kmh")).cast("long").alias("ms"), fare.alias("fare"))


@_query("factor_rungs", _with("SELECT trip, (CASE WHEN route % 6 = 0 THEN 92.0 WHEN route % 6 = 1 THEN 77.0 WHEN route % 6 = 2 THEN 25.0 WHEN route % 6 = 3 THEN 11.0 END)::DOUBLE AS factor FROM trips"))
def factor_rungs(spark, sf_dir):
    """Extended types: 700 falls to the shipped bus, 705 to the user's last row, 900 to the shipped tram, 109 to the user's rail."""
    t = fx.trips(spark, sf_dir).selectExpr("trip", "route", "'A' AS agency", "cast(element_at(array(700, 705, 900, 109, 1501, null), cast(route % 6 + 1 AS int)) AS int) AS route_type")
    rows = [(None, None, None, 705, 70.0, 5.0, None, None), (None, None, None, 705, 70.0, 7.0, None, None), (None, None, None, 2, 11.0, None, None, 0.0)]
    u = spark.createDataFrame(rows, "trip_id string, route_id string, agency_id string, route_type int, vehicle double, fuel double, infrastructure double, operations double").coalesce(1)
    return accounts.factor_ladder(t, tables.load_factors(u).withColumn("trip_id", F.col("trip_id").cast("long")).withColumn("route_id", F.col("route_id").cast("long")))


@_query("street_factors", "SELECT o_orderkey AS id, (CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 37 WHEN 3 THEN NULL WHEN 4 THEN 70 ELSE 162 END)::DOUBLE AS factor FROM orders")
def street_factors(spark, sf_dir):
    pick = lambda xs: "element_at(array(" + ", ".join("cast(null AS string)" if x is None else f"'{x}'" for x in xs) + "), cast(o_orderkey % 6 + 1 AS int))"
    uses = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", pick(["walk", "e_bike", "bicycle", "e_scooter", "car", "car"]) + " AS street_mode", pick([None, "fast", "conventional", "kick", "BEV", "ICE"]) + " AS vehicle_class", pick([None, "private", "private", "shared", "private", "private"]) + " AS service_model")
    user = tables.load_street_factors(spark.createDataFrame([("e_bike", "fast", None, "50", "0", "0", "0"), ("e_scooter", "kick", "shared", "5", None, "1", "1")], "street_mode string, vehicle_class string, service_model string, vehicle string, fuel string, infrastructure string, operations string"))
    return tables.street_factors(uses, tables.shipped_street_factors(spark), user).select("id", "factor")


@_query("cost_accounts", "SELECT o_orderkey AS id, round(o_totalprice / 1000 * CASE o_orderkey % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.047 WHEN 2 THEN 0.047 END, 8)::DOUBLE AS cost_private, round(o_totalprice / 1000 * CASE o_orderkey % 4 WHEN 0 THEN 0.018 END, 8)::DOUBLE AS cost_societal, 'EUR2017' AS currency FROM orders")
def cost_accounts(spark, sf_dir):
    user = tables.load_costs(spark.createDataFrame([("private", "car", "total", 0.3)], "perspective string, street_mode string, component string, cost_per_km double"))
    costs = tables.layered_costs(tables.shipped_costs(spark).withColumn("component", F.expr("IF(perspective = 'private', 'total', component)")), user)
    t = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "element_at(array('car', 'bicycle', 'e_bike', 'e_scooter'), cast(o_orderkey % 4 + 1 AS int)) AS street_mode", "o_totalprice AS network_distance_m")
    both = tables.accounts(t, costs, ["private"]).withColumnRenamed("currency", "c0")
    out = tables.accounts(both, costs, ["societal"], ["climate", "air_pollution"])
    return out.select("id", F.round("cost_private", 8).alias("cost_private"), F.round("cost_societal", 8).alias("cost_societal"), "currency")


_AREAS = "areas AS (SELECT * FROM (VALUES (0, 24.0, 60.0, 24.08, 60.05, 100.0, 5.0), (1, 24.05, 60.02, 24.15, 60.09, 400.0, 1.0), (2, 24.05, 60.02, 24.15, 60.09, 400.0, 3.0), (3, 24.5, 60.0, 24.6, 60.1, 9.0, 9.0)) a(id, x0, y0, x1, y1, s, m))"


@_query("parking_costs", f"WITH {_AREAS}, p AS (SELECT c_custkey AS point, 24 + (c_custkey * 29 % 1000) / 5000.0::DOUBLE AS x, 60 + (c_custkey * 17 % 1000) / 10000.0::DOUBLE AS y FROM customer) SELECT point, coalesce(max(s), 300)::DOUBLE AS seconds, coalesce(max(m) FILTER (s = t), 0)::DOUBLE AS metres FROM (SELECT point, s, m, max(s) OVER (PARTITION BY point) AS t FROM p LEFT JOIN areas ON x > x0 AND x < x1 AND y > y0 AND y < y1) GROUP BY 1")
def parking_costs(spark, sf_dir):
    box = "array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x0, 'y', y1))"
    areas = spark.sql("SELECT * FROM VALUES (24.0D, 60.0D, 24.08D, 60.05D, 100.0D, 5.0D), (24.05D, 60.02D, 24.15D, 60.09D, 400.0D, 1.0D), (24.05D, 60.02D, 24.15D, 60.09D, 400.0D, 3.0D), (24.5D, 60.0D, 24.6D, 60.1D, 9.0D, 9.0D) AS a(x0, y0, x1, y1, seconds, metres)").selectExpr(f"{box} AS ring", "seconds", "metres")
    points = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS point", "24 + (c_custkey * 29 % 1000) / 5000.0D AS x", "60 + (c_custkey * 17 % 1000) / 10000.0D AS y")
    return tables.parking_costs(points, tables.parking_option(areas, "car")).select("point", "seconds", "metres")


@_query("urban_edges", "SELECT c_custkey AS edge FROM (SELECT *, 24 + (c_custkey * 29 % 1000) / 5000.0::DOUBLE AS x, 60 + (c_custkey * 17 % 1000) / 10000.0::DOUBLE AS y FROM customer) WHERE x < 24.1003 AND x + 0.02 > 24.0503 AND y > 60.0203 AND y < 60.0703")
def urban_edges(spark, sf_dir):
    ring = "array(named_struct('x', 24.0503D, 'y', 60.0203D), named_struct('x', 24.1003D, 'y', 60.0203D), named_struct('x', 24.1003D, 'y', 60.0703D), named_struct('x', 24.0503D, 'y', 60.0703D))"
    lines = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS edge", "24 + (c_custkey * 29 % 1000) / 5000.0D AS x1", "60 + (c_custkey * 17 % 1000) / 10000.0D AS y1").selectExpr("*", "x1 + 0.02D AS x2", "y1 AS y2")
    return tables.crossing(lines, spark.sql(f"SELECT {ring} AS ring"))


@_query("stop_chunk", "SELECT c_custkey AS id FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE r // ((n + 2) // 3) = 1")
def stop_chunk(spark, sf_dir):
    return sink.chunk(fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id"), "id", 1, 3)


def _streamed(spark, sf_dir, name: str, **options):
    net = _net(spark, sf_dir)

    def make(origins):
        seeds = origins.selectExpr("origin", "departure", "stop", "arrival")
        f = jn.fastest(jn.earliest(net, seeds, 2))
        return f.selectExpr("origin AS from_id", "stop AS to_id", "arrival - departure AS travel_time_s")

    path = f"{staging.folder(spark)}/{name}-{uuid.uuid4().hex}"
    return path, lambda **more: sink.run(_from_all(spark, sf_dir), make, path, sink.fingerprint("times", ["from_id", "to_id", "travel_time_s"], "morning", {"rounds": 2}), size=40, **options, **more)


_TIMES = _with("SELECT o AS from_id, stop AS to_id, a - d AS travel_time_s FROM b2", morning_sql(), *[x.replace("SELECT * FROM calls WHERE true", "SELECT * FROM mc") for x in rounds_sql("SELECT stop AS o, 28800::BIGINT AS d, stop, 28800::BIGINT AS a FROM stops", 2)])


@_query("streamed_matrix", _TIMES)
def streamed_matrix(spark, sf_dir):
    path, run = _streamed(spark, sf_dir, "streamed")
    run()
    return sink.read(spark, path, verify=True)


@_query("resumed_matrix", _TIMES)
def resumed_matrix(spark, sf_dir):
    """A run that lost its last batch, and is resumed."""
    path, run = _streamed(spark, sf_dir, "resumed")
    run()
    sink.Store(spark, path).remove("batch=000000")
    run(resume=True)
    return sink.read(spark, path)


@_query("saved_network", _with("SELECT route, count(*) AS n_calls, sum(arr) AS arr, round(sum(lat), 6) AS lat FROM calls JOIN stops USING (stop) GROUP BY 1"))
def saved_network(spark, sf_dir):
    path = f"{staging.folder(spark)}/network-{uuid.uuid4().hex}"
    artifact.save({"calls": fx.stop_times(spark, sf_dir), "stops": fx.stops(spark, sf_dir)}, path, {"from": "fixture"})
    t = artifact.load(spark, path)
    return t["calls"].join(F.broadcast(t["stops"]), "stop").groupBy("route").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("arr").alias("arr"), F.round(F.sum("lat"), 6).alias("lat"))
