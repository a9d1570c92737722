"""Feeds read from text, journeys over them, fares, sinks and artifacts, on small networks with literal answers."""

import itertools
import math
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from isochrona import api
from isochrona.functions import scalars
from isochrona.operators import accounts, chains, distances, fares, journeys, osm, paths, policies, tables, timetable
from isochrona.sources import artifact, gtfs
from isochrona.streaming import sink

CALENDAR = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"


def feed(folder, stops, routes, trips, calls, calendar, pack=False, **more):
    files = {
        "agency": "agency_id,agency_name,agency_timezone\nA,One,UTC\n", "stops": "stop_id,stop_lat,stop_lon\n" + "".join(f"{s},{a},{o}\n" for s, a, o in stops),
        "routes": "route_id,route_type,route_color\n" + "".join(f"{r},{t},zzz\n" for r, t in routes), "trips": "route_id,service_id,trip_id\n" + "".join(f"{r},{s},{t}\n" for t, r, s in trips),
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"{t},{a},{d},{s},{i}\n" for t, own in calls.items() for i, (s, a, d) in enumerate(own)), "calendar": CALENDAR + calendar, **more,
    }
    folder.mkdir(parents=True, exist_ok=True)
    if pack:
        with zipfile.ZipFile(folder / "feed.zip", "w") as z:
            for n, t in files.items():
                z.writestr(f"{n}.txt", t)
        return str(folder / "feed.zip")
    for n, t in files.items():
        (folder / f"{n}.txt").write_text(t)
    return f"file://{folder}"


def same(stop, t):
    return (stop, t, t)


@pytest.fixture(scope="module")
def two_lines(spark, tmp_path_factory):
    calls = {
        "BUS_IN_1": [same("A", "08:00:00"), same("H", "08:05:00")], "BUS_OUT_1": [same("H", "08:07:00"), same("B", "08:15:00")], "BUS_IN_2": [same("A", "08:15:00"), same("H", "08:20:00")],
        "BUS_OUT_2": [same("H", "08:30:00"), same("B", "08:38:00")], "TRAM_1": [same("A", "08:00:00"), same("B", "08:30:00")], "TRAM_2": [same("A", "08:15:00"), same("B", "08:45:00")],
    }
    route = {t: t.rpartition("_")[0] for t in calls}
    path = feed(tmp_path_factory.mktemp("two") / "f", [("A", 60.0, 24.0), ("H", 60.0, 24.03), ("B", 60.0, 24.05)], [("BUS_IN", 3), ("BUS_OUT", 3), ("TRAM", 0)], [(t, r, "SV") for t, r in route.items()], calls, "SV,1,1,1,1,1,1,1,20220101,20221231\n", pack=True)
    net = api.TransportNetwork.from_gtfs(spark, path)
    lengths = {"BUS_IN": 1600.0, "BUS_OUT": 1100.0, "TRAM": 2800.0}
    return net.with_distances(spark.createDataFrame([(t, [0.0, lengths[r]]) for t, r in route.items()], "trip string, cum array<double>"))


def test_fast_and_clean_journeys_are_on_the_frontier(two_lines):
    got = two_lines.journey_frontier("A", "B", "2022-02-22", "08:00:00", window=1200).collect()
    on = {(r.travel_time_s, r.rides, round(r.grams, 3)) for r in got if r.frontier}
    assert on == {(15 * 60, 2, round(2.7 * 92, 3)), (30 * 60, 1, round(2.8 * 25, 3))}
    assert {(r.departure, r.arrival) for r in got if r.frontier} == {(28800, 29700), (28800, 30600), (29700, 31500)}
    fast = two_lines.least(two_lines.journey_frontier("A", "B", "2022-02-22", "08:00:00"), "grams").collect()
    assert [(r.travel_time_s, r.rides) for r in fast] == [(1800, 1)]
    diverse = two_lines.journey_frontier("A", "B", "2022-02-22", "08:00:00", candidates="diverse").collect()
    assert [r.travel_time_s for r in diverse] == [900, 1800]
    with pytest.raises(ValueError):
        two_lines.journey_frontier("A", "B", "2022-02-22", "08:00:00", candidates="other")


def test_itineraries_costs_and_fares(spark, two_lines):
    legs = two_lines.detailed_itineraries("A", "B", "2022-02-22", "08:00:00").where("leg_type = 'transit'").orderBy("option", "segment").collect()
    assert [(r.option, r.trip, r.dep, r.arr, r.metres) for r in legs] == [(0, "TRAM_1", 28800, 30600, 2800.0), (1, "BUS_IN_1", 28800, 29100, 1600.0), (1, "BUS_OUT_1", 29220, 29700, 1100.0)]
    cost = {r.to_id: r for r in two_lines.travel_cost_matrix(["A"], "2022-02-22", "08:00:00").collect()}
    assert (cost["B"].travel_time_s, cost["B"].transfers, cost["B"].transit_distance_m, cost["B"].emissions) == (900, 1, 2700.0, pytest.approx(2.7 * 92))
    assert (cost["A"].travel_time_s, cost["A"].transfers, cost["A"].emissions) == (0, 0, 0.0)
    s = fares.setup(two_lines.routes.withColumn("route_short_name", F.lit("x")), 6.0)
    s = fares.Structure(s.types.withColumn("fare", F.expr("IF(type = 'BUS', 4.0D, 6.0D)")), s.pairs.where("first_leg = 'BUS' AND second_leg = 'BUS'").withColumn("fare", F.lit(10.0)), s.routes, 1, 10.0)
    got = {r.cutoff: (r.travel_time_s, r.fare, r.rides) for r in two_lines.fare_frontier(["A"], "2022-02-22", "08:00:00", s, [6.0, 8.0, 10.0]).where("to_id = 'B'").collect()}
    assert got == {6.0: (1800, 6.0, 1), 8.0: (1800, 6.0, 1), 10.0: (900, 10.0, 2)}


def test_time_matrix_windows_exclusions_and_saving(spark, two_lines, tmp_path):
    times = lambda **o: {(r.from_id, r.to_id): r.travel_time_s for r in two_lines.travel_time_matrix(["A", "H"], "2022-02-22", "08:00:00", **o).collect()}
    assert times() == {("A", "A"): 0, ("A", "H"): 300, ("A", "B"): 900, ("H", "H"): 0, ("H", "B"): 900}
    assert times(exclude_routes=["BUS_OUT", "nowhere"])[("A", "B")] == 1800
    assert ("A", "H") not in times(exclude_stops=["H"]) and times(exclude_stops=["H"])[("A", "B")] == 1800
    assert times(max_transfers=0)[("A", "B")] == 1800 and times(exclude_trips=["BUS_IN_1"])[("A", "H")] == 1200
    with pytest.raises(ValueError):
        times(exclude_stops=["Z"])
    with pytest.raises(ValueError):
        times(router="other")
    assert two_lines.travel_time_matrix(["A"], "2023-02-22", "08:00:00").count() == 1
    ranks = {r.to_id: r for r in two_lines.travel_time_matrix(["A"], "2022-02-22", "08:00:00", window=1200, percentiles=[0, 50, 100]).collect()}
    assert (ranks["H"].travel_time_p0_s, ranks["H"].travel_time_p50_s, ranks["H"].travel_time_p100_s) == (300, 840, None)
    two_lines.save(f"file://{tmp_path}/net")
    back = api.TransportNetwork.load(spark, f"file://{tmp_path}/net")
    assert back.digest() == two_lines.digest() and {(r.from_id, r.to_id) for r in back.travel_time_matrix(["H"], "2022-02-22", "08:00:00").collect()} == {("H", "H"), ("H", "B")}
    assert two_lines.summary().first().asDict() == {"n_stops": 3, "n_routes": 3, "n_trips": 6, "n_patterns": 3, "n_transfers": 0}


def test_runs_of_the_day_before_are_boarded(spark, tmp_path):
    path = feed(tmp_path / "n", [("N1", 60.0, 24.0), ("N2", 60.0, 24.1)], [("R", 3)], [("T", "R", "MON")], {"T": [same("N1", "25:00:00"), same("N2", "25:20:00")]}, "MON,1,0,0,0,0,0,0,20220221,20220221\n")
    net = api.TransportNetwork.from_gtfs(spark, path)
    go = lambda date: [(r.departure, r.arrival, r.path[0].dep) for r in net.route_between_stops("N1", "N2", date, "00:30:00").collect()]
    assert go("2022-02-22") == [(1800, 4800, 3600)] and go("2022-02-21") == [(1800, 91200, 90000)] and go("2022-02-23") == []
    assert [(r.departure, r.arrival) for r in net.route_between_stops("N1", "N2", "2022-02-22", "00:30:00", window=3600).collect()] == [(3600, 4800)]


def test_faulty_feeds(spark, tmp_path):
    stops, routes, cal = [("S1", 60.0, 24.0), ("S2", 60.0, 24.1), ("0:S1", "", "")], [("R", 3)], "W,1,1,1,1,1,1,1,20220101,20221231\n"
    calls = {"T_OK": [same("S1", "08:00:00"), same("S2", "08:10:00")], "T_BACK": [same("S1", "09:00:00"), same("S2", "08:30:00")]}
    path = feed(tmp_path / "q", stops, routes, [("T_OK", "R", "W"), ("T_BACK", "R", "W"), ("T_NONE", "R", "NEVER")], calls, cal)
    f = gtfs.read(spark, path)
    gtfs.check_references(f)
    assert {tuple(r) for r in gtfs.findings(f, spark).collect()} == {("stop without coordinates", "0:S1"), ("service never runs", "T_NONE")}
    net = api.TransportNetwork.from_gtfs(spark, path)
    assert {tuple(r) for r in net.quarantined.collect()} == {("T_BACK", "backwards"), ("T_NONE", "no stop times")}
    assert [r.arrival for r in net.route_between_stops("S1", "S2", "2022-02-22", "07:00:00").collect()] == [8 * 3600 + 600]
    assert gtfs.resolve_stop(f, "0:S1") == "0:S1"
    both = gtfs.read(spark, path, path)
    assert gtfs.resolve_stop(both, "0:S2") == "0:S2" and both["trips"].where("trip_id = '1:T_OK' AND route_id = '1:R'").count() == 1
    with pytest.raises(ValueError):
        gtfs.resolve_stop(both, "S2")
    with pytest.raises(ValueError):
        gtfs.resolve_stop(f, "S9")
    with pytest.raises(ValueError):
        gtfs.check_references(gtfs.read(spark, feed(tmp_path / "r", stops, routes, [("T_OK", "R9", "W")], {"T_OK": calls["T_OK"]}, cal)))
    with pytest.raises(ValueError):
        gtfs.check_references(gtfs.read(spark, feed(tmp_path / "s", stops, routes, [("T_OK", "R", "W")], {"T_OK": [same("S1", "08:61:00"), same("S2", "09:00:00")]}, cal)))
    with pytest.raises(ValueError):
        gtfs.read(spark, f"file://{tmp_path}/nowhere")
    ragged = feed(tmp_path / "t", stops, routes, [("T_OK", "R", "W")], {"T_OK": calls["T_OK"]}, cal)
    (tmp_path / "t" / "routes.txt").write_text("route_id,route_type,route_color\nR,3\n")
    with pytest.raises(Exception, match="(?i)malformed|read"):
        gtfs.read(spark, ragged)["routes"].collect()


def test_chains_equal_a_plain_first_fit(spark):
    rows = [(t, 0, p, p, s + p * h, s + p * h) for t, (s, h) in enumerate([(0, 100), (10, 50), (20, 100), (30, 10), (30, 10), (200, 5)]) for p in range(4)]
    got = {r.trip: (r.chain, r["rank"]) for r in chains.fifo_chains(spark.createDataFrame(rows, "trip long, route long, pos int, stop int, arr long, dep long")).collect()}
    assert got == {0: (0, 0), 2: (0, 1), 1: (1, 0), 3: (2, 0), 4: (2, 1), 5: (1, 1)}
    numbers = chains.dense_trips(chains.fifo_chains(spark.createDataFrame(rows, "trip long, route long, pos int, stop int, arr long, dep long"))).orderBy("number").collect()
    assert [r.number for r in numbers] == list(range(6)) and [r.trip for r in numbers] == [0, 2, 1, 5, 3, 4]


def test_exact_frontier_of_three_lines(spark):
    rows = [(1, 0, 0, 0, 100, 0.0, 100.0), (1, 0, 1, 3, 500, 1000.0, 100.0), (2, 1, 0, 0, 100, 0.0, 10.0), (2, 1, 1, 3, 900, 1000.0, 10.0), (3, 2, 0, 0, 100, 0.0, 100.0), (3, 2, 1, 1, 300, 500.0, 100.0), (4, 3, 0, 1, 400, 0.0, 10.0), (4, 3, 1, 3, 700, 500.0, 10.0)]
    net = journeys.prepare(spark.createDataFrame([(t, r, p, s, a, a, c, f) for t, r, p, s, a, c, f in rows], "trip long, route long, pos int, stop long, arr long, dep long, cum double, factor double"))
    seeds = spark.createDataFrame([(0, 50, 0, 50)], "origin long, departure long, stop long, arrival long")
    got = sorted((r.arrival, r.grams, r.rides) for r in journeys.frontier(net, seeds, 4).where("stop = 3").collect())
    assert got == [(500, 100.0, 1), (700, 55.0, 2), (900, 10.0, 1)]
    bucketed = sorted((r.arrival, r.rides) for r in journeys.frontier(net, seeds, 4, bucket=60.0).where("stop = 3").collect())
    assert bucketed == [(500, 1), (700, 2), (900, 1)]
    assert sorted(r.arrival for r in journeys.frontier(net, seeds, 4, horizon=700).where("stop = 3").collect()) == [500, 700]


def test_walks_of_unclosed_sets_leave_from_every_ride(spark):
    """Stop 1 is known by a faster walk; a ride there must still be walked on from where walks are not closed."""
    rows = [(1, 0, 0, 0, 100), (1, 0, 1, 1, 200), (2, 1, 0, 2, 400), (2, 1, 1, 3, 500), (3, 2, 0, 0, 100), (3, 2, 1, 4, 150)]
    net = journeys.prepare(spark.createDataFrame([(t, r, p, s, a, a) for t, r, p, s, a in rows], "trip long, route long, pos int, stop long, arr long, dep long"))
    seeds = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 160)], "origin long, departure long, stop long, arrival long")
    walks = spark.createDataFrame([(1, 2, 100)], "from_stop long, to_stop long, seconds long")
    reach = lambda exact: {r.stop for r in journeys.earliest(net, seeds, 3, walks, exact=exact).collect()}
    assert 3 not in reach(False) and 3 in reach(True)


def test_rule_fares_have_the_published_values(spark):
    types = spark.createDataFrame([("bus", False, False, False, 4.8), ("rail", True, False, False, 4.5)], fares.TYPES)
    pairs = spark.createDataFrame([("bus", "bus", 7.2), ("bus", "rail", 8.37), ("rail", "bus", 8.37)], fares.PAIRS)
    routes = spark.createDataFrame([("", "", r, "", "", k, 1.0, k) for r, k in (("b1", "bus"), ("b2", "bus"), ("b3", "bus"), ("r1", "rail"), ("r2", "rail"))], fares.ROUTES)
    s = fares.Structure(types, pairs, routes, 1, 60.0)
    known = {r.route_id: r for r in fares.route_fares(s).collect()}

    def rides(*steps):
        return [Row(type=known[r].type if r in known else None, route=r, fare=known[r].fare if r in known else None, unlimited=known[r].unlimited if r in known else None, same_route=known[r].same_route if r in known else None, board=t) for r, t in steps]

    cases = [([("b1", 0)], 4.8), ([("r1", 0)], 4.5), ([("b1", 0), ("b2", 1800)], 7.2), ([("b1", 0), ("b2", 4000)], 9.6), ([("b1", 0), ("r1", 600)], 8.37), ([("r1", 0), ("b1", 600)], 8.37), ([("r1", 0), ("r2", 9000)], 4.5), ([("b1", 0), ("b2", 600), ("b3", 1200)], 12.0), ([("b1", 0), ("b1", 600)], 9.6), ([("zz", 0)], None), ([], 0.0)]
    df = spark.createDataFrame([(i, rides(*c)) for i, (c, _) in enumerate(cases)], "id int, rides array<struct<type:string,route:string,fare:double,unlimited:boolean,same_route:boolean,board:bigint>>")
    got = [r.f for r in df.select("id", fares.journey_fare(F.col("rides"), s).alias("f")).orderBy("id").collect()]
    assert [None if g is None else round(g, 6) for g in got] == [w for _, w in cases]
    cap = fares.Structure(types, pairs, routes, 1, 60.0, 5.0)
    assert [r.f for r in df.where("id IN (2, 9)").orderBy("id").select(fares.journey_fare(F.col("rides"), cap).alias("f")).collect()] == [5.0, None]


def test_fare_structures_survive_their_file(spark, tmp_path):
    s = fares.setup(spark.createDataFrame([("0017", "L", 3), ("NA", None, 900)], "route_id string, route_short_name string, route_type int"), 2.0)
    fares.write_structure(fares.Structure(s.types, s.pairs, s.routes, 2, 90.0, 7.5), str(tmp_path / "f.zip"))
    back = fares.read_structure(spark, str(tmp_path / "f.zip"))
    assert (back.discounts, back.allowance, back.cap) == (2, 90.0, 7.5)
    for a, b in ((s.types, back.types), (s.pairs, back.pairs)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert {(r.route_id, r.mode, r.fare_type) for r in back.routes.collect()} == {("0017", "BUS", "BUS"), ("NA", "900", "900")}
    with pytest.raises(ValueError):
        fares.setup(s.routes, 1.0, "ROUTE")


def test_zone_products_from_fare_files(spark):
    text = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    attributes = text([("z", "3.0", "1", "3600", "A"), ("r", "2.0", "", "", "A"), ("od", "1.5", None, None, "A"), ("any", "9.0", None, None, "A")], "fare_id price transfers transfer_duration agency_id")
    rules = text([("z", None, None, None, "Z1"), ("z", "x", None, None, "Z2"), ("r", "x", None, None, None), ("od", None, "Z1", "Z3", None)], "fare_id route_id origin_id destination_id contains_id")
    p = {x["fare_id"]: x for x in fares.zone_products(attributes, rules, text([("x", "A"), ("y", None)], "route_id agency_id"), text([("A",)], "agency_id"))}
    assert p["z"]["zones"] == ["Z1", "Z2"] and p["z"]["routes"] is None and p["z"]["transfers"] == 1 and p["r"]["routes"] == ["x"] and p["od"]["clauses"] == [("Z1", "Z3", None)]
    assert all(x["agency_routes"] == ["x", "y"] for x in p.values())
    assert {x["fare_id"] for x in fares.zone_products(attributes, rules, reading="zones")} == {"z", "any"}
    with pytest.raises(ValueError):
        fares.zone_products(attributes.drop("agency_id"), rules, agencies=text([("A",), ("B",)], "agency_id"))


def test_sink_resumes_and_refuses(spark, tmp_path):
    origins, made = spark.range(10).withColumnRenamed("id", "origin"), []

    def make(o):
        made.append(sorted(r.origin for r in o.collect()))
        return o.selectExpr("origin AS from_id", "origin * 2 AS x")

    path = f"file://{tmp_path}/run"
    w = sink.run(origins, make, path, "key", size=4)
    assert (w.rows, w.batches, w.made) == (10, 3, 3) and made == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    with pytest.raises(ValueError):
        sink.run(origins, make, path, "key", size=4)
    for other in ({"key": "other", "size": 4}, {"key": "key", "size": 5}):
        with pytest.raises(ValueError):
            sink.run(origins, make, path, resume=True, **other)
    store = sink.Store(spark, path)
    store.remove("batch=000001")
    store.write("_part-left/x", "y")
    with pytest.raises(ValueError):
        sink.run(origins, lambda o: o.selectExpr("cast(origin AS string) AS from_id"), path, "key", size=4, resume=True)
    w = sink.run(origins, make, path, "key", size=4, resume=True)
    assert (w.rows, w.made, made[-1]) == (10, 1, [4, 5, 6, 7]) and not store.exists("_part-left") and not store.exists(sink.CLAIM)
    assert sorted(r.x for r in sink.read(spark, path, verify=True).collect()) == list(range(0, 20, 2))
    one = sink.run(origins, make, f"file://{tmp_path}/one.parquet", "key")
    assert one.rows == 10 and (tmp_path / "one.parquet").is_file()
    with pytest.raises(ValueError):
        sink.run(origins, make, f"file://{tmp_path}/one.parquet", "key", resume=True)
    with pytest.raises(ValueError):
        sink.run(origins, make, f"file://{tmp_path}/none", "key", resume=True)
    store.write(sink.CLAIM, "held")
    with pytest.raises(Exception, match="(?i)exist"):
        sink.run(origins, make, path, "key", size=4, resume=True)
    assert sink.fingerprint("a", ["x"], "n", {"p": 0.1}) != sink.fingerprint("a", ["x"], "n", {"p": 0.1000000001})


def test_damaged_and_newer_networks_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    artifact.save({"t": spark.range(5)}, path)
    artifact.save({"t": spark.range(6)}, path, {"k": 1.5})
    assert artifact.load(spark, path)["t"].count() == 6
    spark.range(7).write.mode("overwrite").parquet(f"{path}/t")
    with pytest.raises(ValueError):
        artifact.load(spark, path)
    assert artifact.load(spark, path, verify=False)["t"].count() == 7
    store = sink.Store(spark, path)
    store.replace(artifact.MANIFEST, store.read(artifact.MANIFEST).replace('"version": 1', '"version": 2'))
    with pytest.raises(ValueError):
        artifact.load(spark, path)
    assert artifact.content_digest({"t": spark.range(9)}) == artifact.content_digest({"t": spark.range(9).orderBy(F.desc("id")).repartition(3)})


def test_distance_rungs(spark):
    stops = [Row(lat=60.0, lon=24.0 + i / 100) for i in range(3)]
    shape = spark.createDataFrame([("P", i, 60.0, 24.0 + i / 200) for i in range(5)] + [("Q", i, 60.01, 24.0 + i / 200) for i in range(5)] + [("D", i, 60.0, 24.0 + i / 100) for i in range(3)], "shape string, seq int, lat double, lon double")
    raw = {"m": [0.0, 700.0, 1400.0], "km": [3.0, 3.7, 4.4], "down": [0.0, 900.0, 700.0], "far": [0.0, 1e6, 2e6], "none": [None, None, None]}
    trips = [("m", None, 3), ("km", None, 3), ("down", "P", 3), ("far", "Q", 3), ("none", "D", 2)]
    df = spark.createDataFrame([(t, s, k, stops, raw[t]) for t, s, k in trips], "trip string, shape string, route_type int, stops array<struct<lat:double,lon:double>>, raw array<double>")
    got = {r.trip: r for r in distances.ladder(df, shape).collect()}
    assert got["m"].cum == [0.0, 700.0, 1400.0] and [round(x, 6) for x in got["km"].cum] == [0.0, 700.0, 1400.0] and got["down"].provenance == "shape_linref"
    assert abs(got["down"].cum[1] - 558.0) < 1.5 and abs(got["down"].cum[2] - 2 * got["down"].cum[1]) < 1e-6
    crow = 2 * 6371000 * math.asin(math.sqrt(math.cos(math.radians(60)) ** 2 * math.sin(math.radians(0.005)) ** 2))
    assert got["far"].provenance == "crow_fly" and abs(got["far"].cum[1] - 1.4 * crow) < 1e-6 and abs(got["none"].cum[2] - 2.4 * crow) < 1e-6
    assert {r.provenance: r.n_trips for r in distances.provenance_counts(distances.ladder(df, shape)).collect()} == {"shape_dist": 2, "shape_linref": 1, "crow_fly": 2}
    bad = spark.createDataFrame([("a", [0.0, 1.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.5]), ("c", [0.0, float("nan")]), ("d", [0.0, 0.0])], "trip string, cum array<double>")
    assert {r.trip for r in distances.faulty(bad).collect()} == {"a", "b", "c"}


def test_geometry_slices_and_binary(spark):
    import struct

    df = spark.createDataFrame([([Row(x=0.0, y=0.0), Row(x=10.0, y=0.0), Row(x=10.0, y=10.0)], [0.0, 10.0, 20.0])], "p array<struct<x:double,y:double>>, m array<double>")
    cut = df.select(distances.sliced(F.col("p"), F.col("m"), F.lit(5.0), F.lit(15.0)).alias("c")).first().c
    assert [(q.x, q.y) for q in cut] == [(5.0, 0.0), (10.0, 0.0), (10.0, 5.0)]
    assert len(df.select(distances.sliced(F.col("p"), F.col("m"), F.lit(10.0), F.lit(10.0)).alias("c")).first().c) == 1
    wkb = df.select(scalars.wkb_line(F.col("p")).alias("w"), scalars.wkb_lines(F.array("p", "p")).alias("v")).first()
    assert wkb.w == struct.pack("<BII6d", 1, 2, 3, 0, 0, 10, 0, 10, 10) and wkb.v[:9] == struct.pack("<BII", 1, 5, 2) and len(wkb.v) == 9 + 2 * len(wkb.w)


def test_validated_tables(spark):
    transit = lambda rows, cols: tables.load_factors(spark.createDataFrame(rows, cols))
    got = transit([("NA", " ", "3.0", "5")], "trip_id string, route_id string, route_type string, fuel string").first()
    assert (got.trip_id, got.route_id, got.route_type, got.fuel, got.vehicle) == ("NA", None, 3, 5.0, None)
    for rows, cols in (([("a", "-1")], "trip_id string, fuel string"), ([("a", "inf")], "trip_id string, fuel string"), ([("a", "x")], "trip_id string, fuel string"), ([("a", "")], "trip_id string, fuel string"), ([("a", "1")], "what string, fuel string"), ([("a",)], "trip_id string"), ([("-3", "1")], "route_type string, fuel string")):
        with pytest.raises(ValueError):
            transit(rows, cols)
    with pytest.raises(ValueError):
        tables.load_street_factors(spark.createDataFrame([("car", None, "shared", "1")], "street_mode string, vehicle_class string, service_model string, fuel string"))
    with pytest.raises(ValueError):
        tables.load_costs(spark.createDataFrame([("p", "car", "x", 1.0), ("p", "car", "x", 2.0)], "perspective string, street_mode string, component string, cost_per_km double"))
    with pytest.raises(ValueError):
        tables.costs_per_km(tables.shipped_costs(spark), "societal", ["nothing"])
    assert tables.car_options("car", 2) == (2.0, None) and tables.car_options("walk") == (1.0, None)
    for bad in (("walk", 2), ("car", 0.5), ("car", True), ("car", 1, 3)):
        with pytest.raises(ValueError):
            tables.car_options(*bad)
    assert tables.parking_option(True, "car") == (300.0, 0.0) and tables.parking_option(7, "car") == (7.0, 0.0) and tables.parking_option(None, "walk") is None
    for bad in ((True, "walk"), (-1, "car"), ((1, 2, 3), "car")):
        with pytest.raises(ValueError):
            tables.parking_option(*bad)
    assert tables.keyed_by_street(tables.shipped_street_factors(spark)) and osm.delay_model() is None
    assert osm.delay_model(True, "rush", {"values": {"3": {"rush": 1.0}}, "groups": {"service": "3"}})["seconds"]["3"] == 1.0
    for bad in ((False, "rush"), (True, "noon"), (True, None, {"x": {}}), (True, None, {"groups": {"rocket": "3"}}), (True, None, {"ramp_shares": {"rush": -1}})):
        with pytest.raises(ValueError):
            osm.delay_model(*bad)
    with pytest.raises(ValueError):
        osm.checked_limits({"moon": 3})


def test_point_in_ring_is_strict(spark):
    ring = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 4D))")
    points = [(1.0, 1.0), (2.0, 3.0), (0.0, 1.0), (2.0, 2.0), (3.5, 3.0), (5.0, 1.0), (3.0, 3.0), (1.0, 2.5)]
    df = spark.createDataFrame(points, "x double, y double").withColumn("in", tables.in_ring(F.col("x"), F.col("y"), ring))
    assert [r["in"] for r in df.collect()] == [True, False, False, False, True, False, False, True]


def test_confidence_clock_and_samples():
    assert scalars.confidence_percentiles(0.9) == [5.0, 50.0, 95.0]
    with pytest.raises(ValueError):
        scalars.confidence_percentiles(1.0)
    assert api.seconds("25:00:01") == 90001 and journeys.minute_marks(0, 0) == [0] and journeys.minute_marks(60, 61) == [60, 120] and journeys.sampled_departures(0, 100, 40) == [0, 40, 80]
    for bad in ("8:61:00", "x", "1:2"):
        with pytest.raises(ValueError):
            api.seconds(bad)
    with pytest.raises(ValueError):
        journeys.sampled_departures(0, 100, 0)
    with pytest.raises(ValueError):
        api.only_streets(occupancy=2, parking=None)
    api.only_streets(parking=None)


def test_points_are_validated(spark):
    assert api.point_list(spark.createDataFrame([(1, 60.0, 24.0, "g")], "id int, centroid_lat double, centroid_lon double, geometry string")).columns == ["id", "lat", "lon"]
    for rows, cols in (([(1, 60.0)], "id int, lat double"), ([(1, 99.0, 0.0)], "id int, lat double, lon double"), ([(1, 1.0, 0.0), (1, 2.0, 0.0)], "id int, lat double, lon double"), ([(None, 1.0, 0.0)], "id int, lat double, lon double")):
        with pytest.raises(ValueError):
            api.point_list(spark.createDataFrame(rows, cols))


def test_policies_are_checked_and_penalties_add(spark):
    own, bike, shared = policies.Vehicle("bicycle"), policies.Vehicle("bicycle", side="destination"), policies.Vehicle("e_scooter", "shared", facilities="any_stop")
    policies.check_policy([own], [], [shared])
    for bad in (([own], [bike], []), ([], [], [shared, shared]), ([], [], [policies.Vehicle("e_scooter", "shared")])):
        with pytest.raises(ValueError):
            policies.check_policy(*bad)
    with pytest.raises(ValueError):
        policies.Vehicle("car", carried=True)
    step = "struct<kind:int,route:bigint,dep:bigint,arr:bigint>"
    j = spark.createDataFrame([(1, 100, [(0, 5, 0, 50), (0, 5, 50, 100)]), (2, 120, [(0, 6, 0, 120)]), (3, 130, [(0, 7, 0, 130)])], f"id int, arrival long, path array<{step}>")
    got = {r.id: r.felt for r in policies.penalised(j, spark.createDataFrame([(5, 30), (7, None)], "route long, seconds long")).collect()}
    assert got == {1: 160, 2: 120}
    with pytest.raises(ValueError):
        policies.street_frontier(spark.createDataFrame([(1, 1, 2, None)], "source int, stop int, seconds int, grams double"))


def test_carriage_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    stops, trips = 7, []
    for t in range(30):
        s = rng.randrange(0, 900)
        trips.append([(x, s + 60 * i) for i, x in enumerate(rng.sample(range(stops), 3))])
    takes = [t % 2 == 0 for t in range(len(trips))]
    walks = {(a, (a + 1) % stops): 70 for a in range(stops)}
    cycles = {(a, (a + 2) % stops): 40 for a in range(stops)}
    parks = {1: 30, 4: 10}

    def brute(origin, rounds):
        inf = math.inf
        best = {("c", origin): 0}
        if origin in parks:
            best["f", origin] = parks[origin]
            for (a, b), w in walks.items():
                if a == origin:
                    best["f", b] = min(best.get(("f", b), inf), parks[origin] + w)
        new = dict(best)
        for _ in range(rounds):
            ridden = {"c": {}, "f": {}}
            for t, calls in enumerate(trips):
                for plane in "cf":
                    if plane == "c" and not takes[t]:
                        continue
                    for i, j in itertools.combinations(range(3), 2):
                        if new.get((plane, calls[i][0]), inf) <= calls[i][1]:
                            ridden[plane][calls[j][0]] = min(ridden[plane].get(calls[j][0], inf), calls[j][1])
            carry = dict(ridden["c"])
            for (a, b), w in cycles.items():
                if a in ridden["c"]:
                    carry[b] = min(carry.get(b, inf), ridden["c"][a] + w)
            parked = {s: carry[s] + p for s, p in parks.items() if s in carry}
            sources = [*ridden["f"].items(), *parked.items()]
            free = {}
            for s, a in sources:
                free[s] = min(free.get(s, inf), a)
                for (x, y), w in walks.items():
                    if x == s:
                        free[y] = min(free.get(y, inf), a + w)
            found = {("c", s): a for s, a in carry.items()} | {("f", s): a for s, a in free.items()}
            new = {k: a for k, a in found.items() if a < best.get(k, inf)}
            best |= new
        return best

    rows = [(t, t, p, s, a, a) for t, calls in enumerate(trips) for p, (s, a) in enumerate(calls)]
    calls = spark.createDataFrame(rows, "trip long, route long, pos int, stop long, arr long, dep long")
    seeds = spark.createDataFrame([(o, 0, o, 0) for o in range(stops)], "origin long, departure long, stop long, arrival long")
    t = lambda x: spark.createDataFrame([(a, b, s) for (a, b), s in x.items()], "from_stop long, to_stop long, seconds long")
    got = policies.carriage(journeys.prepare(calls), journeys.prepare(calls.where("trip % 2 = 0")), seeds, seeds.where("false"), t(cycles), t(walks), spark.createDataFrame(list(parks.items()), "stop long, seconds long"), 3)
    got = {(r.origin, r.plane[0], r.stop): r.a for r in got.groupBy("origin", "plane", "stop").agg(F.min("arrival").alias("a")).collect()}
    assert got == {(o, plane, s): a for o in range(stops) for (plane, s), a in brute(o, 3).items()}


def test_cheapest_edges_and_equal_paths(spark):
    edges = spark.createDataFrame([(1, 0, 1, 5.0), (2, 1, 0, 4.0), (3, 2, 2, 1.0)], "edge long, u long, v long, length double")
    assert [tuple(r) for r in paths.cheapest_edges(edges).collect()] == [(0, 1, 2, 4.0)]
    arcs = spark.createDataFrame([(0, 2, 9, 1), (0, 1, 8, 1), (2, 3, 4, 1), (1, 3, 7, 1), (1, 3, 6, 1)], "u long, v long, edge long, cost long")
    best = paths.shortest_paths(arcs, spark.createDataFrame([(0, 0, 0)], "source long, v long, cost long"), 10)
    assert {r.v: (r.cost, r.pred, r.edge) for r in best.collect()} == {0: (0, None, None), 1: (1, 0, 8), 2: (1, 0, 9), 3: (2, 1, 6)}
    assert [r.edges for r in paths.path_edges(best, spark.createDataFrame([(0, 3)], "source long, target long")).collect()] == [[8, 6]]


def test_base_types_and_later_rows(spark):
    t = spark.createDataFrame([(1, 1, "A", 700), (2, 2, "A", 1501), (3, 3, "A", None)], "trip long, route long, agency string, route_type int")
    u = spark.createDataFrame([], "trip_id long, route_id long, agency_id string, route_type int, vehicle double, fuel double, infrastructure double, operations double")
    assert {r.trip: r.factor for r in accounts.factor_ladder(t, u).collect()} == {1: 92.0, 2: None, 3: None}


def test_two_feeds_stay_apart(spark, tmp_path):
    cal = "W,1,1,1,1,1,1,1,20220101,20221231\n"
    one = feed(tmp_path / "a", [("S", 60.0, 24.0), ("E", 60.0, 24.1)], [("R", 3)], [("T", "R", "W")], {"T": [same("S", "08:00:00"), same("E", "08:10:00")]}, cal)
    net = api.TransportNetwork.from_gtfs(spark, one, one)
    got = {(r.from_id, r.to_id) for r in net.travel_time_matrix(["0:S"], "2022-02-22", "08:00:00").collect()}
    assert got == {("0:S", "0:S"), ("0:S", "0:E")} and timetable.patterns(net.calls).count() == 2


def test_the_runs_of_a_line_are_kept_in_parts(spark, monkeypatch):
    # Two runs each minute of one line, every third of them a second time by a trip of another name.
    starts = [(30 * i, i) for i in range(400)] + [(30 * i, 1000 + i) for i in range(0, 400, 3)]
    calls = [(trip, 1, pos, stop, start + 100 * pos, start + 100 * pos + 20) for start, trip in starts for pos, stop in enumerate((5, 6, 7))]
    calls = spark.createDataFrame(calls, "trip long, route long, pos int, stop int, arr long, dep long")
    seeds = spark.createDataFrame([(o, d, o, d) for o in (5, 6) for d in (0, 1, 20, 1919, 1920, 1921, 5000, 12050, 99999)], "origin int, departure long, stop int, arrival long")

    def first(gone=()):
        out = set()
        for o, d in {(o, d) for o, d, _, _ in map(tuple, seeds.collect())}:
            at = o - 5
            runs = sorted((s, t) for s, t in starts if t not in gone and s + 100 * at + 20 >= d)
            out |= {(o, d, s, runs[0][0] + 100 * (s - 5), runs[0][1]) for s in range(o + 1, 8) if runs}
        return out

    def got(net):
        return {(r.origin, r.departure, r.stop, r.arrival, r.path[0].a) for r in journeys.earliest(net, seeds, 1, paths=True).where("rides = 1").collect()}

    gone = [*range(50, 250), 1063, 1066, 399]
    for most in (10**6, 100):
        monkeypatch.setattr(journeys, "BROADCAST_RUNS", most)
        net = journeys.prepare(calls)
        assert net.lines.agg({"part": "max"}).first()[0] == len(starts) // journeys.PART
        assert max(len(r.runs) for r in net.lines.collect()) <= journeys.PART
        hints = net.lines._jdf.queryExecution().analyzed().toString()
        assert ("strategy=broadcast" in hints) == (most > len(starts))
        assert got(net) == first() and got(net.without(trips=gone)) == first(gone)


#: Queries whose lines were broadcast whole, however many runs they had.
MANY_RUNS = "arrivals_excluding_route one_to_all_arrivals pareto_rides arrivals_excluding_stop arrivals_with_walks time_matrix time_matrix_percentiles time_matrix_all_stops".split()


@pytest.mark.parametrize("name", MANY_RUNS)
def test_many_runs_are_not_broadcast(spark, monkeypatch, name):
    from isochrona.plans import registry

    folder, made = "/root/testdata/sf0.001", []
    want = sorted(map(tuple, registry.QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(registry, "_PREPARED", {})
    monkeypatch.setattr(journeys, "BROADCAST_RUNS", 500, raising=False)
    prepare = journeys.prepare
    monkeypatch.setattr(journeys, "prepare", lambda calls: made.append(prepare(calls)) or made[-1])
    assert sorted(map(tuple, registry.QUERIES[name](spark, folder).collect())) == want
    assert made and not any("strategy=broadcast" in net.lines._jdf.queryExecution().analyzed().toString() for net in made)


@pytest.mark.parametrize("most", [1, 6, 40])
def test_capped_equals_all_pairs(spark, monkeypatch, most):
    import random

    random.seed(most)
    pick = lambda n: None if random.random() < 0.01 else random.randrange(n)
    rows = [(i, pick(3), pick(9), pick(30), None if (g := pick(12)) is None else g / 4) for i in range(400)]
    # A group whose many options are all beaten by one.
    rows += [(i, 7, 5, 0 if i == 500 else 10 + i, 0.25) for i in range(500, 900)]

    def beats(y, x):
        whole = None not in x[1:] and None not in y[1:]
        return whole and y[1] == x[1] and y[2] >= x[2] and y[3] <= x[3] and y[4] <= x[4] and y[2:] != x[2:]

    want = []
    for cell in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == cell]
        top = [x for x in own if not any(beats(y, x) for y in own)]
        rest = sorted((min(x[3] - y[3] for y in top if beats(y, x)), x[4]) for x in own if x not in top)
        want += [(cell, r[0], True, 0) for r in top] + [(cell, grams, False, gap) for gap, grams in rest[: max(0, most - len(top))]]
    written, write = [], journeys.stage
    monkeypatch.setattr(journeys, "stage", lambda df, name: (lambda out: written.append(out.count()) or out)(write(df, name)))
    df = spark.createDataFrame(rows, "id long, cell long, departure long, arrival long, grams double")
    got = [(r.cell, r.id if r.frontier else r.grams, r.frontier, r.behind) for r in journeys.capped(df, ["cell"], most).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(written) <= len(rows)  # not the pairs of options


def test_chain_trip_counts_joins_nothing(spark):
    from isochrona.plans import registry

    found = registry.QUERIES["chain_trip_counts"](spark, "/root/testdata/sf0.001")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.agg(F.min("in_order")).first()[0] is True


def test_chains_with_their_times(spark):
    rows = [(t, t % 2, pos, pos, s := (t * 7) % 50 + pos * (3 + t % 4), s + 1) for t in range(200) for pos in range(4)]
    calls = spark.createDataFrame(rows, "trip long, route long, pos int, stop int, arr long, dep long")
    plain, timed = chains.fifo_chains(calls), chains.fifo_chains(calls, times=True)
    assert sorted(map(tuple, timed.drop("arrs", "deps").collect())) == sorted(map(tuple, plain.collect()))
    assert {r.trip: (r.arrs, r.deps) for r in timed.collect()} == {t: ([r[4] for r in rows if r[0] == t], [r[5] for r in rows if r[0] == t]) for t in range(200)}
    last = {}
    for r in timed.orderBy("route", "stops", "chain", "rank").collect():
        key = (r.route, r.stops, r.chain)
        assert all(x >= y for x, y in zip(r.arrs + r.deps, last.get(key, [-1] * 8), strict=True))
        last[key] = r.arrs + r.deps


@pytest.mark.parametrize("most", [200_000, 10])
def test_points_to_snap_are_not_broadcast(spark, tmp_path, monkeypatch, most):
    from isochrona.sources import staging

    spark.range(300).selectExpr("id AS point", "24 + (id % 40) / 1000D AS lon", "60 + (id % 7) / 2000D AS lat").write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    lines = spark.createDataFrame([(e, [(24 + e / 200, 60.0), (24.004 + e / 200, 60.002)]) for e in range(8)], "edge long, points array<struct<lon:double,lat:double>>")
    monkeypatch.setattr(paths, "small", lambda df: staging.small(df, most))
    found = paths.snaps(points, paths.pieces(lines), 300)
    sides = [j for j in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in j or "SortMergeJoin" in j]
    assert len(sides) == 2 and "SortMergeJoin" in sides[0] and ("BuildRight" in sides[1] if most > 10 else "SortMergeJoin" in sides[1])
    want = {r.point for r in points.collect()}
    assert {r.point for r in found.collect()} == want and all(r.connector <= 300 for r in found.collect())


def test_labels_look_through_one_part_of_a_line(spark, monkeypatch):
    from isochrona.plans import registry

    name, folder = "time_matrix_percentiles_all_stops", "/root/testdata/sf0.001"
    want = sorted(map(tuple, registry.QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(registry, "_PREPARED", {})
    monkeypatch.setattr(journeys, "PART", 3)
    assert sorted(map(tuple, registry.QUERIES[name](spark, folder).collect())) == want
    (net,) = registry._PREPARED.values()
    assert net.lines.selectExpr("max(size(runs))").first()[0] == 3


def test_a_line_is_boarded_again_only_for_an_earlier_run(spark, monkeypatch):
    import random

    random.seed(1)
    calls = []
    for route in range(3):
        stops = [random.randrange(8) for _ in range(7)]  # a line may come to a stop twice
        for i in range(40):
            start = random.randrange(6000)
            calls += [(100 * route + i, route, pos, s, start + 60 * pos, start + 60 * pos + 20) for pos, s in enumerate(stops)]
    net = journeys.prepare(spark.createDataFrame(calls, "trip long, route long, pos int, stop long, arr long, dep long"))
    seeds = spark.createDataFrame([(s, d, s, d) for s in range(8) for d in (0, 900)], "origin long, departure long, stop long, arrival long")
    closed = spark.createDataFrame([(random.randrange(8),)], "stop long")
    walks = spark.createDataFrame([(0, 5, 100), (3, 1, 30)], "from_stop long, to_stop long, seconds long")
    cases = [{}, {"paths": True, "closed": closed, "transfers": walks, "exact": True}]
    rides, made = journeys._rides, []
    monkeypatch.setattr(journeys, "_rides", lambda *args: made.append((args[:3], rides(*args))) or made[-1][1])
    got = [sorted(map(str, journeys.earliest(net, seeds, 3, **x).collect())) for x in cases]
    args, second = made[1]
    assert second.count() < rides(*args).count()
    runs = second.groupBy("origin", "departure", "step.route", "step.c").agg(F.min(F.col("step.dep") - F.col("step.c") * 60)).collect()
    by_line = {}
    for origin, departure, route, pos, start in sorted(runs):
        by_line.setdefault((origin, departure, route), []).append(start)
    assert all(x == sorted(x, reverse=True) for x in by_line.values())
    monkeypatch.setattr(journeys, "_rides", lambda *args: rides(*args[:3]))
    assert got == [sorted(map(str, journeys.earliest(net, seeds, 3, **x).collect())) for x in cases]
