"""Small cases with literal rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from isochrona.functions import scalars
from isochrona.operators import pareto, raptor, timetable


def test_blank_times_are_filled_evenly(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 1, None, None), (1, 2, 2, None, None), (1, 3, 3, 300, 300)], "trip long, pos int, stop long, arr long, dep long")
    assert [r.arr for r in timetable.interpolated(c).orderBy("pos").collect()] == [0, 100, 200, 300]


def test_backwards_and_open_trips_are_quarantined(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 1, 60, 60), (2, 0, 0, 90, 90), (2, 1, 1, 30, 30), (3, 0, 0, None, None), (3, 1, 1, 5, 5)], "trip long, pos int, stop long, arr long, dep long")
    assert sorted(map(tuple, timetable.quarantined(c).collect())) == [(2, "backwards"), (3, "missing end time")]


def test_five_stop_network(spark):
    rows = []
    for trip, route, stops, times in ((1, 0, (0, 1, 2), (100, 200, 300)), (2, 0, (0, 1, 2), (700, 800, 900)), (3, 1, (1, 3), (250, 400)), (4, 2, (4, 3), (400, 1000))):
        rows += [(trip, route, 0, i, s, t, t) for i, (s, t) in enumerate(zip(stops, times, strict=True))]
    calls = spark.createDataFrame(rows, "trip long, route long, service int, pos int, stop long, arr long, dep long")
    seeds = spark.createDataFrame([(0, 50, 0, 50)], "origin long, departure long, stop long, arrival long")
    walks = spark.createDataFrame([(2, 4, 50)], "from_stop long, to_stop long, seconds long")
    got = raptor.earliest(*timetable.lines(calls), seeds, 3, transfers=walks).where("rides > 0").select("rides", "stop", "arrival").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 200), (1, 2, 300), (1, 4, 350), (2, 3, 400)]


def test_nearest_rank_is_half_up(spark):
    df = spark.sql("SELECT array(1L, 2L, 3L, 4L) AS a, array(1L, null) AS b")
    assert df.select(scalars.nearest_rank(F.col("a"), 50), scalars.nearest_rank(F.col("b"), 100)).first() == (3, None)


def test_clock_beyond_midnight(spark):
    df = spark.createDataFrame([("25:10:05",), ("07:61:00",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.clock_seconds(F.col("t"))).collect()] == [90605, None, None]


def test_mask_leaves_null_axes_out(spark):
    df = spark.createDataFrame([(0, 500, 100.0), (0, 700, 55.0), (0, 900, 10.0), (0, 900, 60.0), (0, 100, None)], "g int, t long, e double")
    assert sorted(r.t for r in pareto.mask(df, ["g"], "t", "e").where("frontier").collect()) == [500, 700, 900]


def test_full_matrices_equal_brute_force(spark):
    from isochrona.plans import registry
    from isochrona.sources import fixtures as fx

    sf = "/root/testdata/sf0.01"
    m, trips = fx.n_stops(spark, sf), {}
    for r in fx.stop_times(spark, sf).orderBy("trip", "pos").collect():
        trips.setdefault(r.trip, []).append((r.stop, r.arr, r.dep))
    trips = [t for t in trips.values() if t[-1][1] >= registry.DEPARTURE]

    def rides(origin, departure):
        best, k = {origin: departure}, 0
        while k < 8:
            new, k = dict(best), k + 1
            for calls in trips:
                aboard = False
                for stop, arr, dep in calls:
                    if aboard and arr < new.get(stop, math.inf):
                        new[stop] = arr
                    aboard = aboard or best.get(stop, math.inf) <= dep
            if new == best:
                break
            best = new
        return best

    got = {}
    for r in registry.QUERIES["time_matrix_all_stops"](spark, sf).collect():
        got.setdefault(r.from_id, {})[r.to_id] = r.travel_time_s
    assert sorted(got) == list(range(m))
    for origin in (0, 4, 57, m - 1):
        assert got[origin] == {s: a - registry.DEPARTURE for s, a in rides(origin, registry.DEPARTURE).items()}
    ranks = registry.QUERIES["time_matrix_percentiles_all_stops"](spark, sf).collect()
    assert {r.from_id for r in ranks} == set(range(m))
    by_minute = [{s: a - d for s, a in rides(57, d).items()} for d in registry.MINUTES]
    for r in ranks:
        if r.from_id == 57:
            t = sorted(b.get(r.to_id, math.inf) for b in by_minute)
            want = [None if x == math.inf else x for x in t[1:4]]
            assert [r.travel_time_p25_s, r.travel_time_p50_s, r.travel_time_p75_s] == want


def _all_times(spark, sf, departures):
    """Seconds from all stops by (to, departure, from), infinite where not reached: eight rounds, trip by trip."""
    from isochrona.sources import fixtures as fx

    m, trips = fx.n_stops(spark, sf), {}
    for r in fx.stop_times(spark, sf).where(F.col("dep") >= min(departures)).orderBy("trip", "pos").collect():
        trips.setdefault(r.trip, []).append((r.stop, r.arr, r.dep))
    left = np.array(departures, float)[:, None]
    best = np.where(np.eye(m)[:, None, :] == 1, left, np.inf)
    for _ in range(8):
        new = best.copy()
        for calls in trips.values():
            aboard = np.zeros(best.shape[1:], bool)
            for stop, arr, dep in calls:
                np.minimum(new[stop], arr, out=new[stop], where=aboard)
                aboard |= best[stop] <= dep
        best = new
    return best - left


def test_time_matrix_is_whole(spark):
    from isochrona.plans import registry

    sf = "/root/testdata/sf0.01"
    got = {(r.from_id, r.to_id): r.travel_time_s for r in registry.QUERIES["time_matrix"](spark, sf).collect()}
    times = _all_times(spark, sf, [registry.DEPARTURE])
    assert got == {(o, s): t for (s, _, o), t in np.ndenumerate(times) if t < math.inf}


def test_time_matrix_percentiles_is_whole(spark):
    from isochrona.plans import registry

    sf = "/root/testdata/sf0.01"
    got = {(r.from_id, r.to_id): (r.travel_time_p25_s, r.travel_time_p50_s, r.travel_time_p75_s) for r in registry.QUERIES["time_matrix_percentiles"](spark, sf).collect()}
    times = np.sort(_all_times(spark, sf, registry.MINUTES), axis=1)
    want = {(o, s): tuple(None if t == math.inf else t for t in times[s, 1:4, o]) for s, o in np.argwhere(times[:, 0] < math.inf).tolist()}
    assert got == want
