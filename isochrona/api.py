"""A transport network and its queries in one object: timetable, streets' transfers, factors and fares as tables.

Each query gives a DataFrame. Dates are YYYY-MM-DD, clock times HH:MM:SS or seconds; trips of the day before that still run are
boarded a day earlier on the clock. `router` names an engine of the same answers and is checked only.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import nearest_rank
from .operators import accounts, fares, journeys, pareto, policies, timetable
from .sources import artifact, gtfs
from .sources.staging import small
from .streaming import sink

ROUTERS = ("auto", "raptor", "tbtr")
MAX_TRANSFERS, MAX_WINDOW = 7, 86_400


def seconds(clock: str | int) -> int:
    """Seconds of HH:MM:SS, hours beyond 23 allowed."""
    if isinstance(clock, int):
        return clock
    parts = clock.strip().split(":")
    if len(parts) != 3 or not all(p.isdigit() for p in parts) or int(parts[1]) > 59 or int(parts[2]) > 59:
        raise ValueError(f"no clock time: {clock!r}")
    return int(parts[0]) * 3600 + int(parts[1]) * 60 + int(parts[2])


def _router(name: str) -> None:
    if name not in ROUTERS:
        raise ValueError(f"router must be one of {', '.join(ROUTERS)}")


def only_streets(**options) -> None:
    """Options that belong to street networks are refused on a timetable."""
    if given := sorted(k for k, v in options.items() if v is not None):
        raise ValueError(f"{', '.join(given)}: only for a street network")


def point_list(points: DataFrame) -> DataFrame:
    """(id, lat, lon) of points, or of zones by their centres (centroid_lat, centroid_lon); ids must be there and differ."""
    cols = set(points.columns)
    lat, lon = next(((a, b) for a, b in (("lat", "lon"), ("centroid_lat", "centroid_lon")) if {a, b} <= cols), (None, None))
    if "id" not in cols or lat is None:
        raise ValueError("points need id and lat, lon, or centroid_lat, centroid_lon")
    out = points.select("id", F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    if out.where("id IS NULL OR lat IS NULL OR lon IS NULL OR abs(lat) > 90 OR abs(lon) > 180").limit(1).count():
        raise ValueError("a point without id or valid coordinates")
    if out.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a point's id stands twice")
    return out


@dataclass(frozen=True)
class TransportNetwork:
    """calls: trip, route, service, pos, stop, arr, dep[, cum]; calendar and exceptions as the service operators read them; stops:
    stop_id, stop_lat, stop_lon; routes: route_id, route_type, agency_id; transfers: from_stop, to_stop, seconds, metres."""

    calls: DataFrame
    calendar: DataFrame
    exceptions: DataFrame
    stops: DataFrame
    routes: DataFrame
    transfers: DataFrame | None = None
    closed: bool = True  # whether transfers are transitively closed
    factors: DataFrame | None = None  # user's transit factors
    quarantined: DataFrame | None = None
    _prepared: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def from_gtfs(spark: SparkSession, *paths: str) -> TransportNetwork:
        """Reads feeds, fills blank times, and leaves out trips whose times cannot be used (kept in `quarantined`)."""
        feed = gtfs.read(spark, *paths)
        gtfs.check_references(feed)
        calls = gtfs.calls(feed)
        bad = timetable.quarantined(calls).unionByName(gtfs.without_calls(feed))
        good = calls.join(bad.select("trip"), "trip", "left_anti")
        times = timetable.interpolated(good.select("trip", "pos", "stop", "arr", "dep"))
        whole = times.join(feed["trips"].select(F.col("trip_id").alias("trip"), F.col("route_id").alias("route"), F.col("service_id").alias("service")), "trip")
        return TransportNetwork(whole, *gtfs.services(feed, spark), feed["stops"], feed["routes"], quarantined=bad)

    def with_transfers(self, transfers: DataFrame, closed: bool = True) -> TransportNetwork:
        """With these transfers (from_stop, to_stop, seconds, metres), one for each pair: the fastest, then the shortest."""
        one = transfers.groupBy("from_stop", "to_stop").agg(F.min(F.struct("seconds", "metres")).alias("m")).select("from_stop", "to_stop", "m.*")
        return replace(self, transfers=small(one), closed=closed, _prepared={})

    def with_distances(self, distances: DataFrame) -> TransportNetwork:
        """With cumulative metres of trips' calls (trip, cum: array)."""
        one = distances.selectExpr("trip", "posexplode(cum) AS (pos, cum)")
        return replace(self, calls=self.calls.drop("cum").join(one, ["trip", "pos"], "left"), _prepared={})

    def with_factors(self, factors: DataFrame) -> TransportNetwork:
        return replace(self, factors=factors, _prepared={})

    def save(self, path: str) -> dict:
        tables = {k: v for k in ("calls", "calendar", "exceptions", "stops", "routes", "transfers", "factors", "quarantined") if (v := getattr(self, k)) is not None}
        return artifact.save(tables, path, {"closed": self.closed})

    @staticmethod
    def load(spark: SparkSession, path: str, verify: bool = True) -> TransportNetwork:
        return TransportNetwork(**artifact.load(spark, path, verify), closed=bool(artifact.manifest(spark, path)["metadata"]["closed"]))

    def digest(self) -> str:
        return artifact.content_digest({k: v for k in ("calls", "calendar", "exceptions", "stops", "transfers") if (v := getattr(self, k)) is not None})

    def summary(self) -> DataFrame:
        """One row: number of stops, routes, trips, patterns and transfers."""
        spark = self.calls.sparkSession
        n = [self.stops.count(), self.routes.count(), self.calls.select("trip").distinct().count(), timetable.patterns(self.calls).count(), self.transfers.count() if self.transfers is not None else 0]
        return spark.createDataFrame([tuple(n)], "n_stops long, n_routes long, n_trips long, n_patterns long, n_transfers long")

    def day(self, date: str) -> journeys.Network:
        """The network of a date, with the trips of the day before that still run; prepared once."""
        if date not in self._prepared:
            before = (datetime.date.fromisoformat(date) - datetime.timedelta(days=1)).isoformat()
            active = lambda d: timetable.active_services(self.calendar, self.exceptions, d).select(F.col("service_id").alias("service"))
            view = timetable.day_view(self.calls, active(date), active(before))
            types = self.routes.select(F.col("route_id").alias("route"), F.col("agency_id").alias("agency"), "route_type")
            trips = view.select("trip", "route").distinct().join(types, "route", "left")
            none = "trip_id string, route_id string, agency_id string, route_type int, vehicle double, fuel double, infrastructure double, operations double"
            user = self.factors if self.factors is not None else view.sparkSession.createDataFrame([], none)
            self._prepared[date] = journeys.prepare(view.join(accounts.factor_ladder(trips, user), "trip", "left"))
        return self._prepared[date]

    def _seeds(self, origins: DataFrame | list, departures: list[int]) -> DataFrame:
        kind = self.calls.schema["stop"].dataType.simpleString()
        o = origins if isinstance(origins, DataFrame) else self.calls.sparkSession.createDataFrame([(x,) for x in origins], f"origin {kind}")
        known = self.stops.select(F.col("stop_id").alias("origin"))
        if not isinstance(origins, DataFrame) and (lost := o.join(known, "origin", "left_anti").limit(1).collect()):
            raise ValueError(f"no stop {lost[0][0]!r}")
        d = o.select("origin", F.explode(F.array(*[F.lit(x).cast("long") for x in departures])).alias("departure"))
        return d.select("origin", "departure", F.col("origin").alias("stop"), F.col("departure").alias("arrival"))

    def _found(self, origins, date: str, departures: list[int], max_transfers: int, paths: bool, exclude_routes=(), exclude_trips=(), exclude_stops=()) -> DataFrame:
        net = self.day(date).without(list(exclude_routes), list(exclude_trips))
        closed = None
        if exclude_stops:
            closed = self.calls.sparkSession.createDataFrame([(s,) for s in exclude_stops], f"stop {self.calls.schema['stop'].dataType.simpleString()}")
            if lost := closed.join(self.stops.select(F.col("stop_id").alias("stop")), "stop", "left_anti").limit(1).collect():
                raise ValueError(f"no stop {lost[0][0]!r}")
        return journeys.earliest(net, self._seeds(origins, departures), max_transfers + 1, self.transfers, closed, paths, exact=not self.closed)

    def travel_time_matrix(self, origins, date: str, departure, window: int | None = None, percentiles: list[float] | None = None, max_transfers: int = MAX_TRANSFERS, router: str = "auto", **exclusions) -> DataFrame:
        """from_id, to_id, travel_time_s; over a window a column for each percentile of its minutes, null where that rank is not
        reached. Pairs that are never reached have no row."""
        _router(router)
        start = seconds(departure)
        if window is None:
            found = journeys.fastest(self._found(origins, date, [start], max_transfers, False, **exclusions))
            return found.select(F.col("origin").alias("from_id"), F.col("stop").alias("to_id"), (F.col("arrival") - F.col("departure")).alias("travel_time_s"))
        marks = journeys.minute_marks(start, window)
        found = journeys.fastest(self._found(origins, date, marks, max_transfers, False, **exclusions))
        each = found.groupBy("origin", "stop").agg(F.collect_list(F.col("arrival") - F.col("departure")).alias("l"))
        each = each.withColumn("l", F.concat("l", F.array_repeat(F.lit(None).cast("long"), F.lit(len(marks)) - F.size("l"))))
        names = lambda p: f"travel_time_p{p:g}_s"
        return each.select(F.col("origin").alias("from_id"), F.col("stop").alias("to_id"), *[nearest_rank(F.col("l"), p).alias(names(p)) for p in percentiles or [50]])

    def travel_cost_matrix(self, origins, date: str, departure, max_transfers: int = MAX_TRANSFERS, router: str = "auto", **exclusions) -> DataFrame:
        """from_id, to_id, travel_time_s, transfers, transit_distance_m, walk_distance_m, emissions of the fastest journeys."""
        _router(router)
        c = journeys.costs(journeys.fastest(self._found(origins, date, [seconds(departure)], max_transfers, True, **exclusions)))
        return c.selectExpr("origin AS from_id", "stop AS to_id", "arrival - departure AS travel_time_s", "greatest(rides, 1) - 1 AS transfers", "transit_m AS transit_distance_m", "walk_m AS walk_distance_m", "grams AS emissions")

    def route_between_stops(self, origin, destination, date: str, departure, window: int | None = None, max_transfers: int = MAX_TRANSFERS, **exclusions) -> DataFrame:
        """Journeys (departure, arrival, rides, path, grams) by number of rides, each earlier than all with fewer; over a window all
        that no later departure beats."""
        start = seconds(departure)
        if window is None:
            found = self._found([origin], date, [start], max_transfers, True, **exclusions)
        else:
            one = self._seeds([origin], [start]).select("origin", "stop", F.lit(0).cast("long").alias("seconds"))
            starts = [r["departure"] for r in journeys.departure_candidates(self.day(date), one, start, window).select("departure").distinct().collect()]  # of one stop
            found = journeys.undominated(self._found([origin], date, sorted(starts), max_transfers, True, **exclusions), max_transfers + 1)
        return journeys.costs(found.where((F.col("stop") == destination) & (F.col("rides") > 0))).orderBy("departure", "rides")

    def detailed_itineraries(self, origin, destination, date: str, departure, **options) -> DataFrame:
        """A row for each leg of each journey: option, segment, leg_type, stops, trip, route, times, metres, grams."""
        found = self.route_between_stops(origin, destination, date, departure, **options)
        legs = journeys.legs(found.select("origin", "stop", "departure", "rides", "path"))
        return legs.withColumn("option", F.expr("dense_rank() OVER (PARTITION BY origin, stop ORDER BY departure, rides) - 1"))

    def journey_frontier(self, origin, destination, date: str, departure, window: int | None = None, max_transfers: int = MAX_TRANSFERS, candidates: str = "pareto", bucket: float | None = None, within: int | None = None, max_slower: int | None = None, max_options: int | None = None) -> DataFrame:
        """departure, arrival, travel_time_s, rides, grams, frontier: candidates are all journeys by time, or those of the frontier
        of arrival and grams of each departure; frontier marks those that none beats in time and grams."""
        start = seconds(departure)
        marks = [start] if window is None else journeys.minute_marks(start, window)
        if candidates == "time":
            found = journeys.costs(self._found([origin], date, marks, max_transfers, True))
        elif candidates == "pareto":
            found = journeys.frontier(self.day(date), self._seeds([origin], marks), max_transfers + 1, self.transfers, bucket=bucket)
        elif candidates == "diverse":
            search = lambda banned: journeys.costs(self._found([origin], date, marks, max_transfers, True, exclude_routes=banned)).where((F.col("stop") == destination) & (F.col("rides") > 0))
            rows = [(r["departure"], r["arrival"], r["rides"], r["grams"]) for r in policies.diverse(search, max_options or 3)]
            found = self.calls.sparkSession.createDataFrame(rows, "departure long, arrival long, rides int, grams double").withColumn("stop", F.lit(destination))
        else:
            raise ValueError(f"candidates must be time, pareto or diverse, not {candidates!r}")
        own = found.where((F.col("stop") == destination) & (F.col("rides") > 0)).select("departure", "arrival", (F.col("arrival") - F.col("departure")).alias("travel_time_s"), "rides", "grams", F.lit(0).alias("all"))
        own = own if within is None else own.where(F.col("travel_time_s") <= within)
        own = own if max_slower is None else policies.within_band(own, ["departure"], max_slower)
        own = own if max_options is None or candidates == "diverse" else journeys.capped(own, ["all"], max_options, bucket).drop("frontier", "behind")
        return pareto.mask(own, ["all"], "travel_time_s", "grams").drop("all").orderBy("travel_time_s", "grams")

    def least(self, options: DataFrame, objective: str, within: int | None = None) -> DataFrame:
        """The one journey of least grams or fare, ties to the faster."""
        return pareto.least(options.withColumn("all", F.lit(0)), ["all"], objective, "travel_time_s", within).drop("all")

    def fare_frontier(self, origins, date: str, departure, structure: fares.Structure, cutoffs: list[float], max_transfers: int = MAX_TRANSFERS, max_duration: int | None = None) -> DataFrame:
        """from_id, to_id, cutoff, travel_time_s, fare, rides."""
        found = fares.fare_frontier(self.day(date), self._seeds(origins, [seconds(departure)]), structure, cutoffs, max_transfers + 1, self.transfers, max_duration)
        return found.selectExpr("origin AS from_id", "stop AS to_id", "cutoff", "travel_time_s", "fare", "rides")

    def stream_times(self, origins: DataFrame, date: str, departure, output: str, size: int = sink.BATCH, resume: bool = False, max_transfers: int = MAX_TRANSFERS) -> sink.Written:
        """The time matrix of origins (origin), written in batches under output."""
        key = sink.fingerprint("travel_time_matrix", ["from_id", "to_id", "travel_time_s"], self.digest(), {"date": date, "departure": seconds(departure), "max_transfers": max_transfers}, sink.digest(origins))
        return sink.run(origins, lambda o: self.travel_time_matrix(o.select("origin"), date, departure, max_transfers=max_transfers), output, key, size=size, resume=resume)
