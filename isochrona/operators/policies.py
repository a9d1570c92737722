"""Streets before, between and after rides by several modes: choices per stop, vehicles taken aboard, penalties and alternatives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import small, stage
from . import journeys as jn
from .pareto import skyline


@dataclass(frozen=True)
class Vehicle:
    """Terms on which a mode is granted: own or shared, on which side, taken aboard, where it may be left."""

    mode: str
    owner: str = "own"  # own, shared
    side: str = "origin"  # origin, destination
    carried: bool = False
    facilities: str | None = None  # any_stop, where a shared vehicle may be taken and left

    def __post_init__(self):
        if self.owner not in ("own", "shared") or self.side not in ("origin", "destination"):
            raise ValueError(f"no such terms: {self.owner}, {self.side}")
        if self.carried and (self.owner != "own" or self.mode not in ("bicycle", "e_bike") or self.side != "origin"):
            raise ValueError("only an own bicycle can be taken aboard, from the origin")
        if self.facilities not in (None, "any_stop"):
            raise ValueError("facilities are any_stop or none")


def check_policy(access: list[Vehicle], egress: list[Vehicle], transfers: list[Vehicle]) -> None:
    """An own vehicle serves one side unless it is carried; one transfer mode at a time; shared ones there need any_stop."""
    own = {v.mode for v in access if v.owner == "own" and not v.carried} & {v.mode for v in egress if v.owner == "own"}
    if own:
        raise ValueError(f"an own {sorted(own)[0]} cannot be on both sides")
    if len(transfers) > 1:
        raise ValueError("one transfer mode at a time")
    if any(v.owner == "shared" and v.facilities != "any_stop" for v in transfers):
        raise ValueError("a shared vehicle between rides needs facilities at any stop")


def street_choice(options: DataFrame, modes: list[str], transfers: DataFrame | None = None, towards: bool = False, closed: DataFrame | None = None) -> DataFrame:
    """(source, stop, seconds, rentals, mode): of each stop's options (source, stop, mode, seconds, rentals) the fastest, then the
    fewest rentals, then the first mode named; then, from these winners as they stand, one transfer more. towards: transfers lead
    to the chosen stop's side of an egress, i.e. are taken before it. closed stops are never chosen, nor reached by a transfer."""
    order = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    o = options.where(F.col("mode").isin(modes))
    if closed is not None:
        o = o.join(small(closed), "stop", "left_anti")
    won = o.groupBy("source", "stop").agg(F.min(F.struct("seconds", "rentals", order.alias("o"), "mode")).alias("m")).select("source", "stop", "m.seconds", "m.rentals", "m.o", "m.mode")
    if transfers is not None:
        won = stage(won, "choice")
        here, there = ("to_stop", "from_stop") if towards else ("from_stop", "to_stop")
        t = transfers.select(F.col(here).alias("stop"), F.col(there).alias("next"), F.col("seconds").alias("more"))
        hop = won.join(t, "stop").select("source", F.col("next").alias("stop"), (F.col("seconds") + F.col("more")).alias("seconds"), "rentals", "o", "mode")
        if closed is not None:
            hop = hop.join(small(closed), "stop", "left_anti")
        won = won.unionByName(hop).groupBy("source", "stop").agg(F.min(F.struct("seconds", "rentals", "o", "mode")).alias("m")).select("source", "stop", "m.*")
    return won.select("source", "stop", "seconds", "rentals", "mode")


def street_frontier(options: DataFrame) -> DataFrame:
    """Of each source's and stop's options (source, stop, seconds, grams, ...) those that none beats in seconds and grams; an
    option of unknown grams is an error."""
    if options.where("grams IS NULL").limit(1).count():
        raise ValueError("an option's emission factor is not known")
    return skyline(options, ["source", "stop"], "seconds", "grams")


def carriage(net: jn.Network, aboard: jn.Network, carried: DataFrame, free: DataFrame, rides: DataFrame, walks: DataFrame, parks: DataFrame, rounds: int) -> DataFrame:
    """(origin, departure, rides, plane, stop, arrival): earliest arrivals with a bicycle (plane carry) and without (free).

    aboard: the lines that take bicycles; carried, free: seeds (origin, departure, stop, arrival); rides, walks: transfers by
    bicycle and on foot; parks: (stop, seconds) where a bicycle can be left. Each round: both planes ride; bicycles go on from all
    stops their riders alight at; at parks riders leave them, which counts in the same round; walkers go on from all stops they
    alight or park at. No step reads what the same step wrote. Round 0 parks and walks on from parks at the seeds.
    """
    key = ["origin", "departure", "plane", "stop"]
    parks = small(parks.select("stop", F.col("seconds").alias("park_s")))
    row = lambda df, plane: df.select("origin", "departure", F.lit(plane).alias("plane"), "stop", "arrival")
    hop = lambda df, t: row(df.join(t.select(F.col("from_stop").alias("stop"), "to_stop", "seconds"), "stop").select("origin", "departure", F.col("to_stop").alias("stop"), (F.col("arrival") + F.col("seconds")).alias("arrival")), "free")
    left = lambda df: row(df.join(parks, "stop").withColumn("arrival", F.col("arrival") + F.col("park_s")), "free")

    parked = left(carried)
    seeds = row(carried, "carry").unionByName(row(free, "free")).unionByName(parked).unionByName(hop(parked, walks))
    known = stage(seeds.groupBy(*key).agg(F.min("arrival").alias("arrival")), "carriage")
    new, out = known, known.withColumn("rides", F.lit(0))
    for k in range(1, rounds + 1):
        on = lambda plane, own: jn._rides(own, new.where(F.col("plane") == plane).drop("plane").withColumn("path", net.no_path), None).select("origin", "departure", "stop", "arrival")  # noqa: B023, E731
        ridden = stage(row(on("carry", aboard), "carry").unionByName(row(on("free", net), "free")).groupBy(*key).agg(F.min("arrival").alias("arrival")), "carriage-ridden")
        with_bike, without = ridden.where("plane = 'carry'"), ridden.where("plane = 'free'")
        cycled = stage(with_bike.unionByName(hop(with_bike, rides).withColumn("plane", F.lit("carry"))).groupBy(*key).agg(F.min("arrival").alias("arrival")), "carriage-cycled")
        dropped = stage(left(cycled), "carriage-parked")
        walked = hop(without.unionByName(dropped), walks)
        found = cycled.unionByName(without).unionByName(dropped).unionByName(walked).groupBy(*key).agg(F.min("arrival").alias("arrival"))
        after = stage(found.join(known.withColumnRenamed("arrival", "was"), key, "left").where("was IS NULL OR arrival < was").drop("was"), "carriage-new")
        if not after.limit(1).count():
            break
        out = out.unionByName(after.withColumn("rides", F.lit(k)))
        known = stage(known.unionByName(after).groupBy(*key).agg(F.min("arrival").alias("arrival")), "carriage")
        new = after
    return out.select("origin", "departure", "rides", "plane", "stop", "arrival")


def within_band(journeys: DataFrame, group: list[str], most_slower: int) -> DataFrame:
    """Journeys (arrival, grams) of known grams that arrive at most that much after the group's first of known grams."""
    known = journeys.where("grams IS NOT NULL")
    first = known.groupBy(*group).agg(F.min("arrival").alias("_first"))
    return known.join(first, group).where(F.col("arrival") <= F.col("_first") + most_slower).drop("_first")


def penalised(journeys: DataFrame, penalties: DataFrame) -> DataFrame:
    """journeys (arrival, path, ...) with `felt`: the arrival and the penalty seconds of each route ridden; journeys on a banned
    route (null seconds) go. penalties: route, seconds."""
    p = [(r["route"], r["seconds"]) for r in penalties.collect()]  # a user's list of routes
    banned = [r for r, s in p if s is None]
    cost = F.create_map(*[F.lit(x) for r, s in p if s is not None for x in (r, s)]) if any(s is not None for _, s in p) else F.expr("cast(map() AS map<bigint, bigint>)")
    kept = journeys.where(~F.exists("path", lambda s: (s["kind"] == 0) & s["route"].isin(banned))) if banned else journeys
    extra = F.aggregate(F.filter("path", lambda s: s["kind"] == 0), F.lit(0).cast("long"), lambda t, s: t + F.coalesce(F.try_element_at(cost, s["route"]), F.lit(0)).cast("long"))
    return kept.withColumn("felt", F.col("arrival") + extra)


def journey_key(path) -> F.Column:
    """What makes two journeys the same: kinds, routes and times of their legs."""
    return F.to_json(F.transform(path, lambda s: F.struct(s["kind"].alias("k"), s["route"].alias("r"), s["dep"].alias("d"), s["arr"].alias("a"))))


def diverse(search: Callable[[list[int]], DataFrame], options: int = 3, method: str = "time") -> list:
    """Alternatives between one origin and one stop: search(banned routes) gives journeys (departure, arrival, grams, path); each
    round picks a new one (time: the fastest, then the cleanest; spread: the one farthest from those chosen, in time and grams over
    the ranges of the first round), and bans its routes. Fastest first. A pick without rides keeps the same journeys."""
    if method not in ("time", "spread"):
        raise ValueError(f"method must be time or spread, not {method!r}")
    chosen, banned, seen, ranges, pool = [], [], set(), None, None
    while len(chosen) < options:
        if pool is None:
            found = search(banned).withColumn("key", journey_key("path")).withColumn("s", F.col("arrival") - F.col("departure"))
            pool = found.orderBy("s", F.asc_nulls_last("grams"), "key").limit(1000).collect()  # journeys of one pair
            if ranges is None and pool:
                grams = [r["grams"] for r in pool if r["grams"] is not None] or [0.0]
                ranges = (max(r["s"] for r in pool) - min(r["s"] for r in pool) or 1, max(grams) - min(grams) or 1.0)
        fresh = [r for r in pool if r["key"] not in seen]
        if not fresh:
            break
        pick = fresh[0]
        if method == "spread" and chosen:
            far = lambda r: min(((r["s"] - c["s"]) / ranges[0]) ** 2 + (((r["grams"] or 0) - (c["grams"] or 0)) / ranges[1]) ** 2 for c in chosen)
            pick = max(fresh, key=lambda r: (far(r), -r["s"]))
        chosen.append(pick)
        seen.add(pick["key"])
        routes = {s["route"] for s in pick["path"] if s["kind"] == 0}
        if routes:
            banned, pool = banned + sorted(routes), None
    return sorted(chosen, key=lambda r: (r["s"], r["grams"] is None, r["grams"] or 0))
