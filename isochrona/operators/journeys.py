"""Journey searches by rounds over a prepared network: earliest arrivals with their paths, and frontiers of arrival and emissions.

A network is prepared once: trips of equal route, factor, stops, running times and distances are a line, kept as rows of its
calls and PART of its sorted runs; runs of today and of yesterday (a day earlier on the clock) are runs of one line. Origin and departure
are columns, so all origins and departures of a query share each round: labels meet the lines that serve their stops, each line
gives its first run still to come, its later calls become candidates, and one grouped minimum joins them with what is known.
Lines are broadcast only if their runs are counted to be few, boards if they are few themselves.

A path is an array of steps listed from the destination back to the origin; each begins with its rank (ride 0, walk 1, access 2)
and identity, so that arrays compare as the order in which equal arrivals are resolved: rides before walks, then by trip and place.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import small, stage

KEY = ["origin", "departure"]
#: Runs in a row of a line, and runs (about 50 bytes each) and lines that a network may have to be broadcast.
PART, BROADCAST_RUNS, BROADCAST_LINES = 64, 1_000_000, 20_000
#: Cuts of a group's options that are searched before the group.
CUTS = 32


@dataclass(frozen=True)
class Network:
    """lines: line, route, factor, calls (pos, stop, arr, dep, cum from the first call), part, runs (start, trip, day), after (last start
    of the part before) and last (start); boards: stop, line, at, off."""

    lines: DataFrame
    boards: DataFrame

    @property
    def step(self) -> str:
        """Type of a step: rank; of a ride trip, day and places of boarding and alighting; stops, times, metres, factor, route."""
        kinds = {f.name: f.dataType for f in self.lines.schema}
        trip, stop, route = kinds["runs"].elementType["trip"].dataType.simpleString(), kinds["calls"].elementType["stop"].dataType.simpleString(), kinds["route"].simpleString()
        return f"struct<kind:int,a:{trip},b:bigint,c:bigint,d:bigint,from_stop:{stop},to_stop:{stop},dep:bigint,arr:bigint,metres:double,factor:double,route:{route}>"

    @property
    def no_path(self) -> Column:
        return F.lit(None).cast(f"array<{self.step}>")

    def without(self, routes: list[int] = (), trips: list[int] = ()) -> Network:
        """The network with these routes and trips not boarded; unknown ones are ignored."""
        lines = self.lines
        if routes:
            lines = lines.where(~F.coalesce(F.col("route").isin(list(routes)), F.lit(False)))
        if trips:
            lines = lines.withColumn("runs", F.filter("runs", lambda r: ~r["trip"].isin(list(trips)))).where("size(runs) > 0").withColumn("last", F.expr("runs[size(runs) - 1].start"))
            lines = lines.withColumn("after", F.lag("last").over(W.partitionBy("line").orderBy("part")))
        return replace(self, lines=lines)


def prepare(calls: DataFrame) -> Network:
    """calls: trip, route, pos, stop, arr, dep, and where known day (0, or -1 for yesterday's trips), cum (metres from the first
    call) and factor (grams a person and km of the trip; null: unresolved)."""
    have = calls.columns
    more = {"day": "0", "cum": "cast(null AS double)", "factor": "cast(null AS double)"}
    c = calls.select("trip", "route", "pos", "stop", "arr", "dep", *[F.expr(v if k not in have else k).alias(k) for k, v in more.items()])
    one = c.groupBy("trip", "day", "route", "factor").agg(F.sort_array(F.collect_list(F.struct("pos", "stop", "arr", "dep", "cum"))).alias("c")).where("size(c) > 1")
    one = one.withColumn("start", F.col("c")[0]["arr"]).withColumn("calls", F.expr("transform(c, x -> named_struct('pos', x.pos, 'stop', x.stop, 'arr', x.arr - start, 'dep', x.dep - start, 'cum', x.cum))"))
    return of_lines(one.groupBy("route", "factor", "calls").agg(F.sort_array(F.collect_list(F.struct("start", "trip", "day"))).alias("runs")))


def of_lines(lines: DataFrame) -> Network:
    """The network of lines (route, factor, calls, runs), written with its boards. A line's runs may be very many, so they are cut."""
    lines = stage(lines.select(F.monotonically_increasing_id().alias("line"), "route", "factor", "calls", "runs"), "lines")
    boards = stage(lines.selectExpr("line", "size(calls) AS n", "posexplode(calls) AS (i, x)").where("i < n - 1").selectExpr("x.stop AS stop", "line", "x.pos AS at", "x.dep AS off"), "boards")
    cut = f"transform(sequence(0, (size(runs) - 1) div {PART}), k -> named_struct('part', cast(k AS int), 'runs', slice(runs, cast(k * {PART} AS int) + 1, {PART}), 'after', IF(k = 0, null, get(runs, cast(k * {PART} AS int) - 1).start)))"
    parts = lines.where("size(runs) > 0").selectExpr("line", "route", "factor", "calls", f"inline({cut})").withColumn("last", F.expr("runs[size(runs) - 1].start"))
    n_lines, n_runs = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    parts = stage(parts, "line-parts")
    few = n_lines <= BROADCAST_LINES and n_runs <= BROADCAST_RUNS
    return Network(F.broadcast(parts) if few else parts.hint("merge"), small(boards))


def _rides(net: Network, labels: DataFrame, closed: DataFrame | None, first: bool = False) -> DataFrame:
    """labels (KEY, stop, arrival, path, ...) with each later call of the first run of each line that can still be boarded:
    columns stop, arrival and step are the new ones. A boarding at a run that begins the day before keeps its day. first, for one
    label a stop: a line is boarded at a later call only for an earlier run than at the calls before it; any other gives the same
    or later arrivals by a greater step."""
    boards = net.boards if closed is None else net.boards.join(closed, "stop", "left_anti")
    ready = labels.join(boards, "stop").withColumn("ready", F.expr("arrival - off"))
    if first:
        before = W.partitionBy(*KEY, "line").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        ready = ready.withColumn("least", F.min("ready").over(before)).where("least IS NULL OR ready < least").drop("least")
    # One part of a line at most has its first run still to come, and one that does has a run.
    met = ready.join(net.lines, "line").where("(after IS NULL OR ready > after) AND ready <= last").withColumn("run", F.expr("get(filter(runs, r -> r.start >= ready), 0)"))
    own = [c for c in labels.columns if c not in ("stop", "arrival")]
    on = met.withColumn("b", F.expr("filter(calls, x -> x.pos = at)[0]")).selectExpr(*own, "stop AS board", "route", "factor", "run", "b", "inline(transform(filter(calls, x -> x.pos > at), x -> named_struct('x', x)))")
    step = F.expr(f"cast(named_struct('kind', 0, 'a', run.trip, 'b', run.day, 'c', b.pos, 'd', x.pos, 'f', board, 't', x.stop, 'dep', run.start + b.dep, 'arr', run.start + x.arr, 'm', x.cum - b.cum, 'g', factor, 'r', route) AS {net.step})")
    out = on.select(*own, F.expr("x.stop AS stop"), F.expr("run.start + x.arr AS arrival"), step.alias("step"))
    return out if closed is None else out.join(closed, "stop", "left_anti")


def _walks(net: Network, labels: DataFrame, transfers: DataFrame, closed: DataFrame | None) -> DataFrame:
    """One hop along transfers (from_stop, to_stop, seconds[, metres])."""
    t = transfers if closed is None else transfers.join(closed.withColumnRenamed("stop", "to_stop"), "to_stop", "left_anti")
    metres = "metres" if "metres" in transfers.columns else "cast(null AS double)"
    step = F.expr(f"cast(named_struct('kind', 1, 'a', null, 'b', null, 'c', null, 'd', null, 'f', from_stop, 't', to_stop, 'dep', arrival, 'arr', arrival + seconds, 'm', {metres}, 'g', 0.0D, 'r', null) AS {net.step})")
    own = [c for c in labels.columns if c not in ("stop", "arrival", "step")]
    return labels.drop("step").join(t.withColumnRenamed("from_stop", "stop").withColumn("from_stop", F.col("stop")), "stop").select(*own, F.col("to_stop").alias("stop"), (F.col("arrival") + F.col("seconds")).alias("arrival"), step.alias("step"))


def _seeded(net: Network, seeds: DataFrame, paths: bool) -> DataFrame:
    access = F.expr(f"cast(named_struct('kind', 2, 'a', null, 'b', null, 'c', null, 'd', null, 'f', null, 't', stop, 'dep', departure, 'arr', arrival, 'm', {'metres' if 'metres' in seeds.columns else '0.0D'}, 'g', 0.0D, 'r', null) AS {net.step})")
    return seeds.select(*KEY, "stop", "arrival", (F.array(access) if paths else net.no_path).alias("path"))


def _grown(df: DataFrame, paths: bool) -> DataFrame:
    return df.withColumn("path", F.concat(F.array("step"), "path") if paths else F.col("path")).drop("step")


def earliest(net: Network, seeds: DataFrame, rounds: int, transfers: DataFrame | None = None, closed: DataFrame | None = None, paths: bool = False, exact: bool = False) -> DataFrame:
    """(origin, departure, rides, stop, arrival[, path]): arrivals with exactly that many rides that beat all with fewer; equal ones
    are resolved by the least path.

    Boarding uses what the round before gave, comparisons the best of all rounds. Walks go one hop from the stops that rides of
    the round improved; exact: from all stops that rides of the round reach (for transfers that are not closed). closed: stops not
    to board, alight or walk at. Ends when a round improves nothing.
    """
    if closed is not None:
        closed = small(closed)
        seeds = seeds.join(closed, "stop", "left_anti")
    key = [*KEY, "stop"]
    # Without paths the arrivals alone are compared: a minimum of numbers needs no sort.
    value = F.struct("arrival", "path") if paths else F.col("arrival")
    label = (lambda v: F.col(v)) if paths else (lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("arrival"), net.no_path.alias("path"))))

    def joined(known: DataFrame, found: DataFrame) -> DataFrame:
        both = known.select(*key, value.alias("v"), F.lit(False).alias("new")).unionByName(found.select(*key, value.alias("v"), F.lit(True).alias("new")))
        least = both.groupBy(*key).agg(F.min(F.expr("IF(new, null, v)")).alias("was"), F.min(F.expr("IF(new, v, null)")).alias("now"))
        return least.select(*key, label("was").alias("was"), label("now").alias("now"))

    better = "now IS NOT NULL AND (was IS NULL OR now.arrival < was.arrival)"
    known = stage(_seeded(net, seeds, paths).groupBy(*key).agg(F.min(value).alias("v")).select(*key, label("v").alias("v")).select(*key, "v.*"), "known")
    new, out = known, [known.withColumn("rides", F.lit(0))]
    for k in range(1, rounds + 1):
        ridden = stage(joined(known, _grown(_rides(net, new, closed, True), paths)), "ridden")
        new = ridden.where(better).select(*key, "now.*")
        if transfers is not None:
            base = (ridden.where("now IS NOT NULL") if exact else ridden.where(better)).select(*key, "now.*")
            hops = _grown(_walks(net, base, transfers, closed), paths)
            ridden = stage(joined(known, new.select(*key, "arrival", "path").unionByName(hops.select(*key, "arrival", "path"))), "walked")
            new = ridden.where(better).select(*key, "now.*")
        if not new.limit(1).count():
            break
        out.append(new.withColumn("rides", F.lit(k)))
        if k < rounds:
            known = ridden.select(*key, F.expr(f"IF({better}, now, was)").alias("v")).select(*key, "v.*")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select(*KEY, "rides", "stop", "arrival", *(["path"] if paths else []))


def frontier(net: Network, seeds: DataFrame, rounds: int, transfers: DataFrame | None = None, closed: DataFrame | None = None, bucket: float | None = None, horizon: int | None = None) -> DataFrame:
    """(origin, departure, stop, arrival, grams, rides, path): at each stop the labels that no other beats in arrival and grams.

    Grams are taken to a millionth; with a bucket, labels compare by whole buckets and fewest rides, within which the least grams
    stay. Lines of unresolved factor or distance are not ridden, so every journey has its grams. Walks go one hop from what rides
    of the round leave on the frontier. horizon: seconds after the departure beyond which nothing is kept.
    """
    closed = None if closed is None else small(closed)
    clean = replace(net, lines=net.lines.where("factor IS NOT NULL AND NOT exists(calls, x -> x.cum IS NULL)"))
    key = [*KEY, "stop"]
    columns = [*key, "arrival", "grams", "rides", "path"]
    measure = F.col("grams") if bucket is None else F.floor(F.col("grams") / bucket)
    ever = stage(_seeded(net, seeds, True).withColumn("grams", F.lit(0.0)).withColumn("rides", F.lit(0)).select(*columns), "ever")
    if closed is not None:
        ever = ever.join(closed, "stop", "left_anti")
    new = ever
    order = W.partitionBy(*key).orderBy("arrival", "m", "rides", "grams", "fresh", "path")
    before = order.rowsBetween(W.unboundedPreceding, -1)

    def kept(found: DataFrame) -> DataFrame:
        """ever and found without beaten labels; fresh: from found. In order of arrival a label stays if it has a lesser measure
        than all before it, or, by buckets, fewer rides than those of no greater measure."""
        both = ever.withColumn("fresh", F.lit(0)).unionByName(found.select(*columns).withColumn("fresh", F.lit(1)))
        both = both.withColumn("m", measure)
        if horizon is not None:
            both = both.where(F.col("arrival") - F.col("departure") <= horizon)
        if bucket is None:
            return stage(both.withColumn("least", F.min("m").over(before)).where("least IS NULL OR m < least").select(*columns, "fresh"), "kept")
        # Rides are few: the least measure so far by number of rides.
        beaten = [F.min(F.when(F.col("rides") <= r, F.col("m"))).over(before) for r in range(rounds + 1)]
        own = F.get(F.array(*beaten), F.col("rides"))
        return stage(both.withColumn("least", own).where("least IS NULL OR m < least").select(*columns, "fresh"), "kept")

    for k in range(1, rounds + 1):
        ridden = _grown(_rides(clean, new, closed), True).withColumn("rides", F.lit(k))
        grams = F.round(F.col("grams") + F.expr("path[0].metres / 1000 * path[0].factor"), 6)
        state = kept(ridden.withColumn("grams", grams))
        new = state.where("fresh = 1").drop("fresh")
        ever = state.drop("fresh")
        if transfers is not None:
            walked = _grown(_walks(net, new, transfers, closed), True)
            after = kept(walked)
            new = new.join(after.where("fresh = 0").select(*columns), columns, "left_semi").unionByName(after.where("fresh = 1").drop("fresh"))
            ever = after.drop("fresh")
            new = stage(new, "new")
        if not new.limit(1).count():
            break
    return ever


def legs(found: DataFrame) -> DataFrame:
    """One row per leg of each path, in order of travel: segment from 0, leg_type (access, transit, transfer), from_stop, to_stop,
    trip, day, route, dep, arr, metres, grams (0 for walks, null for a ride of unresolved factor)."""
    own = [c for c in found.columns if c != "path"]
    x = found.select(*own, F.posexplode(F.reverse("path")).alias("segment", "s"))
    return x.selectExpr(
        *own, "segment", "CASE s.kind WHEN 0 THEN 'transit' WHEN 1 THEN 'transfer' ELSE 'access' END AS leg_type", "s.from_stop", "s.to_stop", "IF(s.kind = 0, s.a, null) AS trip", "IF(s.kind = 0, s.b, null) AS day", "s.route",
        "s.dep", "s.arr", "s.metres", "IF(s.kind = 0, s.metres / 1000 * s.factor, 0.0D) AS grams",
    )


def costs(found: DataFrame) -> DataFrame:
    """found with the sums over its path: transit_m, walk_m, grams (null as soon as one ride is unresolved)."""
    total = lambda what, kinds: F.expr(f"aggregate(reverse(filter(path, s -> s.kind IN ({kinds}))), 0.0D, (t, s) -> t + {what})")
    return found.withColumn("transit_m", total("s.metres", "0")).withColumn("walk_m", total("s.metres", "1, 2")).withColumn("grams", total("s.metres / 1000 * s.factor", "0"))


def fastest(found: DataFrame) -> DataFrame:
    """Of each origin, departure and stop the earliest arrival, of the fewest rides."""
    own = [c for c in found.columns if c not in (*KEY, "stop")]
    first = ["arrival", "rides", *[c for c in own if c not in ("arrival", "rides")]]
    return found.groupBy(*KEY, "stop").agg(F.min_by(F.struct(*first), F.struct("arrival", "rides")).alias("r")).select(*KEY, "stop", "r.*")


def departure_candidates(net: Network, access: DataFrame, start: int, window: int) -> DataFrame:
    """(origin, departure), distinct: when to leave within [start, start + window) to catch some run at an access stop, and the
    window's last second. access: origin, stop, seconds."""
    runs = net.boards.join(net.lines.select("line", "runs"), "line").selectExpr("stop", "off", "explode(runs.start) AS run")
    left = runs.join(small(access), "stop").selectExpr("origin", "run + off - seconds AS departure").where(f"departure >= {start} AND departure < {start + window} AND departure >= 0")
    if window <= 0:
        return left.distinct()
    return left.union(access.select("origin", F.lit(start + window - 1).cast("long").alias("departure"))).distinct()


def minute_marks(start: int, window: int) -> list[int]:
    """A departure a minute of the window, one at least."""
    return [start + 60 * i for i in range(max(1, -(-window // 60)))]


def sampled_departures(start: int, window: int, step: int) -> list[int]:
    """A departure every step seconds of the window."""
    if step < 1 or window < 1:
        raise ValueError("step and window must be at least one second")
    return list(range(start, start + window, step))


def undominated(found: DataFrame, rounds: int) -> DataFrame:
    """Rows (origin, departure, stop, rides, arrival, ...) that arrive before all that leave later with no more rides, and before
    all that leave then with fewer."""
    k = found.withColumn("k", F.explode(F.sequence(F.greatest("rides", F.lit(0)), F.lit(rounds))))
    w = W.partitionBy("origin", "stop", "k").orderBy(F.desc("departure"), "rides").rowsBetween(W.unboundedPreceding, -1)
    return k.withColumn("best", F.min("arrival").over(w)).where("k = rides AND (best IS NULL OR arrival < best)").drop("k", "best")


def to_points(found: DataFrame, egress: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """(origin, departure, point, seconds): least of stop arrivals plus egress (stop, point, seconds), and of direct walks
    (origin, point, seconds) from every departure."""
    by_stop = found.join(egress.withColumnRenamed("seconds", "last"), "stop").select(*KEY, "point", F.expr("arrival + last - departure AS seconds"))
    if walks is not None:
        by_stop = by_stop.unionByName(found.select(*KEY).distinct().join(walks, "origin").select(*KEY, "point", "seconds"))
    return by_stop.groupBy(*KEY, "point").agg(F.min("seconds").alias("seconds"))


def beating_walks(journeys: DataFrame, walks: DataFrame) -> DataFrame:
    """journeys (origin, point, departure, arrival, ...) that take less time than the direct walk (origin, point, walk_seconds)."""
    return journeys.join(walks, ["origin", "point"], "left").where("walk_seconds IS NULL OR arrival - departure < walk_seconds").drop("walk_seconds")


def _least(group: list[str]):
    """Of points (group, departure, m, arrival), one for each departure and m, those that no other of the group beats: in order of
    leaving later, then of arriving earlier, then of m, a point stays if none before it has as little of arrival and m."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rank = {c: np.unique(p[c].to_numpy(), return_inverse=True)[1] for c in ("departure", "arrival", "m")}
        stairs, on = [], []  # of those that stay: arrival up, m down
        for i in np.lexsort((rank["m"], rank["arrival"], -rank["departure"])).tolist():
            arrival, m = int(rank["arrival"][i]), int(rank["m"][i])
            k = bisect.bisect_right(stairs, arrival, key=lambda s: s[0])
            if k and stairs[k - 1][1] <= m:
                continue
            on.append(i)
            k = end = bisect.bisect_left(stairs, arrival, key=lambda s: s[0])
            while end < len(stairs) and stairs[end][1] >= m:
                end += 1
            stairs[k:end] = [(arrival, m)]
        return p.iloc[on][[*group, "departure", "m", "arrival"]]

    return run


def capped(options: DataFrame, group: list[str], most: int, bucket: float | None = None) -> DataFrame:
    """Options (departure, arrival, grams) of each group: all that none beats in departure, arrival and (buckets of) grams, then, up
    to `most` in all, those that come least behind an option that beats them, ties to the cleaner.

    What is beaten is beaten by one that none beats, and only groups with less than `most` of these have room for more, so that no
    option meets as many."""
    o = options.withColumn("_m", F.col("grams") if bucket is None else F.floor(F.col("grams") / bucket)).withColumn("_id", F.monotonically_increasing_id())
    o = stage(o, "options")
    # Options without a group or a value neither beat nor are beaten.
    whole = " AND ".join(f"`{c}` IS NOT NULL" for c in [*group, "departure", "arrival", "_m"])
    points = o.where(whole).groupBy(*group, "departure", F.col("_m").alias("m")).agg(F.min("arrival").alias("arrival"))
    # First within cuts, so that the task of a large group gets little.
    some = points.groupBy(*group, F.pmod(F.hash("departure", "m"), F.lit(CUTS))).applyInPandas(_least(group), points.schema)
    top = stage(some.groupBy(*group).applyInPandas(_least(group), points.schema), "top")
    on = o.where(whole).join(top.withColumnRenamed("m", "_m"), [*group, "departure", "arrival", "_m"], "left_semi").select(o.columns)
    frontier = on.unionByName(o.where(f"NOT ({whole})"))
    room = frontier.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < most)
    few = top.join(room, group).groupBy(*group, "_n").agg(F.collect_list(F.struct("departure", "m", "arrival")).alias("_top"))
    rest = o.where(whole).join(small(few), group).where("NOT exists(_top, x -> x.departure = departure AND x.m = _m AND x.arrival = arrival)")
    rest = rest.withColumn("behind", F.expr("arrival - array_max(transform(filter(_top, x -> x.departure >= departure AND x.m <= _m AND x.arrival <= arrival), x -> x.arrival))"))
    rest = rest.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy("behind", "_m", "grams", "_id"))).where((F.col("_r") <= most) & (F.col("_r") <= most - F.col("_n"))).select(*o.columns, "behind")
    none = F.lit(0).cast(rest.schema["behind"].dataType)
    return frontier.withColumn("behind", none).withColumn("frontier", F.lit(True)).unionByName(rest.withColumn("frontier", F.lit(False))).drop("_id", "_m")
