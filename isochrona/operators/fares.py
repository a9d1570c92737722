"""Fare structures: rules by type of route, zone tickets, and the search for the fastest journey below each fare."""

from __future__ import annotations

import csv
import io
import math
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import small, stage
from . import journeys

TYPES = "type string, unlimited_transfers boolean, allow_same_route_transfer boolean, use_route_fare boolean, fare double"
PAIRS = "first_leg string, second_leg string, fare double"
ROUTES = "agency_id string, agency_name string, route_id string, route_short_name string, route_long_name string, mode string, route_fare double, fare_type string"
#: Names of the modes by route type.
MODES = {0: "TRAM", 1: "SUBWAY", 2: "RAIL", 3: "BUS", 4: "FERRY", 5: "CABLE_CAR", 6: "GONDOLA", 7: "FUNICULAR"}


@dataclass(frozen=True)
class Structure:
    """Rule-based fares. types, pairs and routes are small tables (TYPES, PAIRS, ROUTES); allowance in minutes."""

    types: DataFrame
    pairs: DataFrame
    routes: DataFrame
    discounts: int = 1
    allowance: float = 120.0
    cap: float = math.inf


def setup(routes: DataFrame, base_fare: float, by: str = "MODE") -> Structure:
    """Every route (route_id, route_short_name, route_type), type and pair of types at one fare; a type for each mode, or one."""
    if by not in ("MODE", "GENERIC"):
        raise ValueError(f"by must be MODE or GENERIC, not {by!r}")
    names = F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (k, v)])
    mode = F.coalesce(F.try_element_at(names, F.col("route_type").cast("int")), F.col("route_type").cast("string"))
    none, fare = F.lit(""), F.lit(float(base_fare))
    r = routes.select(none.alias("agency_id"), none.alias("agency_name"), F.col("route_id").cast("string").alias("route_id"), F.coalesce("route_short_name", none).alias("route_short_name"), none.alias("route_long_name"), mode.alias("mode"), fare.alias("route_fare"), (mode if by == "MODE" else F.lit("GENERIC")).alias("fare_type"))
    kinds = r.select(F.col("fare_type").alias("type")).distinct()
    types = kinds.select("type", *[F.lit(False).alias(c) for c in ("unlimited_transfers", "allow_same_route_transfer", "use_route_fare")], fare.alias("fare"))
    # Every pair of types: each type with the list of all, a few names.
    listed = kinds.agg(F.collect_set("type").alias("l"))
    pairs = kinds.join(F.broadcast(listed)).select(F.col("type").alias("first_leg"), F.explode("l").alias("second_leg"), fare.alias("fare"))
    return Structure(types, pairs, r)


def read_structure(spark: SparkSession, path: str) -> Structure:
    """From a zip of CSV files: global_settings, fares_per_type, fares_per_transfer, fares_per_route. Ids stay text."""
    with zipfile.ZipFile(path) as z:
        rows = {n: list(csv.DictReader(io.TextIOWrapper(z.open(f"{n}.csv"), "utf-8"))) for n in ("global_settings", "fares_per_type", "fares_per_transfer", "fares_per_route")}

    def table(name: str, schema: str) -> DataFrame:
        columns = [c.split() for c in schema.split(", ")]
        data = [tuple((r.get(c) or None) if t != "string" else r.get(c) for c, t in columns) for r in rows[name]]
        text = spark.createDataFrame(data, ", ".join(f"{c} string" for c, _ in columns))
        return text.select(*[F.col(c).cast(t).alias(c) for c, t in columns])

    said = {r["setting"]: r["value"] for r in rows["global_settings"]}
    cap = str(said.get("fare_cap", "Inf"))
    return Structure(
        table("fares_per_type", TYPES), table("fares_per_transfer", PAIRS), table("fares_per_route", ROUTES),
        int(float(said["max_discounted_transfers"])), float(said["transfer_time_allowance"]), math.inf if cap.lower() in ("inf", "infinity") else float(cap),
    )


def write_structure(structure: Structure, path: str) -> None:
    """The same zip; its tables are a network's types and routes, and go through the driver."""
    settings = [("setting", "value"), ("max_discounted_transfers", structure.discounts), ("transfer_time_allowance", structure.allowance), ("fare_cap", "Inf" if math.isinf(structure.cap) else structure.cap)]
    with zipfile.ZipFile(path, "w") as z:
        for name, df in (("global_settings", None), ("fares_per_type", structure.types), ("fares_per_transfer", structure.pairs), ("fares_per_route", structure.routes), ("debug_settings", None)):
            text = io.StringIO()
            rows = settings if name == "global_settings" else [("setting", "value"), ("output_file", '""'), ("trip_info", "MODE")] if df is None else [df.columns, *map(tuple, df.toLocalIterator())]
            csv.writer(text, lineterminator="\n").writerows(rows)
            z.writestr(f"{name}.csv", text.getvalue())


def route_fares(structure: Structure) -> DataFrame:
    """(route_id, type, fare, unlimited, same_route) with each route's full fare; routes of unknown type are left out."""
    t = structure.types.select(F.col("type").alias("fare_type"), "unlimited_transfers", "allow_same_route_transfer", "use_route_fare", F.col("fare").alias("type_fare"))
    full = F.when(F.col("use_route_fare"), F.col("route_fare")).otherwise(F.col("type_fare"))
    return structure.routes.join(F.broadcast(t), "fare_type").select("route_id", F.col("fare_type").alias("type"), full.alias("fare"), F.col("unlimited_transfers").alias("unlimited"), F.col("allow_same_route_transfer").alias("same_route"))


def pair_map(structure: Structure) -> Column:
    """Map 'first|second' -> fare as a literal: the few pairs of types."""
    rows = structure.pairs.collect()  # types x types
    return F.create_map(*[F.lit(x) for r in rows for x in (f"{r['first_leg']}|{r['second_leg']}", float(r["fare"]))]) if rows else F.expr("cast(map() AS map<string, double>)")


STATE = "struct<total:double,type:string,route:string,fare:double,board:bigint,used:int>"


def boarded(state: Column, ride: Column, pairs: Column, allowance_s: float, discounts: int) -> Column:
    """State after boarding a ride (type, route, fare, unlimited, same_route, board) from a state, null before the first ride;
    null if the ride has no type or fare."""
    first = state.isNull()
    again = F.coalesce(~first & (state["type"] == ride["type"]), F.lit(False))
    free = again & F.coalesce(ride["unlimited"], F.lit(False))
    pair = F.try_element_at(pairs, F.concat(F.coalesce(state["type"], F.lit("")), F.lit("|"), F.coalesce(ride["type"], F.lit(""))))
    other = ~again | F.coalesce(ride["same_route"], F.lit(False)) | (state["route"] != ride["route"])
    cheap = F.coalesce(~first & ~free & (state["used"] < discounts) & pair.isNotNull() & other & (ride["board"] - state["board"] <= allowance_s), F.lit(False))
    total = F.when(first, ride["fare"]).when(free, state["total"]).when(cheap, state["total"] + pair - state["fare"]).otherwise(state["total"] + ride["fare"])
    new = F.struct(
        total.alias("total"), ride["type"].alias("type"), ride["route"].cast("string").alias("route"), ride["fare"].alias("fare"),
        F.when(free, state["board"]).otherwise(ride["board"]).cast("long").alias("board"), F.when(first, 0).otherwise(state["used"] + F.when(cheap, 1).otherwise(0)).cast("int").alias("used"),
    )
    return F.when(ride["type"].isNotNull() & ride["fare"].isNotNull(), new)


def capped_total(state: Column, cap: float) -> Column:
    """What a state costs: nothing before the first ride, at most the cap; null stays null."""
    total = F.when(state.isNull(), F.lit(0.0)).otherwise(state["total"])
    return total if math.isinf(cap) else F.when(total.isNotNull(), F.least(total, F.lit(float(cap))))


def journey_fare(rides: Column, structure: Structure) -> Column:
    """Fare of an array of rides (type, route, fare, unlimited, same_route, board); null as soon as one has no type."""
    pairs = pair_map(structure)
    start = F.struct(F.lit(None).cast(STATE).alias("s"), F.lit(True).alias("known"))

    def step(acc, ride):
        after = boarded(acc["s"], ride, pairs, structure.allowance * 60, structure.discounts)
        return F.struct(after.alias("s"), (acc["known"] & after.isNotNull()).alias("known"))

    return F.aggregate(rides, start, step, lambda acc: F.when(acc["known"], capped_total(acc["s"], structure.cap)))


def cheapest_tickets(rides: Column, products: list[dict]) -> Column:
    """Least price of a chain of tickets over an array of rides (route, dep, board_zone, alight_zone); 0 for no rides, null if some
    ride is covered by none.

    A product (price; optional zones, routes, agency_routes: lists; clauses: list of (origin, destination, route), any of them
    None; duration, transfers) covers a run of rides that board within its duration, with no more boardings after the first than
    its transfers, on its agency's routes only, by any of: both zones of every ride among its zones, every route among its routes,
    a clause for the run's ends; without any of these it covers all. A product list is a feed's, a few rows.
    """
    listed = lambda xs: F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() AS array<string>)")
    every = lambda run, f: F.forall(run, lambda r: F.coalesce(f(r), F.lit(False)))

    def covers(p: dict, run: Column) -> Column:
        ok = F.lit(False)
        if p.get("zones") is not None:
            zones = listed(p["zones"])
            ok = ok | every(run, lambda r: F.array_contains(zones, r["board_zone"]) & F.array_contains(zones, r["alight_zone"]))
        if p.get("routes") is not None:
            ok = ok | every(run, lambda r: F.array_contains(listed(p["routes"]), r["route"]))
        for origin, destination, route in p.get("clauses") or ():
            fits = F.lit(True)
            if origin is not None:
                fits = fits & F.coalesce(F.element_at(run, 1)["board_zone"] == origin, F.lit(False))
            if destination is not None:
                fits = fits & F.coalesce(F.element_at(run, -1)["alight_zone"] == destination, F.lit(False))
            if route is not None:
                fits = fits & every(run, lambda r: r["route"] == route)  # noqa: B023
            ok = ok | fits
        if p.get("zones") is None and p.get("routes") is None and not p.get("clauses"):
            ok = F.lit(True)
        if p.get("agency_routes") is not None:
            ok = ok & every(run, lambda r: F.array_contains(listed(p["agency_routes"]), r["route"]))
        if p.get("duration") is not None:
            ok = ok & (F.element_at(run, -1)["dep"] - F.element_at(run, 1)["dep"] <= p["duration"])
        if p.get("transfers") is not None:
            ok = ok & (F.size(run) - 1 <= p["transfers"])
        return ok

    def ticket(run: Column) -> Column:
        return F.array_min(F.array(*[F.when(covers(p, run), float(p["price"])) for p in products])) if products else F.lit(None).cast("double")

    def longer(best: Column, k: Column) -> Column:
        """best[i]: least price of the first i rides; the last ticket covers rides i + 1 to k."""
        options = F.transform(best, lambda b, i: b + ticket(F.slice(rides, i + 1, k - i)))
        return F.concat(best, F.array(F.array_min(options)))

    n = F.size(rides)
    prices = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() AS array<int>)")), F.expr("slice(array(0.0D, cast(null AS double)), 1, 1)"), longer)  # an array that may hold nulls
    return F.element_at(prices, -1)


def zone_products(attributes: DataFrame, rules: DataFrame | None, routes: DataFrame | None = None, agencies: DataFrame | None = None, reading: str = "model") -> list[dict]:
    """Products for cheapest_tickets from a feed's fare files (all columns text): contains_id's make the zones, a rule of a route
    alone joins the routes, a rule with an end is a clause, the attribute's agency limits the routes.

    reading 'zones': zones alone; fares whose rules name none are left out. In a feed of several agencies each fare must name its
    own. The files are small and go through the driver.
    """
    if reading not in ("model", "zones"):
        raise ValueError(f"reading must be model or zones, not {reading!r}")
    get = lambda r, c: v if c in r and (v := r[c]) is not None and str(v).strip() else None
    rows = lambda df: [r.asDict() for r in df.collect()] if df is not None else []
    by_fare: dict[str, list] = {}
    for r in rows(rules):
        if (f := get(r, "fare_id")) is not None:
            by_fare.setdefault(f, []).append(tuple(get(r, c) for c in ("contains_id", "origin_id", "destination_id", "route_id")))
    known = {get(a, "agency_id") for a in rows(agencies)}
    owner = {get(r, "route_id"): get(r, "agency_id") or (next(iter(known)) if len(known) == 1 else None) for r in rows(routes)}
    out = []
    for a in rows(attributes):
        own = by_fare.get(a["fare_id"], [])
        zones = sorted({z for z, *_ in own if z is not None})
        p = {"fare_id": a["fare_id"], "price": float(a["price"]), "zones": zones or None, "duration": float(d) if (d := get(a, "transfer_duration")) else None, "transfers": int(float(t)) if (t := get(a, "transfers")) else None}
        if reading == "zones":
            if zones or not own:
                out.append(p)
            continue
        p["routes"] = sorted({r for z, o, d, r in own if r is not None and z is None and o is None and d is None}) or None
        p["clauses"] = [(o, d, r) for _, o, d, r in own if o is not None or d is not None]
        agency = get(a, "agency_id")
        if agency is None and len(known) > 1:
            raise ValueError(f"fare {a['fare_id']!r} names no agency in a feed of several")
        if agency is not None:
            p["agency_routes"] = sorted(r for r, o in owner.items() if o == agency)
        out.append(p)
    return out


def fare_frontier(net: journeys.Network, seeds: DataFrame, structure: Structure, cutoffs: list[float], rounds: int, transfers: DataFrame | None = None, horizon: int | None = None) -> DataFrame:
    """(origin, departure, stop, cutoff, travel_time_s, fare, rides): for each cutoff the fastest journey that costs no more, ties
    to the cheaper and to fewer rides.

    Labels of one fare state (type, route, fare, clock, discounts used) beat each other by arrival and total; labels of different
    states do not, so nothing is lost. Lines of routes without a fare are not ridden. cutoffs must ascend.
    """
    if not cutoffs or sorted(set(cutoffs)) != list(cutoffs):
        raise ValueError("cutoffs must ascend")
    pairs, key = pair_map(structure), ["origin", "departure", "stop"]
    priced = small(route_fares(structure).withColumnRenamed("route_id", "route_key"))
    most = max(cutoffs) + 1e-9
    columns = [*key, "arrival", "state", "rides"]
    ever = stage(seeds.select(*key, "arrival", F.lit(None).cast(STATE).alias("state"), F.lit(0).alias("rides")), "fare-ever")
    new = ever
    parts = [F.col(f"state.{c}") for c in ("type", "route", "fare", "board", "used")]
    before = W.partitionBy(*key, *parts).orderBy("arrival", "total", "rides", "fresh").rowsBetween(W.unboundedPreceding, -1)

    def kept(found: DataFrame) -> DataFrame:
        both = ever.select(*columns, F.lit(0).alias("fresh")).unionByName(found.select(*columns, F.lit(1).alias("fresh")))
        both = both.withColumn("total", F.coalesce("state.total", F.lit(0.0)))
        if horizon is not None:
            both = both.where(F.col("arrival") - F.col("departure") <= horizon)
        # Without a cap on discounts' worth, a total may still fall by a later pair; only labels beyond cutoff and cap margins go.
        return stage(both.withColumn("least", F.min("total").over(before)).where("least IS NULL OR total < least").select(*columns, "fresh"), "fare-kept")

    for k in range(1, rounds + 1):
        on = journeys._rides(net, new.withColumn("path", net.no_path), None)
        on = on.withColumn("route_key", F.expr("cast(step.route AS string)")).join(priced, "route_key")
        ride = F.struct("type", F.col("route_key").alias("route"), "fare", "unlimited", "same_route", F.col("step.dep").alias("board"))
        after = boarded(F.col("state"), ride, pairs, structure.allowance * 60, structure.discounts)
        state = kept(on.withColumn("state", after).where("state IS NOT NULL").withColumn("rides", F.lit(k)))
        new, ever = state.where("fresh = 1").drop("fresh"), state.drop("fresh")
        if transfers is not None:
            walked = journeys._walks(net, new.withColumn("path", net.no_path), transfers, None)
            fresh = kept(walked)
            ever = fresh.drop("fresh")
            new = ever.where(f"rides = {k}")
        if not new.limit(1).count():
            break
    found = ever.select(*key, F.expr("arrival - departure AS travel_time_s"), capped_total(F.col("state"), structure.cap).alias("fare"), "rides").where(F.col("fare") <= most)
    from .accounts import cutoff_minima

    return cutoff_minima(found, key, [float(c) for c in cutoffs])
