"""Emission factors, fares and costs as joins and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import base_route_type
from ..sources.staging import small

#: Shipped factors in grams CO2e per passenger-km by base route type (vehicle, fuel, infrastructure, operations).
TRANSIT_FACTORS = {0: (2.0, 12.0, 11.0, 0.0), 1: (2.0, 12.0, 11.0, 0.0), 2: (2.0, 12.0, 11.0, 0.0), 3: (8.0, 72.0, 4.0, 8.0)}
#: Monetary costs in EUR per km (perspective, mode, component).
STREET_COSTS = [
    ("private", "car", "total", 0.250), ("private", "bicycle", "total", 0.047), ("private", "walk", "total", 0.041),
    ("societal", "car", "climate", 0.011), ("societal", "car", "subsidies", 0.003), ("societal", "car", "air_pollution", 0.007),
    ("societal", "car", "noise", 0.007), ("societal", "car", "soil_water", 0.005), ("societal", "car", "infrastructure_construction", 0.030),
    ("societal", "car", "roadway_land", 0.011), ("societal", "car", "parking_land", 0.021), ("societal", "car", "infrastructure_maintenance", 0.004),
    ("societal", "car", "resources", 0.007), ("societal", "car", "accidents", 0.002), ("societal", "bicycle", "total", -0.184), ("societal", "walk", "total", -0.370),
]


def component_sum() -> Column:
    """Missing components of a transit factor count as zero."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in ("vehicle", "fuel", "infrastructure", "operations")), F.lit(0.0))


def factor_ladder(trips: DataFrame, user: DataFrame) -> DataFrame:
    """trip with its factor, the first found of: user rows by trip, by route, by agency and type, by type; then the shipped one. At
    the rungs with a type the exact one comes before its base type, user rows before shipped ones; of equal keys the later row
    holds. trips: trip, route, agency, route_type; user: trip_id, route_id, agency_id, route_type (null: not part of the key),
    components."""
    u = user.withColumn("g", component_sum()).withColumn("_o", F.monotonically_increasing_id())
    t = trips.withColumn("_base", base_route_type(F.col("route_type")))
    last = F.max_by("g", "_o")
    wide = "trip_id IS NULL AND route_id IS NULL"
    rungs = [
        ("trip", u.where("trip_id IS NOT NULL").groupBy(F.col("trip_id").alias("trip")), ["trip"]),
        ("route", u.where("trip_id IS NULL AND route_id IS NOT NULL").groupBy(F.col("route_id").alias("route")), ["route"]),
        *[(f"agency{c}", u.where(f"{wide} AND agency_id IS NOT NULL AND route_type IS NOT NULL").groupBy(F.col("agency_id").alias("agency"), F.col("route_type").alias(c)), ["agency", c]) for c in ("route_type", "_base")],
        *[(f"type{c}", u.where(f"{wide} AND agency_id IS NULL AND route_type IS NOT NULL").groupBy(F.col("route_type").alias(c)), [c]) for c in ("route_type", "_base")],
    ]
    for name, rows, on in rungs:
        t = t.join(small(rows.agg(last.alias(f"_{name}"))), on, "left")
    shipped = F.create_map(*[x for k, v in TRANSIT_FACTORS.items() for x in (F.lit(k), F.lit(sum(v)))])
    own = lambda c: F.try_element_at(shipped, F.col(c).cast("int"))
    return t.select("trip", F.coalesce("_trip", "_route", "_agencyroute_type", "_agency_base", "_typeroute_type", own("route_type"), "_type_base", own("_base")).alias("factor"))


def rule_fare(rides: Column, rules: Column, pairs: Column, allowance_s: int, discounts: int, cap: float | None = None) -> Column:
    """Fare of an array of rides (type, route, board): a ride of an unlimited type after the same type is free; else, within
    allowance_s of the boarding before and while discounts are left, a pair that has a fare costs what it adds to the ride before;
    else the full fare. rules: map type -> (fare, unlimited, same_route); pairs: map 'type|type' -> fare. Unknown types: null."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("long").alias("route"), F.lit(None).cast("long").alias("board"), F.lit(0.0).alias("last"), F.lit(0).alias("used"))

    def step(s, r):
        rule, pair = rules[r["type"]], pairs[F.concat_ws("|", s["type"], r["type"])]
        free = (s["type"] == r["type"]) & rule["unlimited"]
        cheap = (s["used"] < discounts) & pair.isNotNull() & ((s["type"] != r["type"]) | rule["same_route"] | (s["route"] != r["route"])) & (r["board"] - s["board"] <= allowance_s)
        full = rule["fare"]
        return F.struct(
            F.when(free, s["total"]).when(cheap, s["total"] + pair - s["last"]).otherwise(s["total"] + full).alias("total"),
            r["type"].alias("type"), r["route"].alias("route"), F.when(free, s["board"]).otherwise(r["board"]).alias("board"),
            full.alias("last"), F.when(F.coalesce(~free & cheap, F.lit(False)), s["used"] + 1).otherwise(s["used"]).alias("used"),
        )

    total = F.aggregate(rides, start, step)["total"]
    return total if cap is None else F.when(total.isNotNull(), F.least(total, F.lit(cap)))


def rental_fare(seconds: Column, unlock: Column, per_minute: Column) -> Column:
    """Unlocking plus each begun minute; null without a tariff."""
    return unlock + F.ceil(seconds / 60) * per_minute


def cutoff_minima(journeys: DataFrame, group: list[str], cutoffs: list[float]) -> DataFrame:
    """Per group and cutoff the least (time, fare, rides) of journeys that cost no more, within 1e-9."""
    j = journeys.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).where(F.col("fare") <= F.col("cutoff") + 1e-9)
    return j.groupBy(*group, "cutoff").agg(F.min(F.struct("travel_time_s", "fare", "rides")).alias("m")).select(*group, "cutoff", "m.*")
