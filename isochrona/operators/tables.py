"""User tables of factors and costs, validated and layered over the shipped ones; street factors, monetary accounts, parking."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import key_text
from ..sources.staging import small
from .accounts import STREET_COSTS

COMPONENTS = ["vehicle", "fuel", "infrastructure", "operations"]
TRANSIT_KEYS, STREET_KEYS = ["trip_id", "route_id", "agency_id", "route_type"], ["street_mode", "vehicle_class", "service_model"]
#: Shipped street factors in grams a km, of a person, or of a car: mode, class, service, components.
STREET_FACTORS = [
    ("walk", None, None, 0.0, 0.0, 0.0, 0.0), ("bicycle", "conventional", "private", 7.0, 21.0, 9.0, 0.0), ("e_bike", None, "private", 13.0, 3.0, 9.0, 0.0), ("e_scooter", None, "private", 26.0, 1.0, 9.0, 0.0), ("e_scooter", None, "shared", 88.8, 3.5, 9.0, 6.9),
    ("car", "ICE", "private", 24.0, 126.0, 12.0, 0.0), ("car", "HEV", "private", 26.0, 94.0, 13.0, 0.0), ("car", "PHEV", "private", 32.0, 43.0, 13.0, 0.0), ("car", "BEV", "private", 42.0, 16.0, 12.0, 0.0), ("car", "FCEV", "private", 38.0, 83.0, 13.0, 0.0),
]
#: Shipped bus factors by power train.
BUS_CLASSES = {"ICE": (8.0, 72.0, 4.0, 8.0), "HEV": (8.0, 53.0, 4.0, 6.0), "BEV": (14.0, 10.0, 4.0, 1.0), "BEV-2packs": (17.0, 10.0, 4.0, 1.0), "FCEV": (11.0, 44.0, 4.0, 5.0)}
PARKING = (300.0, 0.0)


class TableError(ValueError):
    """A user's table that cannot be used."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, JSON (list of records) or YAML file as text columns; ids like NA stay."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, mode="FAILFAST", nullValue="")
    if path.endswith(".json"):
        return spark.read.json(path, multiLine=True, primitivesAsString=True)
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise TableError("YAML tables need PyYAML") from e
        rows = yaml.safe_load("\n".join(r.value for r in spark.read.text(path).collect()))  # a user's table
        columns = sorted({k for r in rows for k in r})
        return spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
    raise TableError(f"{path}: neither CSV, JSON nor YAML")


def _none(df: DataFrame, condition: Column | str, message: str) -> None:
    if df.where(condition).limit(1).count():
        raise TableError(message)


def _factors(df: DataFrame, keys: list[str]) -> DataFrame:
    unknown = sorted(set(df.columns) - {*keys, *COMPONENTS})
    if unknown:
        raise TableError(f"unknown columns {', '.join(unknown)}")
    if not set(df.columns) & set(COMPONENTS):
        raise TableError("no component column")
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    text = df.select(*[(blank(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in [*keys, *COMPONENTS]])
    _none(text, " OR ".join(f"({c} IS NOT NULL AND try_cast({c} AS double) IS NULL)" for c in COMPONENTS), "a component is no number")
    out = text.select(*[key_text(F.col(k)).alias(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in COMPONENTS])
    _none(out, " OR ".join(f"{c} < 0" for c in COMPONENTS), "a component is negative")
    _none(out, " OR ".join(f"isnan({c}) OR {c} = double('Infinity')" for c in COMPONENTS), "a component is not finite")
    return out


def load_factors(df: DataFrame) -> DataFrame:
    """A transit factor table: keys as text but for route_type, a whole number; each row with a component at least."""
    out = _factors(df, TRANSIT_KEYS)
    _none(out, " AND ".join(f"{c} IS NULL" for c in COMPONENTS), "a row has no component")
    _none(out, "route_type IS NOT NULL AND NOT route_type RLIKE '^[0-9]+$'", "a route_type is no whole number")
    return out.withColumn("route_type", F.col("route_type").cast("int"))


def load_street_factors(df: DataFrame) -> DataFrame:
    """A street factor table: each row with a mode, a service only beside a class; a missing component is not known."""
    out = _factors(df, STREET_KEYS)
    _none(out, "street_mode IS NULL", "a row has no street_mode")
    _none(out, "service_model IS NOT NULL AND vehicle_class IS NULL", "a service_model without vehicle_class")
    return out


def selected(components: Sequence[str] | None, known: Sequence[str] = COMPONENTS) -> list[str]:
    """Components to count, all if None, in the table's order; unknown ones and none are refused."""
    if components is None:
        return list(known)
    if unknown := sorted(set(components) - set(known)):
        raise TableError(f"unknown components {', '.join(unknown)}")
    if not components:
        raise TableError("no component chosen")
    return [c for c in known if c in set(components)]


def shipped_street_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STREET_FACTORS, ", ".join([f"{k} string" for k in STREET_KEYS] + [f"{c} double" for c in COMPONENTS]))


def street_factors(uses: DataFrame, shipped: DataFrame, user: DataFrame | None = None, components: Sequence[str] | None = None) -> DataFrame:
    """uses (street_mode, vehicle_class, service_model, ...) with their factor: of the rows that name mode, class and service, else
    mode and class, else the mode alone; at each step the user's before the shipped ones, later before earlier. Null if a chosen
    component of the row is missing, or no row fits."""
    total = sum((F.col(c) for c in selected(components)), F.lit(0.0))
    layers = [shipped.withColumn("_l", F.lit(1))] + ([] if user is None else [user.withColumn("_l", F.lit(0))])
    rows = layers[0] if len(layers) == 1 else layers[0].unionByName(layers[1])
    rows = rows.withColumn("_o", F.monotonically_increasing_id()).withColumn("_g", total)
    out = uses
    for name, on in (("exact", STREET_KEYS), ("class", STREET_KEYS[:2]), ("mode", STREET_KEYS[:1])):
        named = F.lit(True)
        for k in STREET_KEYS:
            named = named & (F.col(k).isNotNull() if k in on else F.col(k).isNull())
        best = rows.where(named).groupBy(*on).agg(F.min_by(F.struct("_g"), F.struct("_l", -F.col("_o"))).alias(f"_{name}"))
        out = out.join(small(best), on, "left")
    found = F.coalesce("_exact", "_class", "_mode")
    return out.select(*[F.col(f"`{c}`") for c in uses.columns], found["_g"].alias("factor"))


def car_options(mode: str, occupancy: float | None = None, vehicle_class: str | None = None) -> tuple[float, str | None]:
    """(persons a car carries, its class); both belong to the car, and a car carries one at least."""
    if mode != "car" and (occupancy is not None or vehicle_class is not None):
        raise TableError("occupancy and vehicle_class belong to the car")
    if occupancy is not None and (isinstance(occupancy, bool) or not isinstance(occupancy, (int, float)) or not math.isfinite(occupancy) or occupancy < 1):
        raise TableError("occupancy must be a finite number of at least 1")
    if vehicle_class is not None and not isinstance(vehicle_class, str):
        raise TableError("vehicle_class must be text")
    return float(occupancy or 1), vehicle_class


def keyed_by_street(df: DataFrame) -> bool:
    """Whether a factor table is one of streets (it names street_mode) or of transit."""
    return "street_mode" in df.columns


COST_KEYS = ["perspective", "street_mode", "component"]


def load_costs(df: DataFrame) -> DataFrame:
    """A cost table: perspective, street_mode, component, cost_per_km; finite, each key once; transit has no costs here."""
    missing = sorted({*COST_KEYS, "cost_per_km"} - set(df.columns))
    if missing:
        raise TableError(f"no column {', '.join(missing)}")
    out = df.select(*[key_text(F.col(k)).alias(k) for k in COST_KEYS], F.col("cost_per_km").try_cast("double").alias("cost_per_km"))
    _none(out, " OR ".join(f"{k} IS NULL" for k in COST_KEYS), "a row without a key")
    _none(out, "cost_per_km IS NULL OR isnan(cost_per_km) OR abs(cost_per_km) = double('Infinity')", "a cost is not finite")
    _none(out, "street_mode = 'transit'", "costs are those of streets")
    _none(out.groupBy(*COST_KEYS).count(), "count > 1", "a key stands twice")
    return out


def shipped_costs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STREET_COSTS, "perspective string, street_mode string, component string, cost_per_km double")


def layered_costs(shipped: DataFrame, user: DataFrame) -> DataFrame:
    """The shipped rows but those whose key the user's table has, and the user's."""
    return shipped.join(user.select(*COST_KEYS), COST_KEYS, "left_anti").unionByName(user.select(*shipped.columns))


def costs_per_km(costs: DataFrame, perspective: str, components: Sequence[str] | None = None) -> DataFrame:
    """(street_mode, cost_per_km) of the chosen components of a perspective; an e-bike costs as a bicycle where it has no rows."""
    own = costs.where(F.col("perspective") == perspective)
    if components is not None:
        known = {r[0] for r in own.select("component").distinct().collect()}  # names of components
        own = own.where(F.col("component").isin(selected(list(components), sorted(known))))
    total = own.groupBy("street_mode").agg(F.sum("cost_per_km").alias("cost_per_km"))
    bikes = total.where("street_mode = 'bicycle'").withColumn("street_mode", F.lit("e_bike"))
    return total.unionByName(bikes.join(total.where("street_mode = 'e_bike'").select("street_mode"), "street_mode", "left_anti"))


def accounts(trips: DataFrame, costs: DataFrame, perspectives: Sequence[str], components: Sequence[str] | None = None, currency: str = "EUR2017") -> DataFrame:
    """trips (street_mode, network_distance_m, ...) with cost_<perspective> of each, cost_<perspective>_<component> where components
    are chosen, and the currency. A mode without a row has a null cost, never zero."""
    out = trips
    km = F.col("network_distance_m") / 1000
    for p in perspectives:
        one = costs_per_km(costs, p, components).withColumnRenamed("cost_per_km", "_k")
        out = out.join(small(one), "street_mode", "left").withColumn(f"cost_{p}", km * F.col("_k")).drop("_k")
        for c in components or ():
            part = costs_per_km(costs, p, [c]).withColumnRenamed("cost_per_km", "_k")
            out = out.join(small(part), "street_mode", "left").withColumn(f"cost_{p}_{c}", km * F.col("_k")).drop("_k")
    return out.withColumn("currency", F.lit(currency))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring (array of x, y; closed or not), strictly: on its line is outside."""
    n = F.size(ring)
    sides = F.transform(ring, lambda a, i: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), F.get(ring, (i + 1) % n)["x"].alias("bx"), F.get(ring, (i + 1) % n)["y"].alias("by")))
    crosses = lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)) + s["ax"])
    touches = lambda s: ((s["bx"] - s["ax"]) * (y - s["ay"]) == (s["by"] - s["ay"]) * (x - s["ax"])) & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))
    odd = F.size(F.filter(sides, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1
    return odd & ~F.exists(sides, touches)


def _cells(df: DataFrame, x0, x1, y0, y1, cell: float) -> DataFrame:
    at = lambda c: F.floor(c / cell)
    return df.withColumn("_cx", F.explode(F.sequence(at(x0), at(x1)))).withColumn("_cy", F.explode(F.sequence(at(y0), at(y1))))


def inside(points: DataFrame, areas: DataFrame, cell: float = 0.01) -> DataFrame:
    """points (x, y, ...) joined with each area (ring, ...) that holds them; both meet in grid cells only, an area in those of its
    box."""
    box = [F.array_min(F.transform("ring", lambda p: p["x"])), F.array_max(F.transform("ring", lambda p: p["x"])), F.array_min(F.transform("ring", lambda p: p["y"])), F.array_max(F.transform("ring", lambda p: p["y"]))]
    a = _cells(areas, *box, cell)
    p = _cells(points, F.col("x"), F.col("x"), F.col("y"), F.col("y"), cell)
    return p.join(a, ["_cx", "_cy"]).where(in_ring(F.col("x"), F.col("y"), F.col("ring"))).drop("_cx", "_cy")


def crossing(lines: DataFrame, areas: DataFrame, cell: float = 0.01) -> DataFrame:
    """(edge) of lines (edge, x1, y1, x2, y2) that touch an area: an end in it, or a side crossed."""
    lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    x, y = [F.col("x1"), F.col("x2")], [F.col("y1"), F.col("y2")]
    box = [F.array_min(F.transform("ring", lambda p: p["x"])), F.array_max(F.transform("ring", lambda p: p["x"])), F.array_min(F.transform("ring", lambda p: p["y"])), F.array_max(F.transform("ring", lambda p: p["y"]))]
    met = _cells(lines, lo(*x), hi(*x), lo(*y), hi(*y), cell).join(_cells(areas, *box, cell), ["_cx", "_cy"])
    turn = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    n = F.size("ring")

    def cuts(a, i):
        b = F.get(F.col("ring"), (i + 1) % n)
        return (turn(*_ends(), a["x"], a["y"]) != turn(*_ends(), b["x"], b["y"])) & (turn(a["x"], a["y"], b["x"], b["y"], F.col("x1"), F.col("y1")) != turn(a["x"], a["y"], b["x"], b["y"], F.col("x2"), F.col("y2")))

    _ends = lambda: (F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    hit = in_ring(F.col("x1"), F.col("y1"), F.col("ring")) | in_ring(F.col("x2"), F.col("y2"), F.col("ring")) | F.exists(F.transform("ring", cuts), lambda c: c)
    return met.where(hit).select("edge").distinct()


def parking_option(parking, mode: str):
    """None if off, (seconds, metres) for True, a number or a pair, or the table of areas (ring, seconds[, metres]) itself."""
    if parking is None or parking is False:
        return None
    if mode != "car":
        raise TableError("parking belongs to the car")
    good = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and 0 <= v <= 1e9
    if parking is True:
        return PARKING
    if isinstance(parking, DataFrame):
        if "seconds" not in parking.columns or "ring" not in parking.columns:
            raise TableError("parking areas need ring and seconds")
        areas = parking if "metres" in parking.columns else parking.withColumn("metres", F.lit(0.0))
        _none(areas, " OR ".join(f"{c} IS NULL OR isnan({c}) OR {c} < 0 OR {c} > 1e9" for c in ("seconds", "metres")), "parking must be finite and not negative")
        return areas
    pair = parking if isinstance(parking, tuple) else (parking, 0.0)
    if len(pair) != 2 or not all(map(good, pair)):
        raise TableError("parking is True, seconds, (seconds, metres) or a table of areas")
    return float(pair[0]), float(pair[1])


def parking_costs(points: DataFrame, option) -> DataFrame:
    """points (point, x, y) with seconds and metres: an option's constants, or those of the area that holds the point (most seconds,
    then most metres, then the first row), the shipped ones outside all."""
    if isinstance(option, tuple):
        return points.withColumn("seconds", F.lit(option[0])).withColumn("metres", F.lit(option[1]))
    met = inside(points.select("point", "x", "y"), option.select("ring", F.col("seconds").cast("double"), F.col("metres").cast("double")).withColumn("_row", F.monotonically_increasing_id()))
    best = met.groupBy("point").agg(F.max(F.struct("seconds", "metres", -F.col("_row"))).alias("b"))
    out = points.join(best, "point", "left")
    return out.withColumn("seconds", F.coalesce("b.seconds", F.lit(PARKING[0]))).withColumn("metres", F.coalesce("b.metres", F.lit(PARKING[1]))).drop("b")


def first_of(options: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in an order."""
    return options.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")
