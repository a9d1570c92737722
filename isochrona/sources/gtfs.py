"""Timetable feeds as DataFrames: reading directories and zips, merging, reference checks, inspection.

Files are read as text with every row checked against its header, then the columns that are used are cast; columns beyond them,
bad colours among them, are never looked at. Ids stay text; in a merge they are written `<feed>:<id>`.
"""

from __future__ import annotations

import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clock_seconds
from . import staging

DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
#: Columns that are used of each file, and which of them must be there.
FILES = {
    "agency": ("agency_id agency_name agency_timezone", ""), "stops": ("stop_id stop_code stop_name stop_lat stop_lon parent_station zone_id", "stop_id"),
    "routes": ("route_id route_short_name route_long_name route_type agency_id", "route_id route_type"),
    "trips": ("trip_id route_id service_id direction_id shape_id trip_headsign bikes_allowed", "trip_id route_id service_id"),
    "stop_times": ("trip_id stop_id stop_sequence arrival_time departure_time shape_dist_traveled", "trip_id stop_id stop_sequence"),
    "calendar": ("service_id start_date end_date " + " ".join(DAYS), "service_id"), "calendar_dates": ("service_id date exception_type", "service_id date exception_type"),
    "shapes": ("shape_id shape_pt_sequence shape_pt_lat shape_pt_lon", "shape_id"), "feed_info": ("feed_publisher_name feed_version", ""),
    "fare_attributes": ("fare_id price currency_type transfers transfer_duration agency_id", "fare_id price"), "fare_rules": ("fare_id route_id origin_id destination_id contains_id", "fare_id"),
}
NEEDED = ("stops", "routes", "trips", "stop_times")
ID_COLUMNS = {"stop_id", "route_id", "trip_id", "service_id", "shape_id", "agency_id", "parent_station"}


@dataclass(frozen=True)
class Feed:
    """Tables of one or several feeds, by file name, each with its feed's number."""

    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _unpacked(spark: SparkSession, path: str) -> str:
    """The folder of a feed; a zip is unpacked into the shared folder."""
    if not path.endswith(".zip"):
        return path
    from pyarrow import fs

    target = f"{staging.folder(spark)}/feed-{uuid.uuid4().hex}"
    store, at = fs.FileSystem.from_uri(target)
    store.create_dir(at, recursive=True)
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        for name in z.namelist():
            if name.endswith(".txt") and name.removesuffix(".txt") in FILES:
                with z.open(name) as src, store.open_output_stream(f"{at}/{name}") as out:
                    while block := src.read(1 << 20):
                        out.write(block)
    return target


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _file(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    path = f"{folder}/{name}.txt"
    if not _exists(spark, path):
        if name in NEEDED:
            raise ValueError(f"the feed {folder} has no {name}.txt")
        return None
    # Whole rows are parsed, so that ragged ones fail whatever columns are used.
    raw = spark.read.option("columnPruning", "false").csv(path, header=True, mode="FAILFAST", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="")
    have = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    wanted, must = (x.split() for x in FILES[name])
    if missing := [c for c in must if c not in have]:
        raise ValueError(f"{name}.txt has no column {', '.join(missing)}")
    return raw.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(c) for c in wanted])


def _typed(name: str, df: DataFrame) -> DataFrame:
    casts = {
        "stops": {"stop_lat": "double", "stop_lon": "double"}, "routes": {"route_type": "int"}, "trips": {"direction_id": "int"},
        "stop_times": {"stop_sequence": "int", "shape_dist_traveled": "double"}, "calendar_dates": {"exception_type": "int"},
    }.get(name, {})
    for c, t in casts.items():
        df = df.withColumn(c, F.col(c).try_cast(t))
    if name == "trips":  # 1 and 2 are yes and no, all else is unknown
        df = df.withColumn("bikes_allowed", F.when(F.col("bikes_allowed") == "1", True).when(F.col("bikes_allowed") == "2", False))
    if name == "stop_times":
        df = df.withColumn("arr", clock_seconds(F.col("arrival_time"))).withColumn("dep", clock_seconds(F.col("departure_time")))
    if name == "calendar":
        df = df.select("feed", "service_id", F.array(*[F.coalesce(F.col(d) == "1", F.lit(False)) for d in DAYS]).alias("days"), *[F.to_date(F.col(c), "yyyyMMdd").alias(c) for c in ("start_date", "end_date")])
    if name == "calendar_dates":
        df = df.withColumn("date", F.to_date("date", "yyyyMMdd")).withColumn("added", F.col("exception_type") == 1)
    return df


def qualified(feed: Column, name: Column, several: bool) -> Column:
    """`<feed>:<id>` where there are several feeds, else the id."""
    return F.when(name.isNotNull(), F.concat_ws(":", feed, name)) if several else name


def read(spark: SparkSession, *paths: str) -> Feed:
    """One feed, or several merged: their rows side by side, with column feed, ids of several written `<feed>:<id>`."""
    if not paths:
        raise ValueError("no feed given")
    folders, tables = [_unpacked(spark, p) for p in paths], {}
    for name in FILES:
        parts = []
        for i, folder in enumerate(folders):
            df = _file(spark, folder, name)
            if df is not None:
                df = _typed(name, df.withColumn("feed", F.lit(i)))
                parts.append(df.select(*[qualified(F.col("feed"), F.col(c), len(paths) > 1).alias(c) if c in ID_COLUMNS else F.col(c) for c in df.columns]))
        if parts:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            tables[name] = whole
    return Feed(tables)


def numbered(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """df with the dense number of each row in that order, without bringing the rows to one task: partitions of ranges are numbered
    within, and shifted by the sizes of those before."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = staging.stage(cut.withColumn("_i", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_i", 33))
    before = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return cut.join(staging.small(before), "_part").withColumn(name, F.col("_before") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_part", "_i", "_before")


def check_references(feed: Feed) -> None:
    """An error if a trip names an unknown route, or a call an unknown trip or stop, or a time that is no clock time."""
    pairs = (("trips", "route_id", "routes"), ("stop_times", "trip_id", "trips"), ("stop_times", "stop_id", "stops"))
    for table, column, other in pairs:
        lost = feed[table].select("feed", column).distinct().join(feed[other].select("feed", column), ["feed", column], "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"{table}: unknown {column} {', '.join(str(r[column]) for r in lost)}")
    bad = feed["stop_times"].where("(trim(arrival_time) <> '' AND arr IS NULL) OR (trim(departure_time) <> '' AND dep IS NULL)").limit(1).collect()
    if bad:
        raise ValueError(f"stop_times: no clock time in a call of trip {bad[0]['trip_id']}")


def services(feed: Feed, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(calendar, exceptions) as the service operators read them; empty ones where a feed has no such file."""
    cal = feed.tables.get("calendar")
    ex = feed.tables.get("calendar_dates")
    cal = spark.createDataFrame([], "service_id string, days array<boolean>, start_date date, end_date date") if cal is None else cal.drop("feed")
    ex = spark.createDataFrame([], "service_id string, date date, added boolean") if ex is None else ex.select("service_id", "date", "added")
    return cal, ex


def calls(feed: Feed) -> DataFrame:
    """trip, route, service, pos, stop, arr, dep of all trips, pos the place in order of stop_sequence."""
    st = feed["stop_times"].join(feed["trips"].select("trip_id", "route_id", "service_id"), "trip_id")
    pos = F.row_number().over(W.partitionBy("trip_id").orderBy("stop_sequence")) - 1
    return st.select(F.col("trip_id").alias("trip"), F.col("route_id").alias("route"), F.col("service_id").alias("service"), pos.alias("pos"), F.col("stop_id").alias("stop"), F.col("arr").cast("long").alias("arr"), F.col("dep").cast("long").alias("dep"))


def findings(feed: Feed, spark: SparkSession) -> DataFrame:
    """(kind, id): stops without coordinates, trips whose service has no calendar rows at all."""
    cal, ex = services(feed, spark)
    known = cal.select("service_id").union(ex.select("service_id")).distinct()
    stops = feed["stops"].where("stop_lat IS NULL OR stop_lon IS NULL").select(F.lit("stop without coordinates").alias("kind"), F.col("stop_id").alias("id"))
    return stops.unionByName(feed["trips"].join(known, "service_id", "left_anti").select(F.lit("service never runs").alias("kind"), F.col("trip_id").alias("id")))


def without_calls(feed: Feed) -> DataFrame:
    """(trip, reason) of trips that have no calls."""
    return feed["trips"].join(feed["stop_times"].select("trip_id").distinct(), "trip_id", "left_anti").select(F.col("trip_id").alias("trip"), F.lit("no stop times").alias("reason"))


def resolve_stop(feed: Feed, stop_id: str) -> str:
    """The stop that an id means: the id as it stands, else the one feed's stop of that own id; an error if none or several."""
    hits = feed["stops"].where((F.col("stop_id") == stop_id) | (F.substring_index(F.col("stop_id"), ":", -1) == stop_id)).select("stop_id").distinct().limit(3).collect()
    found = [r["stop_id"] for r in hits]
    if stop_id in found:
        return stop_id
    if len(found) != 1:
        raise ValueError(f"{'no stop' if not found else 'several stops'} {stop_id!r}")
    return found[0]


def counts(feed: Feed) -> DataFrame:
    """(name, n) rows of each table."""
    out = None
    for name, df in sorted(feed.tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables as a feed's text files; each is a folder of parts, which Spark reads as one file."""
    for name, df in tables.items():
        df.write.option("header", True).option("escape", "\"").csv(f"{folder}/{name}.txt")
