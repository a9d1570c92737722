"""Timetable operators: service activity, day view, quality checks, interpolation, patterns and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def active_services(calendar: DataFrame, exceptions: DataFrame, date: str) -> DataFrame:
    """service_id's that run on date: an exception decides (a removal over an addition), else the weekday within the range.
    calendar: service_id, days (array of 7 booleans from Monday), start_date, end_date; exceptions: service_id, date, added."""
    d = F.lit(date).cast("date")
    ex = exceptions.where(F.col("date") == d).groupBy("service_id").agg(F.min("added").alias("added"))
    weekly = F.col("days")[F.weekday(d)] & d.between(F.col("start_date"), F.col("end_date"))
    both = calendar.join(ex, "service_id", "full")
    return both.where(F.coalesce("added", weekly, F.lit(False))).select("service_id")


def day_view(calls: DataFrame, today: DataFrame, yesterday: DataFrame) -> DataFrame:
    """calls of trips that run today, and those of yesterday's trips that can still be boarded, a day earlier on the clock."""
    now = calls.join(F.broadcast(today), "service", "left_semi").withColumn("day", F.lit(0))
    last = calls.join(F.broadcast(yesterday), "service", "left_semi").withColumn("day", F.lit(-1)).withColumn("arr", F.col("arr") - 86400).withColumn("dep", F.col("dep") - 86400)
    late = last.groupBy("trip").agg(F.max("dep").alias("_end")).where("_end >= 0").select("trip")
    return now.unionByName(last.join(late, "trip", "left_semi"))


def quarantined(calls: DataFrame) -> DataFrame:
    """Trips that cannot be used, with the reason: first or last time missing, or times that go backwards."""
    w = W.partitionBy("trip").orderBy("pos")
    c = calls.withColumn("_t", F.coalesce("arr", "dep")).withColumn("_d", F.coalesce("dep", "arr"))
    before = F.last("_d", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    c = c.withColumn("_back", F.coalesce((F.col("_t") < before) | (F.col("_d") < F.col("_t")), F.lit(False)))
    c = c.groupBy("trip").agg(F.max("_back").alias("back"), F.min_by("_t", "pos").alias("_f"), F.max_by("_t", "pos").alias("_l"), F.max(F.struct("pos", F.col("_t").isNull().alias("z")))["z"].alias("last"), F.min(F.struct("pos", F.col("_t").isNull().alias("z")))["z"].alias("first"))
    return c.where("first OR last OR back").select("trip", F.expr("CASE WHEN first OR last THEN 'missing end time' ELSE 'backwards' END").alias("reason"))


def interpolated(calls: DataFrame) -> DataFrame:
    """Blank interior times filled evenly by position between the times around them, whole seconds rounded down."""
    w = W.partitionBy("trip").orderBy("pos")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    c = calls.withColumn("arr", F.coalesce("arr", "dep")).withColumn("dep", F.coalesce("dep", "arr"))
    c = c.withColumn("_n", F.row_number().over(w)).withColumn("_k", F.when(F.col("arr").isNotNull(), F.col("_n")))
    a, b = F.last("_k", ignorenulls=True).over(back), F.first("_k", ignorenulls=True).over(ahead)
    c = c.withColumn("_a", a).withColumn("_b", b).withColumn("_d", F.last("dep", ignorenulls=True).over(back)).withColumn("_e", F.first("arr", ignorenulls=True).over(ahead))
    t = F.expr("coalesce(arr, _d + ((_e - _d) * (_n - _a)) div (_b - _a))")
    return c.select("trip", "pos", "stop", t.alias("arr"), F.expr("coalesce(dep, _d + ((_e - _d) * (_n - _a)) div (_b - _a))").alias("dep"))


def lines(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips of equal route, stops and running times are a line: they never overtake each other, so that of a line only the
    first trip after a time matters. (line, pos, stop, arr, dep) with times from the start, and (line, route, service, trip, start)."""
    one = calls.groupBy("trip", "route", "service").agg(F.sort_array(F.collect_list(F.struct("pos", "stop", "arr", "dep"))).alias("c"))
    one = one.withColumn("start", F.col("c")[0]["arr"]).withColumn("shape", F.expr("transform(c, x -> named_struct('pos', x.pos, 'stop', x.stop, 'arr', x.arr - start, 'dep', x.dep - start))"))
    one = one.withColumn("line", F.sha2(F.to_json(F.struct("route", "service", "shape")), 256))
    shape = one.groupBy("line").agg(F.first("shape").alias("shape")).selectExpr("line", "inline(shape)")
    return shape, one.select("line", "route", "service", "trip", "start")


def patterns(calls: DataFrame) -> DataFrame:
    """(route, stops, n_trips): trips of one route with the same sequence of stops."""
    t = calls.groupBy("trip", "route").agg(F.expr("transform(sort_array(collect_list(struct(pos, stop))), x -> x.stop)").alias("stops"))
    return t.groupBy("route", "stops").agg(F.count(F.lit(1)).alias("n_trips"))
