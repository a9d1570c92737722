"""Earliest arrivals over lines given as tables of calls and runs; the rounds are those of the journey searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import journeys


def network(shape: DataFrame, runs: DataFrame) -> journeys.Network:
    """The prepared network of lines as timetable.lines() gives them."""
    calls = F.sort_array(F.collect_list(F.struct("pos", "stop", "arr", "dep", F.lit(None).cast("double").alias("cum"))))
    starts = F.sort_array(F.collect_list(F.struct("start", "trip", F.lit(0).alias("day"))))
    lines = shape.groupBy("line").agg(calls.alias("calls")).where("size(calls) > 1").join(runs.groupBy("line", "route").agg(starts.alias("runs")), "line")
    return journeys.of_lines(lines.select("route", F.lit(None).cast("double").alias("factor"), "calls", "runs"))


def earliest(shape: DataFrame, runs: DataFrame, seeds: DataFrame, rounds: int, transfers: DataFrame | None = None, closed_stops: DataFrame | None = None) -> DataFrame:
    """(origin, departure, rides, stop, arrival): improvements with exactly that many rides over all with fewer; see
    journeys.earliest. shape, runs: lines as the timetable operators make them."""
    return journeys.earliest(network(shape, runs), seeds, rounds, transfers, closed_stops)
