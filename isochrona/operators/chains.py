"""Trips of a pattern in chains that never overtake, and their dense numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.gtfs import numbered


def _greedy(p: pd.DataFrame) -> pd.DataFrame:
    """First fit in order of first departure, then of all times: a trip joins the first chain whose last trip it follows at every
    call. Which chain takes a trip depends on all trips before it, so a pattern's trips are taken one by one."""
    p = p.sort_values(["first", "trip"], kind="stable")
    times = np.stack([np.stack(p["arrs"].to_numpy()), np.stack(p["deps"].to_numpy())], axis=2).reshape(len(p), -1)
    # The last key counts first: the first departure, then the first arrival, the first departure, and so on.
    order = np.lexsort([*times.T[::-1], times[:, 1]])
    lasts, n, chain, rank, sizes = np.empty((8, times.shape[1]), times.dtype), 0, np.zeros(len(p), np.int32), np.zeros(len(p), np.int32), []
    for i in order.tolist():
        own = times[i]
        fits = (lasts[:n] <= own).all(axis=1)
        k = int(fits.argmax()) if fits.any() else n
        if k == n:
            n += 1
            sizes.append(0)
            if n > len(lasts):
                lasts = np.concatenate([lasts, np.empty_like(lasts)])
        lasts[k], chain[i], rank[i] = own, k, sizes[k]
        sizes[k] += 1
    return p.drop(columns="first").assign(chain=chain, rank=rank)


def _chained(p: pd.DataFrame) -> pd.DataFrame:
    return _greedy(p).drop(columns=["arrs", "deps"])


def fifo_chains(calls: DataFrame, times: bool = False) -> DataFrame:
    """(trip, route, stops, chain, rank[, arrs, deps]): patterns are trips of equal route and stop sequence; chain numbers within a
    pattern from 0, rank within a chain. A task holds one pattern's trips: those of one route in the timetable."""
    one = calls.groupBy("trip", "route").agg(F.sort_array(F.collect_list(F.struct("pos", "stop", "arr", "dep"))).alias("c"))
    one = one.selectExpr("trip", "route", "array_join(transform(c, x -> x.stop), ' ') AS stops", "transform(c, x -> x.arr) AS arrs", "transform(c, x -> x.dep) AS deps", "c[0].dep AS first")
    kinds = {f.name: f.dataType.simpleString() for f in one.schema}
    own = ["trip", "route", "stops", "chain", "rank"]
    more = f"arrs {kinds['arrs']}, deps {kinds['deps']}, " if times else ""
    form = f"trip {kinds['trip']}, route {kinds['route']}, stops string, {more}chain int, rank int"
    found = one.groupBy("route", "stops").applyInPandas(_greedy if times else _chained, form)
    return found.select(*own, *(["arrs", "deps"] if times else []))


def dense_trips(chains: DataFrame) -> DataFrame:
    """chains with number: dense over all trips, by pattern, chain and rank."""
    return numbered(chains, "route", "stops", "chain", "rank", name="number")


def checked(calls: DataFrame) -> DataFrame:
    """(trip, ok): whether times never go backwards along a trip."""
    w = W.partitionBy("trip").orderBy("pos")
    bad = (F.col("dep") < F.col("arr")) | (F.col("arr") < F.lag("dep").over(w))
    return calls.withColumn("_bad", F.coalesce(bad, F.lit(False))).groupBy("trip").agg((~F.max("_bad")).alias("ok"))
