"""The driver's tables read as a timetable: 41 lines of ten calls, trips from orders, stops from suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES, CALLS, DWELL = 41, 10, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_stops(spark: SparkSession, sf_dir: str) -> int:
    return min(table(spark, sf_dir, "supplier").count(), 100)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, route, start, hop, service (0 = Monday): one row per order."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("o_orderkey AS trip", f"o_orderkey % {LINES} AS route", "18000 + (o_orderkey * 7919) % 64800 AS start", "120 + (o_orderkey % 5) * 15 AS hop", "weekday(o_orderdate) AS service")


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, route, service, pos, stop, arr, dep."""
    m = n_stops(spark, sf_dir)
    t = trips(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(CALLS - 1))))
    return t.selectExpr("trip", "route", "service", "pos", f"(route * 13 + pos * (1 + route % 7)) % {m} AS stop", f"start + pos * (hop + {DWELL}) AS arr", f"start + pos * (hop + {DWELL}) + {DWELL} AS dep")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = n_stops(spark, sf_dir)
    return spark.range(m).selectExpr("id AS stop", "60 + (id * 37 % 100) / 1000.0D AS lat", "24 + (id * 53 % 100) / 500.0D AS lon")


#: The same in DuckDB's SQL, as the head of a WITH clause.
SQL = """
n AS (SELECT least(count(*), 100) AS m FROM supplier),
trips AS (SELECT o_orderkey AS trip, o_orderkey % 41 AS route, 18000 + (o_orderkey * 7919) % 64800 AS start, 120 + (o_orderkey % 5) * 15 AS hop, (isodow(o_orderdate) - 1)::INT AS service FROM orders),
calls AS (SELECT trip, route, service, pos::INT AS pos, (route * 13 + pos * (1 + route % 7)) % m AS stop, start + pos * (hop + 30) AS arr, start + pos * (hop + 30) + 30 AS dep FROM trips, n, (SELECT unnest(range(10)) AS pos)),
stops AS (SELECT i AS stop, 60 + (i * 37 % 100) / 1000.0::DOUBLE AS lat, 24 + (i * 53 % 100) / 500.0::DOUBLE AS lon FROM n, (SELECT unnest(range(100)) AS i) WHERE i < m)
"""
