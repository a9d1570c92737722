"""Scalar functions as SQL expressions and Columns."""

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres between two points in degrees."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS, hours beyond 23 allowed; null if malformed."""
    ok = text.rlike(r"^\s*[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]\s*$")
    p = F.split(F.trim(text), ":")
    return F.when(ok, p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int"))


def walk_seconds(x: Column) -> Column:
    """Whole seconds, rounded up but for a millionth, never below zero; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.ceil(x - 1e-6), F.lit(0)))


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile by nearest rank, half up on n - 1, of an array; nulls count as later than everything."""
    n = F.size(values)
    found = F.filter(values, lambda x: x.isNotNull())
    return F.get(F.sort_array(found), F.floor(F.lit(p / 100.0) * (n - 1) + 0.5).cast("int"))


def base_route_type(t: Column) -> Column:
    """Extended route types by range to the base types 0 to 7; others as they are."""
    out = t
    # Ranges of the public extended route types.
    for lo, hi, base in ((100, 199, 2), (200, 299, 3), (400, 499, 1), (700, 899, 3), (900, 999, 0), (1000, 1099, 4), (1200, 1299, 4), (1300, 1399, 6), (1400, 1499, 7)):
        out = F.when(t.between(lo, hi), F.lit(base)).otherwise(out)
    return out


def to_minutes(df, columns):
    """df with each `*_s` column of columns as `*_min`."""
    return df.select(*[(F.col(c) / 60.0).alias(c.removesuffix("_s") + "_min") if c in columns else F.col(c) for c in df.columns])


def previous_day(day: Column) -> Column:
    return F.date_sub(day, 1)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres a degree of (longitude, latitude) at a latitude; fixed values of the WGS84 series."""
    p = F.radians(lat)
    return 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p), 111132.954 - 559.822 * F.cos(2 * p) + 1.175 * F.cos(4 * p)


def longitude_delta(a: Column, b: Column) -> Column:
    """Degrees from a to b the short way round."""
    d = (b - a) % 360
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def segment_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Length of a short segment on the plane of its middle latitude."""
    kx, ky = metres_per_degree((lat1 + lat2) / 2)
    return F.hypot(longitude_delta(lon1, lon2) * kx, (lat2 - lat1) * ky)


def foot_on_segment(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """(metres from a point to a segment, share of the segment at its nearest place), on the plane around the point."""
    kx, ky = metres_per_degree(lat)
    x1, y1, x2, y2 = longitude_delta(lon, lon1) * kx, (lat1 - lat) * ky, longitude_delta(lon, lon2) * kx, (lat2 - lat) * ky
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(-(x1 * dx + y1 * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(x1 + t * dx, y1 + t * dy), t


def quantised_grams(g: Column) -> Column:
    """Grams to the millionth."""
    return F.round(g, 6)


def grams_bucket(g: Column, width: float) -> Column:
    return F.floor(g / width)


def key_text(x: Column) -> Column:
    """An id as text: blanks are none, whole numbers lose their fraction."""
    t = F.trim(x.cast("string"))
    return F.nullif(F.regexp_replace(t, r"^([+-]?[0-9]+)\.0+$", "$1"), F.lit(""))


def tag_of(column: Column, tags: Column, name: str) -> Column:
    """A node's tag: its own column, or, where that is blank, the entry of its JSON tags; malformed JSON has none."""
    blank = lambda c: F.when(~c.isin("", "nan"), c)
    return F.coalesce(blank(column), blank(F.get_json_object(tags, f"$['{name}']")))


#: Names of the base route types.
ROUTE_TYPES = {0: "tram", 1: "subway", 2: "rail", 3: "bus", 4: "ferry", 5: "cable_tram", 6: "gondola", 7: "funicular", 11: "trolleybus", 12: "monorail"}


def route_type_name(t: Column) -> Column:
    """Name of a base route type, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTE_TYPES.items() for x in kv]), t.cast("int"))


def route_type_code(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in ROUTE_TYPES.items() for x in (v, k)]), name)


def confidence_percentiles(c: float) -> list[float]:
    """The lower end, the middle and the upper end of a confidence interval, as percentiles to nine places."""
    if not 0 < c < 1:
        raise ValueError("confidence must lie between 0 and 1")
    low = round((1 - c) / 2 * 100, 9)
    return [low, 50.0, round(100 - low, 9)]


def _wkb_line(points: pd.Series) -> pd.Series:
    def one(p):
        if p is None or len(p) < 2:
            return None
        return struct.pack(f"<BII{2 * len(p)}d", 1, 2, len(p), *[v for q in p for v in (q["x"], q["y"])])

    return points.map(one, na_action="ignore")


def _wkb_lines(lines: pd.Series) -> pd.Series:
    def one(found):
        parts = [struct.pack(f"<BII{2 * len(p)}d", 1, 2, len(p), *[v for q in p for v in (q["x"], q["y"])]) for p in found if p is not None and len(p) > 1]
        return struct.pack("<BII", 1, 5, len(parts)) + b"".join(parts)

    return lines.map(one, na_action="ignore")


def wkb_line(points: Column) -> Column:
    """Little-endian WKB LineString of arrays of (x, y); null for fewer than two points."""
    return F.pandas_udf(_wkb_line, "binary")(points)


def wkb_lines(lines: Column) -> Column:
    """Little-endian WKB MultiLineString of arrays of arrays of (x, y); lines of fewer than two points are left out."""
    return F.pandas_udf(_wkb_lines, "binary")(lines)
