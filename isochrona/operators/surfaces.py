"""Heights and grids: heights of points from raster cells, structures on or under the ground, lattices of square cells."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def heights(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """points (point, x, y) with `height`, bilinear between the four cells around; null outside the raster, beside a cell without
    a value, or where a value is not finite. cells: row, col, value; the centre of cell (0, 0) is (x0, y0), dy is negative where
    rows run south. Points of several tiles: the union of their cells on one lattice."""
    c = (F.col("x") - x0) / dx
    r = (F.col("y") - y0) / dy
    p = points.withColumn("_c", F.floor(c)).withColumn("_r", F.floor(r)).withColumn("_u", c - F.floor(c)).withColumn("_v", r - F.floor(r))
    # On a lattice line only the cells of weight count.
    near = p.select("point", F.expr("inline(filter(array(named_struct('row', _r, 'col', _c, 'w', (1 - _u) * (1 - _v)), named_struct('row', _r, 'col', _c + 1, 'w', _u * (1 - _v)), named_struct('row', _r + 1, 'col', _c, 'w', (1 - _u) * _v), named_struct('row', _r + 1, 'col', _c + 1, 'w', _u * _v)), s -> s.w > 0))"))
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    met = near.join(cells.select("row", "col", value.alias("value")), ["row", "col"], "left")
    out = met.groupBy("point").agg(F.sum(F.col("w") * F.col("value")).alias("height"), F.max(F.col("value").isNull()).alias("lacks"))
    return points.join(out.select("point", F.when(~F.col("lacks"), F.col("height")).alias("height")), "point", "left")


def heights_by(points: DataFrame, source: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """points (point, x, y) with heights of a callable over columns x and y, which gets copies; what is not finite is null."""
    def run(parts):
        for p in parts:
            h = pd.Series(source(p["x"].copy(), p["y"].copy()), index=p.index, dtype="float64")
            yield p.assign(height=h.where(h.abs() < float("inf")))

    return points.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in points.schema)}, height double")


def coverage(points: DataFrame) -> DataFrame:
    """One row: share of points with a finite height, 0 for no points."""
    known = F.col("height").isNotNull() & ~F.isnan("height") & (F.abs("height") < float("inf"))
    return points.agg(F.coalesce(F.avg(known.cast("double")), F.lit(0.0)).alias("coverage"))


def over_structures(points: DataFrame) -> DataFrame:
    """points (edge, i, x, y, height, structure) with the heights inside a bridge or tunnel on a line between its ends' heights, by
    distance along it; null inside where an end has none. Ends, and edges that are no structure, keep theirs."""
    w = W.partitionBy("edge").orderBy("i")
    whole = W.partitionBy("edge")
    p = points.withColumn("_k", F.cos(F.radians(F.avg("y").over(whole))))
    p = p.withColumn("_s", F.coalesce(F.hypot((F.col("x") - F.lag("x").over(w)) * F.col("_k"), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    p = p.withColumn("_along", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_total", F.sum("_s").over(whole))
    ends = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = p.withColumn("_a", F.first("height").over(ends)).withColumn("_b", F.last("height").over(ends)).withColumn("_end", F.lag("i").over(w).isNull() | F.lead("i").over(w).isNull())
    share = F.when(F.col("_total") > 0, F.col("_along") / F.col("_total")).otherwise(F.lit(0.0))
    inner = F.col("_a") + share * (F.col("_b") - F.col("_a"))
    return p.withColumn("height", F.when(F.col("structure") & ~F.col("_end"), inner).otherwise(F.col("height"))).select(*points.columns)


def square_cells(areas: DataFrame, cell: float, most: int = 50_000_000, clip: bool = False) -> DataFrame:
    """(id, column, row, x, y): cells of a planar lattice over areas (ring), id `column_row`, x and y the centre. All cells of the
    areas' boxes, or, clipped, those that an area meets: a corner or centre in it, or a ring's point in the cell. More than `most`
    cells are an error."""
    from .tables import in_ring

    if not 0 < cell < float("inf"):
        raise ValueError("a cell's side must be finite and positive")
    low = lambda c: F.floor(F.array_min(F.transform("ring", lambda p: p[c])) / cell)
    high = lambda c: F.greatest(F.ceil(F.array_max(F.transform("ring", lambda p: p[c])) / cell), low(c) + 1)
    edge = 1 if clip else 0
    box = areas.select("ring", (low("x") - edge).alias("c0"), (high("x") + edge).alias("c1"), (low("y") - edge).alias("r0"), (high("y") + edge).alias("r1"))
    n = box.agg(F.coalesce(F.sum((F.col("c1") - F.col("c0")) * (F.col("r1") - F.col("r0"))), F.lit(0))).first()[0]
    if n > most:
        raise ValueError(f"{n} cells are too many; take larger cells or a smaller area")
    at = box.withColumn("column", F.explode(F.sequence("c0", F.col("c1") - 1))).withColumn("row", F.explode(F.sequence("r0", F.col("r1") - 1)))
    if clip:
        x, y = F.col("column") * cell, F.col("row") * cell
        corner = in_ring(x + cell / 2, y + cell / 2, F.col("ring"))
        for a, b in ((0, 0), (cell, 0), (0, cell), (cell, cell)):
            corner = corner | in_ring(x + a, y + b, F.col("ring"))
        at = at.where(corner | F.exists("ring", lambda p: p["x"].between(x, x + cell) & p["y"].between(y, y + cell)))
    at = at.select("column", "row").distinct()
    return at.select(F.concat_ws("_", "column", "row").alias("id"), "column", "row", ((F.col("column") + 0.5) * cell).alias("x"), ((F.col("row") + 0.5) * cell).alias("y"))
