"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one vertex from the start. In each pass the vectors of a label are ordered by the concatenated signs
of their random projections, taken from the label's centre, and each is compared, by cosine in double precision, with the WINDOW
vectors after it; the rows of all passes are numbered through and cut into blocks that overlap by a window, so that no neighbour
is missed at a cut. Verified pairs of all passes are united to components. How many vectors a vector links to is then counted
exactly among its component, tile against tile, so that the window bounds the search for candidates but not the number of partners.

A pass finds a pair only if its first signs agree, the more of them the more vectors a label has; so the number of passes grows
with the largest label (`passes_for`). Tests measure the recall against brute force, on vectors that are all alike too.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those of null label, link with
nothing; vectors of different lengths do not link; repeated rows are separate vectors; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import components, small, stage

LEAST, PASSES, WINDOW, BLOCK, TILE, SEED = 0.98, 12, 48, 2048, 512, 7
#: Tiles a side of a task's square of tile pairs; the chance that a pair agrees in one more sign; expected passes that find a pair.
SIDE, SAME_SIGN, FINDS = 16, 0.857, 3.5
#: Cosines this near the threshold are taken again, in the one order of summands that all comparisons share.
CLOSE = 1e-9


def passes_for(n: int, window: int = WINDOW) -> int:
    """Passes for a label of n vectors: a doubling of n asks for one more equal sign before two vectors are in one window."""
    return max(PASSES, math.ceil(FINDS / SAME_SIGN ** max(0.0, math.log2(max(n, 1) / window))))


def _vectors(kind: str, values) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in values]).astype(np.float64)


def _unit(e: np.ndarray) -> np.ndarray:
    e = e / np.abs(e).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def _bytes(kind: str):
    def run(parts):
        for p in parts:
            yield p.assign(v=[np.asarray(v, kind).tobytes() for v in p["v"]])

    return run


def _sums(kind: str):
    def run(parts):
        for p in parts:
            rows = [(label, dim, len(q), _unit(_vectors(kind, q["v"])).sum(axis=0).tobytes()) for (label, dim), q in p.groupby(["label", "dim"], sort=False)]
            yield pd.DataFrame(rows, columns=["label", "dim", "n", "s"])

    return run


def _centre(p: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(s) for s in sorted(p["s"])], axis=0) / p["n"].sum()
    return pd.DataFrame({"label": p["label"].iloc[:1], "dim": p["dim"].iloc[:1], "centre": [total.tobytes()]})


def _signs(kind: str, passes: int):
    def keyed(parts):
        for p in parts:
            for (_, dim), q in p.groupby(["label", "dim"], sort=False):
                e = _unit(_vectors(kind, q["v"])) - np.frombuffer(q["centre"].iloc[0])
                random = np.random.default_rng([SEED, dim])
                for i in range(passes):
                    bits = np.packbits(e @ random.standard_normal((64, dim)).T > 0, axis=1)
                    order = bits.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                    yield q.assign(run=i, sort=order.view(np.int64))[["run", "label", "dim", "sort", "id", "v"]]

    return keyed


def _placed(parts):
    part, at = TaskContext.get().partitionId(), 0
    for p in parts:
        yield p.assign(part=part, place=np.arange(at, at + len(p)))
        at += len(p)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _neighbours(kind: str, least: float, window: int):
    def found(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos", kind="stable")
        ids, root = p["id"].to_numpy(), np.arange(len(p))
        same = pd.MultiIndex.from_frame(p[["run", "label", "dim"]]).factorize()[0]

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for g in np.unique(same):
            rows = np.nonzero(same == g)[0]
            e = _unit(_vectors(kind, p["v"].iloc[rows]))
            for o in range(1, min(window, len(rows) - 1) + 1):
                for i in np.nonzero(_cosines(e[:-o], e[o:]) >= least)[0]:
                    a, b = top(rows[i]), top(rows[i + o])
                    root[max(a, b)] = min(a, b)
        far = [(ids[i], ids[top(i)]) for i in range(len(p)) if top(i) != i]
        return pd.DataFrame(far, columns=["a", "b"]).astype("int64")

    return found


def _counted(kind: str, least: float):
    def counts(parts):
        for p in parts:
            ids, n = [], []
            for r in p.itertuples(index=False):
                a, b = _unit(_vectors(kind, r.va)), _unit(_vectors(kind, r.vb))
                s = a @ b.T
                linked = s >= least
                i, j = np.nonzero(np.abs(s - least) < CLOSE)
                linked[i, j] = _cosines(a[i], b[j]) >= least
                if r.ta == r.tb:
                    np.fill_diagonal(linked, False)
                ids += [r.ia] + [r.ib] * (r.ta != r.tb)
                n += [linked @ np.asarray(r.nb)] + [linked.T @ np.asarray(r.na)] * (r.ta != r.tb)
            yield pd.DataFrame({"id": np.concatenate(ids), "more": np.concatenate(n).astype(np.int64)} if ids else {"id": np.zeros(0, np.int64), "more": np.zeros(0, np.int64)})

    return counts


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    single = vectors.select(F.col(f"`{vector}`")).schema[0].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if single else ("<f8", "double")  # floats are shuffled as they are, and compared as doubles
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{number}>").alias("v"), F.col(f"`{label}`").cast("string").alias("label"))
    sound = F.expr("label IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound").selectExpr("vec_id", "label", "size(v) AS dim", f"transform(v, x -> x + {number}(0)) AS v")
    good = stage(good.mapInPandas(_bytes(kind), "vec_id long, label string, dim int, v binary"), "vectors")
    once = good.groupBy("label", "dim", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    once = stage(once.select(F.monotonically_increasing_id().alias("id"), "dim", "label", "v", "n", "least"), "vectors-once")
    sums = once.select("label", "dim", "v").mapInPandas(_sums(kind), "label string, dim int, n long, s binary")
    centres = stage(sums.groupBy("label", "dim").applyInPandas(_centre, "label string, dim int, centre binary"), "vectors-centres")
    if passes is None:
        passes = passes_for(once.groupBy("label", "dim").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], window)
    keyed = once.select("id", "dim", "label", "v").join(small(centres), ["label", "dim"]).mapInPandas(_signs(kind, passes), "run int, label string, dim int, sort long, id long, v binary")
    order = ["run", "label", "dim", "sort", "id"]
    columns = "run int, label string, dim int, sort long, id long, v binary, part int, place long"
    placed = stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_placed, columns), "vectors-sorted")
    # One row for each partition: the number of rows in those before it.
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before"))
    both = placed.join(small(before), "part").withColumn("pos", F.expr("before + place")).selectExpr(
        "id", "run", "label", "dim", "v", "pos", f"explode(IF(pos >= {BLOCK} AND pos % {BLOCK} < {window}, array(pos div {BLOCK}, pos div {BLOCK} - 1), array(pos div {BLOCK}))) AS block"
    )
    edges = both.groupBy("block").applyInPandas(_neighbours(kind, least, window), "a long, b long")
    groups = components(edges, "vectors")
    # Exact counts: each component in tiles by a hash of the vector; its pairs of tiles in squares of SIDE by SIDE.
    size = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    member = groups.join(small(stage(size, "vectors-sizes")), "root").join(once.select(F.col("id").alias("v"), F.col("v").alias("e"), "n"), "v")
    tiles = member.withColumn("ts", F.expr(f"cast(ceil(m / {TILE}) AS int)")).withColumn("t", F.expr("pmod(xxhash64(v), ts)")).groupBy("root", "t", "ts").agg(F.collect_list(F.struct("v", "e", "n")).alias("x"))
    tiles = stage(tiles.selectExpr("root", "t", "ts", "x.v AS i", "x.e AS v", "x.n AS n"), "vectors-tiles")
    down = tiles.selectExpr("root", "t AS ta", "i AS ia", "v AS va", "n AS na", f"t div {SIDE} AS p", f"explode(sequence(t div {SIDE}, (ts - 1L) div {SIDE})) AS q")
    across = tiles.selectExpr("root", "t AS tb", "i AS ib", "v AS vb", "n AS nb", f"t div {SIDE} AS q", f"explode(sequence(0L, t div {SIDE})) AS p")
    pairs = down.join(across, ["root", "p", "q"]).where("ta <= tb").drop("root", "p", "q")
    counts = pairs.mapInPandas(_counted(kind, least), "id long, more long").groupBy("id").agg(F.sum("more").alias("more"))
    named = groups.join(once.select(F.col("id").alias("v"), "least"), "v").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = groups.withColumnRenamed("v", "id").join(small(stage(named, "vectors-named")), "root").join(counts, "id", "left").select("id", "component_id", "more")
    known = once.select("id", "label", "dim", "v", "n", "least").join(linked, "id", "left")
    known = stage(known.selectExpr("label", "dim", "v", "n - 1 + coalesce(more, 0) AS n_links", "coalesce(component_id, least) AS component_id"), "vectors-known")
    out = good.join(known, ["label", "dim", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def vector_report(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
