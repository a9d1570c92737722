"""SimHash near-duplicates with pigeonhole blocks.

Fingerprints of all documents are made in bounded pieces of each text. Copies of one fingerprint are one vertex from there on.
A fingerprint is cut into blocks; any two that differ in at most RADIUS bits agree in all but RADIUS of them, so both appear
under one combination of len(blocks) - RADIUS blocks. The more fingerprints there are, the more blocks: keys stay selective.

A key that thousands of near copies share would give millions of pairs. So each key's members are first compared with one of
them, its centre, and linked into groups; only members of different groups under one key are then compared, those of all but
the key's largest group against all. No link between groups is lost, no group is expanded into all its pairs.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows and copies share a group; an
empty table gives an empty result; other columns are carried along by `representatives`.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import components, dense, free, small, stage

SHINGLE, RADIUS, SEED = 4, 4, 42
PIECE = 1 << 15


def fingerprint(text: str | None) -> int:
    """64 bits: set where over half the hashes of the text's 4-word shingles (A-Z lower-cased, repeats included) are."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        some = words[at : min(at + PIECE, n) + SHINGLE - 1]
        m = min(PIECE, n - at)
        if len(some) < SHINGLE:
            joined = [b" ".join(some)]
        else:
            joined = map(b" ".join, zip(some, some[1:], some[2:], some[3:], strict=False))
        h = np.fromiter((digest(x, SEED) for x in joined), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for b in batches:
        own = np.fromiter(map(fingerprint, b.column("_s_text").to_pylist()), np.uint64, b.num_rows).view(np.int64)
        yield b.drop_columns(["_s_text"]).append_column("_s_fp", pa.array(own))


def fingerprints(docs: DataFrame, text: str = "text", keys: dict[str, str] | None = None) -> DataFrame:
    """The key columns, given as SQL by name (all long), and _s_fp: the fingerprint as a signed 64-bit number. Rows pass through
    Python as Arrow, so that keys beside a null stay whole."""
    keys = keys or {"_s_id": "doc_id"}
    rows = docs.select(*[F.expr(v).cast("long").alias(k) for k, v in keys.items()], F.col(f"`{text}`").alias("_s_text"))
    return rows.mapInArrow(_fingerprints, ", ".join(f"{k} long" for k in [*keys, "_s_fp"]))


def block_count(n: int, radius: int = RADIUS) -> int:
    """Blocks so that a key has about as many bits as n fingerprints need to stay apart: 6 up to 2 million, then more."""
    for b in range(radius + 2, 13):
        if 64 * (b - radius) / b >= np.log2(max(n, 2)):
            return b
    return max(13, radius + 1)


def _keys(blocks: int, radius: int = RADIUS) -> str:
    """SQL for the array of key structs of column fp."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return "array(" + ", ".join(f"named_struct('k', {c}, 'bits', fp & {signed(sum(masks[i] for i in chosen))}L)" for c, chosen in enumerate(combinations(range(blocks), blocks - radius))) + ")"


def linked(points: DataFrame, blocks: int | None = None, radius: int = RADIUS, rows: int | None = None) -> DataFrame:
    """(fp, root) for distinct fingerprints (fp, n), rows at most if known: connected components of all pairs within the radius."""
    points = stage(points, "simhash-points", rows)
    n = points.count()
    blocks = blocks or block_count(n, radius)
    n_keys = n * comb(blocks, radius)
    keys = _keys(blocks, radius).replace("-9223372036854775808L", "shiftleft(1L, 63)")
    members = stage(points.selectExpr("fp", "n", f"inline({keys})"), "simhash-keys", n_keys)
    centre = members.groupBy("k", "bits").agg(F.max(F.struct("n", "fp"))["fp"].alias("mid"), F.count(F.lit(1)).alias("c")).where("c > 1")
    # Few of a key's rows are left here and below: rebalanced, they are written by as many tasks as they fill.
    centre = stage(centre.drop("c").hint("rebalance"), "simhash-centres", n_keys)
    near = f"bit_count(fp ^ mid) <= {radius} AND fp <> mid"
    stars = stage(members.join(centre, ["k", "bits"]).where(near).selectExpr("fp AS a", "mid AS b").distinct(), "simhash-stars", n_keys)
    groups = components(stars, "simhash-star", stars.count())
    grouped = stage(points.join(groups.withColumnRenamed("v", "fp"), "fp", "left").selectExpr("fp", "coalesce(root, fp) AS g"), "simhash-groups", 2 * n)
    # Keys under which different groups meet, with the largest of them.
    seen = stage(grouped.selectExpr("fp", "g", f"inline({keys})"), "simhash-seen", n_keys)
    met = seen.groupBy("k", "bits", "g").agg(F.count(F.lit(1)).alias("c"))
    pairs = F.expr("(sum(c) - max(c)) * cast(sum(c) AS double)").alias("pairs")
    met = met.groupBy("k", "bits").agg(F.max(F.struct("c", "g"))["g"].alias("most"), F.count(F.lit(1)).alias("gs"), pairs).where("gs > 1")
    met = stage(met.drop("gs").hint("rebalance"), "simhash-met", n_keys)
    most = int(met.agg(F.sum("pairs")).first()[0] or 0)
    mixed = stage(seen.join(met.drop("pairs"), ["k", "bits"]), "simhash-mixed", 2 * n_keys)
    few = mixed.where("g <> most").selectExpr("k", "bits", "fp AS fp2", "g AS g2")
    across = mixed.drop("most").join(few, ["k", "bits"]).where(f"g <> g2 AND bit_count(fp ^ fp2) <= {radius}").selectExpr("g AS a", "g2 AS b").distinct()
    over = components(across, "simhash-over", most)
    return grouped.join(over.withColumnRenamed("v", "g"), "g", "left").selectExpr("fp", "coalesce(root, g) AS root")


def clusters(prints: DataFrame, **options) -> DataFrame:
    """(_s_fp, component_id) from (_s_id, _s_fp): the least id of the documents whose fingerprints are linked."""
    n = prints.count()
    points = stage(prints.groupBy(F.col("_s_fp").alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.min("_s_id").alias("least")), "simhash-prints", n)
    roots = linked(points.select("fp", "n"), rows=n, **options).join(points.select("fp", "least"), "fp")
    roots = stage(roots, "simhash-roots", 2 * n)
    # Only groups of several fingerprints have another id than their own, one row each.
    several = roots.groupBy("root").agg(F.min("least").alias("own"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return roots.join(small(stage(several, "simhash-several", n)), "root", "left").select(F.col("fp").alias("_s_fp"), F.expr("coalesce(own, least) AS component_id"))


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = stage(fingerprints(docs), "simhash-docs")
    n = prints.count()
    out = prints.join(stage(clusters(prints), "simhash-clusters", 2 * n), "_s_fp")
    return dense(out, 2 * n).select(F.col("_s_id").alias("doc_id"), F.lower(F.lpad(F.hex("_s_fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document of least id of each group, one row of each; their own columns, of any name.

    Of documents of one id, that of the least text hash counts as the least; those without an id come after all others. A row is
    known by these three, so that whole texts are shuffled once: of rows alike in them one stays, that of the least hash of all its
    columns that have one, and the join with the kept ones follows by the same key.
    """
    names = [free(n, docs.columns) for n in ("_s_none", "_s_key", "_s_hash")]
    own = dict(zip(names, (f"cast(`{key}` IS NULL AS long)", f"coalesce(cast(`{key}` AS long), 0)", f"xxhash64(`{text}`)"), strict=True))
    known = stage(fingerprints(docs, text, own).select(F.struct(*own).alias("_s_id"), "_s_fp"), "simhash-docs")
    kept = stage(clusters(known).select("component_id.*").distinct(), "simhash-kept", known.count())
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"])
    once = docs.groupBy(*[F.expr(v).alias(k) for k, v in own.items()]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), tie).alias("row"))
    return once.join(kept, names, "left_semi").select("row.*")
