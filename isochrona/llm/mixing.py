"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. SQL functions only.

Each source's documents are dealt into permuted blocks by a keyed hash. A source's target in words becomes an exact quota of
blocks: whole repeats of all of them, then the first blocks in permuted order, the last of these only as far as the target
reaches. A binary tree splits the block quotas of all sources among the output shards: at each node the left half's share is a
multivariate hypergeometric draw, so shards are equal in blocks and random in composition. Each shard then takes the next
disjoint run of each source's permuted block list, and is written in a keyed order of its own (`write_shards`).

Blocks and shards follow the number of rows and words (`plan`); both can be given.

Defined results: a null text has size 0; a null source is a source, ranked last; a source of no words has target 0 and takes
nothing; repeated rows are separate documents, told apart by their place in the table as read, and dealt into blocks each on its
own; an empty table gives an empty result; other columns of any name are carried in `row`. Every draw is a keyed hash: reruns agree.
The list of sources is one small row each; block tables are broadcast only if counted to be small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import fresh_path, small, stage

SEED, BLOCKS, SHARDS = 20240601, 1024, 64
#: Documents a block and words a shard beyond which there are more blocks and shards.
BLOCK_ROWS, SHARD_WORDS = 4096, 1 << 25
WEIGHTS, MOST_TIMES = (1, 2, 3), 3
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _ln_factorial(k: str) -> str:
    """ln k! of a SQL expression k >= 0: Stirling's series at k + 8, less the product in between."""
    z = f"({k} + 8D)"
    between = " * ".join(f"({k} + {j}D)" for j in range(1, 8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + {_HALF_LOG_2PI}D + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) + 1 / (1260 * pow({z}, 5)) - ln({between}))"


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"


def sources(sizes: DataFrame) -> DataFrame:
    """_x_source, source_size, target of a table (_x_source, size): weights 1, 2, 3 repeat over the sources in code point order,
    null last; targets share all words by weight and stop at MOST_TIMES their source's size, the excess reshared by weight."""
    totals = sizes.groupBy("_x_source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("_x_source").asc_nulls_last())) - 1
    w = totals.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")))
    cap = MOST_TIMES * F.col("source_size")
    before = W.orderBy(cap / F.col("w"), F.col("_x_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    # In order of cap / weight, a source is held at its cap while the level over those that remain exceeds it.
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = left / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    w = w.withColumn("level", level).withColumn("free", F.col("level") < cap / F.col("w"))
    final = F.min(F.when(F.col("free"), F.struct(cap / F.col("w"), F.col("_x_source"), F.col("level")))).over(all_rows)["level"]
    return w.select("_x_source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(cap.cast("double"), F.col("w") * F.coalesce(final, F.lit(0.0)))).alias("target"))


def _tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, counts, l): counts[i] is the i-th source's blocks in the shard. quotas: one row, an array of block quotas, and l,
    which goes along."""
    node = quotas.selectExpr("0 AS lo", f"{shards} AS n", "quotas AS counts", "l")
    for level in range(math.ceil(math.log2(max(shards, 2)))):
        u = f"((xxhash64({seed}, {level}, lo, size(a.taken)) & 9007199254740991) / 9007199254740992D)"
        log_p = f"({_ln_choose('c', 'x')} + {_ln_choose('(a.rest - c)', '(a.draws - x)')} - {_ln_choose('a.rest', 'a.draws')})"
        draw = f"""aggregate(sequence(greatest(0L, a.draws - a.rest + c), least(c, a.draws)), named_struct('p', 0D, 'x', 0L),
          (s, x) -> IF(s.p >= {u}, s, named_struct('p', s.p + exp({log_p}), 'x', x))).x"""
        left = f"""aggregate(counts,
          named_struct('rest', aggregate(counts, 0L, (s, c) -> s + c), 'draws', cast(round(aggregate(counts, 0L, (s, c) -> s + c) * (n div 2) / n) AS bigint), 'taken', cast(array() AS array<bigint>)),
          (a, c) -> transform(array({draw}), d -> named_struct('rest', a.rest - c, 'draws', a.draws - d, 'taken', concat(a.taken, array(d))))[0]).taken"""
        halves = node.selectExpr("lo", "n", "counts", "l", f"IF(n > 1, {left}, counts) AS lefts")
        parts = "IF(n > 1, array(named_struct('lo', lo, 'n', cast(n div 2 AS int), 'counts', lefts, 'l', l), named_struct('lo', cast(lo + n div 2 AS int), 'n', cast(n - n div 2 AS int), 'counts', transform(counts, (c, i) -> c - lefts[i]), 'l', l)), array(named_struct('lo', lo, 'n', n, 'counts', counts, 'l', l)))"
        node = halves.selectExpr(f"inline({parts})")
    return node.selectExpr("lo AS shard", "counts", "l")


def plan(rows: int, words: int) -> tuple[int, int]:
    """Blocks and shards, powers of two, for that many documents and words."""
    up = lambda x: 1 << max(0, math.ceil(math.log2(max(x, 1))))
    return max(BLOCKS, up(rows / BLOCK_ROWS)), max(SHARDS, up(words / SHARD_WORDS))


def draw(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", shards: int | None = None, blocks: int | None = None, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Every document as (row, x): its columns to keep (all if None), and id, unique to it, h, its keyed hash, size, source_size,
    target, and shards, the output shard of each copy that the mix takes."""
    carried = docs.columns if keep is None else keep
    h = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.monotonically_increasing_id().alias("id"), F.col(f"`{source}`").alias("src"), h.alias("h"),
        F.expr(f"cast(coalesce(regexp_count(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) AS bigint)").alias("size"),
    )
    rows = stage(rows, "mix-rows")
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks, shards = blocks or plan(n, words)[0], shards or plan(n, words)[1]
    # No table of blocks, sources or quotas has more rows than there are documents.
    # Rows alike in key and text would all lie in one block: there the place of each decides too.
    alike = stage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", F.lit(True).alias("alike")), "mix-alike", n)
    rows = rows.join(small(alike), "h", "left").withColumn("u", F.expr("IF(alike, xxhash64(h, id), h)")).drop("alike").withColumn("block", F.pmod("u", F.lit(blocks)).cast("int"))
    block = stage(rows.groupBy("src", "block").agg(F.sum("size").alias("words")), "mix-blocks", n)
    by_source = stage(sources(block.select(F.col("src").alias("_x_source"), F.col("words").alias("size"))), "mix-sources", n).withColumnRenamed("_x_source", "src")
    s, blk = by_source.alias("s"), block.alias("b")
    at = W.partitionBy("src").orderBy("block")
    q = blk.join(small(s), F.expr("b.src <=> s.src")).selectExpr("b.src", "b.block", "words", "source_size", "target")
    q = q.withColumn("times", F.expr("IF(source_size = 0, 0, cast(floor(target / source_size) AS int))")).withColumn("rest", F.expr("target - times * source_size"))
    q = q.withColumn("end", F.sum("words").over(at)).withColumn("start", F.col("end") - F.col("words"))
    # part: 1 for a block drawn once more, 0 for none, null for the block in which the target is reached.
    q = q.withColumn("part", F.expr("CASE WHEN words = 0 OR start >= rest THEN 0 WHEN end <= rest THEN 1 END"))
    q = stage(q.withColumn("draws", F.expr("times + IF(part IS NULL OR part = 1, 1, 0)")), "mix-quotas", n)

    # The order of the sources in the arrays, and each source's cumulated blocks by shard.
    quota = q.groupBy("src").agg(F.sum("draws").cast("long").alias("quota"))
    listed = quota.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("src", F.lit("")).alias("s"), F.col("src").isNull().alias("z"), "quota"))).alias("l"))
    tree = _tree(listed.select(F.expr("transform(coalesce(l, array()), x -> x.quota)").alias("quotas"), F.expr("coalesce(l, array())").alias("l")), shards, seed)
    cut = stage(tree, "mix-tree").selectExpr("shard", "inline(transform(l, (x, i) -> named_struct('s', x.s, 'z', x.z, 'n', counts[i])))")
    cut = cut.withColumn("upto", F.sum("n").over(W.partitionBy("s", "z").orderBy("shard"))).groupBy("s", "z").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("cuts"))
    # A source's block list, permuted: a copy of a block goes to the shard whose run it falls in.
    unit = q.where("draws > 0").selectExpr("src", "block", "explode(sequence(1, draws)) AS copy")
    place = W.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "block", "copy"), "block", "copy")
    unit = unit.withColumn("place", F.row_number().over(place)).alias("u")
    unit = unit.join(small(cut).alias("c"), F.expr("coalesce(u.src, '') = c.s AND (u.src IS NULL) = c.z"))
    unit = unit.selectExpr("src", "block", "copy", "filter(cuts, x -> x.upto >= place)[0].shard AS shard")
    dealt = unit.groupBy("src", "block").agg(F.expr("transform(sort_array(collect_list(named_struct('copy', copy, 'shard', shard))), x -> x.shard)").alias("shards"))
    dealt = q.alias("q").join(dealt.alias("d"), F.expr("q.src <=> d.src AND q.block = d.block"), "left")
    dealt = stage(dealt.selectExpr("q.src AS s", "q.block AS b", "source_size", "target", "times", "part", "rest - start AS room", "coalesce(shards, cast(array() AS array<int>)) AS shards"), "mix-dealt")

    all_docs = rows.join(small(dealt), F.expr("src <=> s AND block = b"))
    split = stage(all_docs.where("part IS NULL").select("id", "src", "block", "u", "size", "room"), "mix-edge", n)
    # Of the block in which the target is reached, the documents up to the one that comes nearest.
    run = W.partitionBy("src", "block").orderBy("u", "id").rowsBetween(W.unboundedPreceding, 0)
    split = split.withColumn("end", F.sum("size").over(run)).where("end - size / 2 <= room").select("id", F.lit(True).alias("inside"))
    out = all_docs.join(small(stage(split, "mix-inside", n)), "id", "left")
    taken = "CASE WHEN part IS NOT NULL OR inside THEN shards ELSE slice(shards, 1, times) END"
    return out.select("row", F.expr(f"named_struct('id', id, 'h', u, 'size', size, 'source_size', source_size, 'target', target, 'shards', {taken})").alias("x"))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix: (row, shard, place) for each copy taken; place is its keyed order in the shard."""
    copies = draw(docs, seed=seed, **options).select("row", "x", F.posexplode("x.shards").alias("copy", "shard"))
    return copies.select("row", "shard", F.xxhash64(F.lit(seed + 2), "shard", "copy", "x.h").alias("place"))


def in_shards(mixed: DataFrame) -> DataFrame:
    """The mix with each shard in one partition, its rows in the shard's shuffled order."""
    return mixed.repartition("shard").sortWithinPartitions("shard", "place")


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mix as Parquet, a folder for each shard, its rows (`row`) in the shard's shuffled order."""
    in_shards(mixed).drop("place").write.partitionBy("shard").parquet(path)


def mixing_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted), shards: of the ids in the shards as written."""
    drawn = stage(draw(docs, keep=["doc_id"]).select("row", "x"), "mix-drawn")
    path = fresh_path(docs.sparkSession, "mix-shards")
    place = F.xxhash64(F.lit(SEED + 2), "shard", "copy", "x.h")
    write_shards(drawn.select("x", F.posexplode("x.shards").alias("copy", "shard")).select(F.struct("x.id", "x.size").alias("row"), "shard", place.alias("place")), path)
    written = docs.sparkSession.read.schema("row struct<id: bigint, size: bigint>, shard int").parquet(path).select("row.id", "row.size", "shard")
    found = written.groupBy("id").agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    out = drawn.select("row.doc_id", "x.id", "x.size", "x.source_size", "x.target").join(found, "id", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.expr("coalesce(shards, cast(array() AS array<int>))").alias("shards"))
