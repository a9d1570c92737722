"""Quality rules at host level: rule failures are added up by host, their rates shrunk with an empirical beta prior, and the
verdicts joined back to the documents. SQL functions only.

Defined results: a null text has no words and so fails; a null host is a host of its own; repeated rows count as often as they
occur; an empty table gives an empty result; other columns of any name are carried along untouched
in `row` by `judge`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small, stage

SPACE = r"[\\x20\\x09-\\x0D]+"
LEAST_WORDS, MOST_REPEATED, MOST_FAILED = 20, 30, 0.5
#: Weight, in documents, of the prior if the host rates have no usable spread.
PRIOR_DOCS = 2.0

_PLACES = """
aggregate(
  sort_array(transform(
    filter(sequence(0, size(s) - 1), k -> (get(s, k).v = get(s, k - 1).v) OR (get(s, k).v = get(s, k + 1).v)),
    k -> get(s, k).i)),
  named_struct('n', 0, 'last', -8),
  (c, p) -> named_struct('n', c.n + least(8, p - c.last), 'last', p)).n
"""
# h: word hashes, g: hashes of 8-word windows, s: (window hash, place) in order; each is bound once by a one-element transform.
_REPEATED = f"""
transform(array(transform(w, x -> xxhash64(x))), h ->
  transform(array(transform(sequence(0, size(h) - 8),
      i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4), get(h, i + 5), get(h, i + 6), get(h, i + 7)))), g ->
    CASE WHEN size(array_distinct(g)) = size(g) THEN 0 ELSE
      transform(array(sort_array(transform(g, (v, i) -> named_struct('v', v, 'i', i)))), s -> {_PLACES})[0] END)[0])[0]
"""


def measures(text: str = "text") -> F.Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of one whole text."""
    t = f"coalesce(`{text}`, '')"
    return F.expr(f"""
    transform(array(array_remove(split({t}, '{SPACE}'), '')), w -> named_struct(
      'n_words', cast(size(w) AS bigint),
      'word_chars', cast(char_length(array_join(w, '')) AS bigint),
      'n_symbols', cast(regexp_count({t}, '[#*$%&|<>]') AS bigint),
      'n_dup_lines', cast(transform(array(filter(split({t}, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')), l -> size(l) - size(array_distinct(l)))[0] AS bigint),
      'n_repeat_words', cast(CASE WHEN size(w) < 9 THEN 0 ELSE {_REPEATED} END AS bigint)))[0]
    """)


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, most_failed: float = MOST_FAILED) -> DataFrame:
    """(row, q): the documents' columns to keep (all if None), and the measures, base_failed, rejected_host_rate and kept.

    A host's failure rate is (failed + a) / (documents + a + b); a and b fit the beta distribution to the hosts' raw rates by
    moments. Documents of hosts whose rate is over most_failed go with the failed ones. The measured rows are written once;
    host sums combine before the shuffle; rejected hosts are broadcast only if counted to be few.
    """
    carried = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{host}`").alias("host"), measures(text).alias("m"))
    failed = F.expr(f"m.n_words < {LEAST_WORDS} OR 100 * m.n_repeat_words > {MOST_REPEATED} * m.n_words")
    rows = stage(rows.withColumn("failed", failed), "quality")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    hosts = stage(hosts, "quality-hosts")
    m, v = hosts.agg(F.avg(F.expr("f / n")), F.var_samp(F.expr("f / n"))).first()
    m, v = m or 0.0, v or 0.0
    weight = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else PRIOR_DOCS
    a, b = m * weight, (1 - m) * weight
    rate = (F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    rejected = hosts.select(F.col("host").alias("bad"), rate.alias("rate")).where(F.col("rate") > most_failed)
    out = rows.join(small(rejected), F.col("host").eqNullSafe(F.col("bad")), "left")
    return out.select("row", F.struct("m.*", F.col("failed").alias("base_failed"), F.col("rate").alias("rejected_host_rate"), (~F.col("failed") & F.col("rate").isNull()).alias("kept")).alias("q"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, **options).where("q.kept").select("row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept."""
    return judge(docs, keep=["doc_id"]).select("row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept")


#: The same in DuckDB's SQL, over windows as joined rows instead of arrays of hashes.
REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(8)) AS k) GROUP BY rid),
m AS (SELECT s.rid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (SELECT len(l) - len(list_distinct(l)) FROM (SELECT list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN cov ON s.rid = cov.rid),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f, sum(base_failed::INT) / count(*) AS p FROM b GROUP BY source),
p AS (SELECT avg(p) AS m, coalesce(var_samp(p), 0) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 2.0 END AS k FROM p),
r AS (SELECT source, (f + m * k) / (n + k) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND r.rate <= 0.5) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
