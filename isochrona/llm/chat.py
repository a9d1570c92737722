"""Chat formatting in budgeted windows. SQL functions only.

A window holds a run of whole turns of its own; every window after the first repeats the leading system turn and, within
HISTORY_TURNS and HISTORY_TOKENS, the turns just before it. What these two may take is kept free of the budget beforehand: a
conversation's room is the budget less its system turn and its history (HISTORY_TOKENS, or a quarter of what the system turn
leaves, if less). Prefix sums of turn tokens lay the conversation on a token axis cut every room; the turns that lie between two
cuts are a window; a turn that a cut goes through joins the window before it, else the one after it, if there is room, else it is
a window of its own. So a window exceeds the budget only if it has a single own turn, and no turn is ever cut. Repeated turns are
outside the loss mask, so each assistant text is under it exactly once. A turn's tokens are estimated, as its words or a quarter
of its characters, whichever is more, and TURN_COST.

Template: `<|role|>text</s>` for each turn. In roles and texts each of < [ | and backslash is followed by an added backslash, so
that no control string (</s>, <|, |>, [INST] and the like) survives inside a text, and reading takes the backslashes out again.

Defined results: null texts and roles are empty; a null conv_id is a conversation; rows of equal turn are ordered by role and
text, repeated rows are repeated turns, null turns come first; if the system turn fills the budget, each turn is a window of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import stage

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_COST = 512, 2, 128, 4
#: A fixed conversation whose texts are control strings; the query adds it to the table.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return rf"regexp_replace({text}, '([<\\[|\\\\])', '$1\\\\')"


def unescape(text: str) -> str:
    return rf"regexp_replace({text}, '([<\\[|\\\\])\\\\', '$1')"


def windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, tokens, loss): formatted text, how many turns at its start repeat others, the
    estimated tokens, and the (start, length) in code points of each span under the loss mask."""
    t = turns.selectExpr("conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("tok", F.expr(f"greatest(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'), ceil(char_length(text) / 4)) + {TURN_COST}").cast("long"))
    t = t.withColumn("upto", F.sum("tok").over(sofar)).withColumn("rank", F.row_number().over(order)).withColumn("lead", F.first(F.struct("role", "text", "tok")).over(sofar))
    t = t.withColumn("left", F.expr(f"greatest({budget} - IF(lead.role = 'system', lead.tok, 0), 0)")).withColumn("hist", F.expr(f"least({HISTORY_TOKENS}, left div 4)"))
    t = t.withColumn("room", F.expr("greatest(left - hist, 1)")).withColumn("slot", F.expr("(upto - tok) div room")).withColumn("cut", F.expr("upto > (slot + 1) * room"))
    slot = W.partitionBy("conv_id", "slot")
    t = t.withColumn("whole", F.sum(F.expr("IF(cut, 0, tok)")).over(slot)).withColumn("last", F.coalesce(F.max(F.expr("IF(cut, tok, null)")).over(slot), F.lit(0)))
    t = t.withColumn("back", F.expr("whole > 0 AND whole + last <= room")).withColumn("own", F.expr("whole + IF(back, last, 0)"))
    t = t.withColumn("ahead", (F.col("tok") + F.lead("own").over(order) <= F.col("room")) & (F.lead("own").over(order) > 0))
    t = t.withColumn("window", F.when(~F.col("cut") | F.col("back"), F.expr("2 * slot")).when(F.col("ahead"), 2 * F.lead("slot").over(order)).otherwise(F.expr("2 * slot + 1")))
    t = t.withColumn("before", F.lag("window").over(order))
    nexts = []
    for j in range(1, HISTORY_TURNS + 1):
        here, prev = F.lead("window", j).over(order), F.lead("window", j - 1).over(order) if j > 1 else F.col("window")
        fits = (F.lead("upto", j - 1).over(order) if j > 1 else F.col("upto")) - F.col("upto") + F.col("tok") <= F.col("hist")
        nexts.append(F.when((here != prev) & fits & ~((F.col("rank") == 1) & (F.col("role") == "system")), here))
    t = t.withColumn("nexts", F.array(*nexts))
    copies = t.selectExpr("conv_id", """inline(concat(
      array(named_struct('window', window, 'kind', 2, 'rank', rank, 'tok', tok, 'role', role, 'text', text)),
      transform(filter(nexts, w -> w IS NOT NULL), w -> named_struct('window', w, 'kind', 1, 'rank', rank, 'tok', tok, 'role', role, 'text', text)),
      IF(before <> window AND lead.role = 'system', array(named_struct('window', window, 'kind', 0, 'rank', 1, 'tok', lead.tok, 'role', lead.role, 'text', lead.text)), array())))""")
    # In a window every turn has cost at least TURN_COST, so that what is gathered for one row is bounded.
    copies = copies.withColumn("piece", F.expr(f"concat('<|', {escape('role')}, '|>')")).withColumn("body", F.expr(escape("text")))
    parts = copies.groupBy("conv_id", "window").agg(F.sum("tok").alias("tokens"), F.sort_array(F.collect_list(F.struct("kind", "rank", "piece", "body", F.expr("role = 'assistant' AND kind = 2").alias("learn")))).alias("p"))
    ends = "aggregate(p, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + char_length(x.piece) + char_length(x.body) + 4)))"
    return parts.selectExpr(
        "conv_id", "window", "array_join(transform(p, x -> concat(x.piece, x.body, '</s>')), '') AS formatted", "size(filter(p, x -> x.kind < 2)) AS n_repeated", "tokens",
        f"transform(array({ends}), e -> filter(transform(p, (x, i) -> named_struct('start', e[i] + char_length(x.piece), 'length', cast(char_length(x.body) AS bigint), 'learn', x.learn)), y -> y.learn))[0] AS loss",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: its turns (role, text), and the text under the loss mask."""
    turn = f"named_struct('role', {unescape('substring_index(y, chr(124) || chr(62), 1)')}, 'text', {unescape('substring(y, locate(chr(124) || chr(62), y) + 2)')})"
    rows = formatted.selectExpr(
        "conv_id", "window", "char_length(formatted) AS chars",
        f"transform(slice(split(formatted, '</s>'), n_repeated + 1, size(split(formatted, '</s>')) - 1 - n_repeated), z -> transform(array(substring(z, 3)), y -> {turn})[0]) AS turns",
        f"array_join(transform(loss, s -> {unescape('substring(formatted, cast(s.start + 1 AS int), cast(s.length AS int))')}), '') AS learnt",
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "chars", "turns", "learnt"))).alias("w"))
    return whole.selectExpr("conv_id", "flatten(transform(w, x -> x.turns)) AS turns", "array_join(transform(w, x -> x.learnt), '') AS learnt", "aggregate(w, 0L, (s, x) -> s + x.chars) AS formatted_chars")


def chat_report(conversations: DataFrame) -> DataFrame:
    """The query: formats the table and the probe, writes the windows, reads them back and returns digests of what they hold."""
    spark = conversations.sparkSession
    probe = spark.sql(f"SELECT cast({PROBE_ID} AS bigint) AS conv_id, cast(turn AS bigint) AS turn, role, '{PROBE_TEXT}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    rows = conversations.selectExpr("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(stage(windows(rows), "chat"))
    return back.selectExpr(
        "conv_id", "cast(size(turns) AS bigint) AS n_turns", "sha2(array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256) AS turns_sha256",
        "cast(char_length(learnt) AS bigint) AS loss_chars", "sha2(learnt, 256) AS loss_sha256", "formatted_chars",
    )


#: The same in DuckDB's SQL: windows as ranges of ranks, their repeated turns by a join.
REPORT_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, turn, role, '{PROBE_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
a AS (SELECT *, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), (length(text) + 3) // 4)::BIGINT + {TURN_COST} AS tok,
  (8 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[|\\]', '', 'g')))::BIGINT AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rank FROM r),
h AS (SELECT conv_id, if(role = 'system', tok, 0) AS sys, if(role = 'system', chars, 0) AS sys_chars, greatest({BUDGET} - if(role = 'system', tok, 0), 0) AS room0 FROM a WHERE rank = 1),
b AS (SELECT a.*, sys, sys_chars, least({HISTORY_TOKENS}, room0 // 4) AS hist, greatest(room0 - least({HISTORY_TOKENS}, room0 // 4), 1) AS room,
  (sum(tok) OVER (PARTITION BY a.conv_id ORDER BY rank))::BIGINT AS upto FROM a JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id),
c AS (SELECT *, (upto - tok) // room AS slot FROM b),
s AS (SELECT conv_id, slot, sum(if(upto > (slot + 1) * room, 0, tok)) AS whole, sum(if(upto > (slot + 1) * room, tok, 0)) AS last, any_value(room) AS room FROM c GROUP BY ALL),
k AS (SELECT *, whole > 0 AND whole + last <= room AS back, lead(slot) OVER w AS next, lead(whole + if(whole > 0 AND whole + last <= room, last, 0)) OVER w AS next_own FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY slot)),
d AS (SELECT c.*, CASE WHEN upto <= (c.slot + 1) * c.room OR back THEN 2 * c.slot WHEN next_own > 0 AND tok + next_own <= c.room THEN 2 * next ELSE 2 * c.slot + 1 END AS win
  FROM c JOIN k ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND c.slot = k.slot),
f AS (SELECT conv_id, win, min(rank) AS first, any_value(hist) AS hist, any_value(sys_chars) AS sys_chars, sum(chars) AS chars FROM d GROUP BY conv_id, win),
m AS (SELECT f.conv_id, f.win, sum(d.chars) AS chars FROM f JOIN d ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND d.rank BETWEEN f.first - {HISTORY_TURNS} AND f.first - 1
  JOIN d l ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.rank = f.first - 1 WHERE l.upto - d.upto + d.tok <= f.hist AND NOT (d.rank = 1 AND d.role = 'system') GROUP BY ALL),
g AS (SELECT f.conv_id, sum(f.chars + coalesce(m.chars, 0) + if(f.first > 1, f.sys_chars, 0))::BIGINT AS formatted_chars FROM f LEFT JOIN m ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.win = m.win GROUP BY ALL),
o AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY rank) FILTER (role = 'assistant'), '') AS learnt FROM a GROUP BY conv_id)
SELECT o.conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM o JOIN g ON o.conv_id IS NOT DISTINCT FROM g.conv_id
"""
