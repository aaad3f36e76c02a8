"""Chat formatting: every participant's view of a dialogue, with masks.

For every participant of a conversation (every role but `system`), each turn is rendered with that
participant as `assistant`, system turns as `system`, and all others as `user` under their name:

    <|start|>user name=X<|text|>...<|end|>
    <|start|>assistant<|text|>...<|end|>

`mask` lists the code points to learn from, end exclusive: what the assistant says and its <|end|>.
What looks like a marker in a text or a name gets a backslash more after its `<`, so that only real
markers end a turn, and taking one away gives the text back.

A conversation is rendered in parts of `rows_a_part` rows, each one row of the result, so that no row
has to hold a conversation of any length; parts in order of `part` give the whole dialogue. A row's rank is the
number of rows in earlier ranges of turn numbers, plus those before it in its range, by counts of
(turn, role, first digit of the text's digest): no task sorts a long conversation, and no row of equal
turn numbers is dealt with apart. A part's rows are put together once and rendered for each participant.

Edge cases: a null role is a participant named `unknown`; a null text is empty; a null turn stands
before all others; equal turns go by role, then by the text's MD5 digest; repeated rows are counted once and
rendered as often as they occur; rows of a null conv_id are one conversation; a conversation of system
turns only has no participant and no row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import util

SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), md5(coalesce(text, ''))) - 1) AS rank
  FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, p.perspective, t.rank // 256 AS part, t.rank,
         CASE WHEN t.role = p.perspective THEN '<|start|>assistant<|text|>'
              WHEN t.role = 'system' THEN '<|start|>system<|text|>'
              ELSE '<|start|>user name=' || regexp_replace(t.role, '<(\\*)\|', '<\\\1|', 'g') || '<|text|>' END AS head,
         t.role = p.perspective AS own, regexp_replace(t.text, '<(\\*)\|', '<\\\1|', 'g') AS text
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), n AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER w - (length(head) + length(text) + 8) AS began
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
       CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY rank) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(began + length(head) AS BIGINT) || ':' ||
                CAST(began + length(head) + length(text) + 7 AS BIGINT) END, ',' ORDER BY rank), '') AS mask
FROM n GROUP BY conv_id, perspective, part
"""


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _parts(turns: DataFrame, rows_a_part: int) -> DataFrame:
    """(conv_id, part, turns array<struct<rank, role, text, times>>) of each part, times being the repeats of a row."""
    t = turns.select(
        F.col("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    t = t.withColumns({"digest": F.md5("text"), "stretch": F.floor(F.col("turn") / rows_a_part)})
    t = t.groupBy("conv_id", "stretch", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    fine = ["conv_id", "stretch", "turn", "role", "digit"]
    t = t.withColumn("digit", F.substring("digest", 1, 2))
    by_digit = t.groupBy(*fine).agg(F.sum("n").alias("m"))
    by_turn = by_digit.groupBy("conv_id", "stretch").agg(F.sum("m").alias("m"))
    earlier = by_turn.select("conv_id", "stretch", (F.sum("m").over(Window.partitionBy("conv_id").orderBy("stretch")) - F.col("m")).alias("earlier"))
    within = by_digit.select(*fine, (F.sum("m").over(Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "digit")) - F.col("m")).alias("within"))
    own = F.sum("n").over(Window.partitionBy(*fine).orderBy("digest")) - F.col("n")
    same = lambda a, b, keys: a.join(b.hint("rebalance").withColumnsRenamed({k: f"{k}_" for k in keys}), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*[f"{k}_" for k in keys])
    ranked = same(same(t.withColumn("own", own), within, fine), earlier, ["conv_id", "stretch"])
    first = F.col("earlier") + F.col("within") + F.col("own")
    part = F.explode(F.sequence(F.floor(first / rows_a_part), F.floor((first + F.col("n") - 1) / rows_a_part)))
    cut = ranked.select("conv_id", "role", "text", "n", first.alias("first"), part.alias("part"))
    start = F.greatest("first", F.col("part") * rows_a_part)
    times = F.least(F.col("first") + F.col("n"), (F.col("part") + 1) * rows_a_part) - start
    row = F.struct(start.alias("rank"), "role", escaped(F.col("text")).alias("text"), times.cast("int").alias("times"))
    return cut.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(row)).alias("turns"))


def perspectives(turns: DataFrame, rows_a_part: int = 256) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_own, rendered, mask array<struct<start,end>>)."""
    who = turns.select(F.col("conv_id").alias("c"), F.coalesce("role", F.lit("unknown")).alias("perspective")).where("perspective <> 'system'").distinct().hint("rebalance")
    each = _parts(turns, rows_a_part).join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = lambda x: x["role"] == F.col("perspective")
    head = lambda x: (
        F.when(own(x), F.lit("<|start|>assistant<|text|>"))
        .when(x["role"] == "system", F.lit("<|start|>system<|text|>"))
        .otherwise(F.concat(F.lit("<|start|>user name="), escaped(x["role"]), F.lit("<|text|>")))
    )
    each = each.withColumn("turns", F.flatten(F.transform("turns", lambda x: F.array_repeat(F.struct(head(x).alias("head"), x["text"].alias("text"), own(x).alias("own")), x["times"]))))
    rendered = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit("<|end|>\n"))), "")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["text"]) + 8).alias("at"),
            F.when(x["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), (acc["at"] + F.length(x["head"]) + F.length(x["text"]) + 7).alias("end")))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    n_own = F.size(F.filter("turns", lambda x: x["own"])).cast("long")
    return each.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), n_own.alias("n_own"), rendered.alias("rendered"), spans.alias("mask"))


def op2_dialogue_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perspectives(util.table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("conv_id", "perspective", "part", "n_turns", "n_own", "rendered", mask.alias("mask"))
