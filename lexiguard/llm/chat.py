"""Cumulative chat snapshots: keep only conversations that no longer one continues, then render them.

Loggers often write a conversation again after every turn. Each turn gets a
rolling hash of all turns up to it: the bitwise xor of two 64-bit hashes of
(position, role, text), so a prefix's hash is a running aggregate. A
conversation whose full hash is the hash of a strict prefix of another is
dropped by an anti-join; of equal conversations the smallest id stays.

Turns are ordered by turn (null first), then role and text, and numbered
from 1, so repeated turn numbers have a defined place; a repeated row is a turn
of its own. Null roles and texts are values of their own for comparing, and
render as empty strings. Rows with a null conversation id form one
conversation; of equal conversations it stays only if no other is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiguard.llm.common import written

#: Turns that one rendered row holds, so that a very long conversation is rendered by many tasks.
SEGMENT_TURNS = 256


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, run, pos): turns numbered from 1 in each conversation, and the part of all rows that they are in.

    All rows are put in order over many tasks; a conversation goes on in the
    next part where one ends, so neither a long one nor a turn number that many
    rows have needs one task.
    """
    # The last key tells equal rows apart, so that these spread too.
    t = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text", "row")]
    dealt = written(t.repartitionByRange(F.col("conv_id").asc_nulls_first(), *order).withColumn("run", F.spark_partition_id()))
    here = dealt.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "run").orderBy(*order)))
    # A row for each part that a conversation is in.
    sizes = dealt.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    return here.join(offsets, _same(here, offsets)).select(here["conv_id"], "role", "text", here["run"], (F.col("at") + F.col("skipped")).alias("pos"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a["run"] == b["run"])


def rolling_hashes(placed: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2): the hashes of all turns up to each one. Runs are hashed apart and then carried on."""
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)

    def one(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))

    hashed = placed.select("conv_id", "run", "pos", one(1).alias("a"), one(2).alias("b"))
    so_far = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.select("conv_id", "run", "pos", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))
    totals = hashed.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = totals.select("conv_id", "run", F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("cb"))
    return rolled.join(carried, _same(rolled, carried)).select(rolled["conv_id"], "pos", F.col("a").bitwiseXOR(F.col("ca")).alias("h1"), F.col("b").bitwiseXOR(F.col("cb")).alias("h2"))


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are neither a strict prefix nor a later copy of another, for positions()."""
    prefixes = rolling_hashes(placed)
    ends = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "pos").alias("h"))
    ends = ends.select("conv_id", "n_turns", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    # Copies fall together before any join, so a much repeated conversation is one row from here on.
    full = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    # Every full hash counts once a conversation, and once more for each one that goes on after it.
    reached = prefixes.groupBy("pos", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    ended = ends.groupBy("n_turns", "h1", "h2").agg(F.count(F.lit(1)).alias("n_ended"))
    strict = reached.join(ended, (reached.pos == ended.n_turns) & (reached.h1 == ended.h1) & (reached.h2 == ended.h2)).where("n > n_ended").select("pos", reached.h1.alias("p1"), reached.h2.alias("p2"))
    return full.join(strict, (F.col("n_turns") == F.col("pos")) & (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")), "left_anti").select("conv_id", "n_turns")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, segment, n_turns, n_segment_turns, rendered) of the maximal conversations.

    A segment holds the next SEGMENT_TURNS turns by position; a conversation's
    text is that of its segments in order. An empty table gives no rows; further
    columns are not read.
    """
    placed = written(positions(turns))
    keep = maximal_conversations(placed)
    t = placed.select(F.col("conv_id").alias("cid"), "role", "text", "pos")
    kept = t.join(keep, F.col("cid").eqNullSafe(F.col("conv_id"))).drop("cid")
    segment = F.floor((F.col("pos") - 1) / SEGMENT_TURNS).cast("long").alias("segment")
    parts = kept.groupBy("conv_id", "n_turns", segment).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    return parts.select(
        "conv_id",
        "segment",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.size("turns").cast("long").alias("n_segment_turns"),
        F.array_join(F.transform("turns", lambda x: render_turn(x.role, x.text)), "").alias("rendered"),
    )


COLLAPSE_SQL = """
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY pos) AS l FROM t GROUP BY conv_id),
k AS (
  SELECT conv_id, n FROM c a
  WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.n > a.n AND b.l[1] = a.l[1] AND list_slice(b.l, 1, a.n) = a.l)
    AND NOT EXISTS (SELECT 1 FROM c b WHERE b.n = a.n AND b.l = a.l AND (b.conv_id < a.conv_id OR a.conv_id IS NULL AND b.conv_id IS NOT NULL)))
SELECT k.conv_id, CAST((t.pos - 1) // 256 AS BIGINT) AS segment, CAST(any_value(k.n) AS BIGINT) AS n_turns, CAST(count(*) AS BIGINT) AS n_segment_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM k JOIN t ON k.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY k.conv_id, (t.pos - 1) // 256
"""
