"""Cumulative-snapshot collapse and rendering of logged conversations.

A chat logger that saves the whole conversation after every turn leaves, for
one conversation of n turns, n records that are prefixes of each other.  Each
record gets a rolling hash after every turn; a record whose final hash is a
non-final prefix hash of another record is a snapshot of it and is anti-joined
away, and of equal records the one with the smallest conv_id stays.  What
remains is rendered with role markers.

Only DataFrame functions are used.  A hot first turn or a much copied
conversation costs nothing extra: prefix hashes are made distinct with
map-side aggregation before the anti-join, so its right side has one row for
each hash.  Turns are ordered and hashed one by one; only conversations that
stay are gathered, as the output row holds the whole conversation anyway.

Defined cases: turns are ordered by (turn, role, text), nulls first, and turn
numbers themselves are not compared; null role or text differs from an empty
one in the hashes and renders as an empty string; rows with null conv_id form
one conversation; repeated rows are repeated turns; very long conversations are
hashed in one pass; an empty table gives no rows; other columns are ignored,
whatever their names.  Marker strings inside texts are broken up by
a space so that they cannot pose as markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, table

START, END = "<|im_start|>", "<|im_end|>"


def _tagged(c: Column) -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("v"), c), F.lit("n")))


def snapshots(turns: DataFrame) -> DataFrame:
    """Every turn with its place k in its conversation of n turns, and the rolling hash (p, q) up to it.

    The hash is a running exclusive-or of each turn's hash with its place, 120
    bits of MD5: one pass over the ordered turns, however many they are.
    """
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    own = F.md5(F.concat(F.col("k").cast("string"), F.lit(" "), _tagged(F.col("role")), _tagged(F.col("text"))))
    half = lambda at: F.conv(F.substring("_h", at, 15), 16, 10).cast("bigint")
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h", own).withColumn("_a", half(1)).withColumn("_b", half(16))
    return rows.withColumn("p", F.bit_xor("_a").over(upto)).withColumn("q", F.bit_xor("_b").over(upto)).drop("_h", "_a", "_b", "turn")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n, n_copies) of the conversations that are no prefix of a longer one, and of equal ones the first."""
    ends = turns.filter("k = n").groupBy("p", "q", "n").agg(F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id")).alias("_least"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = turns.filter("k < n").select("p", "q", F.col("k").alias("n")).distinct()
    return ends.join(prefixes, ["p", "q", "n"], "left_anti").select(F.col("_least.conv_id").alias("conv_id"), "n", "n_copies")


def render(turns: Column) -> Column:
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    one = lambda x: F.concat(F.lit(START), clean(x.role), F.lit("\n"), clean(x.text), F.lit(END), F.lit("\n"))
    return F.array_join(F.transform(turns, one), "")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations."""
    rows = materialize(snapshots(turns), "chat-snapshots")
    kept = maximal(rows).withColumnRenamed("conv_id", "_id").select("_id", "n_copies")
    mine = rows.join(kept, rows["conv_id"].eqNullSafe(kept["_id"])).groupBy("conv_id", "n_copies").agg(F.sort_array(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
    return mine.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("rendered"))


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(coalesce('v' || role, 'n')) || md5(coalesce('v' || text, 'n')) AS piece,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
h AS (SELECT *, md5(string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h FROM t),
e AS (SELECT conv_id, h FROM h WHERE k = n),
g AS (SELECT h, arg_min(conv_id, conv_id) AS conv_id, count(*) AS n_copies FROM e
      WHERE h NOT IN (SELECT h FROM h WHERE k < n) GROUP BY h)
SELECT g.conv_id, max(t.n) AS n_turns, max(g.n_copies) AS n_copies,
       string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM g JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY g.conv_id
"""
