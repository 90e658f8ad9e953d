"""A bit table of hashes, small enough to broadcast whatever the input, that spares rows an exact join.

``2**size`` bits are held in at most ``2**size / 64`` rows.  A row whose bit is
not set surely has no partner; one whose bit is set may have one, and an exact
join settles that.  A fuller table lets more rows through and changes nothing
else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 20


def _slot(h: Column, size: int) -> Column:
    return F.pmod(h, F.lit(1 << size))


def table_of(keys: DataFrame, column: str, size: int = SIZE) -> DataFrame:
    """(_word, _bits) of the hashes in a column."""
    slot = keys.select(_slot(F.col(column), size).alias("slot"))
    return slot.groupBy(F.floor(F.col("slot") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("_bits"))


def marked(rows: DataFrame, h: Column, table: DataFrame, size: int = SIZE, name: str = "_maybe") -> DataFrame:
    """Adds whether a row's hash may be in the table; the table is broadcast, its size is bounded by ``size``."""
    there = rows.withColumn("_slot", _slot(h, size)).withColumn("_word", F.floor(F.col("_slot") / 64)).join(F.broadcast(table), "_word", "left")
    bit = F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, cast(_slot % 64 as int))")) != 0
    return there.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_slot", "_word", "_bits")
