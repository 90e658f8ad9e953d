"""Mixing sources to target weights along a time-varying curriculum.

Each source has a base weight and a schedule: a piecewise linear multiplier
over training time 0..1 with integral 1.  A source's target (in words) is its
share of the budget by base weight, capped at ``max_epochs`` times its size;
what a capped source cannot take is shared among the rest by weight.  Within a
source, documents come in a hashed order, pass after pass.  A document that
begins at cumulative demand ``c`` of ``target`` words is trained on at the time
``t`` where the integrated schedule reaches ``c / target``; inverting that
integral gives the position, and a range sort by position is the mix.

Only DataFrame functions are used.  The running sums are two-level (source and
hash bucket, then documents of one bucket), so a source that holds a third of
all rows is spread over ``16 ** BUCKET_DIGITS`` window groups, and over more
where there are so many rows that a group would hold more than there are groups.

Defined cases: null text has size 0 and is never taken; null source is a
source of its own, ordered last; null doc_id orders first in its bucket;
repeated rows are separate documents, and rows with the same doc_id and size may
stand for each other; very long texts are counted whole; an empty table gives no
rows.  Input
columns other than ``doc_id``, ``text`` and ``source`` are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: by weight class, (time, multiplier) knots; each integrates to 1
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)

Knots = Sequence[tuple[float, float]]


def bucket_digits(rows: int) -> int:
    """Hexadecimal digits that make about as many buckets as a bucket has rows, BUCKET_DIGITS at least."""
    digits = BUCKET_DIGITS
    while 16 ** (2 * digits) < rows:
        digits += 1
    return digits


def invert_schedule(u: Column, knots: Knots) -> Column:
    """The time at which the integral of a piecewise linear multiplier reaches ``u``."""
    out, area = None, 0.0
    for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False):
        rest, slope = u - F.lit(area), (f1 - f0) / (t1 - t0)
        if slope == 0:
            dt = rest / F.lit(f0)
        else:
            dt = (F.sqrt(F.greatest(F.lit(f0 * f0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(f0)) / F.lit(slope)
        here, area = F.lit(t0) + dt, area + (f0 + f1) / 2 * (t1 - t0)
        out = F.when(u <= F.lit(area), here) if out is None else out.when(u <= F.lit(area), here)
    return F.least(F.greatest(out.otherwise(F.lit(knots[-1][0])), F.lit(knots[0][0])), F.lit(knots[-1][0]))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> adds weight_class, target.

    With caps ``max_epochs * size``, the shares are ``min(cap, level * weight)``
    for one common level.  Over sources sorted by cap / weight, the level found
    by filling the first k to their caps rises while these are really full and
    falls afterwards, so it is the largest of those levels.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_class", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_class") + 1)
    )
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    filled = ranked.withColumn("_level", level).withColumn("_top", F.max("_level").over(everything))
    return filled.select("source", "source_size", F.col("_class").alias("weight_class"), F.least("_cap", F.col("_top") * F.col("_w")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    schedules: Sequence[Knots] = SCHEDULES,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, last_position; sorted by position.

    ``taken`` counts words over all passes; the document in which a source
    reaches its target is taken in part.  ``position`` is where the document
    first begins in the mix, in words; ``last_position`` where its last pass
    begins.  Documents that are not taken have neither and come last.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            key.alias("_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            digest.alias("_order"),
        ),
        "mix-sizes",
    )
    sized = sized.withColumn("_bucket", F.substring("_order", 1, bucket_digits(sized.count())))
    buckets = sized.groupBy("_key", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_sum"))
    totals = buckets.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, budget, max_epochs)
    targets = targets.withColumn("_key", key).drop("source")
    ahead = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.select("_key", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
        .join(targets, "_key")
    )
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_key", "_bucket"])
    start = F.col("_ahead") + F.col("_inside")
    words = F.floor(F.col("target") + F.lit(0.5))
    passes = [F.lit(p) * F.col("source_size") + start for p in range(max_epochs)]
    takes = [F.least(F.greatest(words - at, F.lit(0)), F.col("size")) for at in passes]

    def position(at: Column) -> Column:
        u = at / F.col("target")
        t = None
        for c, knots in enumerate(schedules):
            here = invert_schedule(u, knots)
            t = F.when(F.col("weight_class") % len(schedules) == c, here) if t is None else t.when(F.col("weight_class") % len(schedules) == c, here)
        return t * F.col("_all")

    taken = sum(takes[1:], takes[0])
    total = totals.agg((F.sum("source_size") * F.lit(float(budget))).alias("_all"))
    last = F.coalesce(*[F.when(take > 0, position(at)) for at, take in reversed(list(zip(passes, takes, strict=True)))])
    placed = rows.join(F.broadcast(total)).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.when(takes[0] > 0, position(passes[0])).alias("position"),
        last.alias("last_position"),
    )
    return placed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "position")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
r AS (SELECT *, CAST(([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS w,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, least(cap, max(level) OVER () * w) AS target, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.class, t.budget, floor(t.target + 0.5) AS words,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id NULLS FIRST, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, start / target AS u,
             least(greatest(words - start, 0), size) AS take1, least(greatest(words - (source_size + start), 0), size) AS take2 FROM p)
SELECT doc_id, size, source_size, target, CAST(take1 + take2 AS BIGINT) AS taken, source,
       CASE WHEN take1 > 0 THEN 0.0::DOUBLE + budget * least(greatest(CASE class
         WHEN 0 THEN (sqrt(greatest(2.25::DOUBLE - 2.0::DOUBLE * u, 0)) - 1.5::DOUBLE) / (-1.0::DOUBLE)
         WHEN 1 THEN u
         ELSE CASE WHEN u <= 0.375 THEN (sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * u, 0)) - 0.5::DOUBLE) / 1.0::DOUBLE
              ELSE 0.5::DOUBLE + (sqrt(greatest(1.0::DOUBLE + 2.0::DOUBLE * (u - 0.375::DOUBLE), 0)) - 1.0::DOUBLE) / 1.0::DOUBLE END END, 0.0), 1.0) END AS position
FROM q
"""
