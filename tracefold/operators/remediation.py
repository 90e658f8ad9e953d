"""Remediation history, its decay, and the suggestion cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def attach(remediations: DataFrame, signals: DataFrame) -> DataFrame:
    """The history: each remediation with the incident it names, else the latest earlier signal of its service.

    The latter is an as-of join as one union and one running value: both sides
    are shuffled once by node, and no pair of rows is formed.  ``linked`` tells
    whether the incident's pattern was stored when the remediation came.
    """
    named = F.nullif("incident_id", F.lit("")) if "incident_id" in remediations.columns else F.lit(None).cast("string")
    rem = remediations.select("node", "ts", "event_id", "action", "target", "outcome", named.alias("_named"))
    s = signals.select("node", F.col("sig_ts").alias("ts"), F.lit(0).alias("_k"), F.col("incident_id").alias("_inc"), F.lit(None).cast("bigint").alias("event_id"), *[F.lit(None).cast("string").alias(c) for c in ("action", "target", "outcome", "_named")])
    r = rem.select("node", "ts", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("_inc"), "event_id", "action", "target", "outcome", "_named")
    w = Window.partitionBy("node").orderBy("ts", "_k", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(r).withColumn("_asof", F.last("_inc", ignorenulls=True).over(w)).filter("_k = 1").withColumn("incident_id", F.coalesce("_named", "_asof"))
    first = signals.groupBy(F.col("incident_id").alias("_named")).agg(F.min("event_id").alias("_stored"))
    linked = F.when(F.col("_named").isNull(), F.col("_asof").isNotNull()).otherwise(F.coalesce(F.col("_stored") < F.col("event_id"), F.lit(False)))
    out = both.join(first, "_named", "left")
    return out.select("event_id", F.col("ts").alias("applied_at"), "node", "action", "target", "outcome", "incident_id", X.base_confidence(F.col("outcome")).alias("base"), linked.alias("linked"))


def by_incident(matches: DataFrame, history: DataFrame, per_match: int = 2) -> DataFrame:
    """Strategy 1: the newest remediations of each matched incident, before the signal."""
    h = history.select(F.col("incident_id").alias("match_id"), "action", "target", "outcome", "base", "applied_at", "event_id")
    j = matches.join(h, "match_id").filter(F.col("applied_at") < F.col("sig_ts"))
    w = Window.partitionBy("incident_id", "match_id").orderBy(F.desc("applied_at"), F.desc("event_id"))
    j = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_match)
    c = X.decay(F.col("base"), F.col("applied_at"), F.col("sig_ts"))
    c = F.when(F.col("outcome") == "resolved", F.least(F.lit(0.95), c * 1.2)).otherwise(c)
    return j.select("incident_id", F.lit(1).alias("strategy"), F.col("rank").alias("source_rank"), "action", "target", "outcome", "applied_at", c.alias("confidence"))


def by_pattern(matches: DataFrame, history: DataFrame, per_match: int = 2) -> DataFrame:
    """Strategy 2: the newest remediations stored with a matched incident's pattern, cut before the time filter.

    ``linked`` says which remediations came after their incident's pattern.
    """
    h = history.filter("linked").withColumn("_r", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("applied_at"), F.desc("event_id")))).filter(F.col("_r") <= per_match)
    h = h.select(F.col("incident_id").alias("match_id"), "action", "target", "outcome", "base", "applied_at")
    j = matches.join(h, "match_id").filter(F.col("applied_at") < F.col("sig_ts"))
    c = X.decay(F.col("base"), F.col("applied_at"), F.col("sig_ts"))
    c = F.when(F.col("outcome") == "resolved", F.least(F.lit(0.95), c * 1.2)).otherwise(c)
    return j.select("incident_id", F.lit(2).alias("strategy"), F.col("rank").alias("source_rank"), "action", "target", "outcome", "applied_at", c.alias("confidence"))


def of_family(history: DataFrame, families: DataFrame, per_family: int = 5) -> DataFrame:
    """(family, rank, incident_id, action, target, outcome, base, applied_at): a family's newest remediations."""
    j = history.filter("linked").join(families.select("incident_id", "family"), "incident_id")
    w = Window.partitionBy("family").orderBy(F.desc("applied_at"), F.desc("event_id"))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_family).select("family", "rank", "incident_id", "action", "target", "outcome", "base", "applied_at")


def by_target(signals: DataFrame, history: DataFrame, keep: int = 3, factor: float = 1.0, strategy: int = 3) -> DataFrame:
    """Strategies 3 and 4: resolved remediations of a service; the cut comes before the time filter."""
    h = history.filter((F.col("outcome") == "resolved") & (F.col("base") >= 0.3))
    top = h.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("applied_at"), F.desc("event_id")))).filter(F.col("_r") <= keep)
    j = signals.select("incident_id", "sig_ts", "node").join(top.drop("incident_id"), "node").filter(F.col("applied_at") < F.col("sig_ts"))
    c = X.decay(F.col("base"), F.col("applied_at"), F.col("sig_ts")) * factor
    return j.select("incident_id", F.lit(strategy).alias("strategy"), F.col("_r").alias("source_rank"), "action", "target", "outcome", "applied_at", c.alias("confidence"))


def neighbours(signals: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """Strategy 4: resolved remediations of services one edge away in the current graph."""
    now = edges.filter("valid_to is null")
    both = now.select("src", "dst").unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = signals.join(both, signals["node"] == both["src"]).select("incident_id", "sig_ts", F.col("dst").alias("node"))
    return by_target(near, history, keep=2, factor=0.9, strategy=4)


def suggest(*strategies: DataFrame, keep: int = 3) -> DataFrame:
    """Staged: a strategy adds to what earlier ones found only while there are fewer than ``keep``."""
    every = strategies[0]
    for s in strategies[1:]:
        every = every.unionByName(s)
    first = Window.partitionBy("incident_id", "action", "target").orderBy("strategy", "source_rank", F.desc("applied_at"))
    once = every.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    before = Window.partitionBy("incident_id").orderBy("strategy").rangeBetween(Window.unboundedPreceding, -1)
    open_ = once.withColumn("_n", F.coalesce(F.count(F.lit(1)).over(before), F.lit(0))).filter(F.col("_n") < keep).drop("_n")
    w = Window.partitionBy("incident_id").orderBy(F.desc("confidence"), "strategy", "source_rank", "action", "target")
    return open_.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def reinforcement(history: DataFrame, families: DataFrame) -> DataFrame:
    """(family, n_resolved, reinforced): 0.05 for every resolved remediation, from 0.5 up to 0.95."""
    j = history.filter("outcome = 'resolved'").join(families.select("incident_id", "family"), "incident_id")
    return j.groupBy("family").agg(F.count(F.lit(1)).alias("n_resolved")).withColumn("reinforced", F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.05) * F.col("n_resolved")))
