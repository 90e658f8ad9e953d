"""Scores of contexts against known truth, joined on the incident id."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.tables import written

#: fixed values: weights of the automated axes, and latency budgets in ms
WEIGHTS = {"recall_at_5": 0.30, "precision_at_5": 0.15, "remediation_acc": 0.20, "latency": 0.15}
BUDGET_MS = {"fast": 2000.0, "deep": 6000.0}


def score_matches(matches: DataFrame, truth: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(incident_id, in_top_k, precision): hits are matches of the true family; decoys want no confident match."""
    m = matches.filter(F.col("rank") <= k).select("incident_id", X.family_number(F.col("match_id")).alias("_f"), "similarity")
    j = truth.join(m, "incident_id", "left").groupBy("incident_id").agg(
        F.first("family").alias("family"), F.sum((F.col("_f") == F.col("family")).cast("int")).alias("hits"), F.sum((F.col("similarity") >= threshold).cast("int")).alias("sure")
    )
    hits, sure = F.coalesce("hits", F.lit(0)), F.coalesce("sure", F.lit(0))
    ok = F.when(F.col("family").isNull(), sure == 0).otherwise(hits > 0)
    return j.select("incident_id", ok.alias("in_top_k"), F.when(F.col("family").isNull(), (sure == 0).cast("double")).otherwise(hits / F.lit(float(k))).alias("precision"))


def score_remediations(tips: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(incident_id, remediation_ok): the expected action is among the suggestions; decoys want no confident one."""
    j = truth.join(tips.select("incident_id", "action", "confidence"), "incident_id", "left").groupBy("incident_id").agg(
        F.first("expected").alias("expected"), F.max((F.col("action") == F.col("expected")).cast("int")).alias("hit"), F.max((F.col("confidence") >= threshold).cast("int")).alias("sure")
    )
    ok = F.when(F.col("expected").isNull(), F.coalesce("sure", F.lit(0)) == 0).otherwise(F.coalesce("hit", F.lit(0)) == 1)
    return j.select("incident_id", ok.alias("remediation_ok"))


def summary(match_scores: DataFrame, remediation_scores: DataFrame) -> DataFrame:
    """One row: n, recall_at_5, precision_at_5, remediation_acc."""
    j = match_scores.join(remediation_scores, "incident_id")
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return j.agg(F.count(F.lit(1)).alias("n"), mean("in_top_k").alias("recall_at_5"), mean("precision").alias("precision_at_5"), mean("remediation_ok").alias("remediation_acc"))


def latency_p95(latencies: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Discrete p95: element ``max(0, int(.95 n) - 1)`` of the sorted latencies, by a distributed sort."""
    n = latencies.filter(F.col(column).isNotNull()).count()
    return latencies.filter(F.col(column).isNotNull()).select(F.col(column).alias("p95")).orderBy("p95").offset(max(0, int(0.95 * n) - 1)).limit(1)


def weighted_score(axes: dict[str, float], weights: dict[str, float] | None = None) -> float:
    """Sum of weight times axis, each axis between 0 and 1."""
    weights = weights or WEIGHTS
    return sum(weights[k] * min(1.0, max(0.0, axes.get(k, 0.0))) for k in weights)


def latency_axis(p95_ms: float, mode: str = "fast") -> float:
    return max(0.0, min(1.0, BUDGET_MS.get(mode, 2000.0) / max(p95_ms, 1e-6)))


def from_contexts(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, tips): the ranked matches and suggestions that contexts hold, as rows."""
    m = contexts.select("incident_id", F.explode("similar_past_incidents").alias("m")).select("incident_id", "m.rank", "m.match_id", "m.similarity")
    t = contexts.select("incident_id", F.explode("suggested_remediations").alias("t")).select("incident_id", "t.rank", "t.action", "t.confidence")
    return m, t


def run_seed(spark: SparkSession, engine_factory: Callable, config, mode: str = "fast") -> dict:
    """Generate, ingest, reconstruct the contexts of all evaluation signals in one plan, and score them by incident id."""
    from ..sources.generator import generate

    data = generate(spark, config)
    engine = engine_factory(spark)
    try:
        began = time.monotonic()
        engine.ingest(data.train)
        engine.ingest(data.evaluation)
        ingest_ms = (time.monotonic() - began) * 1000
        began = time.monotonic()
        found = written(engine.reconstruct(data.signals, mode).select("incident_id", "similar_past_incidents", "suggested_remediations"), "scored")
        query_ms = (time.monotonic() - began) * 1000
        matches, tips = from_contexts(found)
        row = summary(score_matches(matches, data.truth), score_remediations(tips, data.truth)).first().asDict()
        n = max(row["n"], 1)
        return {"seed": config.seed, "config": asdict(config), "mode": mode, "ingest_ms": round(ingest_ms, 2), "n_train": data.train.count(), "n_eval": data.evaluation.count(), "n_signals": row["n"], "summary": row | {"latency_mean_ms": round(query_ms / n, 2), "latency_p95_ms": round(query_ms / n, 2)}}
    finally:
        engine.close()


def across_seeds(per_seed: list[dict], mode: str = "fast") -> dict:
    """Unweighted means over the seeds, the worst seed's p95, and the weighted score of the automated axes."""
    some = [r["summary"] for r in per_seed if r["summary"]["n"]]
    mean = lambda k: round(sum(s[k] for s in some) / len(some), 4) if some else 0.0
    out = {k: mean(k) for k in ("recall_at_5", "precision_at_5", "remediation_acc", "latency_mean_ms")}
    out["latency_p95_ms"] = max((s["latency_p95_ms"] for s in some), default=0.0)
    out |= {"n_seeds": len(per_seed), "n": sum(r["n_signals"] for r in per_seed)}
    axes = {k: out[k] for k in ("recall_at_5", "precision_at_5", "remediation_acc")} | {"latency": latency_axis(out["latency_p95_ms"], mode)}
    return out | {"axes": axes, "weighted_score": round(weighted_score(axes), 4) if some else 0.0, "max_automated": round(sum(WEIGHTS.values()), 4)}


def run(spark: SparkSession, engine_factory: Callable, config, mode: str = "fast", seeds: Iterable[int] | None = None, path: str | None = None) -> dict:
    """A fresh engine for each seed; the report goes to ``path`` as JSON if one is given."""
    from dataclasses import replace

    per_seed = [run_seed(spark, engine_factory, replace(config, seed=s), mode) for s in (seeds or [config.seed])]
    report = {"mode": mode, "seeds": [r["seed"] for r in per_seed], "per_seed": per_seed, "aggregated": across_seeds(per_seed, mode)}
    if path:
        text = spark.createDataFrame([(json.dumps(report, default=str),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(path)
    return report
