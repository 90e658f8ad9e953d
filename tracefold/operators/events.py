"""Normalising, filtering and scanning events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X


def normalise(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): events need a readable ``ts`` and a ``kind``; other fields stay.

    A ``ts`` that is a timestamp already is taken as it is.
    """
    if "ts" in raw.columns and raw.schema["ts"].dataType.typeName() != "string":
        typed = raw.withColumn("event_ts", F.col("ts"))
    else:
        typed = raw.withColumn("event_ts", X.parse_timestamp(F.col("ts")))
    good = F.col("event_ts").isNotNull() & F.col("kind").isNotNull()
    return typed.filter(good), typed.filter(~good)


def parser_counts(raw: DataFrame) -> DataFrame:
    """(parsed, errors): how many events are accepted and rejected, in one pass."""
    ok = F.col("event_ts").isNotNull() & F.col("kind").isNotNull()
    typed = raw.withColumn("event_ts", F.col("ts") if raw.schema["ts"].dataType.typeName() != "string" else X.parse_timestamp(F.col("ts")))
    return typed.agg(F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("errors"))


def without_background(events: DataFrame) -> DataFrame:
    """Drop load metrics that every service emits all the time."""
    noise = (F.col("kind") == "metric") & F.col("name").isin(*X.BACKGROUND_METRICS)
    return events.filter(~F.coalesce(noise, F.lit(False)))


def behaviour(events: DataFrame) -> DataFrame:
    """Events that enter fingerprints, with their ``label``."""
    label = X.kind_label(*[F.col(c) for c in ("kind", "name", "value", "level", "trigger", "action")])
    return events.filter(F.col("service").isNotNull()).withColumn("label", label).filter("label is not null")


def time_range(events: DataFrame, start: str, end: str, kind: str | None = None, services: list[str] | None = None) -> DataFrame:
    """Closed time range; the bounds reach the Parquet scan."""
    out = events.filter(F.col("ts").between(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))))
    out = out.filter(F.col("kind") == kind) if kind else out
    return out.filter(F.col("service").isin(*services)) if services is not None else out


def latest(events: DataFrame, n: int, service: str | None = None, seq: str = "event_id") -> DataFrame:
    """The n newest arrivals, of one service or of all: what a ring buffer of n holds."""
    out = events.filter(F.col("service") == service) if service else events
    return out.orderBy(F.desc(seq)).limit(n)


def buffered(events: DataFrame, capacity: int, services: list[str] | None = None, start: str | None = None, end: str | None = None, seq: str = "event_id") -> DataFrame:
    """Of the ``capacity`` newest arrivals, those of the services, or without one, in a closed time range."""
    out = latest(events, capacity, seq=seq)
    if services is not None:
        out = out.filter(F.col("service").isNull() | F.col("service").isin(*services))
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    out = out.filter(F.col("ts") >= at(start)) if start else out
    return out.filter(F.col("ts") <= at(end)) if end else out


def by_id(events: DataFrame, ids: DataFrame | list[int], key: str = "event_id") -> DataFrame:
    """The rows with the given ids; a list is pushed down to the scan, a table is joined."""
    if isinstance(ids, list):
        return events.filter(F.col(key).isin(*ids))
    return events.join(ids.select(key).distinct(), key, "left_semi")


def search(events: DataFrame, predicate) -> DataFrame:
    """The rows that a condition, a Column or SQL text, holds for."""
    return events.filter(predicate)


def for_output(events: DataFrame) -> DataFrame:
    """Events as they are handed out: ``ts`` in ISO 8601, nothing of the raw line."""
    return events.withColumn("ts", X.iso(F.col("ts"))).drop("raw_json")


def kind_histogram(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def first_last_seen(events: DataFrame, key: str = "service") -> DataFrame:
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_events"))


def span_pairs(traces: DataFrame) -> DataFrame:
    """(event_id, ts, pos, src, dst): calls between neighbouring spans of a trace; spans without a service are passed over."""
    names = F.filter(F.transform("spans", lambda s: X.first_text(s["svc"], s["service"])), lambda n: n.isNotNull())
    one = traces.select("event_id", "ts", names.alias("names")).filter(F.size("names") > 1)
    pairs = F.arrays_zip(F.slice("names", 1, F.size("names") - 1).alias("src"), F.slice("names", 2, F.size("names") - 1).alias("dst"))
    return one.select("event_id", "ts", F.posexplode(pairs).alias("pos", "p")).select("event_id", "ts", "pos", "p.src", "p.dst")
