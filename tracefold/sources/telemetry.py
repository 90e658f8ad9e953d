"""Telemetry sources: JSON lines, rows, any DataFrame, and the driver's event table."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("svc", T.StringType()), T.StructField("service", T.StringType()), T.StructField("dur_ms", T.DoubleType())])
_TEXT = ["ts", "kind", "service", "version", "actor", "level", "msg", "trace_id", "name"]
_MORE = ["change", "from_", "from", "source", "src", "to", "target", "dst", "op", "type", "incident_id", "trigger", "action", "outcome", "_corrupt"]
EVENT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT] + [T.StructField("value", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))] + [T.StructField(c, T.StringType()) for c in _MORE]
)
#: fixed values: remediation actions of the evaluation data
ACTIONS = ("rollback", "restart", "scale_up", "failover", "config_revert")


def parse_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One event per line; unreadable lines keep their text in ``_corrupt``; the line itself stays as ``raw_json``."""
    parsed = F.from_json(F.col(column), EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(F.col(column).alias("raw_json"), parsed.alias("e")).select("raw_json", "e.*")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path))


def from_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Events given as dicts, in their order, which ``ingest_seq`` keeps."""
    lines = [(i, json.dumps(r, default=str)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(lines, "ingest_seq bigint, value string")
    return df.select("ingest_seq", F.col("value").alias("raw_json"), F.from_json("value", EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("ingest_seq", "raw_json", "e.*")


def driver_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` table as telemetry.

    Even services are renamed on day 10 and day 20; purchases are remediations,
    errors are logs, and every twentieth error is an incident signal.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = F.concat(F.lit("svc-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"))
    even = F.col("user_id") % 2 == 0
    early, mid = F.to_timestamp_ntz(F.lit("2024-01-11 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-21 00:00:00"))
    service = F.when(~even | (F.col("ts") < early), base).when(F.col("ts") < mid, F.concat(base, F.lit("-r2"))).otherwise(F.concat(base, F.lit("-r2-r3")))
    signal = (F.col("event_type") == "error") & (F.col("event_id") % 20 == 0)
    kind = (
        F.when(signal, "incident_signal").when(F.col("event_type") == "signup", "deploy").when(F.col("event_type") == "view", "metric").when(F.col("event_type") == "purchase", "remediation").otherwise("log")
    )
    e = e.select("event_id", "ts", kind.alias("kind"), service.alias("service"), "value", "event_type")
    name = F.element_at(F.array(F.lit("latency_p99_ms"), F.lit("error_rate"), F.lit("qps")), (F.col("event_id") % 3 + 1).cast("int"))
    scaled = F.when(F.col("event_id") % 3 == 0, F.col("value") * 20).when(F.col("event_id") % 3 == 1, F.col("value") / 20).otherwise(F.col("value"))
    metric = F.when(F.col("event_id") % 40 == 0, "/error_rate>5").otherwise("/latency_p99_ms>3000")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("event_id") % 5 + 1).cast("int"))
    is_metric, is_rem = F.col("kind") == "metric", F.col("kind") == "remediation"
    return e.select(
        "event_id",
        "ts",
        "kind",
        "service",
        F.when(F.col("kind") == "log", F.when(F.col("event_type") == "error", "error").otherwise("info")).alias("level"),
        F.when(is_metric, name).alias("name"),
        F.when(is_metric, scaled).alias("value"),
        F.when(signal_kind(), F.concat(F.lit("INC-"), F.col("event_id").cast("string"))).alias("incident_id"),
        F.when(signal_kind(), F.concat(F.lit("alert:"), F.col("service"), metric)).alias("trigger"),
        F.when(is_rem, action).alias("action"),
        F.when(is_rem, F.col("service")).alias("target"),
        F.when(is_rem, F.when(F.col("value") < 150, "resolved").otherwise("worsened")).alias("outcome"),
    )


def signal_kind():
    return F.col("kind") == "incident_signal"


def driver_topology(spark: SparkSession) -> DataFrame:
    """The constant topology log that goes with ``driver_telemetry``: (ts, seq, change, src, dst)."""
    rows = []
    for i in range(12):
        rows.append((f"2024-01-{i + 1:02d} 00:00:00", "dep_add", f"svc-{i:02d}", f"svc-{(i + 1) % 12:02d}"))
        if i % 3 == 0:
            rows.append(("2024-01-16 00:00:00", "dep_remove", f"svc-{i:02d}", f"svc-{(i + 1) % 12:02d}"))
        if i % 2 == 0:
            rows.append(("2024-01-11 00:00:00", "rename", f"svc-{i:02d}", f"svc-{i:02d}-r2"))
            rows.append(("2024-01-21 00:00:00", "rename", f"svc-{i:02d}-r2", f"svc-{i:02d}-r2-r3"))
    df = spark.createDataFrame([(t, n, c, a, b) for n, (t, c, a, b) in enumerate(sorted(rows))], "ts string, seq int, change string, src string, dst string")
    return df.withColumn("ts", F.to_timestamp_ntz("ts"))
