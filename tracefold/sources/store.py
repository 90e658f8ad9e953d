"""The engine's tables in one folder that every executor sees.

Events are appended by batch: a batch writes its own folder and overwrites it
when it is run again, so a retry neither loses nor doubles rows.  Derived tables
(nodes, edges, patterns, families, remediations) are published as whole new
versions; readers take the newest one whose write has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .telemetry import EVENT_SCHEMA

_EVENT_COLUMNS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields if f.name != "_corrupt")
#: table -> columns
SCHEMAS = {
    "events": f"ingest_seq bigint, event_ts timestamp_ntz, raw_json string, {_EVENT_COLUMNS}",
    "rejected": f"ingest_seq bigint, raw_json string, {_EVENT_COLUMNS}",
    "nodes": "node string, canonical string, aliases array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz",
    "edges": "src string, dst string, kind string, valid_from timestamp_ntz, last_seen timestamp_ntz, valid_to timestamp_ntz, confidence double, n_evidence bigint",
    "patterns": "incident_id string, trigger_node string, sig_ts timestamp_ntz, n_elements int, fp_json string, fp_hash string, family string",
    "families": "family string, trigger_node string, incident_id string, fp_hash string, incident_count bigint, reinforced double",
    "remediations": "event_id bigint, applied_at timestamp_ntz, node string, action string, target string, outcome string, incident_id string, base double, linked boolean",
}
APPENDED = ("events", "rejected")


class Store:
    """Tables below ``folder``; nothing is kept open between calls."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _listed(self, name: str) -> list[str]:
        """Names of what a table's folder holds."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _ended(self, name: str, part: str) -> bool:
        return "_SUCCESS" in self._listed(f"{name}/{part}")

    def append(self, name: str, df: DataFrame, batch: int) -> None:
        """Write a batch; the same batch number again replaces it."""
        columns = self.empty(name).columns
        have = {c for c in df.columns}
        out = df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(self.empty(name).schema[c].dataType).alias(c) for c in columns])
        out.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def publish(self, name: str, df: DataFrame) -> int:
        """Write a whole new version of a derived table; returns its number."""
        number = max([int(p.split("=")[1]) for p in self._listed(name) if p.startswith("version=")], default=0) + 1
        df.select(*[F.col(f"`{c}`") for c in self.empty(name).columns]).write.mode("overwrite").parquet(f"{self.folder}/{name}/version={number}")
        return number

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        """All ended batches of an appended table, or the newest ended version of a derived one."""
        parts = [p for p in self._listed(name) if "=" in p and self._ended(name, p)]
        if not parts:
            return self.empty(name)
        if name in APPENDED:
            return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/{name}/{p}" for p in parts])
        newest = max(parts, key=lambda p: int(p.split("=")[1]))
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/{newest}")

    def batches(self) -> int:
        return len([p for p in self._listed("events") if p.startswith("batch=")])

    def by_id(self, name: str, key: str, ids: list) -> DataFrame:
        """Rows with the given ids; the filter reaches the scan."""
        return self.read(name).filter(F.col(key).isin(*ids))

    def inspect(self) -> DataFrame:
        """(table, n): rows of every table."""
        out = None
        for name in SCHEMAS:
            one = self.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
        return out
