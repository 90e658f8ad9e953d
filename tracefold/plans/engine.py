"""The engine as one object: ingest events, reconstruct contexts, close.

State is the event log and tables derived from it in one plan, so an engine that
is opened again on a folder starts where the last one ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import events, incidents, remediation, topology
from ..sources import telemetry as T
from ..sources.store import Store
from ..sources.tables import shared_folder, written
from . import context

BUFFER = 5000


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None, ingest: context.Ingest = context.INGEST, modes: dict[str, context.Mode] | None = None, buffer: int = BUFFER):
        self.spark, self.settings, self.buffer_size = spark, ingest, buffer
        self.modes = modes or {"fast": context.FAST, "deep": context.DEEP}
        self.store = Store(spark, folder or f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}")
        self._read: context.Telemetry | None = None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def ingest(self, source: DataFrame | Iterable[dict] | str) -> None:
        """Append events in their order: a DataFrame, dicts, or a path of JSON lines. Rejected ones are kept apart."""
        if isinstance(source, str):
            source = T.read_json_lines(self.spark, source)
        elif not isinstance(source, DataFrame):
            source = T.from_rows(self.spark, source)
        if "raw_json" not in source.columns:
            source = source.withColumn("raw_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in source.columns])))
        batch = self.store.batches()
        at = F.col("ingest_seq") if "ingest_seq" in source.columns else F.monotonically_increasing_id()
        numbered = written(source.withColumn("ingest_seq", at + F.lit(batch << 44)), "arrivals")
        good, bad = events.normalise(numbered)
        self.store.append("rejected", bad, batch)
        self.store.append("events", good, batch)
        self._read = None

    def ingest_one(self, event: dict) -> None:
        self.ingest([event])

    def telemetry(self) -> context.Telemetry:
        """Names, graph and signals of the log, derived once after each ingest."""
        if self._read is None:
            self._read = context.Telemetry.of_events(self.store.read("events"))
        return self._read

    def reconstruct(self, signals: DataFrame, mode: str = "fast") -> DataFrame:
        """Contexts of many signals (incident_id, sig_ts, trigger, service) in one plan."""
        return context.contexts(self.telemetry(), self.modes[mode], self.settings, signals)

    def reconstruct_context(self, signal: dict, mode: str = "fast") -> dict:
        """The context of one signal, as a dict; times in ISO 8601."""
        one = T.from_rows(self.spark, [{"kind": "incident_signal"} | signal])
        asked = one.select(F.coalesce("incident_id", F.lit("unknown")).alias("incident_id"), X.parse_timestamp(F.col("ts")).alias("sig_ts"), "trigger", "service")
        row = self.reconstruct(asked, mode).first().asDict(recursive=True)
        for e in row["related_events"] or []:
            e["ts"] = e["ts"].isoformat() + "+00:00"
        lists = ("related_events", "causal_chain", "similar_past_incidents", "suggested_remediations")
        return {k: row[k] or [] for k in lists} | {"confidence": row["confidence"], "explain": row["explain"]}

    def recent(self, n: int | None = None) -> DataFrame:
        """The newest arrivals, as a ring buffer of that size would hold them; load metrics among them."""
        return events.latest(self.store.read("events"), n or self.buffer_size, seq="ingest_seq")

    def resolve(self, name: str) -> str | None:
        row = self.telemetry().names.filter(F.col("name") == name).first()
        return row["node"] if row else None

    def nodes(self) -> DataFrame:
        """(node, canonical, aliases, first_seen, last_seen)."""
        t = self.telemetry()
        seen = t.events.filter("node is not null").groupBy("node").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        ends = t.edges.select(F.explode(F.array("src", "dst")).alias("node"), F.col("valid_from").alias("f"), "last_seen").groupBy("node").agg(F.min("f").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        seen = seen.unionByName(ends).groupBy("node").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        names = t.names.groupBy("node").agg(F.first("canonical").alias("canonical"), F.array_sort(F.collect_set("name")).alias("aliases"))
        return names.select("node", "canonical", F.array_except("aliases", F.array("canonical")).alias("aliases")).join(seen, "node", "left")

    def publish(self) -> None:
        """Write the derived tables: nodes, edges, patterns with their families, families, remediations."""
        t = self.telemetry()
        past = context.history(t, self.settings)
        fam = written(incidents.families(past), "families")
        history = written(context.topology_remediations(t), "remediations")
        self.store.publish("nodes", self.nodes())
        self.store.publish("edges", t.edges)
        self.store.publish("patterns", past.drop("codes").join(fam.select("incident_id", "family"), "incident_id"))
        strong = remediation.reinforcement(history.filter("linked"), fam).select("family", "reinforced")
        sizes = fam.groupBy("family").agg(F.max("incident_count").alias("incident_count"))
        first = incidents.representatives(past, fam).join(sizes, "family").join(strong, "family", "left")
        self.store.publish("families", first.withColumn("reinforced", F.coalesce("reinforced", F.lit(0.5))))
        self.store.publish("remediations", history)

    def stats(self) -> dict[str, int]:
        """Counts of events, nodes, edges, patterns, families and remediations, in a few passes."""
        t = self.telemetry()
        counted = self.store.read("events").agg(F.count(F.lit(1)).alias("raw_events"), F.count_if(F.col("kind") == "incident_signal").alias("patterns"), F.count_if(F.col("kind") == "remediation").alias("remediations"))
        edges = t.edges.agg(F.count_if(F.col("valid_to").isNull()).alias("active_edges"), F.count_distinct(F.when(F.col("valid_to").isNull(), F.struct("src", "dst"))).alias("graph_edges"))
        nodes = t.names.agg(F.count_distinct("node").alias("nodes"))
        errors = self.store.read("rejected").agg(F.count(F.lit(1)).alias("parser_errors"))
        out = counted.crossJoin(edges).crossJoin(nodes).crossJoin(errors).first().asDict()
        families = incidents.families(context.history(t, self.settings)).select("family").distinct().count()
        return out | {"graph_nodes": out["nodes"], "families": families, "buffer_size": min(self.buffer_size, out["raw_events"])}

    def close(self) -> None:
        """Forget what was derived; the log stays in its folder."""
        self._read = None
