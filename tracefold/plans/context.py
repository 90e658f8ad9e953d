"""From signals to contexts in one plan: a DataFrame of signals in, one row per signal out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import causal, events, incidents, remediation, topology
from ..sources.tables import written


@dataclass(frozen=True)
class Mode:
    before_min: int
    after_min: int
    max_events: int
    hops: int
    causal: int
    matches: int
    bucket_min: int
    deep: bool


@dataclass(frozen=True)
class Ingest:
    before_min: int
    after_min: int
    hops: int
    bucket_min: int


INGEST = Ingest(30, 5, 2, 5)
FAST = Mode(35, 5, 200, 1, 5, 5, 10, False)
DEEP = Mode(60, 5, 1000, 2, 15, 5, 2, True)


@dataclass
class Telemetry:
    """Resolved inputs: events with nodes, signals, names, edges."""

    events: DataFrame
    signals: DataFrame
    names: DataFrame
    edges: DataFrame
    log: DataFrame | None = None

    @classmethod
    def of(cls, raw: DataFrame, log: DataFrame) -> Telemetry:
        """From typed events with event_id and service, and a topology log (ts, seq, change, src, dst)."""
        names = written(topology.name_map(log, raw.select(F.col("service").alias("name"))), "names")
        ev = topology.resolve(events.without_background(raw), names)
        return cls(ev, _signals(ev), names, written(topology.edge_intervals(log, names), "edges"), log)

    @classmethod
    def of_events(cls, raw: DataFrame) -> Telemetry:
        """From events as they were sent, in the order of ``ingest_seq``: names, graph and signals are read from them.

        Spans make calls, topology events the renames and dependencies; a
        remediation's node is its target's.  Signals without a service take that
        of their trigger.
        """
        good, _ = events.normalise(raw)
        ev = events.without_background(good).withColumn("ts", F.col("event_ts")).withColumn("event_id", F.col("ingest_seq")).drop("event_ts")
        said = X.first_text(F.col("service"), X.trigger_service(F.coalesce("trigger", F.lit(""))))
        ev = written(ev.withColumn("service", F.when(F.col("kind") == "incident_signal", said).otherwise(X.first_text(F.col("service")))), "events")
        log, calls = topology.topology_log(ev), events.span_pairs(ev.filter("kind = 'trace'"))
        spans = ev.filter("kind = 'trace'").select(F.explode("spans").alias("s")).select(X.first_text(F.col("s.svc"), F.col("s.service")).alias("name"))
        named = ev.select(F.col("service").alias("name")).unionByName(spans).unionByName(ev.filter("kind = 'remediation'").select(F.col("target").alias("name")))
        named = named.unionByName(log.filter("change <> 'rename'").select(F.explode(F.array("src", "dst")).alias("name")))
        names = written(topology.name_map(log, named), "names")
        at = F.when(F.col("kind") == "remediation", F.col("target")).otherwise(F.col("service"))
        resolved = topology.resolve(ev.withColumn("_at", at), names, "_at").drop("_at")
        return cls(resolved, _signals(resolved), names, written(topology.edge_table(log, calls, names), "edges"), log)


def _signals(ev: DataFrame) -> DataFrame:
    return ev.filter("kind = 'incident_signal'").select("incident_id", F.col("ts").alias("sig_ts"), "trigger", "service", "node", F.col("node").alias("trigger_node"), "event_id")


def related(t: Telemetry, mode: Mode) -> DataFrame:
    scope = topology.neighbourhood(t.signals, t.edges, mode.hops)
    return written(causal.ranked(incidents.newest_window_events(scope, t.events, mode.before_min, mode.after_min, mode.max_events), mode.max_events), "related")


def prints(t: Telemetry, before_min: int, after_min: int, hops: int, bucket_min: int) -> DataFrame:
    scope = topology.neighbourhood(t.signals, t.edges, hops)
    return written(incidents.window_fingerprints(scope, events.behaviour(t.events), before_min, after_min, bucket_min), "fingerprints")


def history(t: Telemetry, ingest: Ingest = INGEST) -> DataFrame:
    """Fingerprints as incidents are stored with on arrival: of the trigger, only events under the signal's own service name."""
    own = t.signals.select("incident_id", "sig_ts", F.col("service").alias("sig_service"))
    scope = topology.neighbourhood(t.signals, t.edges, ingest.hops).join(own, ["incident_id", "sig_ts"])
    return written(incidents.window_fingerprints(scope, events.behaviour(t.events), ingest.before_min, ingest.after_min, ingest.bucket_min), "history")


def contexts(t: Telemetry, mode: Mode = FAST, ingest: Ingest = INGEST, signals: DataFrame | None = None) -> DataFrame:
    """incident_id, related_events, causal_chain, similar_past_incidents, suggested_remediations, confidence, explain.

    One row for each signal of the log, or for each of the given ``signals``
    (incident_id, sig_ts, trigger, service) alone; history is always the log's.
    """
    asked = t if signals is None else replace(t, signals=asked_signals(t, signals))
    rel = related(asked, mode)
    near = events.behaviour(rel.drop("rank")).filter((F.col("rel_min") >= -ingest.before_min) & (F.col("rel_min") <= ingest.after_min))
    fp = written(incidents.fingerprints(incidents.fingerprint_elements(near, mode.bucket_min)), "fingerprints")
    past = history(t, ingest)
    matches = written(incidents.similar_incidents(fp, past, k=mode.matches), "matches")
    quiet = written(incidents.abstentions(fp, matches).filter("abstain").select("incident_id"), "abstained")
    chain = written(causal.causal_chain(rel, t.edges, mode.causal, mode.deep), "chains")
    rem = topology_remediations(t)
    sig = asked.signals.select("incident_id", "sig_ts", "node")
    timed = matches.join(sig.select("incident_id", "sig_ts"), "incident_id")
    canon = t.names.select("node", F.col("canonical").alias("_canonical")).distinct()
    known = rem.join(canon, "node", "left").withColumn("target", F.coalesce("_canonical", "target")).drop("_canonical")
    found = [remediation.by_incident(timed, rem), remediation.by_pattern(timed, rem), remediation.by_target(sig, known)]
    if mode.deep:
        found.append(remediation.neighbours(sig, t.edges, known))
    tips = written(remediation.suggest(*found).join(quiet, "incident_id", "left_anti"), "tips")
    matches = matches.join(quiet, "incident_id", "left_anti")
    pack = lambda df, name, *cols: df.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    why = X.rationale(F.col("similarity"), F.col("same_service"), F.col("family")).alias("rationale")
    parts = [
        pack(rel, "related_events", "rank", "event_id", "ts", "kind", "service"),
        pack(chain, "causal_chain", "rank", "cause", "effect", "evidence", F.bround("confidence", 3).alias("confidence")),
        pack(matches, "similar_past_incidents", "rank", "match_id", F.bround("similarity", 3).alias("similarity"), why),
        pack(tips, "suggested_remediations", "rank", "action", "target", "outcome", F.bround("confidence", 3).alias("confidence")),
    ]
    out = asked.signals.select("incident_id", "sig_ts", "trigger")
    for p in parts:
        out = out.join(p, "incident_id", "left")
    if mode.deep:
        parts.append(topology.recent_changes(asked.signals, t.edges))
        out = out.join(parts[-1], "incident_id", "left")
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    n, c, s = size("related_events"), size("causal_chain"), size("similar_past_incidents")
    out = out.withColumn("confidence", F.bround(X.overall_confidence(n, c, s), 3))
    return out.withColumn("explain", explain(mode)).drop("n_added", "n_removed")


def asked_signals(t: Telemetry, signals: DataFrame) -> DataFrame:
    """Signals from outside, resolved; without a service, the first name of their trigger that is known."""
    tokens = X.trigger_tokens(F.coalesce("trigger", F.lit("")))
    said = F.when(X.first_text(F.col("service")).isNotNull(), F.array("service")).otherwise(tokens)
    s = signals.select("incident_id", F.col("sig_ts").cast("timestamp_ntz").alias("sig_ts"), "trigger", said.getItem(0).alias("service"))
    s = topology.resolve(s, t.names)
    return s.select("incident_id", "sig_ts", "trigger", "service", "node", F.col("node").alias("trigger_node"), F.lit(None).cast("bigint").alias("event_id"))


def topology_remediations(t: Telemetry) -> DataFrame:
    return remediation.attach(t.events.filter("kind = 'remediation'"), t.signals)


def explain(mode: Mode):
    """Readable summary of a context row."""
    # fixed values: the wording of the sections
    top = 3 if mode.deep else 1
    kinds = F.transform("related_events", lambda e: e.kind)
    counted = F.array_join(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.concat(F.size(F.filter(kinds, lambda x: x == k)).cast("string"), F.lit(" "), k)), ", ")
    n = lambda c: F.size(c).cast("string")
    chain = F.array_join(F.transform(F.slice("causal_chain", 1, top), lambda e: F.concat(e.evidence, F.lit(" (conf="), e.confidence.cast("string"), F.lit(")"))), " -> ")
    past = F.array_join(F.transform(F.slice("similar_past_incidents", 1, top), lambda m: F.concat(m.match_id, F.lit(" (sim="), m.similarity.cast("string"), F.lit(")"))), ", ")
    added = F.when(F.col("n_added") > 0, F.concat(F.col("n_added").cast("string"), F.lit(" dependencies added recently"))) if mode.deep else F.lit(None).cast("string")
    removed = F.when(F.col("n_removed") > 0, F.concat(F.col("n_removed").cast("string"), F.lit(" dependencies removed recently"))) if mode.deep else F.lit(None).cast("string")
    drift = F.concat_ws("; ", added, removed)
    tip = F.try_element_at("suggested_remediations", F.lit(1))
    rest = F.array_join(F.transform(F.slice("suggested_remediations", 2, 9), lambda r: F.concat(r.action, F.lit(" on "), r.target)), "; ")
    return F.concat_ws(
        " ",
        F.concat(F.lit("[Trigger] Incident "), "incident_id", F.lit(" triggered by '"), "trigger", F.lit("'.")),
        F.concat(F.lit("[Context] "), F.coalesce(n("related_events"), F.lit("0")), F.lit(" related events ("), F.coalesce(counted, F.lit("")), F.lit(").")),
        F.when(F.size("causal_chain") > 0, F.concat(F.lit("[Causal] "), chain, F.lit("."))),
        F.when(F.size("similar_past_incidents") > 0, F.concat(F.lit("[History] "), n("similar_past_incidents"), F.lit(" similar past incidents: "), past, F.lit("."))),
        F.when(drift != "", F.concat(F.lit("[Topology] "), drift)),
        F.when(
            tip.isNotNull(),
            F.concat(F.lit("[Remediation] Suggested: "), tip.action, F.lit(" on "), tip.target, F.lit(" (confidence="), tip.confidence.cast("string"), F.lit(", outcome="), tip.outcome, F.lit(").")),
        ),
        F.when(F.size("suggested_remediations") > 1, F.concat(F.lit("[Alternatives] "), rest, F.lit("."))) if mode.deep else F.lit(None).cast("string"),
    )
