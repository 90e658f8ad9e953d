"""Queries over the driver's tables, with SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as X
from .operators import causal, events, incidents, remediation, topology
from .plans import context
from .plans.context import DEEP, Ingest, Mode, Telemetry
from .sources.telemetry import driver_telemetry, driver_topology

#: the driver's events are sparse, so windows are hours here; the product's are minutes
WIDE = Mode(360, 60, 200, 1, 5, 5, 60, False)
WIDE_DEEP = Mode(360, 60, 200, 2, 15, 5, 60, True)
WIDE_INGEST = Ingest(360, 60, 2, 60)


def _t(spark: SparkSession, d: str) -> Telemetry:
    return Telemetry.of(driver_telemetry(spark, d), driver_topology(spark))


def _at(s: str):
    return F.to_timestamp_ntz(F.lit(s))


def _prints(t: Telemetry) -> DataFrame:
    return context.prints(t, WIDE.before_min, WIDE.after_min, 2, 60)


def _similar(t: Telemetry, p: DataFrame) -> DataFrame:
    past = context.history(t, WIDE_INGEST)
    return incidents.similar_incidents(p, past)


def normalise_events(spark, d):
    return driver_telemetry(spark, d).select("event_id", "ts", "kind", "service", "level", "name", "value")


def parse_trigger(spark, d):
    s = driver_telemetry(spark, d).filter("kind = 'incident_signal'")
    return s.select("incident_id", X.trigger_service(F.col("trigger")).alias("alert_service"), X.trigger_metric(F.col("trigger")).alias("alert_metric"))


def metric_bucket(spark, d):
    m = driver_telemetry(spark, d).filter("kind = 'metric'")
    return m.groupBy("name", X.metric_bucket(F.col("name"), F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def event_severity(spark, d):
    e = driver_telemetry(spark, d)
    return e.groupBy("kind", X.severity(*[F.col(c) for c in ("kind", "name", "value", "level")]).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def kind_labels(spark, d):
    return events.behaviour(driver_telemetry(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def background_filter(spark, d):
    return events.without_background(driver_telemetry(spark, d)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def time_range_scan(spark, d):
    return events.time_range(driver_telemetry(spark, d), "2024-01-05 00:00:00", "2024-01-06 12:00:00").select("event_id", "ts", "kind")


def service_window_scan(spark, d):
    return events.time_range(driver_telemetry(spark, d), "2024-01-09 00:00:00", "2024-01-12 00:00:00", services=["svc-02", "svc-02-r2", "svc-03"]).select("event_id", "ts", "service")


def kind_histogram(spark, d):
    return events.kind_histogram(driver_telemetry(spark, d), "service")


def service_first_last(spark, d):
    return events.first_last_seen(driver_telemetry(spark, d))


def node_first_last(spark, d):
    return events.first_last_seen(_t(spark, d).events, "node")


def engine_stats(spark, d):
    t = _t(spark, d)
    is_ = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    counted = t.events.agg(F.count(F.lit(1)).alias("events"), is_("incident_signal"), is_("remediation"))
    named = lambda df, *pairs: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(c).alias("n")) for k, c in pairs])).alias("s")).select("s.*")
    out = named(counted, ("events", "events"), ("signals", "incident_signal"), ("remediations", "remediation"))
    out = out.unionByName(named(t.names.agg(F.count_distinct("node").alias("n")), ("nodes", "n")))
    return out.unionByName(named(t.edges.agg(F.count_if(F.col("valid_to").isNull()).alias("n")), ("active_edges", "n")))


def name_map(spark, d):
    return _t(spark, d).names


def all_names(spark, d):
    return topology.all_names(_t(spark, d).names).select("node", "n_names", F.array_join("names", ",").alias("names"))


def edge_intervals(spark, d):
    return _t(spark, d).edges


def edges_as_of(spark, d):
    return topology.edges_as_of(_t(spark, d).edges, _at("2024-01-10 12:00:00")).select("src", "dst")


def topology_diff(spark, d):
    return topology.topology_diff(_t(spark, d).edges, _at("2024-01-08 00:00:00"), _at("2024-01-17 00:00:00"))


def one_hop(spark, d):
    t = _t(spark, d)
    return topology.neighbourhood(t.signals, t.edges, 1).select("incident_id", "node", "role")


def two_hop_roles(spark, d):
    t = _t(spark, d)
    return topology.neighbourhood(t.signals, t.edges, 2).select("incident_id", "node", "hop", "role")


def expand_services(spark, d):
    t = _t(spark, d)
    n = topology.neighbourhood(t.signals, t.edges, 1).select("incident_id", "node")
    return n.join(t.names.select("node", "name"), "node").select("incident_id", F.col("name").alias("service")).distinct()


def ctx_related_events(spark, d):
    return context.related(_t(spark, d), WIDE).select("incident_id", "rank", "event_id", "ts", "kind", "service")


def fingerprint_hash(spark, d):
    return _prints(_t(spark, d)).select("incident_id", "trigger_node", "n_elements", "fp_json", "fp_hash")


def similarity_jaccard(spark, d):
    return incidents.pair_scores(_prints(_t(spark, d))).select("a", "b", "jaccard")


def similarity_scores(spark, d):
    return incidents.pair_scores(_prints(_t(spark, d)))


def similar_topk(spark, d):
    t = _t(spark, d)
    return _similar(t, _prints(t))


def abstain_flags(spark, d):
    t = _t(spark, d)
    p = _prints(t)
    return incidents.abstentions(p, _similar(t, p))


def families(spark, d):
    return incidents.families(_prints(_t(spark, d)))


def family_exact(spark, d):
    return _prints(_t(spark, d)).groupBy("trigger_node", "fp_hash").agg(F.count(F.lit(1)).alias("incident_count"), F.min("sig_ts").alias("first_seen"), F.max("sig_ts").alias("last_confirmed"))


def family_reinforcement(spark, d):
    t = _t(spark, d)
    return remediation.reinforcement(context.topology_remediations(t), incidents.families(_prints(t)))


def remediation_asof(spark, d):
    return context.topology_remediations(_t(spark, d)).select("event_id", "node", "incident_id", "action", "outcome", "base")


def remediation_by_target(spark, d):
    t = _t(spark, d)
    return remediation.by_target(t.signals.select("incident_id", "sig_ts", "node"), context.topology_remediations(t)).select("incident_id", "source_rank", "action", "target", F.round("confidence", 6).alias("confidence"))


def remediation_neighbours(spark, d):
    t = _t(spark, d)
    return remediation.neighbours(t.signals.select("incident_id", "sig_ts", "node"), t.edges, context.topology_remediations(t)).withColumn("confidence", F.round("confidence", 6))


def remediation_suggestions(spark, d):
    t = _t(spark, d)
    p, rem, sig = _prints(t), context.topology_remediations(t), t.signals.select("incident_id", "sig_ts", "node")
    m = _similar(t, p).join(sig.select("incident_id", "sig_ts"), "incident_id")
    return remediation.suggest(remediation.by_incident(m, rem), remediation.by_target(sig, rem), remediation.neighbours(sig, t.edges, rem)).withColumn("confidence", F.round("confidence", 6))


def causal_graph_pairs(spark, d):
    t = _t(spark, d)
    return causal.graph_pairs(context.related(t, WIDE), t.edges).select("incident_id", "cause", "effect", F.round("confidence", 6).alias("confidence"))


def causal_rules(spark, d):
    t = _t(spark, d)
    return causal.rule_pairs(context.related(t, WIDE), t.edges).select("incident_id", "cause", "effect", "confidence")


def causal_chain_deep(spark, d):
    t = _t(spark, d)
    scope = topology.neighbourhood(t.signals, t.edges, WIDE_DEEP.hops)
    return causal.deep_chain(scope, t.events, t.edges, WIDE_DEEP.before_min, WIDE_DEEP.after_min, DEEP.causal)


def contexts_fast(spark, d):
    return context.contexts(_t(spark, d), WIDE, WIDE_INGEST)


def contexts_deep(spark, d):
    return context.contexts(_t(spark, d), WIDE_DEEP, WIDE_INGEST)


def baseline_same_name(spark, d):
    """Events of the very same service name within 30 minutes, at most 20: the naive answer to beat."""
    e = driver_telemetry(spark, d)
    s = e.filter("kind = 'incident_signal'").select("incident_id", F.col("ts").alias("sig_ts"), F.col("service").alias("node"))
    w = incidents.window_events(s, e.withColumn("node", F.col("service")), 30, 30)
    ranked = w.withColumn("rank", F.row_number().over(causal.Window.partitionBy("incident_id").orderBy("ts", "event_id"))).filter("rank <= 20")
    return ranked.select("incident_id", "event_id", "rank")


_NAMES = [
    normalise_events, parse_trigger, metric_bucket, event_severity, kind_labels, background_filter, time_range_scan, service_window_scan, kind_histogram,
    service_first_last, node_first_last, engine_stats, name_map, all_names, edge_intervals, edges_as_of, topology_diff, one_hop, two_hop_roles, expand_services,
    ctx_related_events, fingerprint_hash, similarity_jaccard, similarity_scores, similar_topk, abstain_flags, families, family_exact, family_reinforcement,
    remediation_asof, remediation_by_target, remediation_neighbours, remediation_suggestions, causal_graph_pairs, causal_rules, causal_chain_deep,
    contexts_fast, contexts_deep, baseline_same_name,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES}

_TELEMETRY = """
WITH e0 AS (SELECT *, 'svc-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS base FROM events),
e AS (SELECT event_id, ts, value AS v, event_type,
  CASE WHEN event_type = 'error' AND event_id % 20 = 0 THEN 'incident_signal' WHEN event_type = 'signup' THEN 'deploy' WHEN event_type = 'view' THEN 'metric'
       WHEN event_type = 'purchase' THEN 'remediation' ELSE 'log' END AS kind,
  base AS node,
  CASE WHEN user_id % 2 <> 0 OR ts < TIMESTAMP '2024-01-11' THEN base WHEN ts < TIMESTAMP '2024-01-21' THEN base || '-r2' ELSE base || '-r2-r3' END AS service FROM e0),
tel AS (SELECT event_id, ts, kind, service, node,
  CASE WHEN kind = 'log' THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END END AS level,
  CASE WHEN kind = 'metric' THEN ['latency_p99_ms', 'error_rate', 'qps'][event_id % 3 + 1] END AS name,
  CASE WHEN kind = 'metric' THEN CASE event_id % 3 WHEN 0 THEN v * 20 WHEN 1 THEN v / 20 ELSE v END END AS value,
  CASE WHEN kind = 'incident_signal' THEN 'INC-' || event_id END AS incident_id,
  CASE WHEN kind = 'incident_signal' THEN CASE WHEN event_id % 40 = 0 THEN 'error_rate' ELSE 'latency_p99_ms' END END AS watched,
  CASE WHEN kind = 'remediation' THEN ['rollback', 'restart', 'scale_up', 'failover', 'config_revert'][event_id % 5 + 1] END AS action,
  CASE WHEN kind = 'remediation' THEN CASE WHEN v < 150 THEN 'resolved' ELSE 'worsened' END END AS outcome FROM e),
lab AS (SELECT *, CASE kind WHEN 'metric' THEN CASE WHEN name <> 'qps' THEN 'metric:' || name || ':' ||
     CASE WHEN name = 'latency_p99_ms' THEN CASE WHEN value < 100 THEN 'low' WHEN value < 1000 THEN 'medium' WHEN value < 5000 THEN 'high' ELSE 'critical' END
     ELSE CASE WHEN value < 1 THEN 'low' WHEN value < 5 THEN 'medium' WHEN value < 10 THEN 'high' ELSE 'critical' END END END
   WHEN 'log' THEN CASE WHEN level = 'error' THEN 'log:error' END WHEN 'deploy' THEN 'deploy' WHEN 'remediation' THEN 'remediation:' || action
   WHEN 'incident_signal' THEN 'incident_signal:' || watched END AS label,
   CASE kind WHEN 'incident_signal' THEN 1.0 WHEN 'metric' THEN CASE WHEN name = 'latency_p99_ms' AND value > 3000 THEN 0.9 WHEN name = 'error_rate' AND value > 5 THEN 0.8 ELSE 0.3 END
   WHEN 'log' THEN CASE WHEN level = 'error' THEN 0.8 ELSE 0.2 END WHEN 'deploy' THEN 0.5 ELSE 0.1 END::DOUBLE AS severity FROM tel),
ev AS (SELECT * FROM lab WHERE name IS NULL OR name <> 'qps'),
sig AS (SELECT incident_id, ts AS sig_ts, node AS trigger_node FROM tel WHERE kind = 'incident_signal'),
n12 AS (SELECT i, 'svc-' || lpad(CAST(i AS VARCHAR), 2, '0') AS src, 'svc-' || lpad(CAST((i + 1) % 12 AS VARCHAR), 2, '0') AS dst FROM range(12) r(i)),
edge AS (SELECT src, dst, TIMESTAMP '2024-01-01' + to_days(CAST(i AS INT)) AS valid_from, CASE WHEN i % 3 = 0 THEN TIMESTAMP '2024-01-16' END AS valid_to FROM n12),
nm AS (SELECT src AS name, src AS node, CASE WHEN i % 2 = 0 THEN src || '-r2-r3' ELSE src END AS canonical FROM n12
       UNION ALL SELECT src || '-r2', src, src || '-r2-r3' FROM n12 WHERE i % 2 = 0 UNION ALL SELECT src || '-r2-r3', src, src || '-r2-r3' FROM n12 WHERE i % 2 = 0),
both_ AS (SELECT src AS a, dst AS b, 1 AS dir, valid_from, valid_to FROM edge UNION ALL SELECT dst, src, 2, valid_from, valid_to FROM edge),
h0 AS (SELECT incident_id, sig_ts, trigger_node, trigger_node AS node, 0 AS hop, 0 AS dir FROM sig),
h1 AS (SELECT incident_id, sig_ts, trigger_node, b AS node, 1 AS hop, min(both_.dir) AS dir FROM h0 JOIN both_ ON node = a AND valid_from <= sig_ts AND (valid_to IS NULL OR valid_to > sig_ts)
       WHERE b <> trigger_node GROUP BY ALL),
h01 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
h2 AS (SELECT h1.incident_id, h1.sig_ts, h1.trigger_node, b AS node, 2 AS hop, min(both_.dir) AS dir FROM h1 JOIN both_ ON node = a AND valid_from <= sig_ts AND (valid_to IS NULL OR valid_to > sig_ts)
       WHERE NOT EXISTS (SELECT 1 FROM h01 x WHERE x.incident_id = h1.incident_id AND x.node = b) GROUP BY ALL),
hood AS (SELECT *, CASE WHEN hop = 0 THEN 'trigger' ELSE CASE WHEN dir = 1 THEN 'downstream-' ELSE 'upstream-' END || hop END AS role FROM (SELECT * FROM h01 UNION ALL SELECT * FROM h2)),
rel0 AS (SELECT h.incident_id, h.sig_ts, h.trigger_node, v.*EXCLUDE (incident_id) FROM hood h JOIN ev v ON v.node = h.node
       WHERE h.hop <= 1 AND v.ts BETWEEN h.sig_ts - INTERVAL 360 MINUTE AND h.sig_ts + INTERVAL 60 MINUTE),
rel AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts, event_id) AS rank FROM (
       SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, event_id DESC) AS c FROM rel0) WHERE c <= 200),
el0 AS (SELECT h.incident_id, h.trigger_node, h.sig_ts, v.label, h.role, (epoch_us(v.ts) - epoch_us(h.sig_ts)) / 60000000.0 AS m FROM hood h JOIN ev v ON v.node = h.node AND v.label IS NOT NULL
       WHERE v.ts BETWEEN h.sig_ts - INTERVAL 360 MINUTE AND h.sig_ts + INTERVAL 60 MINUTE),
el1 AS (SELECT *, CASE WHEN m <= 0 THEN 'before' ELSE 'after' END AS direction, CAST(trunc(m / 60) AS INT) * 60 AS bucket FROM el0),
el2 AS (SELECT *, lag(label || '|' || role || '|' || direction) OVER w AS prev, row_number() OVER w AS k FROM el1 WINDOW w AS (PARTITION BY incident_id ORDER BY bucket, label, role, direction)),
el AS (SELECT * FROM el2 WHERE prev IS NULL OR prev <> label || '|' || role || '|' || direction),
fp AS (SELECT incident_id, trigger_node, sig_ts, count(*) AS n, '[' || string_agg('["' || label || '","' || role || '","' || direction || '"]', ',' ORDER BY k) || ']' AS js FROM el GROUP BY ALL),
fph AS (SELECT *, substring(sha256(js), 1, 32) AS fp_hash FROM fp),
hist AS (SELECT r.event_id, r.ts AS applied_at, r.node, r.action, r.service AS target, r.outcome,
       CASE r.outcome WHEN 'resolved' THEN 0.7 ELSE 0.3 END::DOUBLE AS base,
       (SELECT s.incident_id FROM sig s WHERE s.trigger_node = r.node AND s.sig_ts <= r.ts ORDER BY s.sig_ts DESC LIMIT 1) AS incident_id FROM tel r WHERE r.kind = 'remediation')
"""

_SQL = {
    "normalise_events": "SELECT event_id, ts, kind, service, level, name, value FROM tel",
    "parse_trigger": "SELECT incident_id, service AS alert_service, watched AS alert_metric FROM tel WHERE kind = 'incident_signal'",
    "metric_bucket": """SELECT name, bucket, count(*) AS n FROM (SELECT name, CASE name WHEN 'latency_p99_ms' THEN CASE WHEN value < 100 THEN 'low' WHEN value < 1000 THEN 'medium' WHEN value < 5000 THEN 'high' ELSE 'critical' END
        WHEN 'error_rate' THEN CASE WHEN value < 1 THEN 'low' WHEN value < 5 THEN 'medium' WHEN value < 10 THEN 'high' ELSE 'critical' END
        ELSE CASE WHEN value = 0 THEN 'zero' WHEN value < 10 THEN 'small' WHEN value < 100 THEN 'medium' WHEN value < 1000 THEN 'large' ELSE 'very_large' END END AS bucket FROM tel WHERE kind = 'metric') GROUP BY ALL""",
    "event_severity": "SELECT kind, severity, count(*) AS n FROM lab GROUP BY ALL",
    "kind_labels": "SELECT label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY ALL",
    "background_filter": "SELECT kind, name, count(*) AS n FROM ev GROUP BY ALL",
    "time_range_scan": "SELECT event_id, ts, kind FROM tel WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'",
    "service_window_scan": "SELECT event_id, ts, service FROM tel WHERE ts BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-12' AND service IN ('svc-02', 'svc-02-r2', 'svc-03')",
    "kind_histogram": "SELECT service, kind, count(*) AS n FROM tel GROUP BY ALL",
    "service_first_last": "SELECT service, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_events FROM tel GROUP BY ALL",
    "node_first_last": "SELECT node, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_events FROM ev GROUP BY ALL",
    "engine_stats": "SELECT 'events' AS what, count(*) AS n FROM ev UNION ALL SELECT 'signals', count(*) FROM sig UNION ALL SELECT 'nodes', count(DISTINCT node) FROM nm UNION ALL SELECT 'active_edges', count(*) FROM edge WHERE valid_to IS NULL UNION ALL SELECT 'remediations', count(*) FROM ev WHERE kind = 'remediation'",
    "name_map": "SELECT name, node, canonical FROM nm",
    "all_names": "SELECT node, count(*) AS n_names, string_agg(name, ',' ORDER BY name) AS names FROM nm GROUP BY node",
    "edge_intervals": "SELECT src, dst, valid_from, valid_to FROM edge",
    "edges_as_of": "SELECT src, dst FROM edge WHERE valid_from <= TIMESTAMP '2024-01-10 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10 12:00:00')",
    "topology_diff": "SELECT 'added' AS change, src, dst, valid_from AS at FROM edge WHERE valid_from > TIMESTAMP '2024-01-08' AND valid_from <= TIMESTAMP '2024-01-17' UNION ALL SELECT 'removed', src, dst, valid_to FROM edge WHERE valid_to > TIMESTAMP '2024-01-08' AND valid_to <= TIMESTAMP '2024-01-17'",
    "one_hop": "SELECT incident_id, node, role FROM hood WHERE hop <= 1",
    "two_hop_roles": "SELECT incident_id, node, hop, role FROM hood",
    "expand_services": "SELECT DISTINCT incident_id, name AS service FROM hood JOIN nm USING (node) WHERE hop <= 1",
    "ctx_related_events": "SELECT incident_id, rank, event_id, ts, kind, service FROM rel",
    "fingerprint_hash": "SELECT incident_id, trigger_node, n AS n_elements, js AS fp_json, fp_hash FROM fph",
    "similarity_jaccard": """SELECT a, b, inter / (na + nb - inter) AS jaccard FROM (SELECT x.fp_hash AS a, y.fp_hash AS b, sum(least(x.c, y.c))::DOUBLE AS inter, any_value(x.n) AS na, any_value(y.n) AS nb
        FROM c x JOIN c y ON x.el = y.el AND x.fp_hash < y.fp_hash GROUP BY ALL)""",
    "family_exact": "SELECT trigger_node, fp_hash, count(*) AS incident_count, min(sig_ts) AS first_seen, max(sig_ts) AS last_confirmed FROM fph GROUP BY ALL",
    "remediation_asof": "SELECT event_id, node, incident_id, action, outcome, base FROM hist",
    "remediation_by_target": """SELECT incident_id, source_rank, action, target, round(greatest(0.1, base * pow(0.95, greatest(0, (epoch_us(sig_ts) - epoch_us(applied_at)) / 60000000.0 / 1440.0))), 6) AS confidence
        FROM (SELECT *EXCLUDE (incident_id), row_number() OVER (PARTITION BY node ORDER BY applied_at DESC, event_id DESC) AS source_rank FROM hist WHERE outcome = 'resolved') h JOIN sig ON h.node = sig.trigger_node WHERE source_rank <= 3 AND applied_at < sig_ts""",
    "causal_graph_pairs": """SELECT incident_id, cause, effect, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, src, dst ORDER BY confidence DESC, ra, rb) AS r FROM (
        SELECT a.incident_id, a.event_id AS cause, b.event_id AS effect, a.rank AS ra, b.rank AS rb, src, dst,
        least(0.95, 0.3 + 0.3 * greatest(0, 1 - abs((epoch_us(b.ts) - epoch_us(a.ts)) / 60000000.0) / 15.0) + 0.2 * ((a.severity + b.severity) / 2.0) + 0.1 + CASE WHEN src = a.trigger_node OR dst = a.trigger_node THEN 0.1 ELSE 0 END) AS confidence
        FROM rel a JOIN edge ON a.node = src AND valid_from <= a.sig_ts AND (valid_to IS NULL OR valid_to > a.sig_ts) JOIN rel b ON a.incident_id = b.incident_id AND b.node = dst AND a.event_id <> b.event_id
        WHERE (epoch_us(b.ts) - epoch_us(a.ts)) / 60000000.0 BETWEEN -1 AND 15)) WHERE r = 1""",
    "causal_rules": """SELECT incident_id, cause, effect, confidence FROM (SELECT a.incident_id, a.event_id AS cause, b.event_id AS effect,
        CASE WHEN a.kind = 'deploy' AND b.kind = 'metric' AND g > 0 AND g <= 10 AND a.node = a.trigger_node THEN 0.8 WHEN g <= 5 AND e.src IS NOT NULL THEN 0.6
             WHEN a.kind = 'log' AND a.level = 'error' AND b.kind = 'metric' AND a.node = b.node AND g > 0 AND g <= 5 THEN 0.6 END::DOUBLE AS confidence
        FROM (SELECT a, b, (epoch_us(b.ts) - epoch_us(a.ts)) / 60000000.0 AS g FROM rel a JOIN rel b ON a.incident_id = b.incident_id AND a.rank < b.rank) p
        LEFT JOIN edge e ON e.valid_to IS NULL AND e.src = a.node AND e.dst = b.node) WHERE confidence IS NOT NULL""",
    "baseline_same_name": """SELECT incident_id, event_id, rank FROM (SELECT s.incident_id, t.event_id, row_number() OVER (PARTITION BY s.incident_id ORDER BY t.ts, t.event_id) AS rank
        FROM tel s JOIN tel t ON s.service = t.service AND t.ts BETWEEN s.ts - INTERVAL 30 MINUTE AND s.ts + INTERVAL 30 MINUTE WHERE s.kind = 'incident_signal') WHERE rank <= 20""",
}
_COUNTS = """, ee AS (SELECT DISTINCT f.fp_hash, f.n, e.k, e.label || '|' || e.role || '|' || e.direction AS el FROM (SELECT fp_hash, min(incident_id) AS incident_id, any_value(n) AS n FROM fph GROUP BY fp_hash) f JOIN el e USING (incident_id)),
c AS (SELECT fp_hash, el, any_value(n) AS n, count(*) AS c FROM ee GROUP BY fp_hash, el) """
ORACLES: dict[str, str] = {k: _TELEMETRY + (_COUNTS if k == "similarity_jaccard" else "") + v for k, v in _SQL.items()}
