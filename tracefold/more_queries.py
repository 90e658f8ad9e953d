"""Further queries over the driver's tables: renames, traces, stored edges, families, cascades, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as X
from .operators import causal, events, incidents, remediation, topology
from .plans import context, evaluate
from .plans.engine import Engine
from .queries import _TELEMETRY, WIDE, WIDE_INGEST, _at, _prints, _similar, _t
from .sources.tables import written
from .sources.telemetry import driver_telemetry, driver_topology, parse_json_lines


MIDWAY = "2024-01-12 00:00:00"


def rename_log(spark: SparkSession, d: str) -> DataFrame:
    """Renames made from the customers: chains of 49, some undone, forked from an old name, or taking another's name."""
    name = lambda n: F.concat(F.lit("n"), n.cast("string"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("k"))
    k, at = F.col("k"), F.col("k") % 50
    step = rows.filter(at != 0).select((2 * k).alias("seq"), name(k - 1).alias("src"), name(k).alias("dst"))
    undo = rows.filter(at == 25).select((2 * k + 1).alias("seq"), name(k).alias("src"), name(k - 1).alias("dst"))
    fork = rows.filter(at == 10).select((2 * k + 1).alias("seq"), name(k - 2).alias("src"), F.concat(F.lit("f"), k.cast("string")).alias("dst"))
    take = rows.filter((at == 40) & (k > 100)).select((2 * k + 1).alias("seq"), name(k).alias("src"), name(k - 75).alias("dst"))
    log = step.unionByName(undo).unionByName(fork).unionByName(take)
    return log.withColumn("change", F.lit("rename")).withColumn("ts", F.lit(None).cast("timestamp_ntz"))


def _no_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "name string")


def driver_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces made from clicks: three spans, some of them under ``service``, some without a name."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'click'")
    svc = lambda n: F.concat(F.lit("svc-"), F.lpad((n % 12).cast("string"), 2, "0"))
    none = F.lit(None).cast("string")
    span = lambda a, b: F.struct(a.alias("svc"), b.alias("service"), F.lit(1.0).alias("dur_ms"))
    u, i = F.col("user_id"), F.col("event_id")
    middle = F.when(i % 4 == 0, span(none, none)).when(i % 4 == 1, span(F.lit(""), svc(u + 1))).otherwise(span(svc(u + 1), none))
    return e.select("event_id", "ts", F.array(span(svc(u), none), middle, span(svc(u + i), none)).alias("spans"))


def _log(spark: SparkSession) -> DataFrame:
    return driver_topology(spark).withColumn("event_id", -1 - F.col("seq").cast("bigint"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return written(topology.edge_table(_log(spark), events.span_pairs(driver_traces(spark, d)), t.names), "edges")


def rename_identities(spark, d):
    return topology.name_map(rename_log(spark, d), _no_names(spark))


def logical_services(spark, d):
    return topology.same_service(topology.name_map(rename_log(spark, d), _no_names(spark)))


def canonical_name(spark, d):
    return _t(spark, d).names.select("node", "canonical").distinct()


def span_pairs(spark, d):
    return events.span_pairs(driver_traces(spark, d)).select("event_id", "pos", "src", "dst")


def edge_table(spark, d):
    return _edges(spark, d)


def edge_evidence(spark, d):
    return topology.edge_evidence(_log(spark), events.span_pairs(driver_traces(spark, d)), _t(spark, d).names)


def current_graph(spark, d):
    return topology.current_graph(_edges(spark, d))


def edges_of_node(spark, d):
    return topology.edges_of(_edges(spark, d), "svc-03", active=False).select("src", "dst", "kind", "valid_from")


def nodes_as_of(spark, d):
    seen = events.first_last_seen(_t(spark, d).events, "node")
    return topology.nodes_as_of(seen, _at("2024-01-01 06:00:00")).select("node", "first_seen")


def one_hop_downstream(spark, d):
    t = _t(spark, d)
    return topology.neighbourhood(t.signals, t.edges, 1, "downstream").select("incident_id", "node", "role")


def two_hop_upstream(spark, d):
    t = _t(spark, d)
    return topology.neighbourhood(t.signals, t.edges, 2, "upstream").select("incident_id", "node", "hop")


def induced_edges(spark, d):
    t = _t(spark, d)
    return topology.induced(topology.neighbourhood(t.signals, t.edges, 2), t.edges)


def topology_recent(spark, d):
    t = _t(spark, d)
    return topology.recent_changes(t.signals, t.edges)


def point_lookup(spark, d):
    return events.by_id(driver_telemetry(spark, d), [7, 20, 41, 999]).select("event_id", "kind", "service")


def latest_events(spark, d):
    return events.latest(driver_telemetry(spark, d), 50).select("event_id", "kind")


def latest_of_service(spark, d):
    return events.latest(driver_telemetry(spark, d), 5, service="svc-03").select("event_id", "service")


def buffer_window(spark, d):
    return events.buffered(driver_telemetry(spark, d), 500, services=["svc-01", "svc-03"], start="2024-01-02 00:00:00", end="2024-01-29 00:00:00").select("event_id", "service")


def search_events(spark, d):
    return events.search(driver_telemetry(spark, d), (F.col("kind") == "metric") & (F.col("value") > 4000)).select("event_id", "name")


def iso_rendering(spark, d):
    return events.for_output(driver_telemetry(spark, d)).select("event_id", "ts")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of the events in the notations that times come in; some have no readable time, no kind, or are cut."""
    e = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ahead = F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    ts = F.when(i % 97 == 0, "soon").when(i % 4 == 0, F.concat(plain, F.lit("Z"))).when(i % 4 == 1, F.concat(ahead, F.lit("+02:00"))).when(i % 4 == 2, F.concat(plain, F.lit("+00:00"))).otherwise(plain)
    line = F.to_json(F.struct(ts.alias("ts"), F.when(i % 89 != 0, F.col("event_type")).alias("kind"), i.cast("string").alias("incident_id")))
    return e.select(F.when(i % 83 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))


def normalise_json(spark, d):
    good, _ = events.normalise(parse_json_lines(_lines(spark, d)))
    return good.select(F.col("incident_id").cast("bigint").alias("event_id"), F.col("event_ts").alias("ts"), "kind")


def parser_counts(spark, d):
    return events.parser_counts(parse_json_lines(_lines(spark, d)))


def trigger_tokens(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")
    t = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("alert:svc-"), n, F.lit("/error-rate>5"))).otherwise(F.concat(F.lit("high error rate at svc-"), n, F.lit(" of 3 ab warn checkout_api")))
    return e.select("event_id", F.array_join(X.trigger_tokens(t), ",").alias("services"))


def field_fallbacks(spark, d):
    """Topology events with the names that their fields go by."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_id < 200")
    i = F.col("event_id")
    name = lambda p: F.concat(F.lit(p), i.cast("string"))
    is_ = lambda k: i % 5 == k
    change = F.when(is_(0), "rename").when(is_(1), "dep_add").when(is_(2), "dep_remove").when(is_(3), "dependency-shift").otherwise("unknown")
    cols = {
        "change": change, "from_": F.when(i % 3 == 0, name("a")).otherwise(""), "from": name("b"), "source": F.when(i % 3 == 1, name("c")), "src": name("d"),
        "to": F.when(i % 2 == 0, name("x")), "target": F.when(i % 7 != 0, name("y")), "dst": F.when(i % 7 == 0, name("z")), "op": F.when(i % 4 == 0, "Retire").when(i % 4 == 1, ""),
        "action": F.when(i % 8 == 1, "delete"), "type": F.lit(None).cast("string"), "kind": F.lit("topology"),
    }
    raw = e.select("event_id", "ts", *[c.alias(k) for k, c in cols.items()])
    return topology.topology_log(raw).select("event_id", F.col("change"), "src", "dst")


def _traced(spark, d) -> tuple[DataFrame, DataFrame]:
    """Related events with trace ids, and edges of which some carry errors backward."""
    t = _t(spark, d)
    rel = context.related(t, WIDE)
    trace = F.when(F.col("kind").isin("log", "metric"), F.concat(F.lit("tr-"), (F.col("event_id") % 40).cast("string")))
    kind = F.when(F.substring("src", -2, 2).cast("int") % 4 == 1, X.ERROR_PROPAGATION).otherwise(X.DEPENDENCY)
    return rel.withColumn("trace_id", trace), t.edges.withColumn("kind", kind)


def causal_rules_traced(spark, d):
    return causal.rule_pairs(*_traced(spark, d)).select("incident_id", "cause", "effect", "confidence", "evidence")


def causal_transitive(spark, d):
    pairs = written(causal.rule_pairs(*_traced(spark, d)), "rules")
    return causal.transitive(pairs).select("incident_id", "cause", "effect", "confidence")


def history_fingerprints(spark, d):
    return context.history(_t(spark, d), WIDE_INGEST).select("incident_id", "n_elements", "fp_hash")


def similarity_rounded(spark, d):
    return incidents.pair_scores(_prints(_t(spark, d))).select("a", "b", "distance", F.round("similarity", 9).alias("similarity"))


def family_assignments(spark, d):
    return incidents.families(_prints(_t(spark, d))).select("incident_id", "family", F.round("similarity", 9).alias("similarity"), "incident_count")


def family_representatives(spark, d):
    p = _prints(_t(spark, d))
    return incidents.representatives(p, incidents.families(p))


def family_remediations(spark, d):
    t = _t(spark, d)
    return remediation.of_family(context.topology_remediations(t), incidents.families(_prints(t))).select("family", "rank", "incident_id", "action", "outcome")


def family_confidence(spark, d):
    t = _t(spark, d)
    return remediation.reinforcement(context.topology_remediations(t), incidents.families(_prints(t))).select("family", "n_resolved", F.round("reinforced", 9).alias("reinforced"))


def ranked_matches(spark, d):
    t = _t(spark, d)
    return _similar(t, _prints(t)).select("incident_id", "rank", "match_id", F.round("similarity", 9).alias("similarity"), "same_service")


def abstained(spark, d):
    t = _t(spark, d)
    p = _prints(t)
    return incidents.abstentions(p, _similar(t, p)).select("incident_id", F.round("top", 3).alias("top"), F.round("second", 3).alias("second"), "abstain")


def _midway(t) -> tuple[DataFrame, DataFrame]:
    """Signals of the second part of the period, and what was remedied in the first."""
    return t.signals.select("incident_id", "sig_ts", "node").filter(F.col("sig_ts") >= _at(MIDWAY)), context.topology_remediations(t).filter(F.col("applied_at") < _at(MIDWAY))


def _tips(df: DataFrame) -> DataFrame:
    return df.select("incident_id", "source_rank", "action", "target", F.round("confidence", 6).alias("confidence"))


def remediation_by_target_midway(spark, d):
    return _tips(remediation.by_target(*_midway(_t(spark, d))))


def remediation_neighbours_midway(spark, d):
    t = _t(spark, d)
    sig, rem = _midway(t)
    return _tips(remediation.neighbours(sig, t.edges, rem))


def _matched(t) -> DataFrame:
    return _similar(t, _prints(t)).join(t.signals.select("incident_id", "sig_ts"), "incident_id")


def remediation_by_incident(spark, d):
    t = _t(spark, d)
    return _tips(remediation.by_incident(_matched(t), context.topology_remediations(t)))


def remediation_by_pattern(spark, d):
    t = _t(spark, d)
    return _tips(remediation.by_pattern(_matched(t), context.topology_remediations(t)))


def _judged(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, tips, truth) made from the signals' numbers."""
    s = driver_telemetry(spark, d).filter("kind = 'incident_signal'").select("incident_id", (F.col("event_id") / 20).cast("bigint").alias("e"))
    r = s.select("incident_id", "e", F.explode(F.array(*[F.lit(i) for i in range(1, 8)])).alias("rank"))
    e, k = F.col("e"), F.col("rank")
    matches = r.select("incident_id", "rank", F.concat(F.lit("INC-"), (e + k).cast("string"), F.lit("-"), F.when(k == 4, "x").otherwise(((e + k * k) % 5).cast("string"))).alias("match_id"), ((e * k) % 100 / 100).alias("similarity"))
    tips = r.filter("rank <= 3").select("incident_id", F.concat(F.lit("act-"), ((e * k) % 4).cast("string")).alias("action"), ((e + 31 * k) % 100 / 100).alias("confidence"))
    decoy = e % 3 == 0
    truth = s.select("incident_id", F.when(~decoy, (e % 5).cast("int")).alias("family"), F.when(~decoy, F.concat(F.lit("act-"), (e % 4).cast("string"))).alias("expected"))
    return matches, tips, truth


def score_match(spark, d):
    matches, _, truth = _judged(spark, d)
    return evaluate.score_matches(matches, truth)


def score_remediation(spark, d):
    _, tips, truth = _judged(spark, d)
    return evaluate.score_remediations(tips, truth)


def metrics_summary(spark, d):
    matches, tips, truth = _judged(spark, d)
    return evaluate.summary(evaluate.score_matches(matches, truth), evaluate.score_remediations(tips, truth))


def latency_p95(spark, d):
    return evaluate.latency_p95(spark.read.parquet(f"{d}/events.parquet").select(F.col("value").alias("latency_ms")))


def baseline_matches(spark, d):
    """Up to five other incidents under the very same service name, in order of arrival, and the first remedy of one of them."""
    e = driver_telemetry(spark, d)
    s = e.filter("kind = 'incident_signal'").select("incident_id", "service", "event_id")
    p = s.select(F.col("incident_id").alias("match_id"), "service", F.col("event_id").alias("m"))
    w = causal.Window
    # a name's first six signals hold the first five others of any one of them
    p = p.withColumn("_p", F.row_number().over(w.partitionBy("service").orderBy("m"))).filter("_p <= 6")
    j = s.join(p, "service").filter("match_id <> incident_id").withColumn("rank", F.row_number().over(w.partitionBy("incident_id").orderBy("m"))).filter("rank <= 5")
    return j.select("incident_id", "rank", "match_id", F.lit(0.5).alias("similarity"))


def baseline_remedies(spark, d):
    """The first remedy that one of the baseline's matches had, in their order."""
    rem = context.topology_remediations(_t(spark, d)).select(F.col("incident_id").alias("match_id"), "action", "target", "outcome", "event_id")
    last = rem.groupBy("match_id").agg(F.max_by(F.struct("action", "target", "outcome"), "event_id").alias("r"))
    j = baseline_matches(spark, d).join(last, "match_id")
    return j.groupBy("incident_id").agg(F.min_by("r", "rank").alias("r")).select("incident_id", "r.action", "r.target", "r.outcome", F.lit(0.3).alias("confidence"))


def engine_ingest(spark, d):
    """JSON lines taken in by an engine, as its event log has them."""
    engine = Engine(spark)
    engine.ingest(parse_json_lines(_lines(spark, d)))
    return engine.store.read("events").select(F.col("incident_id").cast("bigint").alias("event_id"), F.col("event_ts").alias("ts"), "kind")


def context_kinds(spark, d):
    return events.kind_histogram(context.related(_t(spark, d), WIDE), "incident_id")


def current_two_hop(spark, d):
    t = _t(spark, d)
    return topology.current_neighbourhood(t.names.select("node"), t.edges, 2)


def edges_between(spark, d):
    t = _t(spark, d)
    some = spark.createDataFrame([(f"svc-{i:02d}",) for i in range(6)], "node string")
    return topology.edges_as_of(t.edges, _at("2024-01-10 12:00:00"), some).select("src", "dst")


def family_number(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("INC-"), i.cast("string"), F.lit("-7"))).when(i % 4 == 1, F.concat(F.lit("DEC-"), i.cast("string"))).when(i % 4 == 2, "INC-1-x").otherwise("unknown")
    return e.select("event_id", X.family_number(name).alias("family"))


def overall_confidence(spark, d):
    i = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(X.overall_confidence(i % 30, i % 5, i % 4), 6).alias("confidence"))


def rationales(spark, d):
    i = F.col("event_id")
    family = F.when(i % 3 == 0, F.md5(i.cast("string")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", X.rationale((i % 100) / 100, i % 2 == 0, family).alias("rationale"))


def decayed(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.round(X.decay(F.lit(0.7), F.col("ts"), _at("2024-01-20 00:00:00")), 9).alias("confidence"))


def pattern_candidates(spark, d):
    """Patterns of one trigger with their families' confidence, newest first."""
    t = _t(spark, d)
    p = _prints(t)
    fam = incidents.families(p)
    sure = remediation.reinforcement(context.topology_remediations(t), fam)
    return incidents.candidate_patterns(p, fam, sure, "svc-00").select("incident_id", "trigger_node", F.round("confidence", 9).alias("confidence"))


_NAMES = [
    baseline_remedies, engine_ingest, context_kinds, current_two_hop, edges_between, family_number, overall_confidence, rationales, decayed, pattern_candidates,
    rename_identities, logical_services, canonical_name, span_pairs, edge_table, edge_evidence, current_graph, edges_of_node, nodes_as_of, one_hop_downstream,
    two_hop_upstream, induced_edges, topology_recent, point_lookup, latest_events, latest_of_service, buffer_window, search_events, iso_rendering, normalise_json,
    parser_counts, trigger_tokens, field_fallbacks, causal_rules_traced, causal_transitive, history_fingerprints, similarity_rounded, family_assignments,
    family_representatives, family_remediations, family_confidence, ranked_matches, abstained, remediation_by_target_midway, remediation_neighbours_midway,
    remediation_by_incident, remediation_by_pattern, score_match, score_remediation, metrics_summary, latency_p95, baseline_matches,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES}

_RENAMES = """
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 50 AS m FROM customer),
log AS (SELECT 2 * k AS seq, 'n' || (k - 1) AS src, 'n' || k AS dst FROM c WHERE m <> 0
  UNION ALL SELECT 2 * k + 1, 'n' || k, 'n' || (k - 1) FROM c WHERE m = 25
  UNION ALL SELECT 2 * k + 1, 'n' || (k - 2), 'f' || k FROM c WHERE m = 10
  UNION ALL SELECT 2 * k + 1, 'n' || k, 'n' || (k - 75) FROM c WHERE m = 40 AND k > 100),
up AS (SELECT l.seq, l.src, max(p.seq) AS up FROM log l LEFT JOIN log p ON p.dst = l.src AND p.seq < l.seq GROUP BY ALL),
walk AS (SELECT seq, src, up FROM up UNION ALL SELECT w.seq, u.src, u.up FROM walk w JOIN up u ON u.seq = w.up),
moved AS (SELECT l.seq, l.dst, w.src AS node FROM walk w JOIN log l USING (seq) WHERE w.up IS NULL),
given AS (SELECT dst AS name, arg_max(node, seq) AS node FROM moved GROUP BY dst),
known AS (SELECT src AS name FROM log UNION SELECT dst FROM log),
mapped AS (SELECT name, coalesce(node, name) AS node FROM known LEFT JOIN given USING (name)),
last_ AS (SELECT node, arg_max(dst, seq) AS canonical FROM moved GROUP BY node),
names AS (SELECT name, node, coalesce(canonical, node) AS canonical FROM mapped LEFT JOIN last_ USING (node))
"""
_TRACES = """, clicks AS (SELECT event_id, ts, user_id AS u FROM events WHERE event_type = 'click'),
chain AS (SELECT event_id, ts, list_filter(['svc-' || lpad(CAST(u % 12 AS VARCHAR), 2, '0'), CASE WHEN event_id % 4 <> 0 THEN 'svc-' || lpad(CAST((u + 1) % 12 AS VARCHAR), 2, '0') END,
       'svc-' || lpad(CAST((u + event_id) % 12 AS VARCHAR), 2, '0')], lambda x: x IS NOT NULL) AS ns FROM clicks),
pairs_ AS (SELECT event_id, ts, i - 1 AS pos, ns[i] AS src, ns[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(ns))) AS i FROM chain)),
calls AS (SELECT src, dst, arg_min(ts, event_id) AS valid_from, arg_max(ts, event_id) AS last_seen, count(DISTINCT event_id) AS n_evidence FROM pairs_ GROUP BY src, dst),
edgex AS (SELECT src, dst, 'dependency' AS kind, valid_from, valid_from AS last_seen, valid_to, 1.0::DOUBLE AS confidence, 1 AS n_evidence FROM edge
       UNION ALL SELECT src, dst, 'calls', valid_from, last_seen, NULL, 1.0, n_evidence FROM calls) """
_JUDGED = """, s AS (SELECT incident_id, event_id // 20 AS e FROM tel WHERE kind = 'incident_signal'),
r AS (SELECT incident_id, e, unnest(range(1, 8)) AS rank FROM s),
matches AS (SELECT incident_id, rank, CASE WHEN rank = 4 THEN NULL ELSE (e + rank * rank) % 5 END AS fam, ((e * rank) % 100) / 100.0 AS similarity FROM r),
tips AS (SELECT incident_id, 'act-' || ((e * rank) % 4) AS action, ((e + 31 * rank) % 100) / 100.0 AS confidence FROM r WHERE rank <= 3),
truth AS (SELECT incident_id, CASE WHEN e % 3 <> 0 THEN e % 5 END AS family, CASE WHEN e % 3 <> 0 THEN 'act-' || (e % 4) END AS expected FROM s),
sm AS (SELECT t.incident_id, CASE WHEN family IS NULL THEN NOT coalesce(bool_or(similarity >= 0.5), false) ELSE coalesce(bool_or(fam = family), false) END AS in_top_k,
       CASE WHEN family IS NULL THEN CASE WHEN coalesce(bool_or(similarity >= 0.5), false) THEN 0 ELSE 1 END ELSE count(*) FILTER (WHERE fam = family) / 5.0 END::DOUBLE AS precision
       FROM truth t LEFT JOIN (SELECT * FROM matches WHERE rank <= 5) m USING (incident_id) GROUP BY t.incident_id, family),
sr AS (SELECT t.incident_id, CASE WHEN expected IS NULL THEN NOT bool_or(confidence >= 0.5) ELSE bool_or(action = expected) END AS remediation_ok FROM truth t LEFT JOIN tips USING (incident_id) GROUP BY t.incident_id, expected) """
_RULES = """, pp AS (SELECT a.incident_id, a.event_id AS cause, b.event_id AS effect, (epoch_us(b.ts) - epoch_us(a.ts)) / 60000000.0 AS g, a.kind AS ka, b.kind AS kb, a.level AS la, a.node AS na, b.node AS nb, a.trigger_node AS tn,
        CASE WHEN a.kind IN ('log', 'metric') AND b.kind IN ('log', 'metric') AND a.event_id % 40 = b.event_id % 40 THEN 'tr-' || (a.event_id % 40) END AS tr
        FROM rel a JOIN rel b ON a.incident_id = b.incident_id AND a.rank < b.rank),
ek AS (SELECT src, dst, CASE WHEN CAST(right(src, 2) AS INT) % 4 = 1 THEN 'error_propagation' ELSE 'dependency' END AS kind FROM edge WHERE valid_to IS NULL),
rules AS (SELECT incident_id, cause, effect,
        CASE WHEN ka = 'deploy' AND kb = 'metric' AND g > 0 AND g <= 10 AND na = tn THEN 0.8 WHEN tr IS NOT NULL THEN 0.7 WHEN g <= 5 AND e.src IS NOT NULL THEN 0.6 WHEN g <= 5 AND f.src IS NOT NULL THEN 0.5
             WHEN ka = 'log' AND la = 'error' AND kb = 'metric' AND na = nb AND g > 0 AND g <= 5 THEN 0.6 END::DOUBLE AS confidence,
        CASE WHEN ka = 'deploy' AND kb = 'metric' AND g > 0 AND g <= 10 AND na = tn THEN 'deploy precedes metric spike within 10min' WHEN tr IS NOT NULL THEN 'shared trace_id ' || tr WHEN g <= 5 AND e.src IS NOT NULL THEN e.kind || ' edge in graph'
             WHEN g <= 5 AND f.src IS NOT NULL THEN 'error_propagation edge in graph' WHEN ka = 'log' AND la = 'error' AND kb = 'metric' AND na = nb AND g > 0 AND g <= 5 THEN 'error log precedes metric spike' END AS evidence
        FROM pp LEFT JOIN ek e ON e.src = na AND e.dst = nb LEFT JOIN ek f ON f.kind = 'error_propagation' AND f.src = nb AND f.dst = na) """
#: both sets of fingerprints as lists of elements, and their similarity; an element is one character within a pair
_SIMILAR = """, own AS (SELECT incident_id, service AS own_name FROM tel WHERE kind = 'incident_signal'),
hl0 AS (SELECT h.incident_id, h.trigger_node, h.sig_ts, v.label, h.role, (epoch_us(v.ts) - epoch_us(h.sig_ts)) / 60000000.0 AS m FROM hood h JOIN own USING (incident_id) JOIN ev v ON v.node = h.node AND v.label IS NOT NULL
       WHERE v.ts BETWEEN h.sig_ts - INTERVAL 360 MINUTE AND h.sig_ts + INTERVAL 60 MINUTE AND (h.node <> h.trigger_node OR v.service = own_name)),
hl1 AS (SELECT *, CASE WHEN m <= 0 THEN 'before' ELSE 'after' END AS direction, CAST(trunc(m / 60) AS INT) * 60 AS bucket FROM hl0),
hl2 AS (SELECT *, lag(label || '|' || role || '|' || direction) OVER w AS prev, row_number() OVER w AS k FROM hl1 WINDOW w AS (PARTITION BY incident_id ORDER BY bucket, label, role, direction)),
hl AS (SELECT * FROM hl2 WHERE prev IS NULL OR prev <> label || '|' || role || '|' || direction),
past AS (SELECT incident_id, trigger_node, sig_ts, count(*) AS n, list(label || '|' || role || '|' || direction ORDER BY k) AS els,
       substring(sha256('[' || string_agg('["' || label || '","' || role || '","' || direction || '"]', ',' ORDER BY k) || ']'), 1, 32) AS fp_hash FROM hl GROUP BY ALL),
asks AS (SELECT f.incident_id, f.trigger_node, f.sig_ts, f.n, f.fp_hash, g.els FROM fph f JOIN (SELECT incident_id, list(label || '|' || role || '|' || direction ORDER BY k) AS els FROM el GROUP BY incident_id) g USING (incident_id)),
da AS (SELECT fp_hash, any_value(els) AS els FROM asks GROUP BY fp_hash), dp AS (SELECT fp_hash, any_value(els) AS els FROM past GROUP BY fp_hash),
"""
_SCORE = """{name} AS (SELECT a, b, distance, inter, na, nb, least(1.0, 0.75::DOUBLE * (inter / (na + nb - inter)) + 0.25::DOUBLE * greatest(0.0, 1.0 - distance::DOUBLE / greatest(na, nb))) AS similarity FROM (
    SELECT x.fp_hash AS a, y.fp_hash AS b, len(x.els) AS na, len(y.els) AS nb,
       list_sum(list_transform(list_distinct(x.els), lambda e: least(len(list_filter(x.els, lambda q: q = e)), len(list_filter(y.els, lambda q: q = e)))))::DOUBLE AS inter,
       levenshtein(array_to_string(list_transform(x.els, lambda e: chr(CAST(list_position(list_distinct(list_concat(x.els, y.els)), e) + 31 AS INT))), ''),
                   array_to_string(list_transform(y.els, lambda e: chr(CAST(list_position(list_distinct(list_concat(x.els, y.els)), e) + 31 AS INT))), '')) AS distance
    FROM {x} x JOIN {y} y ON {on} AND list_has_any(x.els, y.els)))"""
#: families of past by the rule itself: hashes in order of first arrival, each held against the leaders before it
_FAMILIES = """, seen AS (SELECT trigger_node, fp_hash, min((sig_ts, incident_id)) AS first_, any_value(els) AS els FROM {prints} GROUP BY ALL),
ranked_ AS (SELECT trigger_node, fp_hash, els, row_number() OVER (PARTITION BY trigger_node ORDER BY first_) AS i FROM seen),
steps AS (SELECT trigger_node, i, fp_hash, fp_hash AS leader, 1.0::DOUBLE AS similarity, [struct_pack(h := fp_hash, els := els)] AS leaders FROM ranked_ WHERE i = 1
  UNION ALL SELECT trigger_node, i, fp_hash, coalesce(hit.h, fp_hash), CASE WHEN hit IS NULL THEN 1.0 ELSE 1 - 1.0 / greatest(len(hit.els), len(els)) END, CASE WHEN hit IS NULL THEN list_append(leaders, struct_pack(h := fp_hash, els := els)) ELSE leaders END
  FROM (SELECT s.trigger_node, r.i, r.fp_hash, r.els, s.leaders, list_filter(s.leaders, lambda l: greatest(len(l.els), len(r.els)) >= 5 AND abs(len(l.els) - len(r.els)) <= 1 AND
      levenshtein(array_to_string(list_transform(l.els, lambda e: chr(CAST(list_position(list_distinct(list_concat(l.els, r.els)), e) + 31 AS INT))), ''),
                  array_to_string(list_transform(r.els, lambda e: chr(CAST(list_position(list_distinct(list_concat(l.els, r.els)), e) + 31 AS INT))), '')) <= 1)[1] AS hit
    FROM steps s JOIN ranked_ r ON r.trigger_node = s.trigger_node AND r.i = s.i + 1)),
fam AS (SELECT p.incident_id, p.trigger_node, p.sig_ts, p.fp_hash, md5(s.trigger_node || ':' || s.leader) AS family, s.similarity FROM {prints} p JOIN steps s USING (trigger_node, fp_hash)) """
_MATCHED = """, cand AS (SELECT q.incident_id, p.incident_id AS match_id, p.trigger_node AS mt, f.family, p.trigger_node = q.trigger_node AS same_service, p.sig_ts AS mts,
       CASE WHEN q.fp_hash = p.fp_hash THEN 1.0 ELSE s.similarity END AS s0 FROM asks q JOIN past p ON p.sig_ts < q.sig_ts AND p.incident_id <> q.incident_id JOIN fam f ON f.incident_id = p.incident_id
       LEFT JOIN scored s ON s.a = q.fp_hash AND s.b = p.fp_hash WHERE q.fp_hash = p.fp_hash OR s.a IS NOT NULL),
cand1 AS (SELECT *EXCLUDE (s0), CASE WHEN same_service THEN least(1.0, s0 + 0.15) ELSE s0 END AS similarity FROM cand),
cand2 AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY similarity DESC, same_service DESC, mts DESC, match_id) AS r FROM cand1),
cand3 AS (SELECT *, row_number() OVER (PARTITION BY incident_id, mt, family ORDER BY r) AS f FROM cand2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY CASE WHEN f > 1 THEN 1 ELSE 0 END, r) AS rank FROM cand3) WHERE rank <= 5) """
_PAST = _SIMILAR + _SCORE.format(name="scored", x="da", y="dp", on="x.fp_hash <> y.fp_hash") + _FAMILIES.format(prints="past") + _MATCHED
_ASKED = _SIMILAR + _SCORE.format(name="scored", x="da", y="da", on="x.fp_hash < y.fp_hash")
_OWN_FAMILIES = _SIMILAR + "nothing AS (SELECT 1)" + _FAMILIES.format(prints="asks")
_DECAYED = "greatest(0.1, base * pow(0.95, greatest(0, (epoch_us(sig_ts) - epoch_us(applied_at)) / 60000000.0 / 1440.0)))"
_HISTORY_MID = f"(SELECT *EXCLUDE (incident_id), row_number() OVER (PARTITION BY node ORDER BY applied_at DESC, event_id DESC) AS source_rank FROM hist WHERE outcome = 'resolved' AND applied_at < TIMESTAMP '{MIDWAY}')"
_SIG_MID = f"(SELECT * FROM sig WHERE sig_ts >= TIMESTAMP '{MIDWAY}')"
_BOOSTED = f"round(CASE WHEN outcome = 'resolved' THEN least(0.95, {_DECAYED} * 1.2) ELSE {_DECAYED} END, 6)"

_MORE: dict[str, str] = {
    "rename_identities": _RENAMES + "SELECT name, node, canonical FROM names",
    "logical_services": _RENAMES + "SELECT DISTINCT a.node, b.node AS same FROM names a JOIN names b ON b.canonical = a.name UNION SELECT node, node FROM names",
    "canonical_name": _TELEMETRY + "SELECT DISTINCT node, canonical FROM nm",
    "span_pairs": _TELEMETRY + _TRACES + "SELECT event_id, CAST(pos AS INT) AS pos, src, dst FROM pairs_",
    "edge_table": _TELEMETRY + _TRACES + "SELECT * FROM edgex",
    "edge_evidence": _TELEMETRY + _TRACES + """SELECT DISTINCT src, dst, 'calls' AS kind, event_id FROM pairs_ UNION ALL
        SELECT src, dst, 'dependency', -1 - CAST(seq AS BIGINT) FROM (SELECT row_number() OVER (ORDER BY ts, change, src) - 1 AS seq, * FROM (
          SELECT valid_from AS ts, 'dep_add' AS change, src, dst FROM edge UNION ALL SELECT valid_to, 'dep_remove', src, dst FROM edge WHERE valid_to IS NOT NULL
          UNION ALL SELECT TIMESTAMP '2024-01-11', 'rename', src, src FROM n12 WHERE i % 2 = 0 UNION ALL SELECT TIMESTAMP '2024-01-21', 'rename', src || '-r2', src FROM n12 WHERE i % 2 = 0)) WHERE change = 'dep_add'""",
    "current_graph": _TELEMETRY + _TRACES + "SELECT src, dst, arg_min(kind, (valid_from, kind)) AS kind, max(confidence) AS confidence FROM edgex WHERE valid_to IS NULL GROUP BY src, dst",
    "edges_of_node": _TELEMETRY + _TRACES + "SELECT src, dst, kind, valid_from FROM edgex WHERE src = 'svc-03' OR dst = 'svc-03'",
    "nodes_as_of": _TELEMETRY + "SELECT node, min(ts) AS first_seen FROM ev GROUP BY node HAVING min(ts) <= TIMESTAMP '2024-01-01 06:00:00'",
    "one_hop_downstream": _TELEMETRY + "SELECT incident_id, node, 'trigger' AS role FROM h0 UNION ALL SELECT incident_id, dst, 'downstream-1' FROM h0 JOIN edge ON node = src AND valid_from <= sig_ts AND (valid_to IS NULL OR valid_to > sig_ts)",
    "two_hop_upstream": _TELEMETRY + """, u1 AS (SELECT incident_id, sig_ts, src AS node FROM h0 JOIN edge ON node = dst AND valid_from <= sig_ts AND (valid_to IS NULL OR valid_to > sig_ts)),
        u2 AS (SELECT incident_id, src AS node FROM u1 JOIN edge ON node = dst AND valid_from <= sig_ts AND (valid_to IS NULL OR valid_to > sig_ts))
        SELECT incident_id, node, 0 AS hop FROM h0 UNION ALL SELECT incident_id, node, 1 FROM u1 UNION ALL SELECT incident_id, node, 2 FROM u2""",
    "induced_edges": _TELEMETRY + "SELECT DISTINCT a.incident_id, src, dst FROM hood a JOIN edge ON a.node = src AND valid_from <= a.sig_ts AND (valid_to IS NULL OR valid_to > a.sig_ts) JOIN hood b ON b.incident_id = a.incident_id AND b.node = dst",
    "topology_recent": _TELEMETRY + """SELECT incident_id, (SELECT count(*) FROM edge WHERE valid_from > sig_ts - INTERVAL 7 DAY AND valid_from <= sig_ts) AS n_added,
        (SELECT count(*) FROM edge WHERE valid_to > sig_ts - INTERVAL 7 DAY AND valid_to <= sig_ts) AS n_removed FROM sig""",
    "point_lookup": _TELEMETRY + "SELECT event_id, kind, service FROM tel WHERE event_id IN (7, 20, 41, 999)",
    "latest_events": _TELEMETRY + "SELECT event_id, kind FROM tel ORDER BY event_id DESC LIMIT 50",
    "latest_of_service": _TELEMETRY + "SELECT event_id, service FROM tel WHERE service = 'svc-03' ORDER BY event_id DESC LIMIT 5",
    "buffer_window": _TELEMETRY + "SELECT event_id, service FROM (SELECT * FROM tel ORDER BY event_id DESC LIMIT 500) WHERE service IN ('svc-01', 'svc-03') AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'",
    "search_events": _TELEMETRY + "SELECT event_id, name FROM tel WHERE kind = 'metric' AND value > 4000",
    "iso_rendering": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS ts FROM events",
    "normalise_json": "SELECT event_id, date_trunc('second', ts) AS ts, event_type AS kind FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0",
    "parser_counts": "SELECT count(*) FILTER (WHERE ok) AS parsed, count(*) FILTER (WHERE NOT ok) AS errors FROM (SELECT event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0 AS ok FROM events)",
    "trigger_tokens": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'svc-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') ELSE 'high,svc-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') || ',checkout_api' END AS services FROM events",
    "field_fallbacks": """WITH e AS (SELECT event_id AS i FROM events WHERE event_id < 200),
        t AS (SELECT i, CASE i % 5 WHEN 0 THEN 'rename' WHEN 1 THEN 'dep_add' WHEN 2 THEN 'dep_remove' WHEN 3 THEN CASE WHEN lower(CASE WHEN i % 4 = 0 THEN 'Retire' WHEN i % 8 = 1 THEN 'delete' ELSE 'add' END) IN ('remove', 'delete', 'retire') THEN 'dep_remove' ELSE 'dep_add' END END AS change,
          CASE WHEN i % 3 = 0 THEN 'a' || i WHEN i % 5 = 0 THEN 'b' || i WHEN i % 3 = 1 THEN 'c' || i ELSE 'b' || i END AS src,
          CASE WHEN i % 2 = 0 THEN 'x' || i WHEN i % 5 = 0 THEN NULL WHEN i % 7 <> 0 THEN 'y' || i ELSE 'z' || i END AS dst FROM e)
        SELECT i AS event_id, change, src, dst FROM t WHERE change IS NOT NULL AND dst IS NOT NULL""",
    "causal_rules_traced": _TELEMETRY + _RULES + "SELECT incident_id, cause, effect, confidence, evidence FROM rules WHERE confidence IS NOT NULL",
    "causal_transitive": _TELEMETRY + _RULES + """, rp AS (SELECT * FROM rules WHERE confidence IS NOT NULL)
        SELECT a.incident_id, a.cause, b.effect, round(max(least(a.confidence, b.confidence) * 0.8), 3) AS confidence FROM rp a JOIN rp b ON a.incident_id = b.incident_id AND a.effect = b.cause AND a.cause <> b.effect
        WHERE NOT EXISTS (SELECT 1 FROM rp x WHERE x.incident_id = a.incident_id AND x.cause = a.cause AND x.effect = b.effect) GROUP BY ALL""",
    "history_fingerprints": _TELEMETRY + _SIMILAR + "nothing AS (SELECT 1) SELECT incident_id, CAST(n AS INT) AS n_elements, fp_hash FROM past",
    "similarity_rounded": _TELEMETRY + _ASKED + "SELECT a, b, CAST(distance AS INT) AS distance, round(similarity, 9) AS similarity FROM scored",
    "family_assignments": _TELEMETRY + _OWN_FAMILIES + "SELECT incident_id, family, round(similarity, 9) AS similarity, count(*) OVER (PARTITION BY family) AS incident_count FROM fam",
    "family_representatives": _TELEMETRY + _OWN_FAMILIES + "SELECT family, trigger_node, arg_min(incident_id, (sig_ts, incident_id)) AS incident_id, arg_min(fp_hash, (sig_ts, incident_id)) AS fp_hash FROM fam GROUP BY family, trigger_node",
    "family_remediations": _TELEMETRY + _OWN_FAMILIES + """SELECT family, rank, incident_id, action, outcome FROM (SELECT family, h.incident_id, action, outcome, CAST(row_number() OVER (PARTITION BY family ORDER BY applied_at DESC, event_id DESC) AS INT) AS rank
        FROM hist h JOIN fam f ON f.incident_id = h.incident_id) WHERE rank <= 5""",
    "family_confidence": _TELEMETRY + _OWN_FAMILIES + "SELECT family, count(*) AS n_resolved, round(CAST(least(0.95, 0.5 + 0.05 * count(*)) AS DOUBLE), 9) AS reinforced FROM hist h JOIN fam f ON f.incident_id = h.incident_id WHERE outcome = 'resolved' GROUP BY family",
    "ranked_matches": _TELEMETRY + _PAST + "SELECT incident_id, CAST(rank AS INT) AS rank, match_id, round(similarity, 9) AS similarity, same_service FROM best",
    "abstained": _TELEMETRY + _PAST + """, tops AS (SELECT incident_id, max(round_even(similarity, 3)) FILTER (WHERE rank = 1) AS top, max(round_even(similarity, 3)) FILTER (WHERE rank = 2) AS second FROM best GROUP BY incident_id)
        SELECT a.incident_id, round(top, 3) AS top, round(second, 3) AS second, a.n <= 1 OR top IS NULL OR CASE WHEN top >= 0.55 THEN false WHEN top < 0.38 THEN true ELSE top - coalesce(second, 0) < 0.06 END AS abstain FROM asks a LEFT JOIN tops USING (incident_id)""",
    "remediation_by_target_midway": _TELEMETRY + f"SELECT incident_id, CAST(source_rank AS INT) AS source_rank, action, target, round({_DECAYED}, 6) AS confidence FROM {_HISTORY_MID} h JOIN {_SIG_MID} s ON h.node = s.trigger_node WHERE source_rank <= 3 AND applied_at < sig_ts",
    "remediation_neighbours_midway": _TELEMETRY + f"""SELECT s.incident_id, CAST(source_rank AS INT) AS source_rank, action, target, round({_DECAYED} * 0.9, 6) AS confidence FROM {_HISTORY_MID} h JOIN (
        SELECT DISTINCT s.incident_id, s.sig_ts, CASE WHEN e.src = s.trigger_node THEN e.dst ELSE e.src END AS near FROM {_SIG_MID} s JOIN edge e ON e.valid_to IS NULL AND (e.src = s.trigger_node OR e.dst = s.trigger_node)) s
        ON h.node = s.near WHERE source_rank <= 2 AND applied_at < sig_ts""",
    "remediation_by_incident": _TELEMETRY + _PAST + f"""SELECT incident_id, CAST(source_rank AS INT) AS source_rank, action, target, {_BOOSTED} AS confidence FROM (SELECT b.incident_id, b.rank AS source_rank, h.action, h.target, h.outcome, h.base, h.applied_at, s.sig_ts,
        row_number() OVER (PARTITION BY b.incident_id, b.match_id ORDER BY h.applied_at DESC, h.event_id DESC) AS r FROM best b JOIN sig s ON s.incident_id = b.incident_id JOIN hist h ON h.incident_id = b.match_id AND h.applied_at < s.sig_ts) WHERE r <= 2""",
    "remediation_by_pattern": _TELEMETRY + _PAST + f"""SELECT incident_id, CAST(source_rank AS INT) AS source_rank, action, target, {_BOOSTED} AS confidence FROM (SELECT b.incident_id, b.rank AS source_rank, h.action, h.target, h.outcome, h.base, h.applied_at, s.sig_ts
        FROM best b JOIN sig s ON s.incident_id = b.incident_id JOIN (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY applied_at DESC, event_id DESC) AS r FROM hist) h ON h.incident_id = b.match_id AND h.r <= 2 WHERE h.applied_at < s.sig_ts)""",
    "score_match": _TELEMETRY + _JUDGED + "SELECT incident_id, in_top_k, precision FROM sm",
    "score_remediation": _TELEMETRY + _JUDGED + "SELECT incident_id, remediation_ok FROM sr",
    "metrics_summary": _TELEMETRY + _JUDGED + "SELECT count(*) AS n, round(avg(CAST(in_top_k AS DOUBLE)), 4) AS recall_at_5, round(avg(precision), 4) AS precision_at_5, round(avg(CAST(remediation_ok AS DOUBLE)), 4) AS remediation_acc FROM sm JOIN sr USING (incident_id)",
    "latency_p95": "SELECT value AS p95 FROM (SELECT value, row_number() OVER (ORDER BY value) AS r FROM events WHERE value IS NOT NULL) WHERE r = greatest(1, (SELECT 19 * count(value) // 20 FROM events))",
    "baseline_remedies": _TELEMETRY + """, bm AS (SELECT a.incident_id, b.incident_id AS match_id, row_number() OVER (PARTITION BY a.incident_id ORDER BY b.event_id) AS rank
        FROM tel a JOIN tel b ON a.service = b.service AND a.incident_id <> b.incident_id WHERE a.kind = 'incident_signal' AND b.kind = 'incident_signal'),
        lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY event_id DESC) AS r FROM hist) WHERE r = 1)
        SELECT incident_id, action, target, outcome, 0.3::DOUBLE AS confidence FROM (SELECT bm.incident_id, action, target, outcome, row_number() OVER (PARTITION BY bm.incident_id ORDER BY rank) AS q FROM bm JOIN lastr ON lastr.incident_id = bm.match_id WHERE rank <= 5) WHERE q = 1""",
    "engine_ingest": "SELECT event_id, date_trunc('second', ts) AS ts, event_type AS kind FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0",
    "context_kinds": _TELEMETRY + "SELECT incident_id, kind, count(*) AS n FROM rel GROUP BY incident_id, kind",
    "current_two_hop": _TELEMETRY + """, st AS (SELECT DISTINCT a, b FROM both_ WHERE valid_to IS NULL), one AS (SELECT DISTINCT a AS start, b AS node FROM st WHERE a <> b)
        SELECT start, node, 1 AS hop FROM one UNION ALL SELECT DISTINCT o.start, s.b, 2 FROM one o JOIN st s ON s.a = o.node WHERE s.b <> o.start AND NOT EXISTS (SELECT 1 FROM one x WHERE x.start = o.start AND x.node = s.b)""",
    "edges_between": _TELEMETRY + "SELECT src, dst FROM edge WHERE valid_from <= TIMESTAMP '2024-01-10 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10 12:00:00') AND src < 'svc-06' AND dst < 'svc-06'",
    "family_number": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN CAST(event_id AS INT) END AS family FROM events",
    "overall_confidence": "SELECT event_id, round(least(0.95, 0.3 + least(0.2, 0.01 * (event_id % 30)) + least(0.3, 0.1 * (event_id % 5)) + least(0.2, 0.1 * (event_id % 4)))::DOUBLE, 6) AS confidence FROM events",
    "rationales": """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 100 >= 90 THEN 'near-identical behavioral pattern' WHEN event_id % 100 >= 60 THEN 'similar behavioral pattern' ELSE 'partial behavioral overlap' END,
        CASE WHEN event_id % 2 = 0 THEN 'same trigger service' END, CASE WHEN event_id % 3 = 0 THEN 'family ' || md5(CAST(event_id AS VARCHAR))[1:8] END) AS rationale FROM events""",
    "decayed": "SELECT event_id, round(greatest(0.1, 0.7 * pow(0.95, greatest(0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 60000000.0 / 1440.0))), 9) AS confidence FROM events",
    "pattern_candidates": _TELEMETRY + _OWN_FAMILIES + """, sure AS (SELECT family, least(0.95, 0.5 + 0.05 * count(*)) AS c FROM hist h JOIN fam f ON f.incident_id = h.incident_id WHERE outcome = 'resolved' GROUP BY family)
        SELECT incident_id, trigger_node, round(CAST(coalesce(c, 0.5) AS DOUBLE), 9) AS confidence FROM fam LEFT JOIN sure USING (family) WHERE trigger_node = 'svc-00' OR NOT EXISTS (SELECT 1 FROM fam WHERE trigger_node = 'svc-00') ORDER BY sig_ts DESC, incident_id LIMIT 10""",
    "baseline_matches": _TELEMETRY + """SELECT incident_id, CAST(rank AS INT) AS rank, match_id, 0.5::DOUBLE AS similarity FROM (SELECT a.incident_id, b.incident_id AS match_id, row_number() OVER (PARTITION BY a.incident_id ORDER BY b.event_id) AS rank
        FROM tel a JOIN tel b ON a.service = b.service AND a.incident_id <> b.incident_id WHERE a.kind = 'incident_signal' AND b.kind = 'incident_signal') WHERE rank <= 5""",
}
_ROW = "incident_id, strategy, source_rank, action, target, outcome, applied_at, round(confidence, 6) AS confidence"
_NEIGHBOURS = f"""SELECT s.incident_id, 4 AS strategy, CAST(source_rank AS INT) AS source_rank, action, target, outcome, applied_at, {_DECAYED} * 0.9 AS confidence FROM (
        SELECT *EXCLUDE (incident_id), row_number() OVER (PARTITION BY node ORDER BY applied_at DESC, event_id DESC) AS source_rank FROM hist WHERE outcome = 'resolved') h JOIN (
        SELECT DISTINCT s.incident_id, s.sig_ts, CASE WHEN e.src = s.trigger_node THEN e.dst ELSE e.src END AS near FROM sig s JOIN edge e ON e.valid_to IS NULL AND (e.src = s.trigger_node OR e.dst = s.trigger_node)) s
        ON h.node = s.near WHERE source_rank <= 2 AND applied_at < sig_ts"""
_OF_INCIDENT = f"""SELECT incident_id, 1 AS strategy, CAST(source_rank AS INT) AS source_rank, action, target, outcome, applied_at, CASE WHEN outcome = 'resolved' THEN least(0.95, {_DECAYED} * 1.2) ELSE {_DECAYED} END AS confidence
        FROM (SELECT b.incident_id, b.rank AS source_rank, h.action, h.target, h.outcome, h.base, h.applied_at, s.sig_ts, row_number() OVER (PARTITION BY b.incident_id, b.match_id ORDER BY h.applied_at DESC, h.event_id DESC) AS r
        FROM best b JOIN sig s ON s.incident_id = b.incident_id JOIN hist h ON h.incident_id = b.match_id AND h.applied_at < s.sig_ts) WHERE r <= 2"""
_OF_TARGET = f"""SELECT incident_id, 3 AS strategy, CAST(source_rank AS INT) AS source_rank, action, target, outcome, applied_at, {_DECAYED} AS confidence FROM (
        SELECT *EXCLUDE (incident_id), row_number() OVER (PARTITION BY node ORDER BY applied_at DESC, event_id DESC) AS source_rank FROM hist WHERE outcome = 'resolved') h JOIN sig s ON h.node = s.trigger_node WHERE source_rank <= 3 AND applied_at < sig_ts"""
#: SQL of queries that are registered in ``queries``
_EARLIER: dict[str, str] = {
    "similarity_scores": _ASKED + "SELECT s.a, s.b, inter / (na + nb - inter) AS jaccard, CAST(distance AS INT) AS distance, similarity FROM scored s",
    "similar_topk": _PAST + "SELECT incident_id, CAST(rank AS INT) AS rank, match_id, similarity, same_service, mts AS match_ts, family FROM best",
    "abstain_flags": _PAST + """, tops AS (SELECT incident_id, max(round_even(similarity, 3)) FILTER (WHERE rank = 1) AS top, max(round_even(similarity, 3)) FILTER (WHERE rank = 2) AS second FROM best GROUP BY incident_id)
        SELECT a.incident_id, CAST(a.n AS INT) AS n_elements, top, second, a.n <= 1 OR top IS NULL OR CASE WHEN top >= 0.55 THEN false WHEN top < 0.38 THEN true ELSE top - coalesce(second, 0) < 0.06 END AS abstain FROM asks a LEFT JOIN tops USING (incident_id)""",
    "families": _OWN_FAMILIES + "SELECT incident_id, family, similarity, count(*) OVER (PARTITION BY family) AS incident_count FROM fam",
    "family_reinforcement": _OWN_FAMILIES + "SELECT family, count(*) AS n_resolved, least(0.95::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * count(*)) AS reinforced FROM hist h JOIN fam f ON f.incident_id = h.incident_id WHERE outcome = 'resolved' GROUP BY family",
    "remediation_neighbours": ", nb AS (" + _NEIGHBOURS + f") SELECT {_ROW} FROM nb",
    "remediation_suggestions": _PAST + f""", every AS ({_OF_INCIDENT} UNION ALL {_OF_TARGET} UNION ALL {_NEIGHBOURS}),
        once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, action, target ORDER BY strategy, source_rank, applied_at DESC) AS f FROM every) WHERE f = 1),
        gated AS (SELECT *, (SELECT count(*) FROM once p WHERE p.incident_id = o.incident_id AND p.strategy < o.strategy) AS n FROM once o)
        SELECT {_ROW}, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, strategy, source_rank, action, target) AS rank FROM gated WHERE n < 3) WHERE rank <= 3""",
}
_ALL = _MORE | {k: _TELEMETRY + v for k, v in _EARLIER.items()}
ORACLES: dict[str, str] = {k: v if v.startswith(_RENAMES) else v.replace("\nWITH ", "\nWITH RECURSIVE ", 1) for k, v in _ALL.items()}
