"""Operators on hand-made telemetry, and the SQL-checked queries on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracefold.functions import scalars as X
from tracefold.operators import causal, incidents, topology
from tracefold.operators.events import normalise
from tracefold.plans import context
from tracefold.queries import ORACLES, QUERIES
from tracefold.sources.telemetry import driver_telemetry, parse_json_lines

SF = "/root/testdata/sf0.001"
FAST_QUERIES = ["normalise_events", "parse_trigger", "metric_bucket", "event_severity", "kind_labels", "background_filter", "time_range_scan", "name_map", "edge_intervals", "two_hop_roles", "fingerprint_hash", "remediation_asof"]


@pytest.mark.parametrize("name", FAST_QUERIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_unreadable_lines_are_rejected(spark):
    lines = spark.createDataFrame([('{"ts":"2026-05-10T14:21:30Z","kind":"deploy","service":"a"}',), ("{nope",), ('{"kind":"log"}',)], "value string")
    good, bad = normalise(parse_json_lines(lines))
    assert good.count() == 1 and bad.count() == 2


def _value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("mins,size,want", [(-11.5, 5, -10), (4.9, 5, 0), (-4.9, 5, 0), (12.0, 10, 10)])
def test_relative_bucket_truncates_toward_zero(spark, mins, size, want):
    assert _value(spark, X.relative_bucket(F.lit(mins), size)) == want


def test_decay_after_ten_days(spark):
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    c = _value(spark, X.decay(F.lit(0.7), at("2024-01-01 00:00:00"), at("2024-01-11 00:00:00")))
    assert abs(c - 0.7 * 0.95**10) < 1e-12


def _print(spark, rows):
    el = spark.createDataFrame([("INC-1", "n", "2024-01-01", i, *r) for i, r in enumerate(rows)], "incident_id string, trigger_node string, sig_ts string, rank int, label string, role string, direction string")
    return incidents.fingerprints(el).first()["fp_hash"]


def test_golden_fingerprint_hashes(spark):
    assert _print(spark, [("incident_signal:unknown_anomaly", "trigger", "before")]) == "b4a1f4719335671c6c01263764aad87e"
    rows = [("deploy", "trigger", "before"), ("incident_signal:latency", "trigger", "before"), ("metric:latency_p99_ms:critical", "trigger", "before")]
    assert _print(spark, rows) == "ff7e9c5a75d1fd307b52f3b1b344ee8a"


def _log(spark, rows):
    return spark.createDataFrame([(t, i, *r) for i, (t, *r) in enumerate(rows)], "ts string, seq int, change string, src string, dst string").withColumn("ts", F.to_timestamp_ntz("ts"))


def test_rename_chain_keeps_one_identity(spark):
    log = _log(spark, [("2024-01-01 00:00:00", "rename", "a", "b"), ("2024-01-02 00:00:00", "rename", "b", "c"), ("2024-01-03 00:00:00", "rename", "c", "d")])
    got = {r["name"]: (r["node"], r["canonical"]) for r in topology.name_map(log, spark.createDataFrame([("x",), ("b",)], "name string")).collect()}
    assert got == {"a": ("a", "d"), "b": ("a", "d"), "c": ("a", "d"), "d": ("a", "d"), "x": ("x", "x")}


def test_edges_hold_from_add_to_remove(spark):
    log = _log(spark, [("2024-01-01 00:00:00", "dep_add", "a", "b"), ("2024-01-02 00:00:00", "dep_add", "a", "b"), ("2024-01-03 00:00:00", "dep_remove", "a", "b")])
    names = topology.name_map(log, spark.createDataFrame([("a",), ("b",)], "name string"))
    edges = topology.edge_intervals(log, names)
    at = lambda s: topology.edges_as_of(edges, F.to_timestamp_ntz(F.lit(s))).count()
    assert edges.count() == 1 and at("2023-12-31 00:00:00") == 0 and at("2024-01-02 12:00:00") == 1 and at("2024-01-03 00:00:00") == 0


def test_contexts_have_one_row_per_signal(spark):
    rows = QUERIES["contexts_fast"](spark, SF).collect()
    want = driver_telemetry(spark, SF).filter("kind = 'incident_signal'").count()
    assert len(rows) == want and all(r["incident_id"] in r["explain"] and 0 < r["confidence"] <= 0.95 for r in rows)


def test_matches_spread_over_families(spark):
    """Near variants of one family take one of the five places first; another family keeps its own."""
    element = [(f"metric:m{i}:high", "trigger", "before") for i in range(10)]
    variants = [[*element[:9], (f"deploy{i}", "trigger", "before")] for i in range(6)]
    other = [*element[:6], *[(f"log:x{i}", "trigger", "before") for i in range(4)]]
    rows = [(f"INC-{i}", "n", f"2024-01-0{i + 1}", r, *x) for i, v in enumerate([other, *variants, element]) for r, x in enumerate(v)]
    prints = incidents.fingerprints(spark.createDataFrame(rows, "incident_id string, trigger_node string, sig_ts string, rank int, label string, role string, direction string"))
    got = incidents.similar_incidents(prints, prints, incidents.pair_scores(prints)).filter("incident_id = 'INC-7'").orderBy("rank").collect()
    assert [r["match_id"] for r in got] == ["INC-6", "INC-0", "INC-5", "INC-4", "INC-3"]


def test_history_leaves_out_aliases_of_the_trigger(spark):
    from tracefold.queries import WIDE_INGEST, _t

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    every = ORACLES["fingerprint_hash"]
    own = every.replace("v.label IS NOT NULL\n", "v.label IS NOT NULL AND (h.node <> h.trigger_node OR v.service = (SELECT x.service FROM tel x WHERE x.incident_id = h.incident_id))\n")
    want, other = (sorted(con.execute(f"SELECT incident_id, fp_hash FROM ({q})").fetchall()) for q in (own, every))
    got = sorted((r["incident_id"], r["fp_hash"]) for r in context.history(_t(spark, sf), WIDE_INGEST).collect())
    assert got == want != other


def test_causes_are_read_from_the_graph_at_the_last_event(spark):
    rows = [("INC", s, "a", i, t, "log", n, None, None, "error", i) for i, (s, t, n) in enumerate([("2024-01-01 00:00:00", "2024-01-01 00:01:00", "a"), ("2024-01-01 00:00:00", "2024-01-01 00:04:00", "b")], 1)]
    names = "incident_id string, sig_ts string, trigger_node string, event_id long, ts string, kind string, node string, name string, value double, level string, rank int"
    ev = spark.createDataFrame(rows, names).withColumn("ts", F.to_timestamp_ntz("ts")).withColumn("sig_ts", F.to_timestamp_ntz("sig_ts"))
    edges = spark.createDataFrame([("a", "b", "2024-01-01 00:03:00", "2024-01-02 00:00:00")], "src string, dst string, valid_from string, valid_to string")
    edges = edges.withColumn("valid_from", F.to_timestamp_ntz("valid_from")).withColumn("valid_to", F.to_timestamp_ntz("valid_to"))
    assert [(r["cause"], r["effect"]) for r in causal.causal_chain(ev, edges).collect()] == [(1, 2)]
    assert causal.graph_pairs(ev, edges).count() == 0


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from tracefold.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ts":"2026-05-10T14:21:30Z","kind":"deploy","service":"a"}\n{"ts":"bad","kind":"log"}\n')
    for _ in range(2):
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/events").count() == 1


def test_modes():
    assert context.FAST.max_events == 200 and context.DEEP.causal == 15
