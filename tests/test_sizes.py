"""What keeps the telemetry queries within their limits on large tables, against plain versions of the same."""

import random

from pyspark.sql import functions as F

from tracefold.operators import causal, incidents, sequences


def _prints(spark, sequences_, triggers=1):
    rows = [(f"INC-{i:03d}", f"n{i % triggers}", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", r, x, "trigger", "before") for i, s in enumerate(sequences_) for r, x in enumerate(s)]
    el = spark.createDataFrame(rows, "incident_id string, trigger_node string, sig_ts string, rank int, label string, role string, direction string")
    return incidents.fingerprints(el.withColumn("sig_ts", F.to_timestamp_ntz("sig_ts")))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _some(seed, n, letters, lengths):
    rng = random.Random(seed)
    return [[f"x{rng.randrange(letters)}" for _ in range(rng.choice(lengths))] for _ in range(n)]


def test_searched_matches_equal_those_of_all_scores(spark):
    prints = _prints(spark, _some(1, 90, 5, [1, 2, 5, 8]), triggers=3)
    rows = lambda df: sorted(map(tuple, df.select("incident_id", "rank", "match_id", "similarity", "same_service", "family").collect()))
    got = rows(incidents.similar_incidents(prints, prints))
    assert got and got == rows(incidents.similar_incidents(prints, prints, incidents.pair_scores(prints)))


def test_distances_of_long_sequences():
    import numpy as np
    import pyarrow as pa

    texts = _some(2, 20, 6, [1, 3, 63, 64, 65, 129])
    codes = pa.array([[hash(x) for x in t] for t in texts], pa.list_(pa.int64()))
    (a, b), _ = sequences.numbered(codes, codes)
    i, j = np.divmod(np.arange(400), 20)
    assert sequences.distances(a, b, i, j).tolist() == [_edits(texts[x], texts[y]) for x, y in zip(i, j, strict=True)]


def test_neighbours_are_the_fingerprints_one_edit_away(spark):
    """Only these come together by trigger, and without their elements."""
    texts = [list(t) for t in {tuple(t) for t in _some(3, 60, 2, [4, 5, 6])}]
    seen = spark.createDataFrame([(i, "n", [hash(x) for x in t]) for i, t in enumerate(texts)], "id long, trigger_node string, codes array<long>")
    got = {r["id"]: sorted(r["near"]) for r in incidents._neighbours(seen).collect()}
    want = {i: [j for j, b in enumerate(texts) if _edits(a, b) == 1] for i, a in enumerate(texts)}
    assert got == {i: near for i, near in want.items() if near}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _related(spark):
    names = "incident_id string, trigger_node string, event_id long, ts timestamp_ntz, kind string, node string, service string, name string, value double, level string, trace_id string, rank int"
    return spark.createDataFrame([], names), spark.createDataFrame([], "src string, dst string, valid_from timestamp_ntz, valid_to timestamp_ntz")


def test_rules_meet_within_an_incident(spark):
    """No pair is made twice and sorted out again."""
    plan = _plan(causal.rule_pairs(*_related(spark)))
    assert "Generate" not in plan and "Union" not in plan


def test_chains_are_closed_within_an_incident(spark):
    rng = random.Random(4)
    pairs = {(i, *rng.sample(range(9), 2)): rng.choice([0.5, 0.6, 0.7, 0.8]) for i in (1, 2) for _ in range(14)}
    df = spark.createDataFrame([(f"INC-{i}", a, b, c) for (i, a, b), c in pairs.items()], "incident_id string, cause long, effect long, confidence double")
    out = causal.transitive(df)
    want = {}
    for (i, a, b), c in pairs.items():
        for (j, x, d), e in pairs.items():
            if i == j and x == b and a != d and (i, a, d) not in pairs:
                want[i, a, d] = max(want.get((i, a, d), 0), round(min(c, e) * 0.8, 3))
    assert {(int(r["incident_id"][4:]), r["cause"], r["effect"]): r["confidence"] for r in out.collect()} == want
    assert "Join" not in _plan(out)


def test_fingerprints_of_windows_equal_those_of_their_events(spark):
    """Also on the windows' edges, with events at the same time, odd characters, and the trigger under one name only."""
    rng = random.Random(5)
    at = lambda s: f"2024-01-02 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    labels = ["deploy", 'a"],["b', "back\\slash", "tab\t\x01", "é\U0001f600|"]
    times = [*range(0, 36000, 300), *(rng.randrange(36000) for _ in range(500))]
    ev = spark.createDataFrame([(i, at(s), rng.choice(["n0", "n1", "n2", None]), rng.choice(["x", "y", None]), rng.choice(labels)) for i, s in enumerate(times)], "event_id long, ts string, node string, service string, label string").withColumn("ts", F.to_timestamp_ntz("ts"))
    rows = [(f"INC-{i}", at(s), "n0", node, role, service) for i, (s, service) in enumerate([(0, "x"), (7200, "y"), (20000, "x"), (20001, None), (35999, "y"), (300, "x")]) for node, role in (("n0", "trigger"), ("n1", "upstream-1"), ("n3", "downstream-1"), ("n2", "downstream-2"))]
    scope = spark.createDataFrame(rows, "incident_id string, sig_ts string, trigger_node string, node string, role string, sig_service string").withColumn("sig_ts", F.to_timestamp_ntz("sig_ts"))
    got = lambda df: sorted(map(tuple, df.select("incident_id", "trigger_node", "sig_ts", "n_elements", "fp_json", "fp_hash").collect()))
    for before, after, bucket in ((360, 60, 60), (30, 5, 5), (35, 7, 10), (60, 5, 2)):
        seen = incidents.window_events(scope, ev, before, after)
        plain = lambda x: got(incidents.fingerprints(incidents.fingerprint_elements(x, bucket)))  # noqa: E731, B023
        named = seen.filter((F.col("node") != F.col("trigger_node")) | (F.col("service") == F.col("sig_service")))
        assert got(incidents.window_fingerprints(scope.drop("sig_service"), ev, before, after, bucket)) == plain(seen)
        assert got(incidents.window_fingerprints(scope, ev, before, after, bucket)) == plain(named)


def test_one_edit_leaves_a_half():
    import numpy as np
    import pyarrow as pa

    texts = [list(t) for t in {tuple(t) for t in _some(6, 80, 2, [4, 5, 6, 7])}]
    row, key = sequences.half_keys(pa.array([[hash(x) for x in t] for t in texts], pa.list_(pa.int64())), np.zeros(len(texts), np.uint64))
    held = [set(key[row == i].tolist()) for i in range(len(texts))]
    assert all(held[i] & held[j] for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and _edits(a, b) == 1)
    assert not all(held[i] & held[j] for i in range(len(texts)) for j in range(len(texts)))


def test_stored_codes_are_those_of_the_text(spark):
    """Families and matches read them instead of the texts, which at size do not fit beside the rest; both must be the same hashes."""
    ev = [(i, f"2024-01-02 0{i % 9}:{i:02d}:00", "n0", "x", label) for i, label in enumerate(['a"],["b', "back\\slash", "é\U0001f600|", "", "x" * 5, "y" * 33, "z" * 64, "w" * 90])]
    ev = spark.createDataFrame(ev, "event_id long, ts string, node string, service string, label string").withColumn("ts", F.to_timestamp_ntz("ts"))
    scope = spark.createDataFrame([(f"INC-{h}", f"2024-01-02 0{h}:30:00", "n0", "n0", "trigger") for h in (2, 5, 8)], "incident_id string, sig_ts string, trigger_node string, node string, role string").withColumn("sig_ts", F.to_timestamp_ntz("sig_ts"))
    prints = incidents.window_fingerprints(scope, ev, 360, 60, 60)
    bare = prints.drop("codes")
    both = prints.join(bare.select("incident_id", incidents._codes(bare).alias("cut")), "incident_id").select("n_elements", "codes", "cut").collect()
    assert len(both) == 3 and all(r["codes"] == r["cut"] and len(r["codes"]) == r["n_elements"] for r in both)
    assert incidents._codes(prints)._jc.toString() == "codes"


def _window(spark):
    rng = random.Random(7)
    at = lambda s: f"2024-01-02 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    ev = spark.createDataFrame([(i, at(rng.randrange(36000) // 7 * 7), rng.choice(["n0", "n1", None])) for i in range(1500)], "event_id long, ts string, node string").withColumn("ts", F.to_timestamp_ntz("ts"))
    asks = [("A", 20001, "n0"), ("A", 20001, "n1"), ("B", 600, "n0"), ("C", 35999, "n1"), ("D", 7200, "n0"), ("D", 28800, "n1")]
    scope = spark.createDataFrame([(i, at(s), node) for i, s, node in asks], "incident_id string, sig_ts string, node string").withColumn("sig_ts", F.to_timestamp_ntz("sig_ts"))
    return scope, ev


def test_newest_events_are_those_of_the_whole_window(spark):
    """Also where one incident has two signals; what is older than enough newer slots is not joined."""
    scope, ev = _window(spark)
    rows = lambda df: sorted(map(tuple, df.select("incident_id", "rank", "event_id", "node", "ts").collect()))
    for limit in (1, 20, 5000):
        every, newest = incidents.window_events(scope, ev, 360, 60), incidents.newest_window_events(scope, ev, 360, 60, limit)
        assert rows(causal.ranked(newest, limit)) == rows(causal.ranked(every, limit))
        assert newest.count() <= every.count() if limit == 5000 else newest.count() < every.count() / 2


def test_best_pairs_equal_those_of_all_pairs(spark):
    """No pair of events is a row of the plan, and the best of all pairs is kept, ties by rank."""
    rng = random.Random(8)
    rows, want = [], {}
    for inc in ("A", "B"):
        for r in range(1, 41):
            kind, ts, node = rng.choice(["deploy", "log", "remediation"]), rng.randrange(40), rng.choice(["n0", "n1", "n2"])
            rows.append((inc, "n0", "2024-01-02 00:20:00", r, f"2024-01-02 00:{ts:02d}:00", kind, node, node, None, None, rng.choice(["error", "info"]), None, r))
    ev = spark.createDataFrame(rows, "incident_id string, trigger_node string, sig_ts string, event_id long, ts string, kind string, node string, service string, name string, value double, level string, trace_id string, rank int")
    ev = ev.withColumn("ts", F.to_timestamp_ntz("ts")).withColumn("sig_ts", F.to_timestamp_ntz("sig_ts"))
    edges = spark.createDataFrame([("n0", "n1", None), ("n1", "n2", None), ("n2", "n0", "2024-01-02 00:10:00")], "src string, dst string, valid_to string").withColumn("valid_from", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).withColumn("valid_to", F.to_timestamp_ntz("valid_to"))
    sev = lambda r: {"deploy": 0.5, "remediation": 0.1}.get(r[5], 0.8 if r[10] == "error" else 0.2)
    for a in rows:
        for b in rows:
            gap = int(b[4][14:16]) - int(a[4][14:16])
            if a[0] == b[0] and (a[6], b[6]) in (("n0", "n1"), ("n1", "n2")) and -1 <= gap <= 15:
                c = min(0.95, 0.3 + 0.3 * max(0.0, 1.0 - abs(gap) / 15.0) + 0.2 * ((sev(a) + sev(b)) / 2.0) + 0.1 + (0.1 if a[6] == "n0" else 0.0))
                want.setdefault((a[0], a[6]), []).append((-c, a[3], b[3]))
    pairs = causal.graph_pairs(ev, edges)
    assert _plan(pairs).count("Join") == 1
    assert {(r["incident_id"], r["cause"], r["effect"], r["confidence"]) for r in pairs.collect()} == {(i, a, b, -c) for (i, _), (c, a, b) in ((k, min(v)) for k, v in want.items())}


def _every(scope, ev):
    """All events of the windows, numbered by time, whatever their number."""
    return causal.ranked(incidents.window_events(scope, ev, 360, 60), 1 << 30)


def test_deep_chain_takes_all_events_of_a_window(spark, tmp_path):
    """The query's chain may rest on the oldest events of a window that has more than a context keeps."""
    from tracefold import queries
    from tracefold.operators import topology

    rng = random.Random(9)
    rows = [(i, f"2024-01-12 0{2 + i // 90}:{i % 90 * 2 // 3:02d}:{rng.randrange(60):02d}", rng.randrange(4), rng.choice(["view", "click", "signup", "error", "purchase"]), rng.random() * 400) for i in range(1, 400)]
    rows += [(400, "2024-01-12 06:00:00", 1, "error", 1.0), (440, "2024-01-12 07:00:00", 2, "error", 1.0)]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    made.write.parquet(f"{tmp_path}/events.parquet")
    t = queries._t(spark, str(tmp_path))
    every = _every(topology.neighbourhood(t.signals, t.edges, 2), t.events)
    assert every.groupBy("incident_id").count().agg(F.max("count")).first()[0] > 200
    rows = lambda df: sorted(map(tuple, df.select("incident_id", "rank", "cause", "effect", "confidence", "evidence").collect()))
    got = rows(queries.causal_chain_deep(spark, str(tmp_path)))
    assert len(got) >= 30 and got == rows(causal.causal_chain(every, t.edges, 15, True))


def test_deep_chains_in_blocks_equal_those_of_joins(spark, monkeypatch):
    """Traces, all rules, edges that ended or have other kinds, equal times, an incident with two signals, windows across blocks, steps in parts."""
    rng = random.Random(10)
    rows = []
    for i in range(700):
        kind, node = rng.choice(["deploy", "log", "metric", "remediation"]), rng.choice(["n0", "n1", "n2", "n3", None])
        s = rng.randrange(8 * 3600) // 5 * 5
        rows.append((i, f"2024-01-02 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", kind, node, rng.choice([node, None]), "error_rate", rng.random() * 9, rng.choice(["ERROR", "info", None]), rng.choice(["", None, None, f"t{rng.randrange(60)}"])))
    ev = spark.createDataFrame(rows, "event_id long, ts string, kind string, node string, service string, name string, value double, level string, trace_id string").withColumn("ts", F.to_timestamp_ntz("ts"))
    asks = [("A", "06:00:01", "n0"), ("B", "00:00:00", "n1"), ("C", "07:30:00", "n2"), ("C", "02:00:00", "n0"), ("D", "23:00:00", "n0"), ("E", "07:00:00", "n3")]
    scope = spark.createDataFrame([(i, f"2024-01-02 {at}", trigger, node) for i, at, trigger in asks for node in ("n0", "n1", "n2", "n3")[: 3 if trigger != "n3" else 4]], "incident_id string, sig_ts string, trigger_node string, node string").withColumn("sig_ts", F.to_timestamp_ntz("sig_ts"))
    edges = [("n0", "n1", "calls", "2023-01-01", None), ("n0", "n1", None, "2023-01-02", None), ("n1", "n2", "error_propagation", "2023-01-01", None), ("n2", "n0", "dependency", "2023-01-01", "2024-01-02 06:30:00"), ("n3", "n3", "other", "2023-01-01", None)]
    edges = spark.createDataFrame(edges, "src string, dst string, kind string, valid_from string, valid_to string").withColumn("valid_from", F.to_timestamp_ntz("valid_from")).withColumn("valid_to", F.to_timestamp_ntz("valid_to"))
    rows = lambda df: sorted(map(tuple, df.select("incident_id", "rank", "cause", "effect", "confidence", F.coalesce("evidence", F.lit("null"))).collect()))
    want = rows(causal.causal_chain(_every(scope, ev), edges, 40, True))
    assert {w[0] for w in want} == {"A", "B", "C", "E"} and len({w[5].split("_id ")[0].split(":")[0] for w in want}) > 3
    assert rows(causal.deep_chain(scope, ev, edges, 360, 60, 40)) == want
    import numpy as np

    x, y, c = np.array([3, 0, 1, 0, 1, 4]), np.array([4, 1, 2, 2, 3, 0]), np.array([0.5, 0.6, 0.7, 0.8, 0.8, 0.95])
    whole = causal._closed(x, y, c, 5)
    for n in (1, 2, 3):
        monkeypatch.setattr(causal, "_STEPS", n)
        assert all((p == q).all() for p, q in zip(causal._closed(x, y, c, 5), whole, strict=True))
    assert {(int(a), int(b)): float(s) for a, b, s in zip(*whole, strict=True)} == {(0, 3): 0.6 * 0.8, (1, 4): 0.5 * 0.8, (3, 0): 0.5 * 0.8, (4, 1): 0.6 * 0.8, (4, 2): 0.8 * 0.8}


def test_blocks_of_pairs_meet_once(spark, monkeypatch):
    """Every pair once, the lesser hash first; every cell is a task of its own, so none waits for several."""
    import numpy as np

    monkeypatch.setattr(incidents, "_OWN_ROWS", 40)
    texts = [t for t in {tuple(t) for t in _some(11, 170, 4, [1, 3, 6, 9, 70])}]
    prints = _prints(spark, texts)
    of = dict(map(tuple, prints.select("incident_id", "fp_hash").collect()))
    want = {}
    # repeats in a row stay: the elements are given as they are
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            a, b = of[f"INC-{i:03d}"], of[f"INC-{j:03d}"]
            inter = sum(min(s.count(x), t.count(x)) for x in set(s))
            if a < b and inter:
                d = _edits(s, t) if max(len(s), len(t)) < 20 else None
                want[a, b] = (inter / (len(s) + len(t) - inter), d)
    got = incidents.pair_scores(prints)
    rows = got.select("*", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]) for r in rows} == set(want)
    assert all(r["jaccard"] == want[r["a"], r["b"]][0] and want[r["a"], r["b"]][1] in (None, r["distance"]) for r in rows)
    blocks = -(-len(texts) // 40)
    n = np.bincount([r["task"] for r in rows])
    assert len(n) == blocks * (blocks + 1) // 2 and n.min() > 0
    assert incidents.pair_scores(prints.limit(0)).count() == 0 and incidents.pair_scores(prints.limit(1)).count() == 0
