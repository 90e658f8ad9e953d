"""Causal edges between the events of one incident."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.tables import written
from .incidents import window_events

_EVENT = ["event_id", "ts", "kind", "node", "service", "name", "value", "level", "trace_id", "rank"]
#: minutes within which a rule on time can hold
_RULE_MIN = 10
#: related events that a task takes in one batch for pairs on the graph, steps of chains that are in memory at a time
_TASK_EVENTS, _STEPS = 1 << 16, 1 << 22
#: levels of logs that are errors
_ERRORS = ("error", "fatal", "critical")

#: confidences of the rules in the order in which they decide: deploy, trace, call, backward, log
_RULES = np.array([0.8, 0.7, 0.6, 0.5, 0.6])


def ranked(related: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` events per incident, newest kept, numbered by time."""
    cut = related.withColumn("_c", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("_c") <= limit).drop("_c")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy("ts", "event_id")))


def _side(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    for c, kind in (("trace_id", "string"), ("service", "string")):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast(kind))
    sev = X.severity(F.col("kind"), F.col("name"), F.col("value"), F.col("level"))
    return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in _EVENT], sev.alias(f"{p}_sev"))


def at_last_event(events: DataFrame) -> DataFrame:
    """Adds ``graph_ts``, the time of each incident's last related event; causes are read from the graph as it was then."""
    return events.withColumn("graph_ts", F.max("ts").over(Window.partitionBy("incident_id")))


def graph_pairs(events: DataFrame, edges: DataFrame, at: str = "sig_ts") -> DataFrame:
    """(incident_id, cause, effect, confidence, evidence): the best pair of events on each edge valid at ``at``, the signal's time or another.

    The effect may come from one minute before to fifteen after the cause.
    """
    a = _side(events, "a", ["incident_id", at, "trigger_node"])
    b = _side(events, "b", ["incident_id"])
    valid = (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at)))
    edges = edges.withColumnRenamed("kind", "edge_kind") if "kind" in edges.columns else edges.withColumn("edge_kind", F.lit(X.DEPENDENCY))
    touches = F.coalesce((F.col("src") == F.col("trigger_node")) | (F.col("dst") == F.col("trigger_node")), F.lit(False))
    said = lambda p: [F.col(f"{p}_event_id").alias("event"), F.unix_micros(F.col(f"{p}_ts").cast("timestamp")).alias("at"), F.col(f"{p}_sev").alias("sev"), F.col(f"{p}_rank").alias("rank"), F.col(f"{p}_kind").alias("kind"), F.col(f"{p}_service").alias("service")]
    text = lambda name: F.lit(None).cast("string").alias(name)
    left = a.join(edges.select("src", "dst", "valid_from", "valid_to", "edge_kind"), (a["a_node"] == edges["src"]) & valid)
    left = left.select("incident_id", F.struct(F.lit(True).alias("cause"), *said("a"), "src", "dst", "edge_kind", touches.alias("touches")).alias("e"))
    right = b.select("incident_id", F.struct(F.lit(False).alias("cause"), *said("b"), text("src"), F.col("b_node").alias("dst"), text("edge_kind"), F.lit(False).alias("touches")).alias("e"))
    # so many events in a task as a batch of Arrow can hold at once
    n = max(12, -(-events.count() // _TASK_EVENTS))
    every = left.unionByName(right).repartition(n, "incident_id").groupBy("incident_id").agg(F.collect_list("e").alias("e"))
    texts = "a_kind string, a_service string, b_kind string, b_service string, edge_kind string"
    best = every.mapInArrow(_best_pairs, f"incident_id string, cause bigint, effect bigint, confidence double, gap double, {texts}")
    # fixed values: the wording of evidence
    said = F.concat(F.lit("graph "), F.col("edge_kind"), F.lit(": "), F.col("a_kind"), F.lit(" on "), F.coalesce("a_service", F.lit("?")), F.lit(" \u2192 "), F.col("b_kind"), F.lit(" on "), F.coalesce("b_service", F.lit("?")))
    evidence = F.concat(said, F.lit(" ("), F.bround("gap", 0).cast("int").cast("string"), F.lit("min apart)"))
    return best.select("incident_id", "cause", "effect", "confidence", evidence.alias("evidence"))


def _best_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each incident's causes and effects the best pair on each (src, dst): by confidence, then by ranks, then by the edge's kind."""
    names = ["incident_id", "cause", "effect", "confidence", "gap", "a_kind", "a_service", "b_kind", "b_service", "edge_kind"]
    for batch in batches:
        lists = batch.column(1)
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        rows = lists.flatten()
        of = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
        cause, touches = (of[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("cause", "touches"))
        event, at, sev, rank = (of[c].to_numpy(zero_copy_only=False) for c in ("event", "at", "sev", "rank"))
        dst, src = (of[c].dictionary_encode().indices.fill_null(-1).to_numpy() for c in ("dst", "src"))
        kinds = sorted({k for k in of["edge_kind"].unique().to_pylist() if k is not None})
        kind = pc.index_in(of["edge_kind"], pa.array(kinds, pa.string())).fill_null(-1).to_numpy()
        found: list[tuple] = []
        for row, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            here = np.arange(lo, hi)
            causes, effects = here[cause[lo:hi]], here[~cause[lo:hi] & (dst[lo:hi] >= 0)]
            for s, d in set(zip(src[causes].tolist(), dst[causes].tolist(), strict=True)):
                a, b = causes[(src[causes] == s) & (dst[causes] == d)], effects[dst[effects] == d]
                gap = (at[b] - at[a][:, None]) / 60000000.0
                i, j = np.nonzero((gap >= -1) & (gap <= 15) & (event[b] != event[a][:, None]))
                if not len(i):
                    continue
                gap, a, b = gap[i, j], a[i], b[j]
                near = np.maximum(0.0, 1.0 - np.abs(gap) / 15.0)
                confidence = np.minimum(0.95, 0.3 + 0.3 * near + 0.2 * ((sev[a] + sev[b]) / 2.0) + 0.1 + np.where(touches[a], 0.1, 0.0))
                top = np.nonzero(confidence == confidence.max())[0]
                k = top[np.lexsort((kind[a[top]], rank[b[top]], rank[a[top]]))[0]]
                found.append((row, a[k], b[k], confidence[k], gap[k]))
        row, a, b, confidence, gap = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),) * 2
        a, b = pa.array(a), pa.array(b)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), of["event"].take(a), of["event"].take(b), pa.array(confidence), pa.array(gap), of["kind"].take(a), of["service"].take(a), of["kind"].take(b), of["service"].take(b), of["edge_kind"].take(a)], names)


def _current_kinds(edges: DataFrame) -> DataFrame:
    """(_s, _d, _kind): the pairs of the current graph, edges without an end, and the kind of their first."""
    now = edges.filter("valid_to is null")
    now = now.withColumn("kind", F.lit(X.DEPENDENCY)) if "kind" not in now.columns else now
    return now.groupBy(F.col("src").alias("_s"), F.col("dst").alias("_d")).agg(F.min_by("kind", F.struct("valid_from", "kind")).alias("_kind"))


def rule_pairs(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs in time order that a rule explains; the first rule that holds decides.

    Events of an incident, which are bounded, meet each other in the task that
    has them; of the pairs only those within ten minutes or on a shared trace
    leave the join, and none is shuffled.  The graph is the current one (edges
    without an end).
    """
    now = _current_kinds(edges)
    back = now.filter(F.col("_kind") == X.ERROR_PROPAGATION).select(F.col("_d").alias("_bs"), F.col("_s").alias("_bd"), F.lit(True).alias("_back"))
    a, b = _side(events, "a", ["incident_id", "trigger_node"]), _side(events, "b", ["incident_id"])
    gap = X.minutes(F.col("b_ts"), F.col("a_ts"))
    # pairs that no rule can hold for go before anything is joined to them
    near = (gap <= _RULE_MIN) | (F.nullif("a_trace_id", F.lit("")) == F.col("b_trace_id"))
    p = a.join(b, "incident_id").filter((F.col("a_rank") < F.col("b_rank")) & F.coalesce(near, F.lit(False)))
    p = p.withColumn("gap", X.minutes(F.col("b_ts"), F.col("a_ts")))
    p = p.join(now, (p["a_node"] == now["_s"]) & (p["b_node"] == now["_d"]), "left")
    p = p.join(back, (p["a_node"] == back["_bs"]) & (p["b_node"] == back["_bd"]), "left")
    gap = F.col("gap")
    deploy = (F.col("a_kind") == "deploy") & (F.col("b_kind") == "metric") & (gap > 0) & (gap <= 10) & (F.col("a_node") == F.col("trigger_node"))
    trace = (F.col("a_trace_id") != "") & (F.col("a_trace_id") == F.col("b_trace_id"))
    call = (gap <= 5) & F.col("_kind").isin(*X.CAUSAL_EDGES)
    backward = (gap <= 5) & F.col("_back")
    log = (F.col("a_kind") == "log") & (F.lower("a_level").isin(*_ERRORS)) & (F.col("b_kind") == "metric") & (F.col("a_node") == F.col("b_node")) & (gap > 0) & (gap <= 5)
    conf = F.when(deploy, 0.8).when(trace, 0.7).when(call, 0.6).when(backward, 0.5).when(log, 0.6)
    # fixed values: the wording of evidence
    why = (
        F.when(deploy, "deploy precedes metric spike within 10min")
        .when(trace, F.concat(F.lit("shared trace_id "), F.col("a_trace_id")))
        .when(call, F.concat(F.col("_kind"), F.lit(" edge in graph")))
        .when(backward, f"{X.ERROR_PROPAGATION} edge in graph")
        .when(log, "error log precedes metric spike")
    )
    return p.withColumn("confidence", conf).filter("confidence is not null").select("incident_id", F.col("a_event_id").alias("cause"), F.col("b_event_id").alias("effect"), "confidence", why.alias("evidence"))


def transitive(pairs: DataFrame) -> DataFrame:
    """A->B and B->C give A->C at 0.8 times the weaker confidence, where A->C is not there yet.

    An incident's pairs come together once and are closed in that task, so what
    its chains expand to is never shuffled.
    """

    def close(incident: pa.Table) -> pa.Table:
        cause, effect = (incident[c].to_numpy() for c in ("cause", "effect"))
        ids, at = np.unique(np.concatenate([cause, effect]), return_inverse=True)
        x, y, best = _closed(*np.split(at, 2), incident["confidence"].to_numpy(), len(ids))
        name = pa.repeat(incident["incident_id"][0], len(x))
        return pa.table([name, pa.array(ids[x]), pa.array(ids[y]), pa.array(best)], ["incident_id", "cause", "effect", "confidence"])

    new = pairs.select("incident_id", "cause", "effect", "confidence").groupBy("incident_id").applyInArrow(close, "incident_id string, cause bigint, effect bigint, confidence double")
    return new.select("incident_id", "cause", "effect", F.bround("confidence", 3).alias("confidence"), F.lit("transitive").alias("evidence"))


def _closed(x: np.ndarray, y: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cause, effect, confidence) of the pairs that two steps make of pairs x -> y of n events, where there is none yet; the confidence is not rounded."""
    order = np.argsort(x, kind="stable")
    x, y, c = x[order], y[order], c[order]
    first, last = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right")
    steps = last - first
    upto = np.cumsum(steps)
    direct = np.sort(x * n + y)
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0))]
    lo = 0
    while lo < len(x):
        # whole causes, so that what is found for one is all there is
        hi = max(int(np.searchsorted(upto, upto[lo] - steps[lo] + _STEPS, "right")), lo + 1)
        hi = int(np.searchsorted(x, x[hi], "left")) if hi < len(x) else hi
        hi = hi if hi > lo else int(np.searchsorted(x, x[lo], "right"))
        a = np.repeat(np.arange(lo, hi), steps[lo:hi])
        b = np.arange(len(a)) + np.repeat(first[lo:hi] - (upto[lo:hi] - steps[lo:hi] - upto[lo] + steps[lo]), steps[lo:hi])
        key, weaker = x[a] * n + y[b], np.minimum(c[a], c[b]) * 0.8
        some = x[a] != y[b]
        key, where = np.unique(key[some], return_inverse=True)
        best = np.zeros(len(key))
        np.maximum.at(best, where, weaker[some])
        new = direct[np.minimum(np.searchsorted(direct, key), len(direct) - 1)] != key
        found.append((key[new], best[new]))
        lo = hi
    key, best = (np.concatenate(f) for f in zip(*found, strict=True))
    return key // n, key % n, best


def _thousandths(values: np.ndarray) -> np.ndarray:
    """Rounded as ``bround`` does, by the decimal form; few of the values differ."""
    some, at = np.unique(values, return_inverse=True)
    return np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.001"), ROUND_HALF_EVEN)) for v in some])[at] if len(some) else values


def _blended(x: np.ndarray, y: np.ndarray, c: np.ndarray, near: np.ndarray, alpha: float = 0.85, steps: int = 100) -> np.ndarray:
    """Confidences c of pairs x -> y blended with a walk over them that is biased three times toward ``near`` events."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    src, dst = np.split(at, 2)
    p = np.where(near[ids], 3.0, 1.0)
    p /= p.sum()
    out = np.bincount(src, minlength=len(ids)).astype(float)
    order = np.argsort(dst, kind="stable")
    came, into = src[order], np.unique(dst)
    begin = np.searchsorted(dst[order], into)
    w = p.copy()
    for _ in range(steps):
        v = np.zeros(len(ids))
        v[into] = np.add.reduceat((w / np.maximum(out, 1.0))[came], begin)
        v = alpha * (v + w[out == 0].sum() * p) + (1 - alpha) * p
        done = np.abs(v - w).sum() < len(ids) * 1e-6
        w = v
        if done:
            break
    return np.minimum(0.99, 0.7 * c + 0.3 * np.sqrt(w[src] * w[dst]) / w.max()).round(3)


def pagerank_blend(pairs: DataFrame, events: DataFrame, alpha: float = 0.85, steps: int = 100) -> DataFrame:
    """Blend confidences with a walk biased three times toward the trigger's events; one small graph per incident."""
    heavy = events.filter(F.col("node") == F.col("trigger_node")).select("incident_id", F.col("event_id").alias("_e"))
    ca = pairs.join(heavy.withColumn("cw", F.lit(True)), (pairs["incident_id"] == heavy["incident_id"]) & (pairs["cause"] == heavy["_e"]), "left").select(pairs["*"], "cw")
    he = heavy.select(F.col("incident_id").alias("_i"), F.col("_e").alias("_f")).withColumn("ew", F.lit(True))
    ca = ca.join(he, (ca["incident_id"] == he["_i"]) & (ca["effect"] == he["_f"]), "left").drop("_i", "_f")

    def walk(pdf):
        near = set(pdf.loc[pdf["cw"] == True, "cause"]) | set(pdf.loc[pdf["ew"] == True, "effect"])  # noqa: E712
        ids, at = np.unique(np.concatenate([pdf["cause"], pdf["effect"]]), return_inverse=True)
        blend = _blended(*np.split(at, 2), pdf["confidence"].to_numpy(), np.isin(ids, list(near)), alpha, steps)
        return pdf.assign(confidence=blend)[["incident_id", "cause", "effect", "confidence", "evidence"]]

    return ca.groupBy("incident_id").applyInPandas(walk, "incident_id string, cause bigint, effect bigint, confidence double, evidence string")


def causal_chain(events: DataFrame, edges: DataFrame, keep: int = 5, deep: bool = False) -> DataFrame:
    """Graph pairs, then rules on the other pairs; deep adds transitive edges and the walk."""
    graph = written(graph_pairs(at_last_event(events), edges, "graph_ts"), "graph-pairs")
    rules = rule_pairs(events, edges).join(graph.select("incident_id", "cause", "effect"), ["incident_id", "cause", "effect"], "left_anti")
    chain = graph.unionByName(rules)
    if deep:  # else each row is read once
        chain = written(chain, "causes")
        chain = pagerank_blend(chain.unionByName(transitive(chain)), events)
    w = Window.partitionBy("incident_id").orderBy(F.desc("confidence"), "cause", "effect")
    return chain.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def deep_chain(scope: DataFrame, events: DataFrame, edges: DataFrame, before_min: int, after_min: int, keep: int = 15) -> DataFrame:
    """The deep ``causal_chain`` over all events within ``[t - before, t + after]`` of each signal's services, however many they are.

    Signals and events meet once by blocks of time as long as a window, so none
    of the window's events is repeated for a signal; its pairs are made, closed
    and walked in the task that has the block, and ``keep`` of them leave it.
    Incidents with several signals, which have one chain for all, take the joins.
    """
    span, us = (before_min + after_min) * 60_000_000, lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    of = ["incident_id", "sig_ts", "trigger_node"]
    hood = written(scope.select(*of, "node").filter("node is not null and incident_id is not null and sig_ts is not null").distinct(), "hood")
    several = hood.select(*of).distinct().groupBy("incident_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("incident_id")
    pooled = None
    if not several.isEmpty():
        every = window_events(scope.join(several, "incident_id", "left_semi"), events, before_min, after_min)
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy("ts", "event_id")))
        pooled = causal_chain(written(every, "pooled"), edges, keep, True)
        hood = hood.join(several, "incident_id", "left_anti")
    kinds = edges if "kind" in edges.columns else edges.withColumn("kind", F.lit(X.DEPENDENCY))
    none = F.lit(None).cast("bigint")
    graph = kinds.select("src", "dst", us("valid_from").alias("since"), us("valid_to").alias("until"), "kind", F.lit(False).alias("now"))
    graph = graph.unionByName(_current_kinds(edges).select(F.col("_s").alias("src"), F.col("_d").alias("dst"), none.alias("since"), none.alias("until"), F.col("_kind").alias("kind"), F.lit(True).alias("now")))
    inside = hood.withColumnRenamed("node", "src").join(graph, "src").join(hood.withColumnRenamed("node", "dst"), [*of, "dst"])
    inside = inside.groupBy(*of).agg(F.collect_list(F.struct("src", "dst", "since", "until", "kind", "now")).alias("edges"))
    asks = hood.groupBy(*of).agg(F.collect_list("node").alias("nodes")).join(inside, of, "left")
    asks = asks.select("incident_id", "trigger_node", us("sig_ts").alias("at"), "nodes", "edges").withColumn("block", F.floor(F.col("at") / span))
    for c in ("trace_id", "service"):
        events = events if c in events.columns else events.withColumn(c, F.lit(None).cast("string"))
    sev = X.severity(F.col("kind"), F.col("name"), F.col("value"), F.col("level"))
    seen = events.filter("node is not null and event_id is not null").select(F.col("event_id").alias("event"), us("ts").alias("at"), sev.alias("sev"), "kind", "node", "service", F.lower("level").isin(*_ERRORS).alias("error"), F.nullif("trace_id", F.lit("")).alias("trace"))
    seen = seen.withColumn("block", F.explode(F.sequence(F.floor((F.col("at") - after_min * 60_000_000) / span), F.floor((F.col("at") + before_min * 60_000_000) / span))))
    out = pa.schema([("incident_id", pa.string()), ("cause", pa.int64()), ("effect", pa.int64()), ("confidence", pa.float64()), ("evidence", pa.string()), ("rank", pa.int32())])

    def meet(ask: pa.Table, seen: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(ask) and len(seen):
            block = _Block(seen)
            for row in ask.to_pylist():
                at = np.searchsorted(block.at, [row["at"] - before_min * 60_000_000, row["at"] + after_min * 60_000_000 + 1])
                best = block.chain(*at, row["nodes"], row["trigger_node"], row["edges"] or [], keep)
                found.extend((row["incident_id"], *b, i) for i, b in enumerate(best, 1))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 6, out.types, strict=True)], schema=out)

    n = max(12, int(scope.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = asks.repartition(n, "block").groupBy("block").cogroup(seen.repartition(n, "block").groupBy("block"))
    chains = met.applyInArrow(meet, "incident_id string, cause bigint, effect bigint, confidence double, evidence string, rank int")
    return chains if pooled is None else chains.unionByName(pooled)


class _Block:
    """Events of a block of time in order, and the chains of windows in it."""

    def __init__(self, seen: pa.Table):
        seen = seen.combine_chunks()
        order = np.lexsort([seen[c].to_numpy() for c in ("event", "at")])
        seen = seen.take(pa.array(order)).combine_chunks()
        self.event, self.at, self.sev = (seen[c].to_numpy() for c in ("event", "at", "sev"))
        coded = {c: seen[c].chunk(0).dictionary_encode() for c in ("kind", "node", "service", "trace")}
        self.kind, self.node, self.service, self.trace = (c.indices.fill_null(-1).to_numpy() for c in coded.values())
        self.names = {c: [*x.dictionary.to_pylist(), None] for c, x in coded.items()}
        is_ = lambda kind: self.kind == self.names["kind"].index(kind) if kind in self.names["kind"] else np.zeros(len(self.at), bool)
        self.deploy, self.metric = is_("deploy"), is_("metric")
        self.error = is_("log") & seen["error"].fill_null(False).to_numpy().astype(bool)
        self.place = {x: i for i, x in enumerate(self.names["node"][:-1])}

    def _met(self, left: np.ndarray, right: np.ndarray, most_min: int, least_us: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in which the right event comes after the left one, or at ``least_us`` from it or later, and within ``most_min``."""
        first = np.searchsorted(right, left, "right") if least_us is None else np.searchsorted(self.at[right], self.at[left] + least_us, "left")
        n = np.maximum(np.searchsorted(self.at[right], self.at[left] + most_min * 60_000_000, "right") - first, 0)
        return np.repeat(left, n), right[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]

    def chain(self, lo: int, hi: int, nodes: list[str], trigger: str, edges: list[dict], keep: int) -> list[tuple]:
        """(cause, effect, confidence, evidence) of the best ``keep`` pairs of the events from lo up to but not hi that are of the nodes."""
        wanted = np.zeros(len(self.place) + 1, bool)
        wanted[[self.place[x] for x in nodes if x in self.place]] = True
        mine = lo + np.nonzero(wanted[self.node[lo:hi]])[0]
        if len(mine) < 2:
            return []
        on = {x: mine[self.node[mine] == self.place[x]] for x in nodes if x in self.place}
        here = [e for e in edges if e["src"] in on and e["dst"] in on]
        graph = self._graph(on, trigger, [e for e in here if not e["now"]], self.at[mine[-1]])
        i, j, rule = self._rules(on, mine, trigger, [e for e in here if e["now"]])
        ids, at = np.unique(self.event[mine], return_inverse=True)
        number = lambda k: at[np.searchsorted(mine, k)]
        gi, gj = (np.array([g[k] for g in graph], np.int64) for k in (0, 1))
        other = ~np.isin(number(i) * len(ids) + number(j), number(gi) * len(ids) + number(gj))
        i, j, rule = np.concatenate([gi, i[other]]), np.concatenate([gj, j[other]]), np.concatenate([np.full(len(gi), -1), rule[other]])
        if not len(i):
            return []
        x, y = number(i), number(j)
        confidence = np.concatenate([[g[2] for g in graph], _RULES[rule[len(gi) :]]])
        tx, ty, tc = _closed(x, y, confidence, len(ids))
        near = np.zeros(len(ids), bool)
        near[number(on.get(trigger, mine[:0]))] = True
        x, y = np.concatenate([x, tx]), np.concatenate([y, ty])
        blend = _blended(x, y, np.concatenate([confidence, _thousandths(tc)]), near)
        can = np.nonzero(blend >= np.partition(blend, -keep)[-keep])[0] if len(blend) > keep else np.arange(len(blend))
        top = can[np.lexsort((ids[y[can]], ids[x[can]], -blend[can]))][:keep]
        said = lambda k: "transitive" if k >= len(i) else self._graph_text(graph[k]) if k < len(gi) else self._rule_text(rule[k], i[k], j[k], here)
        return [(int(ids[x[k]]), int(ids[y[k]]), float(blend[k]), said(k)) for k in top]

    def _graph(self, on: dict, trigger: str, edges: list[dict], when: int) -> list[tuple]:
        """(cause, effect, confidence, kind of edge), by places: what ``graph_pairs`` gives for the edges valid then."""
        valid: dict[tuple, list] = {}
        for e in edges:
            if e["since"] is not None and e["since"] <= when and (e["until"] is None or e["until"] > when):
                valid.setdefault((e["src"], e["dst"]), []).append(e["kind"])
        found = []
        for (src, dst), kinds in valid.items():
            a, b = self._met(on[src], on[dst], 15, -60_000_000)
            other = self.event[a] != self.event[b]
            a, b = a[other], b[other]
            if len(a):
                near = np.maximum(0.0, 1.0 - np.abs((self.at[b] - self.at[a]) / 60000000.0) / 15.0)
                c = np.minimum(0.95, 0.3 + 0.3 * near + 0.2 * ((self.sev[a] + self.sev[b]) / 2.0) + 0.1 + (0.1 if trigger in (src, dst) else 0.0))
                # the first of the best: pairs are in the order of causes, then of effects
                k = int(np.argmax(c))
                found.append((a[k], b[k], c[k], min(kinds, key=lambda x: (x is not None, x or ""))))
        return found

    def _rules(self, on: dict, mine: np.ndarray, trigger: str, now: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cause, effect, rule), by places: what ``rule_pairs`` gives."""
        pairs: list[list] = [[] for _ in _RULES]
        metrics = mine[self.metric[mine]]
        pairs[0].append(self._met((own := on.get(trigger, mine[:0]))[self.deploy[own]], metrics, 10, 1))
        traced = mine[self.trace[mine] >= 0]
        traced = traced[np.argsort(self.trace[traced], kind="stable")]
        for same in np.split(traced, np.nonzero(np.diff(self.trace[traced]))[0] + 1):
            a, b = np.triu_indices(len(same), 1)
            pairs[1].append((same[a], same[b]))
        for e in now:
            if e["kind"] in X.CAUSAL_EDGES:
                pairs[2].append(self._met(on[e["src"]], on[e["dst"]], 5))
            if e["kind"] == X.ERROR_PROPAGATION:
                pairs[3].append(self._met(on[e["dst"]], on[e["src"]], 5))
        for some in on.values():
            pairs[4].append(self._met(some[self.error[some]], some[self.metric[some]], 5, 1))
        every = [(np.concatenate([p[0] for p in ps]), np.concatenate([p[1] for p in ps])) if ps else (mine[:0], mine[:0]) for ps in pairs]
        a, b = (np.concatenate([p[k] for p in every]) for k in (0, 1))
        rule = np.repeat(np.arange(len(_RULES)), [len(p[0]) for p in every])
        _, first = np.unique(a * len(self.at) + b, return_index=True)
        return a[first], b[first], rule[first]

    def _graph_text(self, pair: tuple) -> str | None:
        a, b, _, edge = pair
        said = lambda k: (self.names["kind"][self.kind[k]], self.names["service"][self.service[k]])
        (kind_a, at_a), (kind_b, at_b) = said(a), said(b)
        if None in (kind_a, kind_b, edge):
            return None
        gap = round(float((self.at[b] - self.at[a]) / 60000000.0))
        return f"graph {edge}: {kind_a} on {'?' if at_a is None else at_a} \u2192 {kind_b} on {'?' if at_b is None else at_b} ({gap}min apart)"

    def _rule_text(self, rule: int, a: int, b: int, edges: list[dict]) -> str:
        # fixed values: the wording of evidence, as in rule_pairs
        if rule == 1:
            return f"shared trace_id {self.names['trace'][self.trace[a]]}"
        if rule == 2:
            ends = self.names["node"][self.node[a]], self.names["node"][self.node[b]]
            return f"{next(e['kind'] for e in edges if e['now'] and (e['src'], e['dst']) == ends)} edge in graph"
        return {0: "deploy precedes metric spike within 10min", 3: f"{X.ERROR_PROPAGATION} edge in graph", 4: "error log precedes metric spike"}[rule]
