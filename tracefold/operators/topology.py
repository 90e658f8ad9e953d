"""Identities that survive renames, and the valid-time service graph.

A rename hands a node from one name to another, whatever the other name meant
before.  So each rename points to the rename that last gave its source name a
node, these pointers form trees, and a node is known by the name at its tree's
root.  Pointers are followed in doubling steps, with one plan for logs of every
size; edges are intervals made with ``lead`` over each pair's add/remove log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.tables import written

def name_map(topology: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node, canonical): ``node`` is the name a node was first seen under, ``canonical`` the last it was renamed to.

    ``names`` has a column ``name`` with the names seen in events.  The log is
    read up to its end, so an event that comes before its service's rename
    resolves to the same node.  After a -> b and b -> a, or a -> b and a -> c,
    all names are one node; its canonical name is the target of its last rename.
    """
    renames = rename_nodes(topology)
    nodes = renames.groupBy(F.col("dst").alias("name")).agg(F.max_by("node", "seq").alias("node"))
    last = renames.groupBy("node").agg(F.max_by("dst", "seq").alias("canonical"))
    known = names.select("name").unionByName(renames.select(F.col("src").alias("name"))).filter("name is not null").distinct()
    every = known.join(nodes, "name", "full").select("name", F.coalesce("node", "name").alias("node"))
    return every.join(last, "node", "left").select("name", "node", F.coalesce("canonical", "node").alias("canonical"))


def rename_nodes(topology: DataFrame) -> DataFrame:
    """(seq, src, dst, node) of every rename: the node that moves to ``dst``."""
    log = topology.filter("change = 'rename' AND src <> dst").select("seq", "src", "dst")
    asks = log.select(F.col("src").alias("name"), "seq", F.lit(None).cast(log.schema["seq"].dataType).alias("gave"), F.lit(True).alias("asks"))
    gives = log.select(F.col("dst").alias("name"), "seq", F.col("seq").alias("gave"), F.lit(False).alias("asks"))
    before = Window.partitionBy("name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    up = asks.unionByName(gives).withColumn("up", F.last("gave", ignorenulls=True).over(before)).filter("asks").select("seq", "up")
    steps = written(log.join(up, "seq").withColumn("node", F.col("src")), "renames")
    while not steps.filter("up is not null").isEmpty():
        above = steps.select(F.col("seq").alias("up"), F.col("up").alias("_up"), F.col("node").alias("_node"))
        on = F.col("_node").isNotNull()
        steps = written(steps.join(above, "up", "left").select("seq", "src", "dst", F.when(on, F.col("_up")).alias("up"), F.coalesce("_node", "node").alias("node")), "renames")
    return steps.select("seq", "src", "dst", "node")


def resolve(df: DataFrame, names: DataFrame, column: str = "service", node: str = "node") -> DataFrame:
    """Add the node of a service name; unknown names have none."""
    m = names.select(F.col("name").alias("_name"), F.col("node").alias(node))
    return df.join(m, df[column] == m["_name"], "left").drop("_name")


def all_names(names: DataFrame) -> DataFrame:
    return names.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count(F.lit(1)).alias("n_names"))


def edge_intervals(topology: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, valid_from, valid_to): when each dependency held; repeated adds extend, removes close."""
    log = topology.filter("change in ('dep_add', 'dep_remove')").select("ts", "seq", "change", F.col("src").alias("_s"), F.col("dst").alias("_d"))
    log = resolve(resolve(log, names, "_s", "src"), names, "_d", "dst").select("ts", "seq", "change", "src", "dst")
    w = Window.partitionBy("src", "dst").orderBy("ts", "seq")
    log = log.withColumn("_prev", F.lag("change").over(w)).filter("_prev is null or _prev <> change")
    log = log.withColumn("_next", F.lead("ts").over(w))
    return log.filter("change = 'dep_add'").select("src", "dst", F.col("ts").alias("valid_from"), F.col("_next").alias("valid_to"))


def topology_log(events: DataFrame) -> DataFrame:
    """(ts, seq, change, src, dst, event_id) of topology events, their fields read with all the names they go by.

    ``seq`` is the order of arrival; ``change`` is rename, dep_add or dep_remove.
    """
    t = events.filter("kind = 'topology'")
    has = lambda *names: X.first_text(*[F.col(n) for n in names if n in t.columns])
    op = F.lower(F.coalesce(has("op", "action", "type"), F.lit("add")))
    change = (
        F.when(F.col("change").isin("rename", "dep_add", "dep_remove"), F.col("change"))
        .when(F.col("change") == "dependency-shift", F.when(op.isin("remove", "delete", "retire"), "dep_remove").otherwise("dep_add"))
    )
    src = F.when(F.col("change") == "rename", has("from_", "from")).otherwise(has("from_", "source", "from", "src"))
    dst = F.when(F.col("change") == "rename", has("to")).otherwise(has("to", "target", "dst"))
    seq = F.col("ingest_seq") if "ingest_seq" in t.columns else F.col("event_id")
    return t.select("ts", seq.alias("seq"), change.alias("change"), src.alias("src"), dst.alias("dst"), "event_id").filter("change is not null AND src is not null AND dst is not null")


def edge_table(topology: DataFrame, calls: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, kind, valid_from, last_seen, valid_to, confidence, n_evidence): every edge there was, with what it rests on.

    Dependencies come from the topology log: repeated adds extend an edge, a
    remove closes it, the next add opens another.  Calls come from traces and
    never close, so they are summed before they are shuffled.
    """
    log = topology.filter("change in ('dep_add', 'dep_remove')").select("ts", "seq", "change", F.col("src").alias("_s"), F.col("dst").alias("_d"))
    log = resolve(resolve(log, names, "_s", "src"), names, "_d", "dst")
    before = Window.partitionBy("src", "dst").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("epoch", F.coalesce(F.sum((F.col("change") == "dep_remove").cast("int")).over(before), F.lit(0)))
    add = F.col("change") == "dep_add"
    deps = log.groupBy("src", "dst", "epoch").agg(
        F.min_by(F.when(add, F.col("ts")), F.when(add, F.col("seq"))).alias("valid_from"), F.max_by(F.when(add, F.col("ts")), F.when(add, F.col("seq"))).alias("last_seen"),
        F.max(F.when(~add, F.col("ts"))).alias("valid_to"), F.count_if(add).alias("n_evidence"),
    )
    deps = deps.filter("n_evidence > 0").select("src", "dst", F.lit(X.DEPENDENCY).alias("kind"), "valid_from", "last_seen", "valid_to", F.lit(1.0).alias("confidence"), "n_evidence")
    seen = calls.groupBy("src", "dst").agg(F.min_by("ts", "event_id").alias("valid_from"), F.max_by("ts", "event_id").alias("last_seen"), F.count_distinct("event_id").alias("n_evidence"))
    made = resolve(resolve(seen.withColumnsRenamed({"src": "_s", "dst": "_d"}), names, "_s", "src"), names, "_d", "dst")
    made = made.groupBy("src", "dst").agg(F.min("valid_from").alias("valid_from"), F.max("last_seen").alias("last_seen"), F.sum("n_evidence").alias("n_evidence"))
    return deps.unionByName(made.select("src", "dst", F.lit(X.CALLS).alias("kind"), "valid_from", "last_seen", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(1.0).alias("confidence"), "n_evidence"))


def edge_evidence(topology: DataFrame, calls: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, kind, event_id): the events that edges rest on, a row for each, however many there are."""
    adds = topology.filter("change = 'dep_add'").select("event_id", F.col("src").alias("_s"), F.col("dst").alias("_d"), F.lit(X.DEPENDENCY).alias("kind"))
    every = adds.unionByName(calls.select("event_id", F.col("src").alias("_s"), F.col("dst").alias("_d"), F.lit(X.CALLS).alias("kind")))
    return resolve(resolve(every, names, "_s", "src"), names, "_d", "dst").select("src", "dst", "kind", "event_id").distinct()


def current_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence) of the edges without an end, one for each pair: the first kind, the highest confidence."""
    return edges.filter("valid_to is null").groupBy("src", "dst").agg(F.min_by("kind", F.struct("valid_from", "kind")).alias("kind"), F.max("confidence").alias("confidence"))


def edges_of(edges: DataFrame, node: str, active: bool = True) -> DataFrame:
    """A node's edges in both directions, oldest first."""
    out = edges.filter((F.col("src") == node) | (F.col("dst") == node))
    return (out.filter("valid_to is null") if active else out).orderBy("valid_from", "src", "dst")


def nodes_as_of(nodes: DataFrame, at) -> DataFrame:
    """Nodes first seen at a time or before; names are today's."""
    return nodes.filter(F.col("first_seen") <= at)


def same_service(names: DataFrame) -> DataFrame:
    """(node, same): nodes of one logical service; a node whose canonical name another node also goes by belongs to it."""
    canon = names.select(F.col("canonical").alias("name"), F.col("node").alias("same")).distinct()
    also = names.select("node", "name").join(canon, "name").select("node", "same")
    return also.unionByName(names.select("node", F.col("node").alias("same"))).distinct()


def edges_as_of(edges: DataFrame, at, among: DataFrame | None = None) -> DataFrame:
    """Edges valid at a time (a column or literal timestamp), with both ends among the given nodes."""
    out = edges.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    if among is None:
        return out
    ends = lambda c: among.select(F.col("node").alias(c)).distinct()
    return out.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")


def induced(hood: DataFrame, edges: DataFrame) -> DataFrame:
    """(incident_id, src, dst): the edges between the nodes of each incident's neighbourhood, as of its signal."""
    a = hood.select("incident_id", "sig_ts", F.col("node").alias("src"))
    b = hood.select("incident_id", F.col("node").alias("dst"))
    valid = (F.col("valid_from") <= F.col("sig_ts")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("sig_ts")))
    return a.join(edges, "src").filter(valid).join(b, ["incident_id", "dst"]).select("incident_id", "src", "dst").distinct()


def topology_diff(edges: DataFrame, start, end) -> DataFrame:
    """(change, src, dst, at): edges added or removed in ``(start, end]``."""
    added = edges.filter((F.col("valid_from") > start) & (F.col("valid_from") <= end)).select(F.lit("added").alias("change"), "src", "dst", F.col("valid_from").alias("at"))
    removed = edges.filter((F.col("valid_to") > start) & (F.col("valid_to") <= end)).select(F.lit("removed").alias("change"), "src", "dst", F.col("valid_to").alias("at"))
    return added.unionByName(removed)


def _counted(points: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """Adds to points (incident_id, at) how many changes (ts) there were up to ``at``.

    Days are counted first and summed over the calendar; only changes of a
    point's own day are compared with it.
    """
    day = lambda c: F.to_date(c)
    days = changes.groupBy(day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).unionByName(points.select(day("at").alias("day"), F.lit(0).cast("bigint").alias("n")).distinct())
    upto = days.groupBy("day").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = points.withColumn("day", day("at")).join(upto.select("day", "before"), "day")
    same = on.join(changes.select(day("ts").alias("day"), F.col("ts").alias("_ts")), "day").filter(F.col("_ts") <= F.col("at")).groupBy("incident_id", "at").agg(F.count(F.lit(1)).alias("_same"))
    return on.join(same, ["incident_id", "at"], "left").select("incident_id", "at", (F.col("before") + F.coalesce("_same", F.lit(0))).alias(name))


def recent_changes(signals: DataFrame, edges: DataFrame, days: int = 7) -> DataFrame:
    """(incident_id, n_added, n_removed): edges that came or went in the days up to each signal."""
    out = signals.select("incident_id").distinct()
    for name, column in (("n_added", "valid_from"), ("n_removed", "valid_to")):
        changes = edges.filter(F.col(column).isNotNull()).select(F.col(column).alias("ts"))
        now = signals.select("incident_id", F.col("sig_ts").alias("at")).distinct()
        start = signals.select("incident_id", (F.col("sig_ts") - F.expr(f"interval {days} days")).alias("at")).distinct()
        a, b = _counted(now, changes, "_now"), _counted(start, changes, "_then")
        out = out.join(a.groupBy("incident_id").agg(F.max("_now").alias("_now")), "incident_id").join(b.groupBy("incident_id").agg(F.max("_then").alias("_then")), "incident_id")
        out = out.withColumn(name, F.col("_now") - F.col("_then")).drop("_now", "_then")
    return out


def current_neighbourhood(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(start, node, hop): nodes within so many hops of each start, whatever the edges' direction, in the graph without ended edges; not the start."""
    now = edges.filter("valid_to is null")
    step = now.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).unionByName(now.select(F.col("dst").alias("_at"), F.col("src").alias("_to"))).distinct()
    seen = frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        found = frontier.join(step, frontier["node"] == step["_at"]).select("start", F.col("_to").alias("node"), F.lit(hop).alias("hop")).distinct()
        frontier = found.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def neighbourhood(signals: DataFrame, edges: DataFrame, hops: int = 2, direction: str = "both") -> DataFrame:
    """(incident_id, sig_ts, trigger_node, node, hop, role): services around each signal's, as the graph was then.

    Each node is taken at its nearest hop, downstream before upstream;
    ``direction`` is both, downstream or upstream.
    """
    if direction not in ("both", "downstream", "upstream"):
        raise ValueError(f"direction: {direction}")
    here = signals.select("incident_id", "sig_ts", "trigger_node", F.col("trigger_node").alias("node"), F.lit(0).alias("hop"), F.lit(0).alias("_dir"))
    seen = frontier = here.filter("node is not null")
    both = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.lit(1).alias("_d"), "valid_from", "valid_to").unionByName(
        edges.select(F.col("dst").alias("_at"), F.col("src").alias("_to"), F.lit(2).alias("_d"), "valid_from", "valid_to")
    )
    both = both if direction == "both" else both.filter(F.col("_d") == (1 if direction == "downstream" else 2))
    for hop in range(1, hops + 1):
        valid = (F.col("valid_from") <= F.col("sig_ts")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("sig_ts")))
        step = frontier.join(both, (frontier["node"] == both["_at"]) & valid).select("incident_id", "sig_ts", "trigger_node", F.col("_to").alias("node"), F.lit(hop).alias("hop"), F.col("_d").alias("_dir"))
        frontier = step.groupBy("incident_id", "sig_ts", "trigger_node", "node").agg(F.first("hop").alias("hop"), F.min("_dir").alias("_dir")).join(seen.select("incident_id", "node"), ["incident_id", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    role = F.when(F.col("hop") == 0, "trigger").otherwise(F.concat(F.when(F.col("_dir") == 1, "downstream-").otherwise("upstream-"), F.col("hop").cast("string")))
    return seen.select("incident_id", "sig_ts", "trigger_node", "node", "hop", role.alias("role"))
