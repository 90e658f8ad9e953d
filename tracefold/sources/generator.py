"""Synthetic telemetry with a known truth: services that are renamed, incidents of families, decoys, load metrics.

Every value is a hash of (seed, stream, row), so any row can be made on any
executor and a seed always gives the same data.  Load metrics, nearly all rows,
come from ``spark.range``; names are settled by the renames before events are
made, which makes matching by literal names fail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .telemetry import EVENT_SCHEMA

#: fixed values: what each family is remedied with, in turn
FAMILY_ACTIONS = ("rollback", "restart", "scale_up", "config_change", "failover")
TRAIN_SHARE = 0.7
CASCADE_SHARE = 0.7


@dataclass(frozen=True)
class Config:
    seed: int = 42
    n_services: int = 12
    days: int = 7
    deploys: int = 30
    topology_mutations: int = 20
    rename_weight: float = 0.8
    incidents_train: int = 24
    incidents_eval: int = 10
    incident_families: int = 5
    background_density: int = 200
    start: str = "2026-05-01 00:00:00"
    cascading_renames: bool = False
    decoy_rate: float = 0.0


def stretch(seed: int = 42) -> Config:
    """The hard preset: longer, more renames in chains, more families, a fifth of decoys."""
    return Config(seed, 30, 21, 80, 80, 0.85, 60, 25, 8, 120, cascading_renames=True, decoy_rate=0.20)


@dataclass
class Data:
    train: DataFrame
    evaluation: DataFrame
    signals: DataFrame
    truth: DataFrame


_TEXT = [f.name for f in EVENT_SCHEMA.fields if f.dataType.simpleString() == "string" and f.name not in ("ts", "_corrupt")]


class _Stream:
    """Pseudo-random columns of one kind of row."""

    def __init__(self, seed: int, name: str):
        self.seed, self.name = seed, name

    def unit(self, what: str, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.name), F.lit(what), i), F.lit(1 << 40)) / float(1 << 40)

    def pick(self, what: str, i: Column, n: int | Column) -> Column:
        return F.floor(self.unit(what, i) * n).cast("int")


def _events(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows (t, ...) as events; what is not given is null."""
    text = [columns.get(c, F.lit(None)).cast("string").alias(c) for c in _TEXT]
    return df.select(F.col("t"), *text, columns.get("value", F.lit(None)).cast("double").alias("value"))


def _at(cfg: Config, share: Column) -> Column:
    """A second of the period."""
    return F.to_timestamp_ntz(F.lit(cfg.start)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(share * cfg.days * 86400).cast("decimal(18,6)"))


def _mutations(spark: SparkSession, cfg: Config) -> DataFrame:
    """(i, t, change, victim, other, old, new) in time order; a rename adds to the name its service has by then."""
    r, i = _Stream(cfg.seed, "mutation"), F.col("id")
    rest = (1 - cfg.rename_weight) / 2
    u = r.unit("change", i)
    change = F.when(u < cfg.rename_weight, "rename").when(u < cfg.rename_weight + rest, "dep_add").otherwise("dep_remove")
    hot = max(1, cfg.n_services // 4)  # cascades fall on a few services again and again
    victim = r.pick("victim", i, cfg.n_services)
    if cfg.cascading_renames:
        victim = F.when((change == "rename") & (r.unit("cascade", i) < CASCADE_SHARE), r.pick("again", i, hot)).otherwise(victim)
    other = F.pmod(victim + 1 + r.pick("other", i, cfg.n_services - 1), F.lit(cfg.n_services))
    m = spark.range(cfg.topology_mutations).select(i.alias("i"), _at(cfg, r.unit("time", i)).alias("t"), change.alias("change"), victim.alias("victim"), other.alias("other"), (2 + r.pick("digit", i, 8)).alias("digit"))
    w = Window.partitionBy("victim").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("change") == "rename", F.concat(F.lit("-r"), F.col("digit").cast("string")))
    old = F.concat(_base(F.col("victim")), F.array_join(F.collect_list(step).over(w), ""))
    return m.withColumn("old", old).withColumn("new", F.concat("old", step))


def _base(i: Column) -> Column:
    return F.concat(F.lit("svc-"), F.when(i < 10, F.lit("0")).otherwise(""), i.cast("string"))


def _names(spark: SparkSession, cfg: Config, mutations: DataFrame) -> DataFrame:
    """(service, live): the name each service has in the end."""
    last = mutations.filter("change = 'rename'").groupBy(F.col("victim").cast("bigint").alias("service")).agg(F.max_by("new", F.struct("t", "i")).alias("live"))
    return spark.range(cfg.n_services).withColumnRenamed("id", "service").join(last, "service", "left").select("service", F.coalesce("live", _base(F.col("service"))).alias("live"))


def generate(spark: SparkSession, cfg: Config | None = None) -> Data:
    """Events to learn from, events to evaluate on, the signals to ask about and their truth."""
    cfg = cfg or Config()
    mutations = _mutations(spark, cfg)
    names = _names(spark, cfg, mutations)
    live = lambda df, key, out: df.join(names.select(F.col("service").alias(key), F.col("live").alias(out)), key)
    renames = mutations.filter("change = 'rename'")
    shifts = live(live(mutations.filter("change <> 'rename'").withColumns({"victim": F.col("victim").cast("bigint"), "other": F.col("other").cast("bigint")}), "victim", "a"), "other", "b")
    topo = _events(renames, kind=F.lit("topology"), change=F.col("change"), from_=F.col("old"), to=F.col("new"))
    topo = topo.unionByName(_events(shifts, kind=F.lit("topology"), change=F.col("change"), from_=F.col("a"), to=F.col("b")))
    i = F.col("id")
    d = _Stream(cfg.seed, "deploy")
    deploys = spark.range(cfg.deploys).select(_at(cfg, d.unit("time", i)).alias("t"), d.pick("service", i, cfg.n_services).cast("bigint").alias("s"), _version(d, i).alias("v"))
    deploys = _events(live(deploys, "s", "name_"), kind=F.lit("deploy"), service=F.col("name_"), version=F.col("v"), actor=F.lit("ci"))
    b = _Stream(cfg.seed, "load")
    load = spark.range(cfg.n_services * cfg.days * cfg.background_density).select(_at(cfg, b.unit("time", i)).alias("t"), b.pick("service", i, cfg.n_services).cast("bigint").alias("s"), (10 + b.pick("value", i, 991)).alias("x"))
    load = _events(live(load, "s", "name_"), kind=F.lit("metric"), service=F.col("name_"), name=F.lit("qps"), value=F.col("x"))
    inc = _incidents(spark, cfg, live)
    before, signal, after, truth = _incident_events(inc)
    cutoff = _at(cfg, F.lit(TRAIN_SHARE))
    early = lambda df: df.filter(F.col("t") < cutoff)
    late = lambda df: df.filter(F.col("t") >= cutoff)
    by_time = [topo, deploys, load, before]
    train, evaluation = early(by_time[0]), late(by_time[0])
    for df in by_time[1:]:
        train, evaluation = train.unionByName(early(df)), evaluation.unionByName(late(df))
    is_eval = lambda df, yes: df.filter(F.col("actor") == ("eval" if yes else "train")).withColumn("actor", F.lit(None).cast("string"))
    train = train.unionByName(is_eval(signal, False)).unionByName(after)
    evaluation = evaluation.unionByName(is_eval(signal, True))
    asked = is_eval(signal, True).select("incident_id", F.col("t").alias("sig_ts"), "trigger", "service")
    return Data(_sent(train), _sent(evaluation), asked, truth)


def _sent(df: DataFrame) -> DataFrame:
    """Events as they are sent, with ``ts`` in ISO 8601, in time order."""
    return df.orderBy("t", "kind", "service", "name", "value").withColumn("ts", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("t")


def _version(r: _Stream, i: Column, what: str = "v") -> Column:
    return F.concat(F.lit("v"), (1 + r.pick(what + "1", i, 9)).cast("string"), F.lit("."), r.pick(what + "2", i, 100).cast("string"), F.lit("."), r.pick(what + "3", i, 10).cast("string"))


def _incidents(spark: SparkSession, cfg: Config, live) -> DataFrame:
    """One row for each incident and decoy, with the names its events take."""
    r, f, i = _Stream(cfg.seed, "incident"), _Stream(cfg.seed, "family"), F.col("id")
    late = i >= cfg.incidents_train
    share = F.when(late, TRAIN_SHARE + (1 - TRAIN_SHARE) * r.unit("time", i)).otherwise(TRAIN_SHARE * r.unit("time", i))
    decoy = late & (r.unit("decoy", i) < cfg.decoy_rate)
    fam = r.pick("family", i, cfg.incident_families)
    home = F.when(decoy, r.pick("where", i, cfg.n_services)).otherwise(f.pick("home", fam.cast("bigint"), cfg.n_services))
    other = F.pmod(home + 1 + r.pick("upstream", i, cfg.n_services - 1), F.lit(cfg.n_services))
    rows = spark.range(cfg.incidents_train + cfg.incidents_eval).select(
        i.alias("i"), _at(cfg, share).alias("t"), late.alias("late"), decoy.alias("decoy"), fam.alias("family"), home.cast("bigint").alias("home"), other.cast("bigint").alias("other"),
        (3000 + r.pick("latency", i, 6001)).alias("latency"), _version(r, i, "v").alias("v"), _version(r, i, "p").alias("p"), F.concat(F.lit("tr-"), (100000 + r.pick("trace", i, 900000)).cast("string")).alias("trace"),
    )
    rows = live(live(rows, "home", "svc"), "other", "upstream")
    number = F.lpad(F.col("i").cast("string"), 5, "0")
    action = F.element_at(F.array(*[F.lit(a) for a in FAMILY_ACTIONS]), F.pmod(F.col("family"), F.lit(len(FAMILY_ACTIONS))) + 1)
    ident = F.when(F.col("decoy"), F.concat(F.lit("DEC-"), number)).otherwise(F.concat(F.lit("INC-"), number, F.lit("-"), F.col("family").cast("string")))
    return rows.withColumns({"incident_id": ident, "action": action})


def _incident_events(inc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What comes before an incident, its signal, its remedy, and the truth of those to evaluate on."""
    real = inc.filter(~F.col("decoy"))
    ago = lambda df, text: df.withColumn("t", F.col("t") - F.expr(f"interval {text}"))
    before = _events(ago(real, "30 minutes"), kind=F.lit("deploy"), service=F.col("svc"), version=F.col("v"), actor=F.lit("ci"))
    before = before.unionByName(_events(ago(real, "10 minutes"), kind=F.lit("metric"), service=F.col("svc"), name=F.lit("latency_p99_ms"), value=F.col("latency")))
    said = F.concat(F.lit("timeout calling "), F.col("svc"))
    before = before.unionByName(_events(ago(real, "30 seconds"), kind=F.lit("log"), service=F.col("upstream"), level=F.lit("error"), msg=said, trace_id=F.col("trace")))
    watched = F.when(F.col("decoy"), "/unknown_anomaly").otherwise("/latency_p99_ms>3000")
    who = F.when(F.col("late"), "eval").otherwise("train")
    signal = _events(inc, kind=F.lit("incident_signal"), incident_id=F.col("incident_id"), trigger=F.concat(F.lit("alert:"), F.col("svc"), watched), service=F.col("svc"), actor=who)
    fixed = inc.filter(~F.col("late")).withColumn("t", F.col("t") + F.expr("interval 20 minutes"))
    after = _events(fixed, kind=F.lit("remediation"), incident_id=F.col("incident_id"), action=F.col("action"), target=F.col("svc"), version=F.col("p"), outcome=F.lit("resolved"))
    truth = inc.filter("late").select(
        "incident_id", F.when(~F.col("decoy"), F.col("family")).alias("family"), F.col("svc").alias("trigger_service_live"), _base(F.col("home")).alias("trigger_service_canonical"),
        F.when(~F.col("decoy"), F.col("action")).alias("expected"), F.col("decoy").alias("is_decoy"),
    )
    return before, signal, after, truth
