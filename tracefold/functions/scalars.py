"""Column expressions of the incident model; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: what counts as behaviour in a fingerprint
SIGNAL_KINDS = ("deploy", "log", "incident_signal", "remediation", "trace")
SIGNAL_METRICS = "latency|error|memory|heap|gc|timeout|failure|dropped|rejected|queue"
SIGNAL_LEVELS = ("error", "critical", "warn", "warning", "fatal", "exception")
BACKGROUND_METRICS = ("qps", "requests_per_second", "rps")
#: fixed values: edge kinds, those that carry causes, and the one that carries them backward
CALLS, DEPENDENCY, ERROR_PROPAGATION = "calls", "dependency", "error_propagation"
CAUSAL_EDGES = (CALLS, DEPENDENCY, ERROR_PROPAGATION)


def minutes(later: Column, earlier: Column) -> Column:
    """Signed minutes between two timestamps as a double."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(later) - us(earlier)) / F.lit(60000000.0)


def parse_timestamp(c: Column) -> Column:
    """ISO 8601 with Z, an offset or none (UTC) as UTC without zone, whatever the session's zone; null if unreadable."""
    text = F.trim(c)
    zoned = text.rlike("(?i)(z|[+-][0-9]{2}:?[0-9]{2})$") & F.contains(text, F.lit(":"))
    instant = F.try_to_timestamp(F.when(zoned, text))
    since = F.unix_micros(instant)
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.floor(since / 86400000000), F.lit(0), F.lit(0), F.pmod(since, F.lit(86400000000)).cast("decimal(20,6)") / 1000000)
    return F.when(zoned, utc).otherwise(text.try_cast("timestamp_ntz"))


def iso(ts: Column) -> Column:
    """A UTC time without zone as ISO 8601 with its offset; fractions only where there are some."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def first_text(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def trigger_service(trigger: Column) -> Column:
    """Service named by ``alert:<service>/...``; empty if there is none."""
    return F.regexp_extract(trigger, "alert:([a-zA-Z0-9_-]+)/", 1)


def trigger_tokens(trigger: Column) -> Column:
    """Candidate service names of a trigger: the alert's service, else all name-like tokens."""
    tokens = F.regexp_extract_all(trigger, F.lit("([a-zA-Z][a-zA-Z0-9_-]{2,})"), 1)
    kept = F.filter(tokens, lambda t: ~t.isin("alert", "error", "rate", "warn"))
    return F.when(trigger_service(trigger) != "", F.array(trigger_service(trigger))).otherwise(kept)


def trigger_metric(trigger: Column) -> Column:
    """What the alert watches: between the first slash and the comparison."""
    rest = F.substring(trigger, F.locate("/", trigger) + 1, 1 << 20)
    metric = F.trim(F.substring_index(F.substring_index(rest, ">", 1), "<", 1))
    return F.when(F.locate("/", trigger) > 0, metric).otherwise("unknown_anomaly")


def metric_bucket(name: Column, value: Column) -> Column:
    low = F.lower(name)
    latency = F.when(value < 100, "low").when(value < 1000, "medium").when(value < 5000, "high").otherwise("critical")
    rate = F.when(value < 1, "low").when(value < 5, "medium").when(value < 10, "high").otherwise("critical")
    size = F.when(value == 0, "zero").when(value < 10, "small").when(value < 100, "medium").when(value < 1000, "large").otherwise("very_large")
    return F.when(low.contains("latency"), latency).when(low.rlike("error|rate"), rate).otherwise(size)


def kind_label(kind: Column, name: Column, value: Column, level: Column, trigger: Column, action: Column) -> Column:
    """Behaviour label of an event; null where the event is no behaviour (quiet logs and metrics)."""
    lvl = F.lower(F.coalesce(level, F.lit("info")))
    nm = F.coalesce(name, F.lit("unknown"))
    return (
        F.when((kind == "metric") & F.lower(nm).rlike(SIGNAL_METRICS), F.concat(F.lit("metric:"), nm, F.lit(":"), metric_bucket(nm, F.coalesce(value, F.lit(0.0)))))
        .when((kind == "log") & lvl.isin(*SIGNAL_LEVELS), F.concat(F.lit("log:"), lvl))
        .when(kind == "deploy", "deploy")
        .when(kind == "incident_signal", F.concat(F.lit("incident_signal:"), trigger_metric(F.coalesce(trigger, F.lit("")))))
        .when(kind == "remediation", F.concat(F.lit("remediation:"), F.coalesce(action, F.lit("unknown"))))
        .when(kind == "trace", "trace")
    )


def relative_bucket(mins: Column, size: int) -> Column:
    """Minutes in steps of ``size``, truncated toward zero."""
    return (mins / F.lit(float(size))).cast("int") * F.lit(size)


def severity(kind: Column, name: Column, value: Column, level: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    metric = F.when(low.contains("latency") & (value > 3000), 0.9).when(low.contains("error") & (value > 5), 0.8).otherwise(0.3)
    log = F.when(F.lower(F.coalesce(level, F.lit("info"))).isin("error", "fatal", "critical"), 0.8).otherwise(0.2)
    return F.when(kind == "incident_signal", 1.0).when(kind == "metric", metric).when(kind == "log", log).when(kind == "deploy", 0.5).otherwise(0.1)


def graph_confidence(gap: Column, sev_a: Column, sev_b: Column, touches_trigger: Column, kind_bonus: float = 0.1) -> Column:
    """Confidence that an event at an edge's source caused one at its target."""
    near = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(gap) / F.lit(15.0))
    c = F.lit(0.3) + F.lit(0.3) * near + F.lit(0.2) * ((sev_a + sev_b) / F.lit(2.0)) + F.lit(kind_bonus) + F.when(touches_trigger, 0.1).otherwise(0.0)
    return F.least(F.lit(0.95), c)


def decay(base: Column, applied_at: Column, now: Column, rate: float = 0.95, floor: float = 0.1) -> Column:
    """Exponential decay by days, never under the floor."""
    days = F.greatest(F.lit(0.0), minutes(now, applied_at) / F.lit(1440.0))
    return F.greatest(F.lit(floor), base * F.pow(F.lit(rate), days))


def base_confidence(outcome: Column) -> Column:
    return F.when(outcome == "resolved", 0.7).when(outcome == "worsened", 0.3).otherwise(0.5)


def overall_confidence(events: Column, causal: Column, similar: Column) -> Column:
    part = lambda cap, step, n: F.least(F.lit(cap), F.lit(step) * n)
    return F.least(F.lit(0.95), F.lit(0.3) + part(0.2, 0.01, events) + part(0.3, 0.1, causal) + part(0.2, 0.1, similar))


def abstains(elements: Column, top: Column, second: Column) -> Column:
    """Whether to withhold matches: nothing to compare, weak, or not clearly better than the next."""
    gap = top - F.coalesce(second, F.lit(0.0))
    return (elements <= 1) | top.isNull() | F.when(top >= 0.55, False).when(top < 0.38, True).otherwise(gap < 0.06)


# fixed values: the wording of a rationale
def rationale(similarity: Column, same_service: Column, family: Column) -> Column:
    how = F.when(similarity >= 0.9, "near-identical behavioral pattern").when(similarity >= 0.6, "similar behavioral pattern").otherwise("partial behavioral overlap")
    return F.concat_ws("; ", how, F.when(same_service, "same trigger service"), F.when(family.isNotNull(), F.concat(F.lit("family "), F.substring(family, 1, 8))))


def family_number(incident_id: Column) -> Column:
    """The number at the end of an incident id; null if there is none."""
    return F.substring_index(incident_id, "-", -1).try_cast("int")
