"""Families assigned as fingerprints arrive: one state of leaders for each trigger service."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incidents import Leaders

OUTPUT = "incident_id string, trigger_node string, family string, similarity double, incident_count bigint"


def _assign(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
    import pandas as pd

    (trigger,) = key
    leaders, counts = Leaders(), {}
    if state.exists:
        rows, sizes = state.get
        leaders, counts = Leaders(json.loads(rows)), json.loads(sizes)
    arrived = pd.concat(list(frames)).sort_values(["sig_ts", "incident_id"])
    out = []
    for incident, h, js in zip(arrived["incident_id"], arrived["fp_hash"], arrived["fp_json"], strict=True):
        family, similarity = leaders.assign(trigger, h, json.loads(js))
        counts[family] = counts.get(family, 0) + 1
        out.append((incident, trigger, family, similarity, counts[family]))
    state.update((json.dumps(leaders.rows), json.dumps(counts)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def stream_families(prints: DataFrame) -> DataFrame:
    """A stream of (incident_id, trigger_node, sig_ts, fp_json, fp_hash) with families; state lives as long as the stream."""
    rows = prints.select("incident_id", "trigger_node", prints["sig_ts"].cast("string").alias("sig_ts"), "fp_json", "fp_hash")
    return rows.groupBy("trigger_node").applyInPandasWithState(_assign, OUTPUT, "leaders string, counts string", "append", GroupStateTimeout.NoTimeout)
