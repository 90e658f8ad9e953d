"""Windows around signals, fingerprints, similarity, families."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.tables import written
from . import sequences

#: what the same trigger service adds to a similarity
_SAME_SERVICE = 0.15
#: rows of a block on the left and on the right: of scores a cell's pairs are in memory, of matches only k for each row
_SCORE_ROWS, _MATCH_ROWS = (512, 2048), (4096, 4096)
#: as many cells at least, so that all cores have work
_CELLS = 24
#: rows of a block where a table meets itself, and as many blocks at least while they have 64
_OWN_ROWS, _OWN_BLOCKS = 2048, 12
#: incidents put together at a time, places looked up at a time
_TOGETHER, _LOOKUPS = 128, 1 << 21


def window_events(scope: DataFrame, events: DataFrame, before_min: int, after_min: int, step_min: int = 60) -> DataFrame:
    """Events of each signal's services within ``[t - before, t + after]``.

    A range join as an equi-join: the window is cut into time buckets, so rows
    meet by (node, bucket) and the exact bounds are a residual filter.
    """
    step = step_min * 60
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    lo, hi = sec(F.col("sig_ts")) - before_min * 60, sec(F.col("sig_ts")) + after_min * 60
    cut = scope.withColumn("_b", F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step))))
    keyed = events.drop(*[c for c in scope.columns if c != "node"]).withColumn("_b", F.floor(sec(F.col("ts")) / step))
    gap = X.minutes(F.col("ts"), F.col("sig_ts"))
    return cut.join(keyed.filter("node is not null"), ["node", "_b"]).withColumn("rel_min", gap).filter((F.col("rel_min") >= -before_min) & (F.col("rel_min") <= after_min)).drop("_b")


def newest_window_events(scope: DataFrame, events: DataFrame, before_min: int, after_min: int, limit: int, step_min: int = 10) -> DataFrame:
    """Of ``window_events`` at least each incident's ``limit`` newest.

    Events are counted by (node, time slot) first.  A slot is read only while
    the newer ones that lie wholly within the window have less than ``limit``
    events, so that what a dense window holds beyond them is never joined.
    """
    step = step_min * 60
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    lo, hi = sec(F.col("sig_ts")) - before_min * 60, sec(F.col("sig_ts")) + after_min * 60
    cut = scope.withColumn("_b", F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step))))
    keyed = events.drop(*[c for c in scope.columns if c != "node"]).filter("node is not null").withColumn("_b", F.floor(sec(F.col("ts")) / step))
    counts = keyed.groupBy("node", "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = (F.col("_b") * step > lo) & ((F.col("_b") + 1) * step <= hi)
    newer = Window.partitionBy("incident_id").orderBy(F.desc("_b")).rangeBetween(Window.unboundedPreceding, -1)
    slots = cut.join(counts, ["node", "_b"]).withColumn("_newer", F.sum(F.when(whole, F.col("_n")).otherwise(0)).over(newer))
    slots = slots.filter(F.coalesce("_newer", F.lit(0)) < limit).drop("_n", "_newer")
    gap = X.minutes(F.col("ts"), F.col("sig_ts"))
    return slots.join(keyed, ["node", "_b"]).withColumn("rel_min", gap).filter((F.col("rel_min") >= -before_min) & (F.col("rel_min") <= after_min)).drop("_b")


def fingerprint_elements(windowed: DataFrame, bucket_min: int = 5) -> DataFrame:
    """(incident_id, trigger_node, sig_ts, rank, label, role, direction) in order, repeats in a row collapsed."""
    el = windowed.select("incident_id", "trigger_node", "sig_ts", "label", "role", F.when(F.col("rel_min") <= 0, "before").otherwise("after").alias("direction"), X.relative_bucket(F.col("rel_min"), bucket_min).alias("bucket"))
    w = Window.partitionBy("incident_id").orderBy("bucket", "label", "role", "direction")
    same = F.struct("label", "role", "direction")
    el = el.withColumn("_prev", F.lag(same).over(w)).filter(F.col("_prev").isNull() | (F.col("_prev") != same)).drop("_prev")
    return el.withColumn("rank", F.row_number().over(w))


def fingerprints(elements: DataFrame) -> DataFrame:
    """(incident_id, trigger_node, sig_ts, n_elements, fp_json, fp_hash): the ordered elements and their hash."""
    g = elements.groupBy("incident_id", "trigger_node", "sig_ts").agg(F.sort_array(F.collect_list(F.struct("rank", "label", "role", "direction"))).alias("e"))
    js = F.to_json(F.transform("e", lambda x: F.array(x.label, x.role, x.direction)))
    return g.select("incident_id", "trigger_node", "sig_ts", F.size("e").alias("n_elements"), js.alias("fp_json"), F.substring(F.sha2(js, 256), 1, 32).alias("fp_hash"))


def _steps(before_min: int, after_min: int, bucket_min: int) -> tuple[list[int], list[int], list[int]]:
    """(bucket, whether before, edge): the steps of a window; step i has the microseconds from edge i up to but not edge i + 1."""
    b, steps = bucket_min * 60_000_000, []
    for q in range(-(before_min // bucket_min), after_min // bucket_min + 1):
        if q <= 0:
            steps.append((q * bucket_min, 1, (q - 1) * b + 1))
        if q >= 0:
            steps.append((q * bucket_min, 0, max(1, q * b)))
    edges = [max(e, -before_min * 60_000_000) for _, _, e in steps] + [after_min * 60_000_000 + 1]
    return [x for x, _, _ in steps], [x for _, x, _ in steps], edges


def window_fingerprints(scope: DataFrame, events: DataFrame, before_min: int, after_min: int, bucket_min: int = 5) -> DataFrame:
    """What ``fingerprints`` gives for the labelled events within ``[t - before, t + after]`` of each signal's services.

    A fingerprint only says which labels came in which step of its window, so
    none of the window's events is repeated for a signal: events and signals
    meet once by (node, time cell), each label's times are searched for the
    steps' edges, and bits of the steps are what goes on.  With ``sig_service``
    in the scope, events of the trigger count only under that name.  ``codes``
    has the elements' hashes, so that what compares them need not read the text.
    """
    buckets, before, edges = _steps(before_min, after_min, bucket_min)
    span = (before_min + after_min) * 60_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.lit(False) if "sig_service" not in scope.columns else F.col("node") == F.col("trigger_node")
    who = F.when(own, F.concat(F.lit("="), F.col("sig_service") if "sig_service" in scope.columns else F.lit(""))).otherwise("*")
    n = max(12, int(scope.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys, of = ["node", "who", "cell"], ["incident_id", "trigger_node", "sig_ts"]
    asks = scope.select(*of, "node", "role", who.alias("who"), us("sig_ts").alias("at")).filter("who is not null")
    asks = asks.withColumn("cell", F.explode(F.sequence(F.floor((F.col("at") + edges[0]) / span), F.floor((F.col("at") + edges[-1] - 1) / span))))
    said = events.filter("node is not null").select("node", "service", us("ts").alias("at"), "label").withColumn("cell", F.floor(F.col("at") / span))
    seen = said.withColumn("who", F.lit("*"))
    if "sig_service" in scope.columns:
        seen = seen.unionByName(said.withColumn("who", F.concat(F.lit("="), "service")).filter("who is not null"))
    kind = scope.schema["sig_ts"].dataType.simpleString()

    def meet(ask: pa.Table, seen: pa.Table) -> pa.Table:
        ask = ask.combine_chunks()
        out = ask.select([*of, "role"]).slice(0, 0).append_column("labels", pa.array([], pa.list_(pa.string()))).append_column("bits", pa.array([], pa.binary()))
        if not len(ask) or not len(seen):
            return out
        label = seen["label"].combine_chunks().dictionary_encode()
        label = label.chunk(0) if isinstance(label, pa.ChunkedArray) else label
        ts = seen["at"].to_numpy()
        start, width = ts.min(), int(ts.max() - ts.min()) + 2
        key = np.sort(label.indices.to_numpy().astype(np.int64) * width + (ts - start))
        base = np.arange(len(label.dictionary), dtype=np.int64) * width
        at = ask["at"].to_numpy()[:, None] + np.array(edges) - start
        every = [out]
        step = max(1, _LOOKUPS // (len(base) * len(edges)))
        for lo in range(0, len(at), step):
            places = np.searchsorted(key, base[:, None] + np.clip(at[lo : lo + step], 0, width - 1)[:, None, :])
            some = np.diff(places, axis=2) > 0
            row, lab = np.nonzero(some.any(axis=2))
            packed = np.packbits(some[row, lab], axis=1)
            rows, first = np.unique(row, return_index=True)
            cuts = np.append(first, len(row))
            labels = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), label.dictionary.take(pa.array(lab)))
            bits = pa.array([packed[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            got = ask.slice(lo, step).take(pa.array(rows)).select([*of, "role"])
            every.append(got.append_column("labels", labels).append_column("bits", bits))
        return pa.concat_tables(every)

    met = asks.repartition(n, *keys).groupBy(*keys).cogroup(seen.drop("service").repartition(n, *keys).groupBy(*keys))
    parts = met.applyInArrow(meet, f"incident_id string, trigger_node string, sig_ts {kind}, role string, labels array<string>, bits binary")
    parts = parts.repartition(n, *of).groupBy(*of).agg(F.collect_list(F.struct("role", "labels", "bits")).alias("parts"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(lo, _TOGETHER)
                texts, codes, cuts = _fingerprint_texts(part.column(3), np.array(buckets), np.array(before))
                hashes = [hashlib.sha256(t.encode()).hexdigest()[:32] for t in texts]
                columns = [pa.array(np.diff(cuts), pa.int32()), pa.array(texts, pa.string()), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(codes))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], [*of, "n_elements", "fp_json", "fp_hash", "codes"])

    return parts.mapInArrow(put_together, f"incident_id string, trigger_node string, sig_ts {kind}, n_elements int, fp_json string, fp_hash string, codes array<bigint>")


def _fingerprint_texts(parts: pa.ListArray, buckets: np.ndarray, before: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, codes of elements laid end to end, where each text's begin) of incidents, given (role, labels, bits of steps) of their services."""
    row = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
    role, labels, bits = parts.flatten().flatten()
    roles, role = _in_order(role)
    each = labels.value_lengths().to_numpy()
    names, label = _in_order(labels.flatten())
    row, role = np.repeat(row, each), np.repeat(role, each)
    some = np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(label), -1), axis=1)[:, : len(buckets)]
    i, step = np.nonzero(some)
    bucket = np.unique(buckets, return_inverse=True)[1]
    # in the order of bucket, label, role, direction, in which "after" comes first
    size = len(names) * len(roles) * 2
    key = np.unique((row[i] * (bucket[-1] + 1) + bucket[step]) * size + (label[i] * len(roles) + role[i]) * 2 + before[step])
    element, row = key % size, key // size // (bucket[-1] + 1)
    new = np.ones(len(key), bool)
    new[1:] = (element[1:] != element[:-1]) | (row[1:] != row[:-1])
    element, row = element[new], row[new]
    kinds, at = np.unique(element, return_inverse=True)
    inner = [f'{_escaped(names[k // 2 // len(roles)])}","{_escaped(roles[k // 2 % len(roles)])}","{"before" if k % 2 else "after"}' for k in kinds.tolist()]
    said, codes = np.array([f'["{x}"]' for x in inner], object)[at], np.array([_hashed(x) for x in inner], np.int64)[at]
    cuts = np.searchsorted(row, np.arange(len(parts) + 1))
    return ["[" + ",".join(said[a:b]) + "]" for a, b in zip(cuts[:-1], cuts[1:], strict=True)], codes, cuts


def _in_order(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different texts by code point, and each one's place among them."""
    coded = texts.dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return [names[i] for i in order], place[coded.indices.to_numpy()]


#: how ``to_json`` writes these characters
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _escaped(text: str) -> str:
    return re.sub(r'["\\\x00-\x1f]', lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04X}", text)


@functools.lru_cache(1 << 16)
def _hashed(text: str) -> int:
    """What Spark's ``xxhash64`` gives for a text."""
    m, p1, p2, p3, p4, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda x, r: (x << r | x >> (64 - r)) & m
    mix = lambda acc, lane: turn((acc + lane * p2) & m, 31) * p1 & m
    b, seed, i = text.encode(), 42, 0
    word = lambda at, n: int.from_bytes(b[at : at + n], "little")
    h = (seed + p5) & m
    if len(b) >= 32:
        v = [(seed + p1 + p2) & m, (seed + p2) & m, seed, (seed - p1) & m]
        while i + 32 <= len(b):
            v = [mix(x, word(i + 8 * k, 8)) for k, x in enumerate(v)]
            i += 32
        h = sum(turn(x, r) for x, r in zip(v, (1, 7, 12, 18), strict=True)) & m
        for x in v:
            h = ((h ^ mix(0, x)) * p1 + p4) & m
    h = (h + len(b)) & m
    while i + 8 <= len(b):
        h = (turn(h ^ mix(0, word(i, 8)), 27) * p1 + p4) & m
        i += 8
    if i + 4 <= len(b):
        h = (turn(h ^ word(i, 4) * p1 & m, 23) * p2 + p3) & m
        i += 4
    for x in b[i:]:
        h = turn(h ^ x * p5 & m, 11) * p1 & m
    h = (h ^ h >> 33) * p2 & m
    h = (h ^ h >> 29) * p3 & m
    h ^= h >> 32
    return h - (1 << 64) if h >> 63 else h


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two arrays of strings.

    Elements are written as one character each, numbered within the pair, so
    that the built-in edit distance counts elements whatever the vocabulary is;
    it counts code points, and the numbers pass over the surrogates.
    """
    every = F.array_distinct(F.concat(a, b))

    def coded(x: Column) -> Column:
        at = lambda e: F.array_position(every, e) + 31
        hexed = F.transform(x, lambda e: F.lpad(F.hex(at(e) + F.when(at(e) >= 0xD800, 0x800).otherwise(0)), 8, "0"))
        return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-32")

    return F.levenshtein(coded(a), coded(b))


def _codes(prints: DataFrame) -> Column:
    """A fingerprint's elements as 64-bit hashes, in order.

    Where the table does not have them they are cut out of its text: in a string a quote has a backslash before it, so what parts two elements stands nowhere else.
    """
    if "codes" in prints.columns:
        return F.col("codes")
    inner = F.col("fp_json").substr(F.lit(4), F.length("fp_json") - 6)
    return F.transform(F.split(inner, r'"\],\["'), lambda x: F.xxhash64(x))


def _cells(left: DataFrame, right: DataFrame, key: str, block_rows: tuple[int, int]) -> DataFrame:
    """Every row of both sides, ``side`` 0 or 1, in each ``cell`` of blocks in which it meets rows of the other.

    Blocks have as many rows as ``block_rows`` says, those of the left fewer where there would be less than ``_CELLS`` cells.
    """
    n, b = max(1, left.count()), -(-max(1, right.count()) // block_rows[1])
    a = -(-n // max(64, min(-(-n * b // _CELLS), block_rows[0])))
    block = lambda m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one = left.withColumn("_o", each(b)).withColumn("cell", block(a) * b + F.col("_o")).withColumn("side", F.lit(0))
    two = right.withColumn("_o", each(a)).withColumn("cell", F.col("_o") * b + block(b)).withColumn("side", F.lit(1))
    # a number of partitions that is given is not coalesced: the rows are few, the work on them is not
    return one.unionByName(two, allowMissingColumns=True).drop("_o").repartition(max(a * b, 12), "cell")


def _own_cells(rows: DataFrame, key: str) -> DataFrame:
    """Every row in each ``cell`` in which its block meets another, or itself; every two blocks meet once, and a cell is a partition of its own.

    ``side`` is 0 and 1 for the rows of two blocks, 2 for those of one.
    """
    n = max(1, rows.count())
    m = max(-(-n // _OWN_ROWS), min(_OWN_BLOCKS, -(-n // 64)))
    block, other = F.pmod(F.xxhash64(key), F.lit(m)).cast("int"), F.col("_o")
    each = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("_b", block)
    hi, lo = F.greatest("_b", other), F.least("_b", other)
    side = F.when(F.col("_b") == other, 2).when(F.col("_b") == lo, 0).otherwise(1)
    each = each.withColumn("side", side).withColumn("cell", (hi * (hi + 1) / 2).cast("int") + lo).drop("_o", "_b")
    # by the number itself: hashes of so few cells put several into one task and none into others
    return each.repartitionById(m * (m + 1) // 2, F.col("cell"))


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    t = t.combine_chunks()
    return tuple(t.filter(pc.equal(t["side"], i)).combine_chunks() for i in (0, 1))


def pair_scores(prints: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard, distance, similarity) for different fingerprints that share an element.

    Without ``past`` every pair has ``a < b``; with it, ``a`` is of ``prints``
    and ``b`` of ``past``.  Only distinct fingerprints are compared, in cells of
    blocks; those that share none have similarity 0 and are left out.
    """
    kinds = "a string, b string, jaccard double, distance int, similarity double"
    names = ["a", "b", "jaccard", "distance", "similarity"]
    distinct = lambda df: df.select("fp_hash", _codes(df).alias("codes")).dropDuplicates(["fp_hash"])
    one = lambda t, c: t[c].chunk(0)
    left = written(distinct(prints), "coded")
    if past is None:

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = list(batches)
            cell = pa.Table.from_batches(every).combine_chunks() if every else None
            if cell is None or not len(cell):
                return
            alone = cell["side"][0].as_py() == 2
            x, y = (cell, cell) if alone else _sides(cell)
            if len(x) and len(y):
                for r in sequences.all_scores(one(x, "fp_hash"), one(x, "codes"), one(y, "fp_hash"), one(y, "codes"), alone, True):
                    yield pa.RecordBatch.from_arrays(r, names)

        return _own_cells(left, "fp_hash").mapInArrow(own, kinds)
    right = written(distinct(past), "coded")

    def score(cell: pa.Table) -> pa.Table:
        x, y = _sides(cell)
        empty = pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64())], names)
        if not len(x) or not len(y):
            return empty
        got = sequences.all_scores(one(x, "fp_hash"), one(x, "codes"), one(y, "fp_hash"), one(y, "codes"), False)
        return pa.concat_tables([empty, *(pa.table(r, names) for r in got)])

    return _cells(left, right, "fp_hash", _SCORE_ROWS).groupBy("cell").applyInArrow(score, kinds)


def _matches(prints: DataFrame, past: DataFrame, k: int) -> DataFrame:
    """The candidates of ``similar_incidents``: for each row of prints at least those of its k best matches."""
    time = F.col("sig_ts").cast("timestamp_ntz")
    q = written(prints.select("incident_id", "fp_hash", "trigger_node", time.alias("sig_ts"), _codes(prints).alias("codes")), "asks")
    p = past.select("incident_id", "fp_hash", "trigger_node", time.alias("sig_ts"), _codes(past).alias("codes"))
    p = written(p.join(families(past).groupBy("incident_id").agg(F.min("family").alias("family")), "incident_id"), "past")

    def search(cell: pa.Table) -> pa.Table:
        x, y = _sides(cell)
        rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(x) and len(y):
            side = lambda t: {n: t[c].to_numpy() for n, c in (("fp", "fp_hash"), ("trigger", "trigger_node"), ("id", "incident_id"), ("family", "family"))} | {"ts": t["sig_ts"].cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(), "codes": t["codes"].chunk(0)}
            for got in sequences.best_matches(side(x), side(y), k, _SAME_SERVICE):
                for into, part in zip(rows, got, strict=True):
                    into.append(part)
        i, j, s = (np.concatenate(r) for r in rows)
        ask, match = x.take(pa.array(i)), y.take(pa.array(j))
        same = pc.equal(ask["trigger_node"], match["trigger_node"])
        return pa.table([ask["incident_id"], match["incident_id"], match["trigger_node"], match["family"], same, pa.array(s), match["sig_ts"]], ["incident_id", "match_id", "match_node", "family", "same_service", "similarity", "match_ts"])

    cells = _cells(q, p, "incident_id", _MATCH_ROWS)
    return cells.groupBy("cell").applyInArrow(search, "incident_id string, match_id string, match_node string, family string, same_service boolean, similarity double, match_ts timestamp_ntz")


def _scored_matches(prints: DataFrame, past: DataFrame, scores: DataFrame) -> DataFrame:
    """Every earlier incident that ``scores`` holds against one of prints."""
    own = prints.select(F.col("fp_hash").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity"))
    both = scores.select("a", "b", "similarity").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).dropDuplicates(["a", "b"])
    q = prints.select("incident_id", F.col("fp_hash").alias("a"), "trigger_node", "sig_ts").join(both.unionByName(own), "a")
    p = past.select(F.col("incident_id").alias("match_id"), F.col("fp_hash").alias("b"), F.col("trigger_node").alias("_tn"), F.col("sig_ts").alias("_ts"))
    p = p.join(families(past).groupBy(F.col("incident_id").alias("match_id")).agg(F.min("family").alias("family")), "match_id")
    m = q.join(p, "b").filter((F.col("_ts") < F.col("sig_ts")) & (F.col("match_id") != F.col("incident_id")))
    same = F.col("_tn") == F.col("trigger_node")
    return m.select("incident_id", "match_id", F.col("_tn").alias("match_node"), "family", same.alias("same_service"), F.when(same, F.least(F.lit(1.0), F.col("similarity") + _SAME_SERVICE)).otherwise(F.col("similarity")).alias("similarity"), F.col("_ts").alias("match_ts"))


def similar_incidents(prints: DataFrame, past: DataFrame, scores: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(incident_id, rank, match_id, similarity, same_service, match_ts, family): the k most similar earlier incidents.

    ``past`` has the fingerprints that incidents were stored with.  Same trigger
    service adds 0.15.  One match for each (trigger, family) comes first, then
    the list is filled up by rank.  Similarities are taken from ``scores``, which
    then covers both, each pair in one order or both; without it only those are
    computed that can enter a list.
    """
    m = _matches(prints, past, k) if scores is None else _scored_matches(prints, past, scores)
    order = [F.desc("similarity"), F.desc("same_service"), F.desc("match_ts"), F.asc("match_id")]
    m = m.withColumn("_r", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order)))
    m = m.withColumn("_f", F.row_number().over(Window.partitionBy("incident_id", "match_node", "family").orderBy("_r")))
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy((F.col("_f") > 1).cast("int"), "_r"))).filter(F.col("rank") <= k)
    return m.select("incident_id", "rank", "match_id", "similarity", "same_service", "match_ts", "family")


def abstentions(prints: DataFrame, matches: DataFrame) -> DataFrame:
    """(incident_id, top, second, abstain)."""
    tops = matches.groupBy("incident_id").agg(F.max(F.when(F.col("rank") == 1, F.bround("similarity", 3))).alias("top"), F.max(F.when(F.col("rank") == 2, F.bround("similarity", 3))).alias("second"))
    j = prints.select("incident_id", "n_elements").join(tops, "incident_id", "left")
    return j.select("incident_id", "n_elements", "top", "second", X.abstains(F.col("n_elements"), F.col("top"), F.col("second")).alias("abstain"))


def families(prints: DataFrame) -> DataFrame:
    """(incident_id, family, similarity, incident_count): online leader clustering within each trigger service, in arrival order.

    Same hash joins its family; else the first leader within one edit whose
    share of equal elements is 0.8 or more; else a new family.  What a hash
    joins is settled when it first arrives, so only distinct hashes count; pairs one
    edit apart are found by hashes of what one deletion leaves, and of a trigger
    only the fingerprints that are in such a pair come together, without their
    elements.
    """
    first = prints.groupBy("trigger_node", "fp_hash").agg(F.min(F.struct(F.col("sig_ts").cast("string").alias("sig_ts"), "incident_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.select("trigger_node", "fp_hash", "n", "first.sig_ts", "first.incident_id")
    own = prints.select("trigger_node", "fp_hash", F.col("sig_ts").cast("string").alias("sig_ts"), "incident_id", _codes(prints).alias("codes"))
    seen = first.join(own, ["trigger_node", "fp_hash", "sig_ts", "incident_id"])
    seen = written(seen.withColumn("id", F.xxhash64("trigger_node", "fp_hash")), "seen")
    met = _neighbours(seen)
    rows = seen.select("trigger_node", "fp_hash", "n", "sig_ts", "incident_id", "id", F.size("codes").alias("length")).join(met, "id", "left")
    alone = rows.filter("near is null").select("trigger_node", "fp_hash", "n", F.md5(F.concat("trigger_node", F.lit(":"), "fp_hash").cast("binary")).alias("family"), F.lit(1.0).alias("similarity"))
    folded = rows.filter("near is not null").groupBy("trigger_node").applyInPandas(_fold_families, "trigger_node string, fp_hash string, n bigint, family string, similarity double")
    got = written(alone.unionByName(folded), "families")
    counts = got.groupBy("family").agg(F.sum("n").alias("incident_count"))
    return prints.select("trigger_node", "fp_hash", "incident_id").join(got.drop("n"), ["trigger_node", "fp_hash"]).select("family", "incident_id", "similarity").join(counts, "family")


def _neighbours(seen: DataFrame) -> DataFrame:
    """(id, near): the fingerprints of the same trigger that are one edit away, for those that have some.

    One edit leaves one half of a fingerprint as it is; keys of all deletions
    are made only for those that share a half with another.
    """
    salted = seen.select("id", F.xxhash64("trigger_node").alias("salt"), "codes")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key = sequences.half_keys(b.column(2), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(key)], ["id", "key"])

    half = written(salted.mapInArrow(halves, "id bigint, key bigint"), "halves")
    shared = half.join(half.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "key", "left_semi").select("id").distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                row, pos, key = sequences.one_edit_keys(part.column(2), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(key)], ["id", "pos", "key"])

    made = salted.join(shared, "id", "left_semi").mapInArrow(keys, "id bigint, pos int, key bigint")
    met = made.groupBy("key").agg(F.collect_list(F.struct("id", "pos")).alias("m")).filter("size(m) > 1")
    pairs = met.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).filter("x.id <> y.id AND (x.pos = y.pos OR x.pos = -1 OR y.pos = -1)")
    return pairs.groupBy(F.col("x.id").alias("id")).agg(F.collect_set("y.id").alias("near"))


def family_id(trigger: str, fp_hash: str) -> str:
    """A family's id, from its trigger and its leader's hash."""
    import hashlib

    return hashlib.md5(f"{trigger}:{fp_hash}".encode()).hexdigest()


class Leaders:
    """The families of one trigger: leaders in order, found by the sequences that one deletion makes of theirs."""

    def __init__(self, state: list | None = None):
        self.rows: list = []
        self._hash: dict[str, int] = {}
        self._near: dict[tuple, list[int]] = {}
        for family, fp_hash, elements in state or []:
            self._add(family, fp_hash, elements)

    @staticmethod
    def _keys(e: tuple) -> set[tuple]:
        return {e, *(e[:i] + e[i + 1 :] for i in range(len(e)))}

    def _add(self, family: str, fp_hash: str, elements: list) -> None:
        at = len(self.rows)
        self.rows.append([family, fp_hash, elements])
        self._hash[fp_hash] = at
        for k in self._keys(tuple(map(tuple, elements))):
            self._near.setdefault(k, []).append(at)

    def assign(self, trigger: str, fp_hash: str, elements: list) -> tuple[str, float]:
        if fp_hash in self._hash:
            return self.rows[self._hash[fp_hash]][0], 1.0
        mine = tuple(map(tuple, elements))
        for at in sorted({i for k in self._keys(mine) for i in self._near.get(k, ())}):
            other = tuple(map(tuple, self.rows[at][2]))
            longest = max(len(mine), len(other))
            if _one_edit(mine, other) and 1 - 1 / longest >= 0.8:
                return self.rows[at][0], 1 - 1 / longest
        family = family_id(trigger, fp_hash)
        self._add(family, fp_hash, elements)
        return family, 1.0


def _one_edit(a: tuple, b: tuple) -> bool:
    """Whether one insertion, deletion or substitution turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return (len(a) == len(b) and a[i + 1 :] == b[i + 1 :]) or (len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


def _fold_families(pdf):
    pdf = pdf.sort_values(["sig_ts", "incident_id"])
    leaders: dict[int, tuple[int, str, int]] = {}
    found = []
    for trigger, fp_hash, key, length, near in zip(pdf["trigger_node"], pdf["fp_hash"], pdf["id"], pdf["length"], pdf["near"], strict=True):
        met = [leaders[i] for i in near if i in leaders and 1 - 1 / max(length, leaders[i][2]) >= 0.8]
        if met:
            _, family, longest = min(met)
            found.append((family, 1 - 1 / max(length, longest)))
        else:
            family = family_id(trigger, fp_hash)
            leaders[key] = (len(leaders), family, length)
            found.append((family, 1.0))
    return pdf[["trigger_node", "fp_hash", "n"]].assign(family=[f for f, _ in found], similarity=[s for _, s in found])


def family_members(families: DataFrame, family: str, without: str | None = None) -> DataFrame:
    """The incidents of a family, but for one."""
    out = families.filter(F.col("family") == family)
    return out.filter(F.col("incident_id") != without) if without else out


def representatives(prints: DataFrame, families: DataFrame) -> DataFrame:
    """(family, trigger_node, incident_id, fp_hash): the incident each family began with."""
    j = prints.join(families.select("incident_id", "family"), "incident_id")
    return j.groupBy("family", "trigger_node").agg(F.min(F.struct("sig_ts", "incident_id", "fp_hash")).alias("f")).select("family", "trigger_node", "f.incident_id", "f.fp_hash")


def candidate_patterns(prints: DataFrame, families: DataFrame, confidence: DataFrame, trigger: str, limit: int = 10) -> DataFrame:
    """(incident_id, trigger_node, sig_ts, confidence): patterns of one trigger, newest first, or of all services where it has none."""
    j = prints.join(families.select("incident_id", "family"), "incident_id", "left").join(confidence.select("family", F.col("reinforced").alias("_c")), "family", "left")
    j = j.select("incident_id", "trigger_node", "sig_ts", F.coalesce("_c", F.lit(0.5)).alias("confidence"))
    own = j.filter(F.col("trigger_node") == trigger)
    rest = j.withColumn("_own", (F.col("trigger_node") == trigger).cast("int"))
    top = rest.agg(F.max("_own").alias("_any"))
    return (own if top.first()["_any"] else j).orderBy(F.desc("sig_ts"), "incident_id").limit(limit)
