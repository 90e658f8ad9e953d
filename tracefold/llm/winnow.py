"""Benchmark decontamination by winnowing.

Every text becomes a sequence of word hashes; of each window of ``WINDOW``
consecutive words the smallest ``GRAM``-gram hash is kept as its fingerprint.
A shared span of WINDOW words or more has a whole window in common and hence
that window's fingerprint, so none is missed.  Document fingerprints are
looked up in a bit table of the benchmark's fingerprints, the survivors are
joined with the benchmark's (fingerprint, window) pairs, where the 128-bit
digest of the window's words settles the hit, and hits are extended to all the
words that their windows cover.  Benchmark items shorter than a window are one
window of their own length, fingerprinted by their whole gram.

The bit table has ``2 ** BITS`` bits whatever the benchmark's size (a fuller
table passes more false candidates to the join, never fewer true ones).
Window matches join one row per distinct benchmark window, so a passage that
many items or documents share makes no pairs; items of a window travel as one
interned list.  Documents keep one row each from the scan on.

Defined cases: null and empty texts have no words and no hits; null items are
never found; repeated rows of either table are treated alike (a repeated item
counts once); an empty benchmark leaves every document clean; other columns
are ignored by the report and pass through the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits as bits_
from . import flat
from .store import materialize, table

WINDOW = 10
GRAM = 5
BITS = 23
IS_WORD = flat.word_bytes(flat.NON_ALNUM)
LOWER = flat.lower_ascii()
_FOUND = "array<struct<at:int,len:int,fp:bigint,win:string>>"


def _fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of every window of n words: smallest hash of its grams."""
    k = min(GRAM, n) if n >= WINDOW else n
    g = flat.grams(h, k, 0x5BD1E995 + n if n < WINDOW else 0x5BD1E995)
    span = n - k + 1
    if len(g) < span:
        return np.zeros(0, np.uint64)
    done = 1
    while done < span:  # minimum over runs of doubling length
        step = min(done, span - done)
        g = np.minimum(g[:-step], g[step:])
        done += step
    return g


def _digest(data: np.ndarray, w: flat.Words, i: int, n: int) -> str:
    parts = [LOWER[data[w.starts[j] : w.ends[j]]].tobytes() for j in range(i, i + n)]
    return hashlib.blake2b(b" ".join(parts), digest_size=16).hexdigest()


def _scan(column: pa.Array, lengths: list[int], hit) -> tuple[list[int], list[list[dict]]]:
    """Word counts, and the windows that pass ``hit`` (a mask over fingerprints), by text."""
    counts: list[int] = []
    found: list[list[dict]] = []
    data = flat.string_buffer(column)[1]
    for w in flat.words(column, IS_WORD, LOWER):
        sizes = np.diff(w.offsets)
        counts += sizes.tolist()
        mine: list[list[dict]] = [[] for _ in sizes]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for n in lengths:
            fp = _fingerprints(w.hashes, n)
            if not len(fp):
                continue
            ok = np.flatnonzero(hit(fp))
            ok = ok[owner[ok] == owner[ok + n - 1]]
            for i in ok.tolist():
                d = int(owner[i])
                mine[d].append({"at": i - int(w.offsets[d]), "len": n, "fp": int(fp[i].view(np.int64)), "win": _digest(data, w, i, n)})
        found += mine
    return counts, found


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(fp, win, items): each distinct window of the benchmark with the sorted ids of its items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, _ = _scan(b.column(1), [], None)
            ids, lens, fps, wins = [], [], [], []
            for n in {min(c, WINDOW) for c in counts} - {0}:
                rows = [i for i, c in enumerate(counts) if min(c, WINDOW) == n]
                _, found = _scan(b.column(1).take(pa.array(rows)), [n], lambda fp: np.ones(len(fp), bool))
                for i, f in zip(rows, found, strict=True):
                    ids += [b.column(0)[i].as_py()] * len(f)
                    lens += [x["len"] for x in f]
                    fps += [x["fp"] for x in f]
                    wins += [x["win"] for x in f]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lens, pa.int32()), pa.array(fps, pa.int64()), pa.array(wins, pa.string())], ["item_id", "len", "fp", "win"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(scan, "item_id string, len int, fp bigint, win string")
    return rows.groupBy("fp", "len", "win").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _bit_table(windows: DataFrame) -> tuple[bytes, list[int]]:
    """The bits of all fingerprints (at most 2**BITS / 64 rows come to the driver) and the window lengths."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(fp, {1 << BITS}) % 64 as int))")
    words = windows.groupBy(F.floor(F.pmod("fp", F.lit(1 << BITS)) / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for r in words:
        bits[r["word"]] = r["bits"]
    return bits.tobytes(), sorted(r["len"] for r in windows.select("len").distinct().collect())


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(text))


def document_windows(docs: DataFrame, bits: bytes, lengths: list[int]) -> DataFrame:
    """(rid, doc_id, h, n_words, found): candidate windows of every document; ``h`` is a hash of its text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        hit = lambda fp: bit[fp & np.uint64((1 << BITS) - 1)]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32()), ("fp", pa.int64()), ("win", pa.string())]))
        for b in batches:
            counts, found = _scan(b.column(3), lengths, hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(found, kind)], ["rid", "doc_id", "h", "n_words", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash(F.col("text")).alias("h"), "text")
    return rows.mapInArrow(scan, f"rid bigint, doc_id bigint, h bigint, n_words bigint, found {_FOUND}")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, h; one row per document."""
    windows = materialize(benchmark_windows(benchmark), "bench-windows")
    bits, lengths = _bit_table(windows)
    scanned = materialize(document_windows(docs, bits, lengths), "doc-windows")
    cand = scanned.filter(F.size("found") > 0).select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    hits = cand.join(windows, ["fp", "len", "win"]).select("rid", "at", "len", "items")
    # a hit word is counted once: sequence of its window's words, distinct within the document
    per_doc = hits.groupBy("rid").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    step = lambda acc, s: F.struct(
        (acc.n + F.greatest(s["at"] + s["len"] - F.greatest(s["at"], acc.to), F.lit(0))).cast("bigint").alias("n"), F.greatest(acc.to, s["at"] + s["len"]).alias("to")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    per_doc = per_doc.select("rid", "items", F.aggregate("spans", zero, step).n.alias("n_hit"))
    none = F.array().cast("array<string>")
    out = scanned.select("rid", "doc_id", "h", "n_words").join(per_doc, "rid", "left").withColumn("items", F.coalesce("items", none))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "items",
        "h",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark window; columns unchanged.

    Each row is judged by its own text, whatever its doc_id: only a hash of the
    texts that go is looked for, and only rows whose bit is set in a table of
    bounded size are shuffled for that.
    """
    bad = materialize(contamination(docs, benchmark).filter("contaminated").select(F.col("h").alias("_bad")).distinct(), "contaminated")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _text_hash(docs["text"]).alias("h"))
    rows = bits_.marked(rows, F.col("h"), bits_.table_of(bad, "_bad"))
    maybe = rows.filter("_maybe")
    kept = maybe.join(bad, maybe["h"] == bad["_bad"], "left_anti").select("row").unionByName(rows.filter("NOT _maybe").select("row"))
    return kept.select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "h")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
