"""N-gram Jaccard join by set relations, exact at 80 percent.

A document's set holds the 64-bit hashes of its distinct five-word shingles;
equal sets are one class, so copies cost one row each.  Sets are put in one
global order, rare shingles first, by a counting sketch of fixed size; two sets
that reach the threshold share a shingle within their prefixes, so the index
lists of prefix shingles hold every link.

Set relations do the skipping:

* *Index level.*  A set of ``n`` shingles whose first common shingle with
  another stands at position ``pos`` can share ``n - pos`` with it at most, so
  every posting carries its reach, the largest partner that its position still
  allows.  Postings without a partner in reach leave their list, lists with the
  same members are read once, and a list is cut into blocks by set size: a
  posting meets only the blocks that its reach and theirs allow, and no block
  that lies in its own component.
* *Answer level.*  First every set is compared with one hub, the best of all
  its lists; a group of thousands of near copies thus takes one comparison for
  each member.  The comparison leaves the differences from the hub, and any two
  sets that were compared with the same hub are answered from those alone:
  ``|y & z| = |x| - |x-y| - |x-z| + |(x-y) & (x-z)| + |(y-x) & (z-x)|``.

What is still open then is finished in rounds.  A round takes a number of
members of every open list as hubs, compares them with all members of other
components, and takes them out; the number grows from round to round until all
lists are empty.  New links join the components of the round before, and a list
within one component is closed.  Pairs within a component are never compared.

Components spread by alternating minimum steps over the links; nothing but the
sketch and two bit tables of fixed size, and a few counts, comes to the driver.
A bit table only spares rows: where it is too full, more pass and are left out
by the exact joins that follow.

Defined cases: null, empty and word-less texts have an empty set and are linked
with nothing; fewer words than five are one shingle; very long texts are hashed
in slices; rows that share a doc_id are one node; rows with null doc_id take
part in the join and get the smallest doc_id of their component, or null if
none of it has one; repeated rows are kept as rows; an empty table gives no
rows; extra columns are ignored, whatever their names, and pass through
``keep_one``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat
from .store import Scratch, table

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 20
BLOCK_BITS = 14
ID_BITS = 23
TOKEN_BITS = 26
#: hubs of an open list in the first round that finishes lists, and the factor by which they grow
HUBS, GROWTH = 128, 16
#: each class is compared with one hub again while that links this share of them or more, and leaves more than another of the postings open
PRODUCTIVE, MANY = 0.1, 0.25
#: a block of an index list holds sets whose sizes differ by less than this factor
BAND = 1.05
PIECE = 256
IS_WORD = flat.word_bytes(flat.SPACE)
LOWER = flat.lower_ascii()


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of every text."""
    for w in flat.words(column, IS_WORD, LOWER):
        g = flat.grams(w.hashes, SHINGLE, 0xA5)
        at = w.offsets.tolist()
        for lo, hi in zip(at, at[1:], strict=False):
            if hi - lo >= SHINGLE:
                yield np.unique(g[lo : hi - SHINGLE + 1])
            elif hi > lo:
                yield flat.grams(w.hashes[lo:hi], hi - lo, 0xA5 + hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most PIECE rows, which bound what a Python worker holds besides its input."""
    for b in batches:
        for lo in range(0, b.num_rows, PIECE):
            yield b.slice(lo, PIECE)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _first_pass(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, n, key) by document, and rows (block, counts): how many sets hold a shingle of a slot."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n", "key", "block", "counts"]
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in _pieces(batches):
            sizes, keys = [], []
            for s in shingle_sets(b.column(2)):
                sizes.append(len(s))
                keys.append(_key(s) if len(s) else None)
                np.add.at(counts, _slots(s), 1)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        parts = counts.reshape(-1, 1 << BLOCK_BITS)
        k = len(parts)
        packed = [zlib.compress(x.tobytes(), 1) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(packed, pa.binary())], names)

    return docs.select("doc_id", _text_hash(F.col("text")).alias("h"), "text").mapInArrow(scan, "doc_id bigint, h bigint, n int, key binary, block int, counts binary")


def _sketch(first: DataFrame) -> bytes:
    """The merged sketch: 2**SKETCH_BITS saturating 32-bit counts, 4 MB."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BLOCK_BITS, np.uint64)
        for b in batches:
            for x in b.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(x), np.uint32)
        total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    rows = first.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(merge, "block int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["counts"], np.uint32)
    return out.tobytes()


def prefix_length(n: int) -> int:
    """Shingles of a set of n of which a linked set must hold at least one."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's prefix in the global order, rarest shingles first."""
    return s[np.argsort(counts[_slots(s)], kind="stable")[: prefix_length(len(s))]]


def _shared_bits(docs: DataFrame, sketch: bytes) -> bytes:
    """Bit table of the prefix shingles that two documents or more have.

    Only the shingles themselves are shuffled.  The table has 2**TOKEN_BITS
    bits whatever the input; a fuller one lets more postings through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint32)
        for b in _pieces(batches):
            held = [_prefix(s, counts) for s in shingle_sets(b.column(0)) if len(s)]
            toks = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
            for lo in range(0, len(toks), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(toks[lo : lo + (1 << 17)])], ["tok"])

    toks = docs.select("text").mapInArrow(scan, "tok bigint").groupBy("tok").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return _bit_table(toks, F.col("tok"), TOKEN_BITS)


def _bit_table(rows: DataFrame, key: Column, size: int) -> bytes:
    """2**size bits, one set for each key; at most 2**size / 64 rows come to the driver."""
    slot = F.pmod(key, F.lit(1 << size))
    words = rows.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.tobytes()


def _lookup(table_: bytes, slot: np.ndarray) -> np.ndarray:
    byte = np.frombuffer(table_, np.uint8)[slot >> 3]
    return (byte >> (slot & 7).astype(np.uint8)) & 1 == 1


def _postings(docs: DataFrame, sketch: bytes, bits: bytes) -> DataFrame:
    """(tok, cls, n, pos): prefix shingles that may be shared, one document for each set; ``cls`` is the set's key."""
    shared = docs.sparkSession.sparkContext.broadcast((sketch, bits))
    kind = pa.list_(pa.struct([("tok", pa.int64()), ("pos", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, table_ = np.frombuffer(shared.value[0], np.uint32), shared.value[1]
        for b in _pieces(batches):
            sizes, keys, ends, toks, poss = [], [], [0], [], []
            for s in shingle_sets(b.column(0)):
                tok = _prefix(s, counts)
                pos = np.flatnonzero(_lookup(table_, (tok & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64)))
                if len(pos):
                    sizes.append(len(s))
                    keys.append(_key(s))
                    ends.append(ends[-1] + len(pos))
                    toks.append(tok[pos].view(np.int64))
                    poss.append(pos.astype(np.int32))
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            inner = pa.StructArray.from_arrays([cat(toks, np.int64), cat(poss, np.int32)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists], ["cls", "n", "posts"])

    rows = docs.select("text").mapInArrow(scan, "cls binary, n int, posts array<struct<tok:bigint,pos:int>>")
    classes = rows.groupBy("cls").agg(F.first("n").alias("n"), F.first("posts").alias("posts"))
    return classes.select("cls", "n", F.explode("posts").alias("p")).select("p.tok", "cls", "n", "p.pos")


def _reach(n: str, pos: str) -> Column:
    """Size of the largest set that can be linked if this position holds the first common shingle."""
    return F.expr(f"cast(floor(({100 + PERCENT} * cast({n} - {pos} as bigint)) / {PERCENT}) - {n} as int)")


def _meets(x: str, y: str) -> Column:
    """Postings of one list that each other's reach allows."""
    return F.expr(f"{x}n <= {y}r AND {y}n <= {x}r")


def _open(lists: DataFrame) -> DataFrame:
    """The postings with a partner in reach, of the lists that more than one component shares."""
    ends = lists.groupBy("tok").agg(F.min("n").alias("_n"), F.max("r").alias("_r"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi")
    near = lists.join(ends.select("tok", "_n", "_r"), "tok").filter("r >= _n AND n <= _r")
    return near.select("tok", "cls", "n", "r", "comp")


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """Of lists with the same members, the first in the global order, which holds their first common shingle."""
    h = F.xxhash64("cls")
    marks = lists.groupBy("tok").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s"), F.bit_xor(F.xxhash64(h)).alias("y"), F.min(F.struct("cls", F.negative("r").alias("at"))).alias("at"))
    once = marks.filter("m > 1").groupBy("m", "x", "s", "y").agg(F.min(F.struct("at.at", "tok")).alias("first")).select("first.tok")
    return lists.join(once, "tok")


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes ``ids``, found by a bit table of their smallest doc_ids.

    Where two ids share a bit, a set comes along that no pair will ask for; an
    exact join here would shuffle all sets to leave those few out.  Rows
    without doc_id are all looked at.
    """
    low = classes.join(ids, classes["key"] == ids["cls"], "left_semi").select("low")
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(low.filter("low is not null"), F.xxhash64("low"), ID_BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            slot = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
            pick = pa.array(np.flatnonzero((slot < 0) | _lookup(shared.value, np.maximum(slot, 0))))
            keys, values, ends = [], [], [0]
            for s in shingle_sets(b.column(0).take(pick)):
                keys.append(_key(s))
                values.append(s.view(np.int64))
                ends.append(ends[-1] + len(s))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], ["cls", "shingles"])

    slot = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)))
    rows = docs.select("text", slot.cast("bigint").alias("slot")).mapInArrow(scan, "cls binary, shingles array<bigint>")
    # rows that repeat, or share an id
    return rows.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _reaches(overlap: str, a_n: str, b_n: str) -> str:
    """SQL: an overlap that makes a link."""
    return f"{100 + PERCENT} * cast({overlap} as bigint) >= {PERCENT} * cast({a_n} + {b_n} as bigint)"


def _asked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that the pairs name, and few others, without a shuffle of the sets.

    The broadcast side is a bit table of at most 2**ID_BITS / 64 rows.
    """
    slot = F.pmod(F.xxhash64("cls"), F.lit(1 << ID_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).select(slot.alias("slot"))
    bits = ids.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    rows = sets.withColumn("slot", slot).withColumn("word", F.floor(F.col("slot") / 64)).join(F.broadcast(bits), "word")
    return rows.filter("getbit(bits, cast(slot % 64 as int)) = 1").select("cls", "shingles")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with both sets, sa and sb; only sets that a pair names are shuffled."""
    sets = _asked(sets, pairs)
    left = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    return pairs.join(left, "b").join(right, "a")


def _hub_answers(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, ca, cb, o) of each set b and its hub a, with the differences ``more`` (b - a) and ``less`` (a - b) if the most is shared."""
    over = _compared(pairs, sets).withColumn("more", F.array_except("sb", "sa")).withColumn("o", F.col("nb") - F.size("more"))
    alike = F.col("o") * 2 >= F.col("na")
    return over.select("a", "b", "na", "nb", "ca", "cb", "o", F.when(alike, F.col("more")).alias("more"), F.when(alike, F.array_except("sa", "sb")).alias("less"))


def _derived(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs with their overlap ``o`` where both were compared with the same hub; null for the others."""
    side = lambda p, k: near.select(F.col("cls").alias(k), *[F.col(c).alias(f"{p}{c}") for c in ("hub", "nh", "more", "less")])
    both = pairs.join(side("a_", "a"), "a", "left").join(side("b_", "b"), "b", "left")
    o = F.expr("a_nh - size(a_less) - size(b_less) + size(array_intersect(a_less, b_less)) + size(array_intersect(a_more, b_more))")
    return both.select("a", "b", "na", "nb", "ca", "cb", F.when(F.col("a_hub") == F.col("b_hub"), o).alias("o"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, comp) for every node of the links (a, b): comp is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands the smallest
    of its neighbours to its larger ones, then every node hands it to its
    smaller ones.
    """
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        new = scratch.put(small, "edges")
        now = mark(new)
        scratch.drop(edges)
        edges = new
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct())


class _Join:
    """The state of the join over the rounds: open lists, labels of the linked classes, pairs that were compared."""

    def __init__(self, scratch: Scratch, live: DataFrame, sets: DataFrame):
        self.scratch, self.live, self.sets = scratch, live, sets
        self.labels: DataFrame | None = None
        self.known: list[DataFrame] = []
        self.near: DataFrame | None = None
        self.answers: list[DataFrame] = []

    def contract(self, links: DataFrame, live: DataFrame) -> int:
        """Joins the components that new links connect; ``live`` are the postings that are left. Returns how many are open."""
        put, drop = self.scratch.put, self.scratch.drop
        if links.isEmpty():
            live = put(_open(live), "lists")
            drop(self.live)
            self.live = live
            return live.count()
        moved = put(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), self.scratch), "moved")
        step = moved.select(F.col("cls").alias("comp"), F.col("comp").alias("_to"))
        if self.labels is None:
            labels = moved
        else:
            old = self.labels.join(step, "comp", "left").select("cls", F.coalesce("_to", "comp").alias("comp"))
            labels = old.unionByName(moved.join(self.labels, "cls", "left_anti"))
        labels = put(labels, "labels")
        live = live.join(step, "comp", "left").withColumn("comp", F.coalesce("_to", "comp")).select("tok", "cls", "n", "r", "comp")
        live = put(_open(live), "lists")
        drop(self.labels, self.live, moved)
        self.labels, self.live = labels, live
        return live.count()

    def probe(self) -> bool:
        """Compares every class with one hub of another component, the best of all its lists; returns whether to do so again."""
        rows = self.live.count()
        hubs = self.live.groupBy("tok").agg(F.max(F.struct("r", "cls", "n", "comp")).alias("hub"))
        cand = self.live.join(hubs, "tok").filter("cls <> hub.cls AND comp <> hub.comp AND n <= hub.r AND hub.n <= r")
        best = cand.groupBy("cls").agg(F.max("hub").alias("hub"), F.first("n").alias("nb"), F.first("comp").alias("cb"))
        pairs = best.select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"), F.col("hub.n").alias("na"), "nb", F.col("hub.comp").alias("ca"), "cb")
        pairs = self.scratch.put(pairs, "pairs")
        over = self.scratch.put(_hub_answers(pairs, self.sets), "answers")
        self.scratch.drop(pairs)
        self.answers.append(over)
        self.known.append(over.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        answers = over.filter("more is not null").select(F.col("b").alias("cls"), F.col("a").alias("hub"), F.col("na").alias("nh"), "o", "more", "less")
        # of the hubs a class was compared with, the one most alike; the first round's answers nearly always
        self.near = answers if self.near is None else self.near.unionByName(answers.join(self.near, "cls", "left_anti"))
        links = over.filter(_reaches("o", "na", "nb"))
        linked, of = links.count(), self.live.select("cls").distinct().count()
        left = self.contract(links, self.live)
        return linked >= PRODUCTIVE * of and left > MANY * rows

    def finish(self, hubs: int) -> bool:
        """Compares some hubs of every open list with all that is in their reach and takes them out; returns whether lists are open still."""
        sizes = self.live.groupBy("tok").agg(F.count(F.lit(1)).alias("m"))
        chosen = F.pmod(F.xxhash64("cls", "tok"), F.ceil(F.col("m") / hubs)) == 0
        live = self.live.join(sizes, "tok").select("tok", "cls", "n", "r", "comp", ((F.col("m") <= 2 * hubs) | chosen).alias("is_hub"))
        live = live.withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
        live = self.scratch.put(live, "ranked")
        blocks = live.groupBy("tok", "band").agg(F.min("n").alias("n_lo"), F.max("r").alias("r_hi"), F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"))
        x = live.filter("is_hub").select("tok", F.col("cls").alias("x"), F.col("n").alias("xn"), F.col("r").alias("xr"), F.col("comp").alias("xc"))
        y = live.select("tok", "band", F.col("cls").alias("y"), F.col("n").alias("yn"), F.col("r").alias("yr"), F.col("comp").alias("yc"), F.col("is_hub").alias("yh"))
        skip = (F.col("n_lo") <= F.col("xr")) & (F.col("r_hi") >= F.col("xn")) & ((F.col("c_lo") != F.col("xc")) | (F.col("c_hi") != F.col("xc")))
        asked = x.alias("x_").join(blocks.alias("b_"), (F.col("x_.tok") == F.col("b_.tok")) & skip).select("x_.tok", "band", "x", "xn", "xr", "xc")
        on = (F.col("p.tok") == F.col("q.tok")) & (F.col("p.band") == F.col("q.band")) & _meets("x", "y") & (F.col("xc") != F.col("yc")) & (~F.col("yh") | (F.col("x") < F.col("y")))
        cand = asked.alias("p").join(y.alias("q"), on)
        low, high = F.when(F.col("x") < F.col("y"), F.struct("x", "xn", "xc")), F.when(F.col("x") >= F.col("y"), F.struct("x", "xn", "xc"))
        other = F.struct(F.col("y").alias("x"), F.col("yn").alias("xn"), F.col("yc").alias("xc"))
        pairs = cand.select(F.coalesce(low, other).alias("a"), F.coalesce(high, other).alias("b")).distinct()
        pairs = pairs.select(F.col("a.x").alias("a"), F.col("b.x").alias("b"), F.col("a.xn").alias("na"), F.col("b.xn").alias("nb"), F.col("a.xc").alias("ca"), F.col("b.xc").alias("cb"))
        for k in self.known:
            pairs = pairs.join(k, ["a", "b"], "left_anti")
        pairs = self.scratch.put(pairs, "pairs")
        answers = self.scratch.put(_derived(pairs, self.near), "derived")
        asked = answers.filter("o is null").drop("o")
        whole = _compared(asked, self.sets).withColumn("o", F.size(F.array_intersect("sa", "sb")))
        over = self.scratch.put(answers.filter("o is not null").unionByName(whole.select("a", "b", "na", "nb", "ca", "cb", "o")), "answers")
        self.scratch.drop(pairs, answers)
        self.answers.append(over)
        self.known.append(over.select("a", "b"))
        left = self.contract(over.filter(_reaches("o", "na", "nb")), live.filter("NOT is_hub"))
        self.scratch.drop(live)
        return left > 0


def class_links(docs: DataFrame, classes: DataFrame, sketch: bytes, scratch: Scratch) -> DataFrame | None:
    """(cls, comp) of the classes with links; None if there are no links."""
    posts = scratch.put(_postings(docs, sketch, _shared_bits(docs, sketch)), "postings")
    lists = scratch.put(_open(posts.select("tok", "cls", "n", _reach("n", "pos").alias("r"), F.col("cls").alias("comp"))), "lists")
    scratch.drop(posts)
    live = scratch.put(_distinct_lists(lists), "lists")
    scratch.drop(lists)
    if live.isEmpty():
        return None
    state = _Join(scratch, live, scratch.put(_sets(docs, classes, live.select("cls").distinct()), "sets"))
    while state.probe():
        pass
    hubs = HUBS
    while state.finish(hubs):
        hubs *= GROWTH
    scratch.drop(state.sets, state.live, *state.answers)
    return state.labels


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, key) of the documents, with ``h`` a hash of the text and null keys for empty sets,
    and classes (key, low, comp, one): smallest doc_id, component and the component's first row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "jaccard")
    first = scratch.put(_first_pass(docs), "sizes")
    rows = first.filter("block is null").select("doc_id", "h", "n", "key")
    head = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h"))
    classes = scratch.put(rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"), head.alias("one")), "classes")
    comps = class_links(docs, classes, _sketch(first), scratch)
    if comps is None:
        return rows, classes.withColumn("comp", F.col("key"))
    return rows, classes.join(comps.withColumnRenamed("cls", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    rows, classes = _classed(docs)
    lows = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = rows.filter("key is not null").join(classes.join(lows, "comp").select("key", "component_id"), "key")
    empty = rows.filter("key is null").withColumn("component_id", F.col("doc_id"))
    return named.unionByName(empty, allowMissingColumns=True).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id; rows with an empty set stay.

    Rows without doc_id come last in the choice.  Of rows that repeat the same
    doc_id and text one stays; rows that share an id with other texts are
    judged by their own.
    """
    rows, classes = _classed(docs)
    ones = classes.groupBy("comp").agg(F.min("one").alias("one"))
    chosen = classes.join(ones, "comp").select("key", ones["one"]["doc_id"].alias("one_id"), ones["one"]["h"].alias("one_h"))
    judged = rows.filter("key is not null").join(chosen, "key").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("h") == F.col("one_h")))
    fate = judged.groupBy("doc_id", "h").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("times")).filter("NOT stays OR times > 1")
    fate = Scratch(docs.sparkSession, "jaccard").put(fate, "fate")
    mine = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("bigint").alias("doc_id"), _text_hash(docs["text"]).alias("h"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["h"] == y["h"])
    kept = mine.join(fate, same(mine, fate), "left_anti").select("row")
    again = fate.filter("stays")
    if not again.isEmpty():
        kept = kept.unionByName(mine.join(again, same(mine, again), "left_semi").groupBy("doc_id", "h").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
