"""Sequences of 64-bit codes in numpy: shared elements, edit distances, nearest matches, one-edit keys.

Codes are hashes of elements.  Nothing here is approximate: bounds only spare
distances that cannot change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: queries scored at a time, pairs whose distances run together, columns of a product, entries of a table of bits
CHUNK, PAIRS, COLUMNS, TABLE = 256, 16384, 2048, 1 << 22


class Sequences:
    """Sequences laid end to end, their elements numbered from 0."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids, self.offsets = ids, offsets
        self.n = np.diff(offsets)
        self.rows = np.repeat(np.arange(len(self.n)), self.n)

    def counts(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, element, count) of what each sequence holds."""
        key, c = np.unique(self.rows * size + self.ids, return_counts=True)
        return key // size, key % size, c


def numbered(*columns: pa.Array) -> tuple[list[Sequences], int]:
    """Lists of codes as sequences over one numbering, and its size."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    lengths = [np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in columns]
    every, ids = np.unique(np.concatenate(flat), return_inverse=True)
    cuts = np.cumsum([0, *(len(f) for f in flat)])
    return [Sequences(ids[a:b].astype(np.int64), o.astype(np.int64)) for a, b, o in zip(cuts[:-1], cuts[1:], lengths, strict=True)], len(every)


class Shared:
    """How many elements each of some sequences shares with each of others, repeats counted.

    The smaller of two counts is a sum over thresholds that both reach, so it is
    a product of two 0/1 matrices with a column for each element and threshold.
    """

    def __init__(self, a: Sequences, b: Sequences, size: int):
        self._a, self._b = a.counts(size), b.counts(size)
        most = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
        for m, (_, e, c) in zip(most, (self._a, self._b), strict=True):
            np.maximum.at(m, e, c)
        self._width = np.minimum(*most)
        self._start = np.concatenate([[0], np.cumsum(self._width)])
        self._n = len(b.n)
        self._right: list[np.ndarray] | None = None
        if self._n * int(self._start[-1]) <= TABLE * 16:
            self._right = [self._part(self._b, 0, self._n, lo) for lo in range(0, int(self._start[-1]), COLUMNS)]

    def _part(self, side: tuple, first: int, last: int, lo: int) -> np.ndarray:
        row, e, c = side
        i, j = np.searchsorted(row, [first, last])
        row, e, c = row[i:j] - first, e[i:j], np.minimum(c[i:j], self._width[e[i:j]])
        each = np.repeat(np.arange(len(c)), c)
        col = self._start[e[each]] + np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c) - lo
        hi = min(COLUMNS, int(self._start[-1]) - lo)
        ok = (col >= 0) & (col < hi)
        out = np.zeros((last - first, hi), np.float32)
        out[row[each[ok]], col[ok]] = 1
        return out

    def rows(self, first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, self._n), np.float32)
        for k, lo in enumerate(range(0, int(self._start[-1]), COLUMNS)):
            right = self._right[k] if self._right is not None else self._part(self._b, 0, self._n, lo)
            out += self._part(self._a, first, last, lo) @ right.T
        return out.astype(np.float64)


def distances(a: Sequences, b: Sequences, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edits between sequences ``left`` of a and ``right`` of b, pair by pair: bit-parallel, many pairs at a time."""
    out = np.zeros(len(left), np.int64)
    # by the query's words and the text's length, so that pairs of a batch end at about the same time
    order = np.lexsort((-b.n[right], (a.n[left] + 63) // 64))
    at = 0
    while at < len(order):
        take = order[at : at + PAIRS]
        # fewer pairs where the patterns' bits would fill too large a table
        while len(take) > 1:
            q = np.unique(left[take])
            words = int((a.n[q].max() + 63) // 64)
            if words * len(q) * (int(a.n[q].sum()) + 1) <= TABLE or words * len(q) * (len(np.unique(np.concatenate([a.ids[a.offsets[x] : a.offsets[x + 1]] for x in q]))) + 1) <= TABLE:
                break
            take = take[: len(take) // 2]
        out[take] = _batch(a, b, left[take], right[take])
        at += len(take)
    return out


def _batch(a: Sequences, b: Sequences, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    by_length = np.argsort(-b.n[right], kind="stable")
    left, right = left[by_length], right[by_length]
    q, mine = np.unique(left, return_inverse=True)
    m, n = a.n[left], b.n[right]
    own = [a.ids[a.offsets[x] : a.offsets[x + 1]] for x in q]
    known = np.unique(np.concatenate(own))
    size, words = len(known) + 1, max(1, int((m.max() + 63) // 64))
    bits = np.zeros((words, len(q) * size), np.uint64)  # the last element of each query's table is one that no query has
    for i, ids in enumerate(own):
        place = np.arange(len(ids))
        np.bitwise_or.at(bits, (place // 64, i * size + np.searchsorted(known, ids)), np.uint64(1) << (place % 64).astype(np.uint64))
    t, text = np.unique(right, return_inverse=True)
    codes = np.full((len(t), max(1, int(b.n[t].max()))), size - 1, np.int64)
    for i, x in enumerate(t):
        ids = b.ids[b.offsets[x] : b.offsets[x + 1]]
        place = np.minimum(np.searchsorted(known, ids), len(known) - 1) if len(known) else np.zeros(len(ids), np.int64)
        codes[i, : len(ids)] = np.where(known[place] == ids, place, size - 1) if len(known) else size - 1
    codes, base = codes.T.copy(), mine * size
    one, top = np.uint64(1), np.uint64(63)
    pv, mv = np.full((words, len(left)), ~np.uint64(0)), np.zeros((words, len(left)), np.uint64)
    buffers = [np.empty(len(left), np.uint64) for _ in range(4)]
    live = np.searchsorted(-n, -np.arange(1, len(codes) + 1), "right")
    for j in range(int(n.max())):
        k = int(live[j])
        at = codes[j].take(text[:k])
        at += base[:k]
        up, down = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        eq, xv, xh, ph = (x[:k] for x in buffers)
        for w in range(words):
            p, v = pv[w, :k], mv[w, :k]
            np.take(bits[w], at, out=eq, mode="clip")
            np.bitwise_or(eq, v, out=xv)
            np.bitwise_or(eq, down, out=eq)
            np.bitwise_and(eq, p, out=xh)
            np.add(xh, p, out=xh)
            np.bitwise_xor(xh, p, out=xh)
            np.bitwise_or(xh, eq, out=xh)
            np.bitwise_or(xh, p, out=ph)
            np.invert(ph, out=ph)
            np.bitwise_or(ph, v, out=ph)
            np.bitwise_and(p, xh, out=xh)
            up_next, down_next = ph >> top, xh >> top
            np.left_shift(ph, one, out=ph)
            np.bitwise_or(ph, up, out=ph)
            np.left_shift(xh, one, out=xh)
            np.bitwise_or(xh, down, out=xh)
            np.bitwise_or(xv, ph, out=eq)
            np.invert(eq, out=eq)
            np.bitwise_or(eq, xh, out=p)
            np.bitwise_and(ph, xv, out=v)
            up, down = up_next, down_next
    got = n.copy()
    for w in range(words):
        inside = np.clip(m - 64 * w, 0, 64)
        mask = np.where(inside == 64, ~np.uint64(0), (one << (inside % 64).astype(np.uint64)) - one)
        got += np.bitwise_count(pv[w] & mask).astype(np.int64) - np.bitwise_count(mv[w] & mask).astype(np.int64)
    out = np.empty_like(got)
    out[by_length] = got
    return out


def similarity(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(jaccard, similarity) of pairs."""
    jac = inter / (na + nb - inter)
    near = np.maximum(0.0, 1.0 - distance / np.maximum(na, nb))
    return jac, np.minimum(1.0, 0.75 * jac + 0.25 * near)


def all_scores(a_ids: pa.Array, a_codes: pa.Array, b_ids: pa.Array, b_codes: pa.Array, ordered: bool, lesser_first: bool = False) -> Iterator[list[pa.Array]]:
    """[a, b, jaccard, distance, similarity] of all pairs that share an element; with ``ordered`` only those with a < b, else those with a <> b.

    With ``lesser_first`` the lesser of each pair's ids is said to be a, whichever side it is of.
    """
    (a, b), size = numbered(a_codes, b_codes)
    rank = np.unique(np.concatenate([a_ids.to_numpy(zero_copy_only=False), b_ids.to_numpy(zero_copy_only=False)]), return_inverse=True)[1]
    ra, rb = rank[: len(a_ids)], rank[len(a_ids) :]
    both = pa.concat_arrays([a_ids, b_ids])
    shared = Shared(a, b, size)
    for lo in range(0, len(a.n), CHUNK):
        hi = min(lo + CHUNK, len(a.n))
        inter = shared.rows(lo, hi)
        x, y = np.nonzero((inter > 0) & ((ra[lo:hi, None] < rb) if ordered else (ra[lo:hi, None] != rb)))
        left = x + lo
        for i in range(0, len(x), 1 << 17):
            s = slice(i, i + (1 << 17))
            d = distances(a, b, left[s], y[s])
            jac, sim = similarity(inter[x[s], y[s]], a.n[left[s]], b.n[y[s]], d)
            one, two = left[s], y[s] + len(ra)
            if lesser_first:
                turned = ra[left[s]] > rb[y[s]]
                one, two = np.where(turned, two, one), np.where(turned, one, two)
            yield [both.take(pa.array(one)), both.take(pa.array(two)), pa.array(jac), pa.array(d.astype(np.int32)), pa.array(sim)]


def best_matches(asks: dict, past: dict, k: int, bonus: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ask, match, similarity): for each ask the k best earlier rows of ``past``, one of each (trigger, family) before second ones of any.

    Both have numpy columns fp, trigger, ts, id and the codes of their rows;
    past has the family too.  The similarity without order bounds the one with
    it: distances are taken from the top of the bounds down, until no other row
    can enter the k.
    """
    uq, iq = np.unique(asks["fp"], return_index=True)
    up, ip = np.unique(past["fp"], return_index=True)
    (a, b), size = numbered(asks["codes"].take(pa.array(iq)), past["codes"].take(pa.array(ip)))
    fp_a, fp_b = np.searchsorted(uq, asks["fp"]), np.searchsorted(up, past["fp"])
    group = np.unique(np.array([f"{t}\0{f}" for t, f in zip(past["trigger"], past["family"], strict=True)], object), return_inverse=True)[1]
    names = np.unique(np.concatenate([asks["trigger"], past["trigger"], asks["id"], past["id"]]), return_inverse=True)[1]
    t_a, t_b, id_a, id_b = np.split(names, np.cumsum([len(fp_a), len(fp_b), len(fp_a)]))
    by_fp = np.argsort(fp_a, kind="stable")
    shared = Shared(a, b, size)
    for lo in range(0, len(uq), CHUNK):
        hi = min(lo + CHUNK, len(uq))
        inter = shared.rows(lo, hi)
        longest = np.maximum(a.n[lo:hi, None], b.n)
        bound = 0.75 * (inter / (a.n[lo:hi, None] + b.n - inter)) + 0.25 * (inter / longest)
        exact = np.full(inter.shape, -1.0)

        def settle(pairs: list[np.ndarray]) -> None:
            want = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            x, y = want // len(up), want % len(up)
            todo = exact[x, y] < 0
            x, y = x[todo], y[todo]
            exact[x, y] = similarity(inter[x, y], a.n[lo + x], b.n[y], distances(a, b, lo + x, y))[1]

        def value(s: np.ndarray, same: np.ndarray) -> np.ndarray:
            return np.where(same, np.minimum(1.0, s + bonus), s)

        rows, first, open_ = by_fp[np.searchsorted(fp_a[by_fp], lo) : np.searchsorted(fp_a[by_fp], hi)], [], []
        for r in rows:
            x = fp_a[r] - lo
            can = np.nonzero((past["ts"] < asks["ts"][r]) & (id_b != id_a[r]) & (inter[x, fp_b] > 0))[0]
            same = t_b[can] == t_a[r]
            most = value(np.minimum(1.0, bound[x, fp_b[can]]), same)
            n = min(len(can), 4 * k)
            while True:
                top = np.argpartition(-most, n - 1)[:n] if n < len(can) else np.arange(len(can))
                if n == len(can) or len(np.unique(group[can[top]])) >= k + 1:
                    break
                n = min(len(can), 4 * n)
            open_.append((r, x, can, same, most, top))
            first.append(x * len(up) + fp_b[can[top]])
        settle(first)
        more, found = [], []
        for r, x, can, same, most, top in open_:
            got = value(exact[x, fp_b[can[top]]], same[top])
            g, inv = np.unique(group[can[top]], return_inverse=True)
            best = np.full(len(g), -1.0)
            np.maximum.at(best, inv, got)
            # with k groups that reach it nothing below can enter
            least = np.sort(best)[-k] if len(g) >= k else -1.0
            rest = np.nonzero(most >= least - 1e-9)[0]
            more.append(x * len(up) + fp_b[can[rest]])
            found.append((r, x, can[rest], same[rest]))
        settle(more)
        for r, x, can, same in found:
            got = value(exact[x, fp_b[can]], same)
            order = np.lexsort((id_b[can], -past["ts"][can], ~same, -got))
            _, lead = np.unique(group[can[order]], return_index=True)
            second = np.ones(len(order), bool)
            second[lead] = False
            order = order[np.argsort(second, kind="stable")][:k]
            yield np.full(len(order), r), can[order], got[order]


def one_edit_keys(column: pa.Array, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, key): a hash of each sequence (position -1) and of what is left without each one element.

    Two sequences are one substitution apart if they leave the same without the
    same position, and one insertion apart if one leaves the other.  Those of
    fewer than 4 elements have no keys: no one edit of them counts.
    """
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    out: list[tuple] = []
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(np.diff(offsets).max(initial=0)) + 2, 0x9E3779B97F4A7C15, np.uint64))
        for i, (lo, hi) in enumerate(zip(offsets, offsets[1:], strict=False)):
            n = int(hi - lo)
            if n < 4:
                continue
            e = flat[lo:hi]
            here, shifted = np.cumsum(e * power[1 : n + 1]), np.cumsum(e * power[:n])
            left = np.concatenate([[np.uint64(0)], here[:-1]]) + (shifted[-1] - shifted)
            key = np.concatenate([here[-1:], left])
            # the length is part of the key
            key ^= np.concatenate([[n], np.full(n, n - 1)]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt[i]
            out.append((np.full(n + 1, i), np.arange(-1, n), key.view(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def half_keys(column: pa.Array, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): hashes of each sequence's first and last half, so that two that are one edit apart share one.

    Of two sequences, the longer with ``n`` elements, that differ by one edit
    either the first n // 2 elements are the same or the last n - 1 - n // 2; a
    sequence has keys as the longer and as the shorter.  Those of fewer than 4
    elements have none.
    """
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    rows, keys = [], []
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(np.diff(offsets).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        for i, (lo, hi) in enumerate(zip(offsets, offsets[1:], strict=False)):
            n = int(hi - lo)
            if n < 4:
                continue
            for longer in (n, n + 1):
                head, tail = longer // 2, longer - 1 - longer // 2
                for side, e in ((1, flat[lo : lo + head]), (2, flat[hi - tail : hi])):
                    rows.append(i)
                    keys.append(int((e * power[: len(e)]).sum() + salt[i]) ^ (2 * longer + side) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return np.array(rows, np.int64), np.array(keys, np.uint64).view(np.int64)
