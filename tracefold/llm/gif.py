"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

``encode`` stores 8-bit samples as an animated GIF (palette of 256 colours);
``decode`` reads any GIF87a/89a: variable-width LZW with clear codes and full
tables, global and local palettes, interlacing, transparency, the three
disposal methods and delays.  ``store`` writes the media of every text as a
table in the shared folder; ``frames`` reads stored media into one row per
composited frame with its delay and colour histogram; ``features`` stores those
rows and gives one row per medium.

Codes are packed and unpacked as whole arrays: code widths depend only on how
many codes came since the last clear, so a run's bit positions are known
beforehand.  Memory is a few times one medium.

Defined cases: null text is stored as an empty one (64 zero bytes); equal texts
give equal media and features; very long texts become several frames; repeated
rows and null doc_ids are kept as rows; an empty table gives no rows; other
columns are ignored, whatever their names; media that cannot be read, end early
or have too few samples raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, table

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
BATCH = 256
_MAX_RUN = 3838  # codes after a clear until a table of 4096 is full
GREYS = bytes(v for i in range(256) for v in (i, i, i))
#: the palette that samples are stored under: 3 bits of red, 3 of green, 2 of blue
COLOURS = bytes(v for i in range(256) for v in ((i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85))


def _widths(low: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear, for a minimum code size."""
    entries = (1 << low) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, low + 1, 12)


_RUN_WIDTHS = {low: _widths(low, 8192) for low in range(2, 9)}


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    at = ends - widths
    size = int(ends[-1] + 7) // 8
    v = codes << (at & 7)
    byte = at >> 3
    out = np.zeros(size + 3)
    for i in range(3):  # codes have no bits in common, so sums are bitwise ors
        out += np.bincount(byte + i, weights=v >> (8 * i) & 255, minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """LZW codes of 8-bit samples, packed least significant bit first."""
    codes: list[int] = [256 << 8]  # each times 256, as the loop has them
    widths = [np.array([9])]
    rest = iter(data)
    p = next(rest, None)
    p = None if p is None else p << 8
    put = codes.append
    while p is not None:
        begun, known, free = len(codes), {}, 258
        for b in rest:
            k = p | b
            if k in known:
                p = known[k]
            else:
                put(p)
                known[k] = free << 8
                free += 1
                p = b << 8
                if free == 258 + _MAX_RUN:
                    put(256 << 8)  # the table is full; p goes on into the next run
                    break
        else:
            put(p)
            put(257 << 8)
            p = None
        widths.append(_RUN_WIDTHS[8][: len(codes) - begun])
    if len(codes) == 1:
        return _pack(np.array([256, 257]), np.array([9, 9]))
    return _pack(np.array(codes, np.int64) >> 8, np.concatenate(widths))


def _unpack(data: np.ndarray, bit: int, low: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes from a bit position on as if no clear came (``most`` bits), and where each begins (one more for the end)."""
    left = min((len(data) - 4) * 8 - bit, most)
    n = max(0, left // (low + 1) + 1)
    n = min(n, _MAX_RUN + 2 + max(0, left // 12)) if n > _MAX_RUN else n
    w = _RUN_WIDTHS[low][:n] if n <= len(_RUN_WIDTHS[low]) else _widths(low, n)
    starts = bit + np.concatenate([[0], np.cumsum(w)])
    n = int(np.searchsorted(starts, bit + left, "right")) - 1
    at, w = starts[:n], w[:n]
    byte = at >> 3
    word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return word >> (at & 7) & ((1 << w) - 1), starts[: n + 1]


def _expand(codes: np.ndarray, first: int) -> np.ndarray:
    """Samples of the codes of one run; entry ``first + n`` is code n's string and one sample more.

    Every entry is a piece of the output, so an output sample either is a
    literal or repeats an earlier one; the repeats are followed in doubling steps.
    """
    entry = codes - first
    literal = entry < 0
    if np.any(entry >= np.arange(len(codes))) or np.any(literal & (codes >= first - 2)):
        raise ValueError("LZW code beyond the table")
    up, size = np.where(literal, -1, entry), np.ones(len(codes), np.int64)
    size[~literal] += 1
    go = np.flatnonzero(up >= 0)
    up = up.copy()
    while len(go):  # length of a code: literals are 1, others 1 more than the code they extend
        to = up[go]
        size[go] += size[to] - 1
        up[go] = up[to]
        go = go[up[go] >= 0]
    ends = np.cumsum(size)
    begin = ends - size
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total)
    shift = np.where(literal, 0, begin[np.where(literal, 0, entry)] - begin)
    source += np.repeat(shift, size)
    value = np.zeros(total, np.uint8)
    value[begin[literal]] = codes[literal]
    while True:
        then = source[source]
        if np.array_equal(then, source):
            return value[source]
        source = then


def lzw_decode(data: bytes, low: int, n_pixels: int) -> bytes:
    """Pixels of a code stream, n_pixels of them; what comes after those is left out."""
    raw = np.frombuffer(data + b"\0" * 4, np.uint8)
    clear, end = 1 << low, (1 << low) + 1
    out: list[bytes] = []
    have, bit = 0, 0
    while have < n_pixels:
        codes, starts = _unpack(raw, bit, low, 12 * 4096)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops):  # a table that stays in use after it is full
            codes, starts = _unpack(raw, bit, low, len(raw) * 8)
            stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        out.append(_expand(codes[:stop], end + 1).tobytes())
        have += len(out[-1])
        if stop == len(codes) or codes[stop] == end:
            break
        bit = int(starts[stop + 1])
    if have < n_pixels:
        raise ValueError("LZW code stream ends early")
    return b"".join(out)[:n_pixels]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes) -> bytes:
    """8-bit samples (a positive multiple of WIDTH of them) as a GIF of timed frames."""
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), COLOURS]
    for top in range(0, rows, FRAME_ROWS):
        part = samples[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY_CS, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """A frame: its own pixels (palette indexes) and the canvas after it, as RGB."""

    index: int
    delay_cs: int
    disposal: int
    pixels: np.ndarray
    canvas: np.ndarray


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("GIF data ends within a block")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n


def decode(data: bytes) -> Iterator[Frame]:
    """Decode frame by frame; the canvas follows each frame's disposal and transparency."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("GIF data ends early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    everywhere, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 3), np.uint8)
    if everywhere is not None and background < len(everywhere):
        canvas[:] = everywhere[background]
    empty = canvas[:1, :1].copy() if canvas.size else canvas
    delay, disposal, clear_index, index = 0, 0, None, 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                f, delay, t = struct.unpack_from("<BHB", body)
                disposal, clear_index = f >> 2 & 7, t if f & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown GIF block")
        x, y, w, h, f = struct.unpack_from("<HHHHB", data, at)
        own, at = _palette(data, at + 9, f)
        low = data[at]
        body, at = _sub_blocks(data, at + 1)
        if not 2 <= low <= 8:
            raise ValueError("LZW code size")
        pixels = np.frombuffer(lzw_decode(body, low, w * h), np.uint8).reshape(h, w)
        if f & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(pixels)
            plain[order] = pixels
            pixels = plain
        palette = own if own is not None else everywhere
        if palette is None:
            palette = np.frombuffer(GREYS, np.uint8).reshape(-1, 3)
        before = canvas.copy() if disposal == 3 else None
        hh, ww = max(0, min(h, height - y)), max(0, min(w, width - x))
        part = pixels[:hh, :ww]
        colours = palette[np.minimum(part, len(palette) - 1)]
        there = canvas[y : y + hh, x : x + ww]
        if clear_index is None:
            there[:] = colours
        else:
            opaque = part != clear_index
            there[opaque] = colours[opaque]
        yield Frame(index, delay, disposal, pixels, canvas)
        if disposal == 2:
            canvas[y : y + hh, x : x + ww] = empty
        elif before is not None:
            canvas = before
        delay, disposal, clear_index, index = 0, 0, None, index + 1
    raise ValueError("GIF without a trailer")


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in 4 x 4 x 4 steps of red, green and blue."""
    c = canvas.reshape(-1, 3).astype(np.uint32) >> 6
    return np.bincount(c[:, 0] << 4 | c[:, 1] << 2 | c[:, 2], minlength=64)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a GIF, written and read back."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                raw = [x.as_buffer().to_pybytes() for x in part.column(1).cast(pa.binary())]
                media = [encode(payload_of(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(put, "doc_id bigint, n_bytes bigint, media binary"), "gif")


_MEDIUM = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_FRAME = "doc_id bigint, frame int, delay_ms int, disposal int, colours array<bigint>, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint, duration_ms bigint"


def _read_medium(doc: int | None, n_bytes: int, medium: bytes) -> list[tuple]:
    """Frame rows of a medium; the first also has what holds for the whole of it."""
    sha, size, tail, seen, rows, ms = hashlib.sha256(), 0, b"", np.zeros(64, np.int64), [], 0
    for f in decode(medium):
        pixels = f.pixels.tobytes()
        sha.update(pixels)
        size, tail, ms = size + len(pixels), pixels[-64:], ms + f.delay_cs * 10
        colours = colour_histogram(f.canvas)
        own = f.canvas[: f.pixels.shape[0], : f.pixels.shape[1]]
        seen += colours if own.size == f.canvas.size else colour_histogram(own)
        rows.append((doc, f.index, f.delay_cs * 10, f.disposal, colours.tolist()))
    whole = (n_bytes, size, sha.hexdigest(), zlib.crc32(tail), len(medium), hashlib.sha256(medium).hexdigest(), ",".join(map(str, seen)), len(rows), ms)
    return [r + (whole if i == 0 else (None,) * len(whole)) for i, r in enumerate(rows)]


def frames(media: DataFrame) -> DataFrame:
    """(doc_id, frame, delay_ms, disposal, colours, ...): a row per composited frame with its colour histogram (4 x 4 x 4 bins).

    The first frame's row also has the medium's lengths and digests, its number
    of frames and duration, and ``feature``, the histogram over all frames.
    """
    names = ["doc_id", "frame", "delay_ms", "disposal", "colours", *_MEDIUM]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *_KINDS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                rows = [r for doc, n, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True) for r in _read_medium(doc, n, m.as_buffer().to_pybytes())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, _FRAME)


def features(media: DataFrame) -> DataFrame:
    """One row per stored medium, from its stored frames: payload and medium digests, and the colour histogram of all frames."""
    return materialize(frames(media), "gif-frames").filter("frame = 0").select("doc_id", *_MEDIUM)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
