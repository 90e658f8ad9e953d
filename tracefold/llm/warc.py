"""WARC archives with revisit resolution.

Headers (page id, payload digest, payload length) are shuffled by digest; of
the records with equal payloads the one with the smallest page_id is the
response and the others become revisit records that refer to it.  The archives
are then written with fresh headers and read back record by record.

A record ends with two line breaks, so the archive is what Spark's text writer
makes with those as its line separator: the writer's commit protocol makes the
files whole, whatever executors are lost, and any store that Spark knows will
do.  Files are gzip, which Spark does not split, so a reader sees a file's
pieces in order and joins the pieces of a record until its Content-Length is
reached; memory is a few records.

Equal payloads meet by pre-aggregated digests, never as a list of pages.  Only
records whose digest may occur again are joined with the response of theirs, as
plain tables, so Spark splits the copies of one payload over tasks.

Defined cases: null html is an empty payload; with ``min_bytes`` above 0,
smaller payloads are all responses; of repeated rows (same page_id and payload)
exactly one is the response; null page_ids come last in the choice; null url
is written as an empty target; very long payloads are held whole, one at a
time; other columns are ignored, whatever their names; an empty table gives an
empty archive and no rows.  Line breaks in urls are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from .store import materialize, new_path, table

VERSION = "WARC/1.1"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 0
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(digest, n_bytes, first) of the payloads that several records have; ``first`` is the record that answers for them.

    A minimum with map-side sums: a digest that a third of all records share is
    a row for each map task.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid", "url")
    shared = headers.filter(F.col("n_bytes") >= min_bytes)
    return shared.groupBy("digest", "n_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def _record_id(rid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(rid))}>"


def _uri(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(rid: int, page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, refers_rid: int | None, refers_url: str | None) -> bytes:
    """One record without the two line breaks at its end."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(rid)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_rid)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {DATE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block


def numbered(pages: DataFrame) -> DataFrame:
    """The pages with record number, digest and length, written once, so that later reads agree on the numbers."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"))
    body = F.col("html").cast("binary")
    return materialize(rows.withColumn("digest", F.sha1(body)).withColumn("n_bytes", F.octet_length(body).cast("long")), "warc-pages")


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write one record per page to gzip archives below ``path``, equal payloads once.

    Only records whose digest may occur again are joined with the responses.
    """
    rows = numbered(pages)
    first = materialize(resolve(rows.select("rid", "page_id", "url", "digest", "n_bytes"), min_bytes), "warc-responses")
    h = F.xxhash64("digest", "n_bytes")
    rows = bits.marked(rows, h, bits.table_of(first.select(h.alias("h")), "h"))
    joined = rows.filter("_maybe").join(first.hint("merge"), ["digest", "n_bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid"))
    kind = lambda c: F.when(revisit, F.col(c))
    near = joined.select("rid", "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), kind("first.page_id").alias("refers_to"), kind("first.rid").alias("refers_rid"), kind("first.url").alias("refers_url"))
    none = lambda t: F.lit(None).cast(t)
    far = rows.filter("NOT _maybe").select("rid", "page_id", "url", "html", F.lit("response").alias("record_type"), none("bigint").alias("refers_to"), none("bigint").alias("refers_rid"), none("string").alias("refers_url"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                r = b.slice(lo, 512)
                cols = [c.to_pylist() for c in r.columns]
                out = [record(i, p, u, h.encode(), k, t, tr, tu).decode() for i, p, u, h, k, t, tr, tu in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    near.unionByName(far).mapInArrow(put, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Joins the pieces of a stream until a record's Content-Length is reached; each byte is looked at once."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.size = 0
        self.need = 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.pieces.append(piece)
        self.size += len(piece)
        while self.size and self.size >= self.need:
            held = b"".join(self.pieces).lstrip(b"\r\n")
            r = parse(held)
            if isinstance(r, tuple):
                yield r[:2]
                held = held[r[2] :].lstrip(b"\r\n")
            self.pieces, self.size, self.need = ([held] if held else []), len(held), 0
            if not isinstance(r, tuple):
                self.need = r if r else len(held) + 1
                return

    def end(self) -> None:
        if b"".join(self.pieces).strip():
            raise ValueError("an archive ends within a record")


def parse(stream: bytes) -> tuple[dict[str, str], bytes, int] | int:
    """The first record of a stream: headers, payload and length with its end; if it is not whole, how long the stream must be (0: unknown)."""
    if len(stream) >= len(VERSION) and not stream.startswith(VERSION.encode()):
        raise ValueError("bytes outside a WARC record")
    head = stream.find(b"\r\n\r\n")
    if head < 0:
        return 0
    lines = stream[:head].decode().split("\r\n")[1:]
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    to = head + 4 + int(fields["Content-Length"])
    if len(stream) < to + len(END):
        return to + len(END)
    return fields, stream[head + 4 : to].partition(b"\r\n\r\n")[2], to + len(END)


_RECORD = "record_id string, page_id bigint, record_type string, target_uri string, refers_to_id string, declared string, digest string, n_bytes bigint, payload string"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives: ids, type, declared digest, and digest and length of the payload as read."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "record_type", "target_uri", "refers_to_id", "declared", "digest", "n_bytes", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        reader = _Reader()
        for b in batches:
            out = []
            for piece in b.column(0):
                # what Spark took as a separator may have been part of a payload
                for f, p in reader.feed(piece.as_py().encode() + END.encode()):
                    page = f.get("X-Page-ID", "")
                    out.append((f["WARC-Record-ID"], int(page) if page else None, f["WARC-Type"], f.get("WARC-Target-URI"), f.get("WARC-Refers-To"), f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), payload_digest(p), len(p), p.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)
        reader.end()

    return spark.read.option("lineSep", END).text(path).mapInArrow(get, _RECORD)


def resolved_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: every record of the archives, revisits with what their response holds."""
    rows = materialize(read_archive(spark, path).drop("payload"), "warc-headers")
    answers = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("n_bytes").alias("_n"), F.col("digest").alias("_digest"))
    plain = rows.filter("record_type = 'response'").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"), "record_id")
    again = rows.filter("record_type <> 'response'").drop("digest", "n_bytes").join(answers, "refers_to_id", "left")
    again = again.select("page_id", F.col("_n").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to", "record_id")
    return plain.unionByName(again)


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return resolved_records(spark, path)
