"""Structured Streaming ingest: JSON lines in, the engine's event log out, exactly once per batch id.

Arrival order is kept: a row's ``ingest_seq`` is its batch and its place in it,
and everything that depends on order (identities, edges, families) is derived by
that number.  Late events are appended like all others; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import normalise
from ..sources.store import Store
from ..sources.tables import written
from ..sources.telemetry import parse_json_lines

PLACE_BITS = 44


def stream_events(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Events of a folder of JSON lines; ``per_batch`` bounds the files of a micro-batch."""
    reader = spark.readStream.format("text")
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    return parse_json_lines(reader.load(path))


def write_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    """Idempotent append: a batch writes its own part and overwrites it if it is run again."""
    store = Store(batch.sparkSession, target)
    rows = written(batch.withColumn("ingest_seq", F.monotonically_increasing_id() + F.lit(batch_id << PLACE_BITS)), "arrivals")
    good, bad = normalise(rows)
    store.append("rejected", bad, batch_id)
    store.append("events", good, batch_id)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = False, per_batch: int | None = None) -> StreamingQuery:
    """Start the stream; ``once`` takes what is there and ends. An Engine on ``target`` reads what was written."""
    writer = stream_events(spark, source, per_batch).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: write_batch(df, i, target))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
