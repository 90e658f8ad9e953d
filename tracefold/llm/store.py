"""Tables written to the folder that all executors share.

Long plans cut their lineage by writing a Parquet table below the folder named
in ``spark.checkpoint.dir`` and reading it back, so a lost executor costs a
re-read and never a recomputation of the whole plan.  The setting is read from
the session; only where it is unset (tests, a laptop) a folder is made here.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared working folder of this session, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tracefold-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        folder = f"file://{_OWN[app]}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: shuffle files of a finished write go at once, not when the driver happens to collect garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back from there.

    The shuffle files of the write are deleted when it has ended; while it runs
    they are all there for tasks that have to be repeated.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one query, deleted by name when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._paths = spark, name, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{name}")
        out = materialize(df, name, path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if id(t) in self._paths:
                remove(self.spark, self._paths.pop(id(t))[1])


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows of whole texts that go to Python at a time
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """From now on at most BATCH_ROWS rows go to Python at a time in this session, or fewer where it says so already.

    A task holds a batch of texts several times, outside the heap too: as it is
    filled, as it doubles its buffers, and as it comes back.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
