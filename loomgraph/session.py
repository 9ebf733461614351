"""Session helpers: where shared tables go, how big a plan's input is, what workers can import."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it runs from a checkout, and bounds Arrow batches.

    Batches are bounded in rows as well as bytes because a handful of very long
    texts would otherwise fill a worker's memory at once.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one is set only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-checkpoint")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes of what a plan reads that one task of a spread exchange gets: some 100 MB of sorted rows.
PART_BYTES = 8 << 20

#: Bytes of files that a task reads at most where what is read is spread: beyond 200 parts a task holds the rows that it sends.
SPLIT_BYTES = 2 * PART_BYTES

#: Rows of a few columns, counted, that may be sent to each worker.
SENT_ROWS = 1_000_000


def parts(df: DataFrame) -> int:
    """Into how many parts a plan's rows are spread, so that a task's memory doesn't grow with the input."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(df.sparkSession.sparkContext.defaultParallelism, (total if total < 1 << 60 else df.count() << 6) // PART_BYTES + 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys together, in ``parts`` that adaptive execution doesn't merge again."""
    return df.repartition(parts(df), *keys)


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Within it, a task reads ``SPLIT_BYTES`` of files at most, or less where the session says so."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(key, str(min(before, SPLIT_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def sent(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast where it is counted and small."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's process ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clear, spark)
    _WRITTEN.append(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read from there: columns, where a checkpoint keeps whole rows."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def settled(df: DataFrame, name: str) -> DataFrame:
    """A frame that can be asked again and again: itself where it is no more than columns and rows of files, else written."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return df if plan.children().isEmpty() and plan.nodeName().startswith(("LogicalRelation", "Relation")) else stored(df, name)


def clear(spark: SparkSession) -> None:
    """Removes scratch tables. Frames that read them can't be used after it."""
    for at in _WRITTEN:
        where = urlparse(at)
        if where.scheme in ("", "file"):
            shutil.rmtree(unquote(where.path), ignore_errors=True)
            continue
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit; the cluster's folder is cleaned by its owner then
            return
    _WRITTEN.clear()


def input_bytes(df: DataFrame) -> int:
    """Size of what a plan reads: that of its files, else Catalyst's estimate, else counted rows of 1 kB."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 60 else df.count() << 10
