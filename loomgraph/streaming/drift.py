"""Streaming forms of drift detection and transcript tallies.

Drift arrives as files of observations (``path, content_hash, size, mtime_ms``, null hash for a
deletion); each batch is compared with the index and merged into it. Tallies keep counts per
conversation and hour, and a watermark bounds their state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.facts import Folder
from loomgraph.operators import maintain

#: Observation files of one batch, at most.
MOST_FILES = 10_000
OBSERVED = "path string, content_hash string, size long, mtime_ms double"


def follow(spark: SparkSession, observations: str, index: DataFrame, on_drift: Callable[[DataFrame, int], None], checkpoint_dir: str) -> StreamingQuery:
    """Calls ``on_drift`` with (path, state) of every batch of observation files, against the index as the batches before left it.

    The index after each batch is a version below ``checkpoint_dir``; a batch that is run again reads the version
    before its own and writes its own anew, so its answer is the same. Two versions are kept.
    """
    folder = Folder(spark, f"{checkpoint_dir}/index")

    def batch(rows: DataFrame, number: int) -> None:
        before = [int(n) for n in folder.names() if n.isdigit() and int(n) < number]
        base = spark.read.schema(OBSERVED).parquet(f"{folder.path}/{max(before)}") if before else index.select("path", "content_hash", "size", "mtime_ms")
        latest = rows.groupBy("path").agg(F.max_by(F.struct("content_hash", "size", "mtime_ms"), "mtime_ms").alias("o")).select("path", "o.*")
        known = base.join(latest.select("path"), "path", "left_semi")
        there = latest.where("content_hash IS NOT NULL")
        on_drift(maintain.drift(known, there, there.select("path").limit(0)), number)
        maintain.retire(base, latest).unionByName(there).write.mode("overwrite").parquet(f"{folder.path}/{number}")
        for old in sorted(before)[:-1]:
            folder.remove(str(old))

    source = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", MOST_FILES).parquet(observations)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint_dir}/stream").trigger(availableNow=True).start()


def tally(turns: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Turns and characters per conversation and window, from a stream of (ts, conv_id, role, text)."""
    return turns.withWatermark("ts", late).groupBy(F.window("ts", window), "conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
