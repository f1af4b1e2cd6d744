"""Streaming forms of the incremental operators.

Each takes a DataFrame with an event time, streaming or not; on a finite one it gives what the stream gives once
every event has arrived in time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import ensure_checkpoint_dir


def _timed(events: DataFrame, at: str) -> DataFrame:
    """Watermarks need timestamps with a zone; those without one are taken in the session's."""
    return events.withColumn(at, F.col(at).cast("timestamp")) if events.isStreaming else events


def tumbling_counts(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(key, window_start, n, total): counts of fixed windows, final once the watermark has passed them."""
    marked = _timed(events, at).withWatermark(at, lateness) if events.isStreaming else events
    sums = marked.groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(key, F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, n): runs of events of a key without a pause of ``gap``."""
    marked = _timed(events, at).withWatermark(at, lateness) if events.isStreaming else events
    runs = marked.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, at: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """One event of each key within the watermark; of a finite table any one of each key."""
    return _timed(events, at).withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def paired_in_time(left: DataFrame, right: DataFrame, key: str, at: str, within: str = "10 minutes", lateness: str = "1 day") -> DataFrame:
    """Left events with the right events of their key that follow within a bounded time (an interval join).

    The right side's columns get the prefix ``r_``.  Left events without a partner come out with nulls once the
    watermark has passed (left outer).
    """
    left, right = _timed(left, at), _timed(right, at)
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    if left.isStreaming:
        left, b = left.withWatermark(at, lateness), b.withWatermark(f"r_{at}", lateness)
    near = (F.col(key) == F.col(f"r_{key}")) & (F.col(f"r_{at}") >= F.col(at)) & (F.col(f"r_{at}") <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return left.join(b, near, "left_outer")


def replay(spark: SparkSession, path: str, operator: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Runs an operator as a stream over a Parquet table's files to its end and returns what it wrote.

    Results go to files in the checkpoint folder that all executors share; nothing passes through the driver.
    """
    ensure_checkpoint_dir(spark)
    base = os.path.join(spark.sparkContext.getCheckpointDir() or "", f"stream-{uuid.uuid4().hex}")
    schema = spark.read.parquet(path).schema
    # As a pattern the path may name a folder or a single file.
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    source = spark.readStream.schema(schema).parquet(pattern)
    query = operator(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(operator(source).schema).parquet(f"{base}/out")
