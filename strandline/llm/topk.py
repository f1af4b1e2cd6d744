"""Most frequent values of a column: external sort, run-length counting, and a bounded heap per range.

Each map task sorts its values in bounded blocks and writes runs (value, count), so a hot value costs one row a
block; the runs are range-partitioned by value, sorted (spilling to disk where needed) and merged in one pass that
keeps a single open run and a heap of the largest counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import shuffle_partitions

#: Values that a map task holds at once before it writes their runs (8 bytes each).
BLOCK = 1 << 20

_RUNS = T.StructType([T.StructField("value", T.LongType()), T.StructField("n", T.LongType())])


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["value", "n"])

    held: list[np.ndarray] = []
    size = 0
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part.column(0).to_numpy(zero_copy_only=False))
        size += part.num_rows
        if size >= BLOCK:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _merge_and_keep(k: int):
    """Merges sorted runs and keeps the k largest counts of the range; ties go to the smaller value."""

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[int, int]] = []

        def offer(values: np.ndarray, counts: np.ndarray) -> None:
            if len(heap) == k:
                least = counts >= heap[0][0]
                values, counts = values[least], counts[least]
            if len(values) > k:
                order = np.lexsort((values, -counts))[:k]
                values, counts = values[order], counts[order]
            for value, count in zip(values.tolist(), counts.tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (count, -value))
                elif (count, -value) > heap[0]:
                    heapq.heapreplace(heap, (count, -value))

        open_value, open_count = 0, 0
        for part in parts:
            if not part.num_rows:
                continue
            values, counts = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            begins = np.flatnonzero(np.diff(values, prepend=values[0] - 1 if values[0] > -(1 << 63) else values[0] + 1))
            values, counts = values[begins], np.add.reduceat(counts, begins)
            if open_count and values[0] == open_value:
                counts[0] += open_count
            elif open_count:
                offer(np.array([open_value]), np.array([open_count]))
            open_value, open_count = int(values[-1]), int(counts[-1])
            offer(values[:-1], counts[:-1])
        if open_count:
            offer(np.array([open_value]), np.array([open_count]))
        found = sorted(heap, reverse=True)
        yield pa.RecordBatch.from_arrays([pa.array([-v for _, v in found], pa.int64()), pa.array([n for n, _ in found], pa.int64())], names=["value", "n"])

    return merge


def heaviest_per_range(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n): of each range of values the k largest counts; the k largest of all are among them.

    ``column`` is a bigint; nulls aren't counted.  Counts are exact, ties go to the smaller value, an empty table
    gives no rows.  A task holds BLOCK values on the map side, one batch and k counts on the other.
    """
    values = df.select(F.col(f"`{column}`").cast("bigint").alias("value")).where(F.col("value").isNotNull())
    runs = values.mapInArrow(_runs, _RUNS)
    ranged = runs.repartitionByRange(shuffle_partitions(df.sparkSession), "value").sortWithinPartitions("value")
    return ranged.mapInArrow(_merge_and_keep(k), _RUNS)


def most_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values (value, n), ties to the smaller value; nulls aren't counted."""
    return heaviest_per_range(df, column, k).orderBy(F.desc("n"), "value").limit(k)


def heavy_hitters(df: DataFrame, column: str, one_in: int) -> DataFrame:
    """(value, n, total): values with at least one in ``one_in`` of the rows whose value isn't null.

    At most ``one_in`` values can reach that share, so a heap of that size a range loses none.
    """
    kept = heaviest_per_range(df, column, one_in)
    total = df.where(F.col(f"`{column}`").isNotNull()).agg(F.count(F.lit(1)).alias("total")).first()["total"]
    return kept.where(F.col("n") * F.lit(one_in) >= F.lit(total)).withColumn("total", F.lit(total))
