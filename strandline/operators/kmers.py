"""K-mers of many sequences at once, rolled over whole Arrow batches in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, (_upper, _lower) in enumerate(zip(b"ACGT", b"acgt", strict=True)):
    _CODE[[_upper, _lower]] = _i

#: Sequences that are rolled together.
BATCH = 2048


def _rolled(seqs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, forward and reverse-complement code of every k letters A, C, G, T in a row."""
    texts = [x.encode() for x in seqs.to_pylist()]
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    letters = _CODE[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    m = max(len(letters) - k + 1, 0)
    forward, backward, valid = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    for j in range(k if m else 0):
        part = letters[j : j + m]
        valid &= part < 4
        forward = forward * 4 + part
        backward += (3 - (part & 3)).astype(np.int64) << (2 * j)
    row = np.repeat(np.arange(len(texts)), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(valid & (row[:m] == row[k - 1 :][:m]))
    return row[at], at - starts[at], forward[at], backward[at]


def exploded_kmers(sequences: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, pos, forward, revcomp): every k letters A, C, G, T (of any case) in a row, at most 31.

    Codes have 2 bits a base, the first base highest.  Null and shorter sequences and places with other letters
    give no rows; repeated rows repeat theirs.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")
    schema = T.StructType([T.StructField(key, sequences.schema[key].dataType), T.StructField("pos", T.IntegerType()), T.StructField("forward", T.LongType()), T.StructField("revcomp", T.LongType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, part.num_rows, BATCH):
                piece = part.slice(begin, BATCH)
                row, pos, forward, backward = _rolled(piece.column(1), k)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(forward), pa.array(backward)], names=[f.name for f in schema.fields])

    chosen = sequences.select(F.col(f"`{key}`"), F.col(f"`{seq}`").alias("__seq")).where(F.col("__seq").isNotNull())
    return chosen.mapInArrow(batches, schema)
