"""Counters of fixed size filled by all tasks and added up slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 32


def sum_slices(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of compressed slices of counters (slice int, counts binary) that tasks wrote: ``size`` counters, capped at 2**32 - 1."""
    slices = min(SLICES, size)
    width = size // slices

    def unpack(blob: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(blob, 4 * width, "zstd", asbytes=True), dtype=np.uint32)

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in tables:
            for blob in batch.column("counts").to_pylist():
                total += unpack(blob)
        capped = pa.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([capped], pa.binary())], ["slice", "counts"])

    out = np.zeros(size, dtype=np.uint32)
    for row in parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").toLocalIterator():
        out[row["slice"] * width : (row["slice"] + 1) * width] = unpack(row["counts"])
    return out


def packed_slices(counters: np.ndarray) -> pa.RecordBatch:
    """Counters as the rows that ``sum_slices`` adds up; slices without counts are not sent."""
    parts = np.minimum(counters, 2**32 - 1).astype(np.uint32).reshape(min(SLICES, len(counters)), -1)
    keep = [i for i, part in enumerate(parts) if part.any()]
    return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([pa.compress(parts[i].tobytes(), "zstd", asbytes=True) for i in keep], pa.binary())], ["slice", "counts"])


def gather(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum of what ``fill`` counts in each task: ``size`` counters, whatever the data hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed_slices(fill(batches))

    return sum_slices(df.mapInArrow(count, "slice int, counts binary"), size)
