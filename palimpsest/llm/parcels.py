"""Rows that travel a shuffle as packed arrays.

A map task deals its rows to numbered parcels by a key, so that a key's rows share a parcel; a reduce
task opens one parcel at a time. A row costs the bytes of its numbers, not a row's overhead, and is
sorted in numpy. The number of parcels grows with the rows, not with the reducers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions_for

PARCEL = "parcel int, data binary"
#: Rows of a parcel, roughly.
ROWS = 250_000


def parcels_for(spark, rows: int) -> int:
    return max(partitions_for(spark), rows // ROWS + 1)


def deal(parcel: np.ndarray, columns: list[np.ndarray], ragged: np.ndarray | None = None, sizes: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a parcel: its number of rows, the columns one after the other, then ``sizes`` values of ``ragged`` each."""
    order = np.argsort(parcel, kind="stable")
    parcel = parcel[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, parcel[1:] != parcel[:-1], True]) if len(parcel) else np.zeros(1, np.int64)
    if ragged is not None:
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        ragged, ends = ragged[at], np.r_[0, np.cumsum(sizes)]
    blobs = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        parts = [np.int64(b - a).tobytes(), *(c[a:b].tobytes() for c in columns)]
        if ragged is not None:
            parts.append(ragged[ends[a] : ends[b]].tobytes())
        blobs.append(b"".join(parts))
    return pa.RecordBatch.from_arrays([pa.array(parcel[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["parcel", "data"])


def opened(blobs: list[bytes], kinds: list, ragged: type | None = None) -> list[np.ndarray]:
    """The columns of the blobs of one parcel, and the ragged values behind them."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(kinds) + (ragged is not None))]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for k, kind in enumerate(kinds):
            kind = np.dtype(kind)
            found[k].append(np.ndarray((n, *kind.shape), kind.base, blob, at))
            at += n * kind.itemsize
        if ragged is not None:
            found[-1].append(np.frombuffer(blob, ragged, -1, at))
    return [np.concatenate(f) for f in found]


def delivered(rows: DataFrame) -> DataFrame:
    """Each parcel whole and in a row."""
    return rows.repartition(partitions_for(rows.sparkSession), "parcel").sortWithinPartitions("parcel")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(number, blobs) of every parcel of a task."""
    now, blobs = None, []
    for batch in batches:
        for parcel, data in zip(batch.column("parcel").to_pylist(), batch.column("data"), strict=True):
            if parcel != now and blobs:
                yield now, blobs
                blobs = []
            now = parcel
            blobs.append(data.as_py())
    if blobs:
        yield now, blobs


def binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ragged values as a column of bytes, without a loop over its rows."""
    ends = np.r_[0, np.cumsum(sizes)] * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())
