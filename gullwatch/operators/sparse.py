"""Sparse vectors as plain columns, and as small matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of one matrix inside a task.
CELLS = 1 << 22


def entries(vector: str) -> list[Column]:
    """``indices array<int>, values array<double>`` of an ML vector column, sparse or dense."""
    plain = F.unwrap_udt(F.col(vector))
    every = F.when(F.size(plain["values"]) > 0, F.sequence(F.lit(0), F.size(plain["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return [F.coalesce(plain["indices"], every).alias("indices"), plain["values"].alias("values")]


class Slice(NamedTuple):
    """Rows ``start`` to ``end`` of a batch over the columns ``columns`` that they use."""

    start: int
    end: int
    columns: np.ndarray
    matrix: np.ndarray


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, cells: int = CELLS) -> Iterator[Slice]:
    """The rows of a batch with ``indices`` and ``values`` in dense pieces of at most ``cells`` numbers, one row at least."""
    lists = column(batch, "indices")
    at = lists.offsets.to_numpy().astype(np.int64)
    indices, values = lists.flatten().to_numpy(), column(batch, "values").flatten().to_numpy()
    at = at - at[0]
    start = 0
    while start < batch.num_rows:
        end = min(batch.num_rows, start + 1024)
        while True:
            used, place = np.unique(indices[at[start] : at[end]], return_inverse=True)
            if (end - start) * max(len(used), 1) <= cells or end == start + 1:
                break
            end = start + max(1, (end - start) // 2)
        matrix = np.zeros((end - start, len(used)))
        np.add.at(matrix, (np.repeat(np.arange(end - start), np.diff(at[start : end + 1])), place), values[at[start] : at[end]])
        yield Slice(start, end, used, matrix)
        start = end


def column_blocks(total: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``total`` that are not zero, ``width`` of them to a row ``(block, sums)``."""
    for block in range(-(-len(total) // width)):
        own = total[block * width : (block + 1) * width]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "sums"])


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a partition: the sum of its rows."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(sums)
            total[block] = total[block] + own if block in total else own
    for block, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "sums"])
