"""Linear SVMs by gradient steps, any number of settings over one pass per step.

A step moves the weights against the mean hinge-loss gradient by ``step / sqrt(t)`` after
shrinking them by the L2 penalty, from zero weights and without intercept, until they move
by less than ``TOLERANCE`` of their length. Settings that share a feature matrix share its
passes: their weights are the columns of one matrix, a task multiplies its rows by it, and a
column takes part only in the rows of its training folds. So the number of jobs grows with
the steps alone, not with settings or folds.

Rows are ``(label double, fold int, indices array<int>, values array<double>)``. Weights are
the only state of the driver; partial gradients are added up by blocks of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gullwatch.operators.sparse import add_blocks, column, column_blocks, slices

TOLERANCE = 0.001
#: Bytes of a weight matrix; more settings go through one after the other.
WEIGHT_BYTES = 32 << 20
#: Columns of the features whose sums travel together.
COLUMNS = 64

#: Fold of a setting that trains on all rows.
NO_FOLD = -1


@dataclass(frozen=True)
class Setting:
    reg: float
    step: float
    fold: int = NO_FOLD  # its rows are left out of training


def fold_frequencies(rows: DataFrame, dims: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows of each fold, and for each column those that hold it: ``(folds,), (dims, folds)``."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, folds))  # the last row counts rows
        for batch in batches:
            fold, label = _folds(batch), _labels(batch)
            for part in slices(batch):
                mine = ~np.isnan(label[part.start : part.end])
                member = (fold[part.start : part.end, None] == np.arange(folds)) & mine[:, None]
                total[part.columns] += (part.matrix != 0).T @ member.astype(float)
                total[dims] += member.sum(axis=0)
        yield from column_blocks(total, COLUMNS)

    total = _summed(rows, counts, dims + 1, folds)
    return total[dims], total[:dims]


def _folds(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "fold").to_numpy(zero_copy_only=False)


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    """1 or 0, NaN without a label."""
    return column(batch, "label").cast(pa.float64()).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, task, dims: int, width: int) -> np.ndarray:
    """Matrix of ``dims`` rows that the tasks give in blocks, added up by block before the driver."""
    parts = rows.mapInArrow(task, "block int, sums binary")
    added = parts.repartition("block").mapInArrow(add_blocks, "block int, sums binary")
    total = np.zeros((dims, width))
    for r in added.collect():  # the matrix itself, of at most WEIGHT_BYTES
        own = np.frombuffer(r.sums).reshape(-1, width)
        total[r.block * COLUMNS : r.block * COLUMNS + len(own)] += own
    return total


def _gradients(rows: DataFrame, weights: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """Sum of the hinge-loss gradients of every column of ``weights`` over its training rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, folds))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left_out = shared.value
        total = np.zeros_like(own)
        for batch in batches:
            fold, label = _folds(batch), _labels(batch)
            for part in slices(batch):
                here = slice(part.start, part.end)
                sign = 2 * label[here, None] - 1
                short = (1 > sign * (part.matrix @ own[part.columns])) & (fold[here, None] != left_out)  # never where the label is missing
                total[part.columns] += part.matrix.T @ np.where(short, -sign, 0.0)
        yield from column_blocks(total, COLUMNS)

    try:
        return _summed(rows, task, *weights.shape)
    finally:
        shared.unpersist()


def fit(rows: DataFrame, dims: int, settings: Sequence[Setting], scale: np.ndarray | None = None, max_iter: int = 100) -> np.ndarray:
    """Weights ``(dims, settings)``. ``scale`` ``(dims, settings)`` weights the features of each setting."""
    reg, step = (np.array([getattr(s, c) for s in settings], float) for c in ("reg", "step"))
    folds = np.array([s.fold for s in settings], np.int64)
    sizes = {r["fold"]: r["n"] for r in rows.where(F.col("label").isNotNull()).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a fold
    n = np.array([sum(v for k, v in sizes.items() if k != f) for f in folds], float)
    weights = np.zeros((dims, len(settings)))
    moving = np.flatnonzero(n > 0)
    for t in range(1, max_iter + 1):
        if not len(moving):
            break
        old = weights[:, moving]
        by = 1.0 if scale is None else scale[:, moving]
        slope = by * _gradients(rows, by * old, folds[moving]) / n[moving]
        size = step[moving] / np.sqrt(t)
        new = old * (1 - size * reg[moving]) - size * slope
        weights[:, moving] = new
        if t > 1:
            still = np.linalg.norm(new - old, axis=0) >= TOLERANCE * np.maximum(np.linalg.norm(new, axis=0), 1)
            moving = moving[still]
    return weights


def confusions(rows: DataFrame, weights: np.ndarray, settings: Sequence[Setting]) -> DataFrame:
    """``(setting, part, tp, fp, tn, fn)``: counts on the rows left out (test) and on the others (train).

    Without a label a row counts as negative, as everywhere.
    """
    shared = rows.sparkSession.sparkContext.broadcast((weights, np.array([s.fold for s in settings], np.int64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left_out = shared.value
        total = np.zeros((2, 4, len(left_out)), np.int64)
        for batch in batches:
            fold, label = _folds(batch), _labels(batch)
            for part in slices(batch):
                here = slice(part.start, part.end)
                said, actual = part.matrix @ own[part.columns] > 0, label[here, None] > 0
                test = fold[here, None] == left_out
                for k, quadrant in enumerate((said & actual, said & ~actual, ~said & ~actual, ~said & actual)):
                    total[0, k] += (quadrant & ~test).sum(axis=0)
                    total[1, k] += (quadrant & test).sum(axis=0)
        m = len(left_out)
        columns = [pa.array(np.tile(np.arange(m, dtype=np.int32), 2)), pa.array(["train"] * m + ["test"] * m)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(total[:, k].reshape(-1)) for k in range(4))], names=["setting", "part", "tp", "fp", "tn", "fn"])

    counted = rows.mapInArrow(task, "setting int, part string, tp long, fp long, tn long, fn long")
    return counted.groupBy("setting", "part").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")))


def shared_fits(dims: int) -> int:
    """Settings whose weights fit into ``WEIGHT_BYTES``."""
    return max(1, WEIGHT_BYTES // (8 * max(dims, 1)))
