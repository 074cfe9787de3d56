"""Numpy work on the rows of one task: moments of blends, and places and orders of mixed scores.

Spark deals the rows and sums what tasks return. The functions are shipped by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]


def numbers(batch, name: str) -> np.ndarray:
    """A column as doubles, NaN where it is missing."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def labels(batch, name: str) -> np.ndarray:
    """A column of whole numbers, 0 where it is missing."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def missing(batch, names: Sequence[str]) -> np.ndarray:
    found = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        found |= np.asarray(batch.column(name).is_null().to_numpy(zero_copy_only=False)) if batch.column(name).null_count else False
    return found


def moment_sums(weights: np.ndarray, eps: float) -> Callable[[Batches], Batches]:
    """(``training``, ``n``, ``sums``) of a task: loss, slopes and packed curvature, summed over the training rows of every fold."""
    k, free = weights.shape
    low = np.tril_indices(free)

    def run(batches: Batches) -> Batches:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, 1 + free + len(low[0])))
        for batch in batches:
            fold, y = labels(batch, "fold"), numbers(batch, "y")
            values = np.column_stack([numbers(batch, f"m{i}") for i in range(free + 1)])
            last, slopes = values[:, -1], values[:, :-1] - values[:, -1:]
            for f in range(k):
                training = fold != f
                own, t = slopes[training], y[training]
                blend = last[training] + own @ weights[f]
                with np.errstate(all="ignore"):
                    # As in SQL, NaN is the largest number.
                    b = np.where(np.isnan(blend), 1.0 - eps, np.clip(blend, eps, 1.0 - eps))
                    inner = (blend > eps) & (blend < 1.0 - eps)
                    first = np.where(inner, (b - t) / (b * (1.0 - b)), 0.0)
                    second = np.where(inner, t / (b * b) + (1.0 - t) / ((1.0 - b) * (1.0 - b)), 0.0)
                    loss = -(t * np.log(b) + (1.0 - t) * np.log(1.0 - b))
                n[f] += len(t)
                sums[f, 0] += loss.sum()
                sums[f, 1 : 1 + free] += first @ own
                sums[f, 1 + free :] += (own.T @ (own * second[:, None]))[low]
        seen = np.flatnonzero(n)
        if len(seen):
            columns = [pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64()), pa.array([list(x) for x in sums[seen]], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["training", "n", "sums"])

    return run


@dataclass(frozen=True)
class Placing:
    """Cells of the mixed scores of two members for the weights to try."""

    members: tuple[str, str]
    max_weight: float
    steps: int
    low: float
    high: float
    cells: int

    def columns(self, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return *(numbers(batch, c) for c in self.members), missing(batch, self.members)

    def mix(self, candidate: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        w = candidate * self.max_weight / float(self.steps)
        with np.errstate(all="ignore"):
            return (1.0 - w) * first + w * second

    def cell(self, candidate: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Cell of the mixed score, 0 for the highest; missing scores, NaN here, come last. It never rises with the score."""
        mixed, last = self.mix(candidate, first, second), self.cells - 1.0
        with np.errstate(all="ignore"):
            if self.high > self.low:
                place = (self.high - mixed) * (self.cells / (self.high - self.low))
                place = np.where(mixed == np.inf, 0.0, place)
            else:
                place = np.where(mixed > self.high, 0.0, np.where(mixed < self.low, last, 1.0))
            place = np.where(np.isnan(mixed) | np.isnan(place), last, np.clip(place, 0.0, last))
        return np.floor(place).astype(np.int32)


def runs(placing: Placing, bucket_of_cell: np.ndarray, candidates: Sequence[int]) -> Callable[[Batches], Batches]:
    """Rows once per bucket that they visit, with ``bucket``, ``start`` and ``stop``, the run of candidates for which they do."""
    bucket_of_cell = np.asarray(bucket_of_cell, dtype=np.int32)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second, _ = placing.columns(batch)
            visits = np.stack([bucket_of_cell[placing.cell(c, first, second)] for c in candidates], axis=1)
            starts = np.ones(visits.shape, dtype=bool)
            starts[:, 1:] = visits[:, 1:] != visits[:, :-1]
            row, start = np.nonzero(starts)
            stop = np.append(start[1:] - 1, len(candidates) - 1)
            stop[np.append(row[1:] != row[:-1], True)] = len(candidates) - 1
            moved = batch.take(pa.array(row))
            more = [pa.array(x, pa.int32()) for x in (visits[row, start], start, stop)]
            yield pa.RecordBatch.from_arrays([*moved.columns, *more], [*moved.schema.names, "bucket", "start", "stop"])

    return run


def counts(placing: Placing, bucket_of_cell: np.ndarray, candidates: Sequence[int], label: str) -> Callable[[Batches], Batches]:
    """(``at``, ``bucket``, ``n``, ``p``) of a task: rows and positives per candidate and bucket."""
    bucket_of_cell = np.asarray(bucket_of_cell, dtype=np.int32)
    buckets = int(bucket_of_cell.max()) + 1

    def run(batches: Batches) -> Batches:
        n, p = (np.zeros((len(candidates), buckets), dtype=np.int64) for _ in range(2))
        for batch in batches:
            first, second, _ = placing.columns(batch)
            y = labels(batch, label).astype(float)
            for at, c in enumerate(candidates):
                bucket = bucket_of_cell[placing.cell(c, first, second)]
                n[at] += np.bincount(bucket, minlength=buckets)
                p[at] += np.bincount(bucket, weights=y, minlength=buckets).astype(np.int64)
        for at in range(len(candidates)):
            bucket = np.flatnonzero(n[at])
            if len(bucket):
                columns = [pa.array(np.full(len(bucket), at), pa.int32()), pa.array(bucket, pa.int32()), pa.array(n[at][bucket]), pa.array(p[at][bucket])]
                yield pa.RecordBatch.from_arrays(columns, ["at", "bucket", "n", "p"])

    return run


def ordered(
    placing: Placing, id: str, label: str, candidates: Sequence[int], before: np.ndarray, negative_weight: int, weight: int, limit: int
) -> Callable[[tuple, pa.Table], pa.Table]:
    """(``at``, ``area``, ``caught``) of the rows of one bucket, ordered by mixed score and id for every candidate.

    ``area`` sums the weight at or after each positive, ``caught`` counts the positives within the first ``limit`` of the weight.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[(id, "ascending")], null_placement="at_start")).drop_columns([id])
        (first, second, absent), y = placing.columns(table), labels(table, label)
        start, stop = labels(table, "start"), labels(table, "stop")
        found = []
        for at, c in enumerate(candidates):
            here = (start <= at) & (at <= stop)
            if not here.any():
                continue
            falling = np.where(absent, np.inf, -placing.mix(c, first, second))[here]
            # Rows stand in the order of their ids, and equal scores keep it.
            own = y[here][np.argsort(falling, kind="stable")]
            p = np.cumsum(own)
            r = np.arange(1, len(own) + 1)
            passed = (int(before[at, bucket]) + negative_weight * (r - p) + p)[own == 1]
            found.append((at, int((weight + 1 - passed).sum()), int((passed <= limit).sum())))
        return pa.Table.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["at", "area", "caught"])

    return run
