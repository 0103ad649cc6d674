"""Extremely randomised trees: every forest of a fit looks at the columns through random cuts of its own.

A value is kept as its place between the cuts of all forests, two bytes, and rows are packed in blocks. All trees
of all folds grow together: a level is one pass over the blocks that sums rows and labels per open node, column
tried there and bin, and one small shuffle that adds the sums up. Their size follows trees, nodes, columns and
cuts, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordstack.constants import FOLD
from ordstack.models.boosting import Bins, Boosting, Tree, _best_split, _matrix, columns_tried
from ordstack.session import ship

BLOCKS = "folds binary, labels binary, places binary"
#: Rows of a task of small tables. Every task sends sums of every node, so of large tables the number of
#: tasks grows with the root of the rows.
TASK_ROWS = 100_000
ROOT_FROM = 36


@dataclass(frozen=True)
class Forest:
    """Trees of the given numbers, fitted on all train rows but those of ``fold``, seen through ``bins``."""

    fold: int
    bins: Bins
    numbers: tuple[int, ...]


def tasks_for(n_rows: int) -> int:
    """Partitions of the input, from its rows alone."""
    n = n_rows / TASK_ROWS
    return max(1, ceil(min(n, sqrt(n * ROOT_FROM))))


def _all_cuts(forests: Sequence[Forest]) -> list[np.ndarray]:
    width = len(forests[0].bins.sizes)
    return [np.unique(np.concatenate([g.bins.edges[f] for g in forests])) for f in range(width)]


def _bin_at(limits: Sequence[np.ndarray], bins: Bins) -> np.ndarray:
    """Per column, the bin of every place between all cuts."""
    out = np.zeros((len(limits), max(len(x) for x in limits) + 1), dtype=bins.dtype)
    for f, x in enumerate(limits):
        out[f, 1 : len(x) + 1] = np.searchsorted(bins.edges[f], x, side="right")
    return out


def _pack(train: DataFrame, limits: Sequence[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(2))
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            if np.isnan(labels).any() or np.isnan(rows).any():
                raise ValueError("a train row without a label or with a value that is not a number")
            folds = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint8)
            places = np.stack([np.searchsorted(x, rows[:, f], side="left") for f, x in enumerate(limits)])
            parts = (folds, labels.astype(np.float64), places.astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.tobytes()], pa.binary()) for p in parts], names=["folds", "labels", "places"]
            )

    slim = train.select(F.col(FOLD).cast("int"), "label", vector_to_array("features"))
    return slim.mapInArrow(run, BLOCKS)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one key added up, in the order they come in."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, k in enumerate(batch.column(0).to_pylist()):
            part = np.frombuffer(batch.column(2)[i].as_buffer(), np.float64)
            held[k] = held[k] + part if k in held else part.copy()
    made = [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(made, names=["k", "h"])


def _sums(
    state: DataFrame, forests: Sequence[Forest], trees: dict[int, Tree], tables: Sequence[np.ndarray], params: Boosting
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per tree the columns tried at each open node, and an array (2, node, column tried, bin) of rows and labels."""
    width = len(forests[0].bins.sizes)
    size = max(max(g.bins.sizes) for g in forests)
    picks = {j: np.array([columns_tried(params, width, j, node) for node in t.open]) for j, t in trees.items()}
    tried = next(iter(picks.values())).shape[1]

    def add(folds: np.ndarray, labels: np.ndarray, places: np.ndarray, held: dict[int, np.ndarray]) -> None:
        for g, table in zip(forests, tables):
            numbers = [j for j in g.numbers if j in trees]
            if not numbers:
                continue
            rows = np.flatnonzero((folds != g.fold) & (folds != 0))
            bins = np.stack([table[f].take(places[f].take(rows)) for f in range(width)])
            y, flat = labels[rows], bins.ravel()
            for j in numbers:
                tree = trees[j]
                slot = np.full(len(tree.feature), -1)
                slot[tree.open] = np.arange(len(tree.open))
                node = slot[tree.nodes(bins)]
                at = np.flatnonzero(node >= 0)
                node = node[at]
                first = picks[j].T[:, node] * len(rows) + at
                key = ((node * tried + np.arange(tried)[:, None]) * size + flat.take(first)).ravel()
                cells = len(tree.open) * tried * size
                held[j][0] += np.bincount(key, minlength=cells)
                held[j][1] += np.bincount(key, np.tile(y[at], tried), minlength=cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {j: np.zeros((2, len(t.open) * tried * size)) for j, t in trees.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(c)[i].as_buffer() for c in range(3)]
                folds, labels = np.frombuffer(raw[0], np.uint8), np.frombuffer(raw[1], np.float64)
                add(folds, labels, np.frombuffer(raw[2], np.uint16).reshape(width, -1), held)
        part = TaskContext.get().partitionId()
        for j, h in held.items():
            sums = pa.array([h.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([part], pa.int32()), sums], names=["k", "part", "h"])

    # added up in the order of the partitions, so that the same rows give the same trees
    made = state.mapInArrow(run, "k int, part int, h binary")
    total = made.repartition("k").sortWithinPartitions("k", "part").mapInArrow(_added, "k int, h binary").collect()
    found = {r["k"]: np.frombuffer(r["h"], np.float64) for r in total}
    return {j: (picks[j], found[j].reshape(2, -1, tried, size)) for j in trees if j in found}


def grow(train: DataFrame, forests: Sequence[Forest], params: Boosting) -> dict[int, Tree]:
    """All trees, level by level. ``train`` has ``fold``, ``label`` and ``features``; of ``params`` the depth,
    the least rows of a node, the columns tried and the seed count."""
    ship(train.sparkSession)
    limits = _all_cuts(forests)
    tables = [_bin_at(limits, g.bins) for g in forests]
    of = {j: g for g in forests for j in g.numbers}
    trees = {j: Tree() for j in of}
    width = len(limits)
    state = _pack(train, limits).persist(StorageLevel.MEMORY_AND_DISK)
    for depth in range(params.depth):
        still = {j: t for j, t in trees.items() if t.open}
        if not still:
            break
        for j, (pick, sums) in _sums(state, forests, still, tables, params).items():
            tree, fresh = still[j], []
            for at, node in enumerate(tree.open):
                full = np.zeros((width, sums.shape[3], 3))
                full[pick[at], :, 0] = full[pick[at], :, 1] = sums[0, at]
                full[pick[at], :, 2] = sums[1, at]
                if not depth:
                    n, s = sums[0, 0, 0].sum(), sums[1, 0, 0].sum()
                    tree.value[0] = s / n if n else 0.0
                found = _best_split(full, of[j].bins, params, j, node)
                if found is not None:
                    fresh += tree.split(node, *found)
                    tree.depth = depth + 1
            tree.open = fresh
    state.unpersist()
    return trees
