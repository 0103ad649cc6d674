"""Stage-wise gradient boosting of regression trees, with an early stop that ends the fitting.

Rows are binned once: every feature gets at most ``bins`` ranges (or its categories), and blocks of train rows
are packed column by column, a byte a value; features that all folds share are packed once. A round grows one
tree per task on what the scores leave unexplained, all tasks (a fold, and for classifiers a target or class)
together and level by level: a level is one pass over the blocks that sums weights and steps per node, feature
and bin, and one small shuffle that adds the sums up. The driver sees those sums, whose size follows nodes,
features and bins, never rows.

After a block of rounds the losses on the held-out folds are measured in one pass, the tasks whose best round
lies ``patience`` rounds back stop, and the scores of the others, carried beside the rows, move on. A model is
cut to its best round by taking its first trees, so nothing is ever fitted twice, and a cut model is the model
of that many rounds.

Trees of classifiers are fitted to Newton steps, gradient over curvature weighted by curvature, so a leaf
holds the step of its rows. Packed blocks stay in memory or on local disks; a lost executor's are made again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordstack.constants import FOLD, IS_TEST, ROW_ID, SEED
from ordstack.functions.numeric import quoted
from ordstack.session import ship

PARALLEL = 8  # fits of other learners in flight; each is itself a series of Spark jobs
DRAWS = 1 << 20  # resolution of the share of rows a round sees
LEAST_CURVATURE = 1e-4
LARGEST_STEP = 4.0  # of a row of a classifier: steps of rare classes would be without a bound
LEAST_SHARE = 1e-9  # of a class, so that its logarithm exists
LEAST_GAIN = 1e-12  # of a split, as a share of what its node explains: below is rounding
REDUCERS = 16  # tasks that add up the sums of a pass, whose size does not follow the rows
#: Tasks whose scores a block holds, or those of one unit; with more there are blocks of the same rows for the others.
TASKS_EACH = 10
#: Trees of more nodes are walked row by row instead of by masks of whole blocks.
MASKED_NODES = 255
#: Rows that the limits of the bins are taken from, as MLlib does with 10,000; trees see all rows.
EDGE_ROWS = 40_000


@dataclass(frozen=True)
class Boosting:
    """Parameters of boosted jobs. ``patience`` rounds without a better loss end the fitting, looked at
    after every ``block`` rounds."""

    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    min_rows: int = 8
    subrow: float = 0.8
    subcol: str = "auto"
    bins: int = 64
    patience: int = 10
    block: int = 5
    seed: int = SEED

    def tried(self, width: int) -> int:
        """How many of the columns a node looks at, by the names MLlib has for it."""
        named = {"auto": width, "all": width, "sqrt": ceil(sqrt(width)), "onethird": ceil(width / 3),
                 "log2": max(1, ceil(log2(width)))}
        if self.subcol in named:
            return named[self.subcol]
        number = int(self.subcol) if self.subcol.isdigit() else ceil(float(self.subcol) * width)
        return min(width, max(1, number))


@dataclass(frozen=True)
class Task:
    """One sum of trees to fit: the fold left out (none for a fit on all train rows), the column of its
    label, and the tasks it stops with (its ``unit``)."""

    fold: int | None
    label: str = "label"
    unit: int = 0


# --- bins and trees -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Bins:
    """Per feature the upper limits of its bins but the last, or, of a category, none; and the numbers of bins."""

    edges: list[np.ndarray | None]
    sizes: list[int]

    @property
    def dtype(self) -> type:
        return np.uint8 if max(self.sizes, default=1) <= 256 else np.uint16

    def part(self, lines: Sequence[int]) -> Bins:
        return Bins([self.edges[at] for at in lines], [self.sizes[at] for at in lines])

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Bins of a matrix of rows, a line per feature."""
        out = np.empty((len(self.sizes), len(rows)), dtype=self.dtype)
        for f, (edges, size) in enumerate(zip(self.edges, self.sizes)):
            x = rows[:, f]
            out[f] = np.clip(x, 0, size - 1) if edges is None else np.searchsorted(edges, x, side="left")
        return out


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Limits between at most ``bins`` bins of about equal counts, half way between values."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    at = np.searchsorted(np.cumsum(counts), len(x) * np.arange(1, bins) / bins)
    at = np.unique(np.minimum(at, len(values) - 2))
    return (values[at] + values[at + 1]) / 2


@dataclass
class Tree:
    """Nodes of a tree: the feature an inner node splits on (-1: a leaf), which bins go left and, if those are
    the first ones, how many (-1: a set), the left child (the right one follows it), the value and the gain."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left: list[np.ndarray | None] = field(default_factory=lambda: [None])
    first: list[int] = field(default_factory=lambda: [-1])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0
    open: list[int] = field(default_factory=lambda: [0])  # nodes that may still be split

    def split(self, node: int, feature: int, left: np.ndarray, gain: float, values: tuple[float, float]) -> list[int]:
        at = len(self.feature)
        self.feature[node], self.left[node], self.child[node], self.gain[node] = feature, left, at, gain
        n = int(left.sum())
        self.first[node] = n if left[:n].all() else -1
        for v in values:
            for part, start in ((self.first, -1), (self.feature, -1), (self.left, None), (self.child, 0), (self.value, v), (self.gain, 0.0)):
                part.append(start)
        return [at, at + 1]

    def reached(self, lines: Sequence[np.ndarray], wanted: Sequence[int], use: np.ndarray) -> dict[int, np.ndarray]:
        """Per wanted node, which of the rows of ``use`` come by it; bytes 0 and 1."""
        parent = {c: i for i, at in enumerate(self.child) if self.feature[i] >= 0 for c in (at, at + 1)}
        on_way = set(wanted)
        for node in wanted:
            while node in parent:
                node = parent[node]
                on_way.add(node)
        masks = {0: use.view(np.uint8)}
        for node in sorted(on_way):  # children have higher numbers than their parents
            at = self.child[node]
            if self.feature[node] >= 0 and (at in on_way or at + 1 in on_way):
                line, n = lines[self.feature[node]], self.first[node]
                left = line < n if n >= 0 else self.left[node].take(line)  # a range needs one comparison
                masks[at] = masks[node] & left.view(np.uint8)
                masks[at + 1] = masks[node] ^ masks[at]
        return {node: masks[node] for node in wanted}

    def nodes(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        """The node each row ends in."""
        n = len(bins[0]) if len(bins) else 0
        if not self.depth:
            return np.zeros(n, dtype=np.int64)
        if len(self.feature) <= MASKED_NODES:
            leaves = [i for i, f in enumerate(self.feature) if f < 0]
            at = np.zeros(n, dtype=np.uint8)
            for node, mask in self.reached(bins, leaves, np.ones(n, dtype=bool)).items():
                at |= mask * np.uint8(node)
            return at
        bins, at = np.ascontiguousarray(bins), np.zeros(n, dtype=np.int64)
        feature, child = np.array(self.feature), np.array(self.child)
        width = max(len(m) for m in self.left if m is not None)
        right = np.zeros((len(feature), width), dtype=np.int64)
        for i, m in enumerate(self.left):
            if m is None:  # a leaf is its own child
                feature[i], child[i] = 0, i
            else:
                right[i, : len(m)] = ~m
        right += child[:, None]
        first, start, flat, rows = feature * n, np.arange(len(feature)) * width, bins.ravel(), np.arange(n)
        to = right.ravel()
        for _ in range(self.depth):
            at = to.take(start.take(at) + flat.take(first.take(at) + rows), mode="clip")
        return at

    def apply(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    """A fitted sum: ``base`` plus ``rate`` times each tree. ``losses`` is the curve of its unit."""

    base: float
    rate: float
    bins: Bins
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def cut(self, rounds: int) -> Boosted:
        return replace(self, trees=self.trees[:rounds])

    def apply(self, df: DataFrame, out: str, features: str = "features") -> DataFrame:
        """``df`` with the whole sum as ``out``."""
        return df.withColumn(out, F.get(sums_of([self], features), F.lit(0)))

    def importances(self) -> list[float]:
        """Gain per feature, shares of the total."""
        gains = np.zeros(len(self.bins.sizes))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gains[f] += g
        return (gains / (gains.sum() or 1.0)).tolist()


def sums_of(models: Sequence[Boosted], features: str = "features") -> Column:
    """An array column of the models' sums; rows are binned once per set of bins."""

    def run(values: pa.Array) -> pa.Array:
        rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        out, binned = np.empty((len(values), len(models))), {}
        for j, m in enumerate(models):
            if id(m.bins) not in binned:
                binned[id(m.bins)] = m.bins.of(rows)
            out[:, j] = m.base
            for t in m.trees:
                out[:, j] += m.rate * t.apply(binned[id(m.bins)])
        ends = np.arange(len(values) + 1, dtype=np.int32) * len(models)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(vector_to_array(features))


def sum_of_own(models: Sequence[Boosted], which: Column, features: Column) -> Column:
    """The sum of the one model whose place ``which`` gives (null without one), of an array of doubles."""

    def run(values: pa.Array, places: pa.Array) -> pa.Array:
        rows, at = _matrix(values), places.fill_null(-1).to_numpy(zero_copy_only=False)
        out = np.full(len(rows), np.nan)
        for j, m in enumerate(models):
            mine = np.flatnonzero(at == j)
            if len(mine):
                binned, sums = m.bins.of(rows[mine]), np.full(len(mine), m.base)
                for t in m.trees:
                    sums += m.rate * t.apply(binned)
                out[mine] = sums
        return pa.array(out, mask=(at < 0) | (at >= len(models)))

    run.__annotations__ = {"values": pa.Array, "places": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(features, which.cast("int"))


def best_of_curve(losses: Sequence[float], patience: int) -> int:
    """1-based round of the smallest loss before ``patience`` rounds pass without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def split_counts(spark, models: Sequence[Boosted], features: Sequence[str]) -> DataFrame:
    """``(name, n, share)``: how many inner nodes of the models split on each feature, and the share of all
    splits. Features without a split have 0."""
    counts = [0] * len(features)
    for m in models:
        for t in m.trees:
            for f in t.feature:
                if f >= 0:
                    counts[f] += 1
    total = max(1, sum(counts))
    rows = [(name, n, n / total) for name, n in zip(features, counts)]
    return spark.createDataFrame(rows, "name string, n bigint, share double")


# --- losses -------------------------------------------------------------------------------------


def _newton(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(p * (1 - p), LEAST_CURVATURE)
    return np.clip((y - p) / h, -LARGEST_STEP, LARGEST_STEP), h


def _log_sum_exp(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=0)
    return top + np.log(np.exp(scores - top).sum(axis=0))


def log_sum_exp(scores: Sequence[Column]) -> Column:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return top + F.log(sum((F.exp(s - top) for s in scores), F.lit(0.0)))


def _loss(kind: str, y: np.ndarray, s: np.ndarray) -> float:
    """Sum over rows; a line per task of the unit."""
    if kind == "squared":
        return float(((y[0] - s[0]) ** 2).sum())
    if kind == "logistic":
        # log(1 + exp(-s)) for label 1, written so that it never overflows
        z = np.where(y[0] > 0.5, -s[0], s[0])
        return float((np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))).sum())
    return float((_log_sum_exp(s) - (y * s).sum(axis=0)).sum())


# --- packed rows --------------------------------------------------------------------------------


@dataclass
class _Block:
    """Some train rows for a group of tasks: fold (0: none), hash of the id, a line per label of the group, per packed
    feature, per task of it and, of classes, per unit the logarithm of the sum of exponentials of its scores."""

    group: int
    folds: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    bins: np.ndarray
    scores: np.ndarray
    whole: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _small(labels: np.ndarray) -> np.ndarray:
    """Whole labels as bytes."""
    short = np.clip(labels, 0, 255).astype(np.uint8)
    return short if (short == labels).all() else labels


def _drawn(ids: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """The rows a round sees: a mixed hash of the row's, the seed and the round below the share."""
    if share >= 1:
        return np.ones(len(ids), dtype=bool)
    with np.errstate(over="ignore"):
        x = ids + np.uint64((seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x % np.uint64(DRAWS) < int(share * DRAWS)


def _added(sums: Iterator[tuple[tuple[int, int], tuple[np.ndarray, ...]]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sums of one key added up, in the order they come in."""
    held: dict[int, list[np.ndarray]] = {}
    for (k, _), parts in sums:
        if k in held:
            for whole, part in zip(held[k], parts):
                whole += part
        else:
            held[k] = [p.astype(np.int64 if p.dtype.kind == "i" else np.float64) for p in parts]
    yield from held.items()


# --- fitting ------------------------------------------------------------------------------------


class Stagewise:
    """Fits ``tasks`` over ``data`` (row id, fold, test flag, labels, ``features``). With ``own`` the model of a
    fold sees, after these, the features that ``own`` gives for the fold, an array of doubles.

    ``kind`` is ``squared``, ``logistic`` (label 0 or 1) or ``softmax``: the tasks of a unit are then the
    classes, and their labels must add up to 1 in every row. With ``partitions`` rows are dealt into that many
    by a hash of their id once they are packed, a byte a value; without, they are taken as they lie.
    """

    def __init__(
        self,
        data: DataFrame,
        tasks: Sequence[Task],
        params: Boosting,
        kind: str = "squared",
        own: Callable[[int | None], Column] | None = None,
        partitions: int | None = None,
    ):
        self.tasks, self.kind = list(tasks), kind
        # classes are looked at after every round
        self.params = replace(params, block=1) if kind == "softmax" else params
        self.spark = data.sparkSession
        ship(self.spark)
        self.labels = sorted({t.label for t in self.tasks})
        self.units = sorted({t.unit for t in self.tasks})
        folds = list(dict.fromkeys(t.fold for t in self.tasks)) if own else []
        self.set_of = [folds.index(t.fold) if own else 0 for t in self.tasks]
        arrays = [vector_to_array("features"), *[own(f) for f in folds]]
        train = data.filter(~F.col(IS_TEST))
        self.groups: list[list[int]] = []  # of tasks: units one after the other, until there are enough
        for u in self.units:
            if not self.groups or len(self.groups[-1]) >= TASKS_EACH:
                self.groups.append([])
            self.groups[-1] += self._unit(u)
        counts, bases = self._bases(train)
        self.packed, self.lines = self._lines(train, arrays, sum(counts.values()))
        parts = [self.packed.part(lines) for lines in self.lines]
        self.models = [Boosted(b, self.params.rate, parts[s]) for b, s in zip(bases, self.set_of)]
        self.done = [0 for _ in self.tasks]  # trees whose part is in the carried scores
        self.grown: dict[int, Tree] = {}
        self.state: RDD | None = None
        self.passed: RDD | None = None  # blocks that the next pass makes the new ones from
        self.above: dict[int, list[tuple[np.ndarray, int]]] = {}  # per pair of open nodes: rows of both, the smaller
        self._keep(self._pack(train, arrays, partitions))

    def _bases(self, train: DataFrame) -> tuple[dict[int | None, int], list[float]]:
        """Rows per fold, and the start of every sum: the mean, or its (log) odds, of the task's train rows."""
        sums = [F.sum(quoted(c).cast("double")).alias(f"s{i}") for i, c in enumerate(self.labels)]
        rows = train.groupBy(FOLD).agg(F.count("*").alias("n"), *sums).collect()
        made = []
        for t in self.tasks:
            mine = [r for r in rows if r[FOLD] != t.fold]
            n = sum(r["n"] for r in mine)
            if not n:
                raise ValueError(f"no rows to fit on outside fold {t.fold}")
            mean = sum(r[f"s{self.labels.index(t.label)}"] or 0.0 for r in mine) / n
            share = min(max(mean, LEAST_SHARE), 1 - LEAST_SHARE)
            made.append({"squared": mean, "logistic": log(share / (1 - share)), "softmax": log(share)}[self.kind])
        return {r[FOLD]: r["n"] for r in rows}, made

    def _lines(self, train: DataFrame, arrays: Sequence[Column], n: int) -> tuple[Bins, list[list[int]]]:
        """Bins of all packed features, and per set of features which of them it sees. Categories declared in
        the metadata keep theirs."""
        attrs = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
        categories = {a["idx"]: a["num_vals"] if "num_vals" in a else len(a["vals"]) for a in attrs}
        some = train.filter(F.pmod(F.xxhash64(F.lit(self.params.seed), F.col(ROW_ID)), F.lit(n)) < EDGE_ROWS)
        table = some.select(*[a.alias(f"v{i}") for i, a in enumerate(arrays)]).toArrow()
        matrices = [_matrix(c.combine_chunks()) for c in table.columns]
        rows, common = np.hstack(matrices), matrices[0].shape[1]
        edges = [None if f in categories else edges_of(rows[:, f], self.params.bins) for f in range(rows.shape[1])]
        lines, at = [], common
        for m in matrices[1:]:
            lines.append([*range(common), *range(at, at + m.shape[1])])
            at += m.shape[1]
        packed = Bins(edges, [categories[f] if e is None else len(e) + 1 for f, e in enumerate(edges)])
        return packed, lines or [list(range(common))]

    def _pack(self, train: DataFrame, arrays: Sequence[Column], partitions: int | None) -> RDD:
        packed, bases, whole, groups = self.packed, np.array([m.base for m in self.models]), self._whole(), self.groups
        width, size = len(packed.sizes), len(packed.sizes) * np.dtype(packed.dtype).itemsize
        needed = [sorted({self.labels.index(self.tasks[j].label) for j in g}) for g in groups]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                if np.isnan(_matrix(batch.column(3))).any():
                    raise ValueError("a train row without a label")
                bins = packed.of(np.hstack([_matrix(c) for c in batch.columns[4:]]))
                ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size))
                held = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(bins.T.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], held], names=[*batch.schema.names[:4], "bins"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), packed.dtype).reshape(n, width)
                made = _Block(
                    0,
                    batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint8),
                    batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
                    _small(np.ascontiguousarray(_matrix(batch.column(3)).T)),
                    np.ascontiguousarray(bins.T),
                    np.empty((0, 0)),
                    np.empty((0, 0)),
                )
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.binary())], names=["block"])

        missing = F.lit(float("nan"))
        labels = F.array(*[F.coalesce(quoted(c).cast("double"), missing) for c in self.labels])
        keys = [F.col(ROW_ID), F.xxhash64(ROW_ID).alias("id"), F.col(FOLD).cast("int").alias("fold"), labels.alias("y")]
        slim = train.select(*keys, *[a.alias(f"v{i}") for i, a in enumerate(arrays)])
        schema = StructType(slim.schema.fields[:4]).add("bins", "binary")
        made = slim.mapInArrow(rows, schema)
        if partitions:
            made = made.repartition(partitions, ROW_ID).sortWithinPartitions(ROW_ID)
        base = made.mapInArrow(blocks, "block binary").rdd

        def of_group(g: int) -> Callable:
            def start(row) -> _Block:
                b = pickle.loads(row[0])
                scores = np.repeat(bases[groups[g], None], len(b.ids), axis=1)
                return replace(b, group=g, labels=b.labels[needed[g]], scores=scores, whole=whole(g, scores))

            return start

        # partitions of a group follow those of the one before: a task's rows keep their order
        parts = [base.map(of_group(g)) for g in range(len(groups))]
        return parts[0] if len(parts) == 1 else self.spark.sparkContext.union(parts)

    def _whole(self) -> Callable[[int, np.ndarray], np.ndarray]:
        """Of classes, a line per unit of a group; otherwise none."""
        if self.kind != "softmax":
            return lambda g, scores: np.empty((0, 0))
        line = self._places()[0]
        units = [[[line[j] for j in self._unit(u)] for u in dict.fromkeys(self.tasks[j].unit for j in g)] for g in self.groups]
        return lambda g, scores: np.stack([_log_sum_exp(scores[js]) for js in units[g]])

    def _places(self) -> tuple[list[int], list[int], list[int]]:
        """Per task its lines among the scores, labels and units of its group."""
        line, label, unit = ([0] * len(self.tasks) for _ in range(3))
        for g in self.groups:
            labels = sorted({self.tasks[j].label for j in g})
            units = list(dict.fromkeys(self.tasks[j].unit for j in g))
            for i, j in enumerate(g):
                line[j], label[j], unit[j] = i, labels.index(self.tasks[j].label), units.index(self.tasks[j].unit)
        return line, label, unit

    def _keep(self, state: RDD) -> None:
        """The blocks from now on, held in memory or on local disks. The next pass makes them, then those they
        come from go."""
        self.passed, self.state = self.state, state.persist(StorageLevel.MEMORY_AND_DISK)

    def _totals(self, run: Callable[[int, Iterator[_Block]], Iterator], keys: int) -> dict[int, list[np.ndarray]]:
        """What ``run`` yields, arrays under one of ``keys`` keys and the number of the partition, added up by key
        in the order of the partitions, so that the same rows give the same trees."""
        made = self.state.mapPartitionsWithIndex(run, preservesPartitioning=True)
        n = min(made.getNumPartitions(), keys, REDUCERS)
        total = dict(made.repartitionAndSortWithinPartitions(n, lambda k: k[0]).mapPartitions(_added).collect())
        if self.passed is not None:
            self.passed.unpersist()
            self.passed = None
        return total

    def release(self) -> None:
        for x in (self.passed, self.state):
            if x is not None:
                x.unpersist()

    def _unit(self, unit: int) -> list[int]:
        return [j for j, t in enumerate(self.tasks) if t.unit == unit]

    def _mover(self) -> Callable[[_Block], np.ndarray]:
        """Scores of a block by all trees there are: what is carried and the part of the trees since."""
        rate, set_of, lines, groups = self.params.rate, self.set_of, self.lines, self.groups
        new = {j: m.trees[self.done[j] :] for j, m in enumerate(self.models) if len(m.trees) > self.done[j]}

        def moved(b: _Block) -> np.ndarray:
            if not new:
                return b.scores
            scores, seen = b.scores.copy(), [[b.bins[at] for at in part] for part in lines]
            for i, j in enumerate(groups[b.group]):
                for t in new.get(j, []):
                    scores[i] += rate * t.apply(seen[set_of[j]])
            return scores

        return moved

    def _sums(self, trees: dict[int, Tree], number: int) -> dict[int, np.ndarray]:
        """Per task an array (open node, feature, bin, 3): rows, weights and weighted steps. One pass. Of two children
        the rows of the smaller one are counted; the other has the rest of their parent's."""
        p, kind, lines, set_of, tasks = self.params, self.kind, self.lines, self.set_of, self.tasks
        (at_line, at_label, at_unit), groups = self._places(), self.groups
        sizes = [[self.packed.sizes[at] for at in part] for part in lines]
        starts = [np.cumsum([0, *x]) for x in sizes]
        moved, whole_of, plain = self._mover(), self._whole(), kind == "squared"
        # places of the open nodes, those to be counted first
        order = {j: [2 * i + c for i, (_, c) in enumerate(self.above.get(j, []))] for j in trees}
        counted = {j: len(x) or len(trees[j].open) for j, x in order.items()}
        order = {j: x + [i ^ 1 for i in x] or list(range(len(trees[j].open))) for j, x in order.items()}

        def block_sums(b: _Block, held: dict[int, tuple[np.ndarray, ...]]) -> None:
            drawn, scores = _drawn(b.ids, p.seed, number, p.subrow), moved(b)
            whole = b.whole if scores is b.scores else whole_of(b.group, scores)
            seen, across, wide = [[b.bins[at] for at in part] for part in lines], {}, [max(x, default=1) for x in sizes]
            use_of = {f: drawn if f is None else drawn & (b.folds != f) & (b.folds != 0) for f in {tasks[j].fold for j in held}}
            roots = {}  # classes of a fold have their roots' rows in common

            def looked_at(j: int) -> tuple:
                """Rows of the task's open nodes in their order, the cells they fall in and the counts per feature."""
                t, nodes, part = tasks[j], [trees[j].open[i] for i in order[j]], set_of[j]
                masks = trees[j].reached(seen[part], nodes, use_of[t.fold])
                inside = [np.flatnonzero(masks[node].view(bool)) for node in nodes]
                rows, first = np.concatenate(inside), sum(len(x) for x in inside[: counted[j]])
                if part not in across:  # a row's bins side by side: rows are picked by copies of whole rows
                    across[part] = np.ascontiguousarray(b.bins[lines[part]].T)
                picked = np.ascontiguousarray(across[part].take(rows, axis=0).T)
                at = np.repeat(np.arange(len(nodes)) * wide[part], [len(x) for x in inside])
                cells = counted[j] * wide[part]
                keys = (at + line for line in picked)
                return rows, ((key, np.bincount(key[:first], minlength=cells)) for key in keys)

            for j in held:
                t, part = tasks[j], set_of[j]
                if trees[j].depth or plain:
                    rows, keys = looked_at(j)
                else:
                    if (t.fold, part) not in roots:
                        roots.clear()
                        rows, keys = looked_at(j)
                        roots[t.fold, part] = rows, list(keys)
                    rows, keys = roots[t.fold, part]
                y, s = b.labels[at_label[j]].take(rows), scores[at_line[j]].take(rows)
                if plain:
                    step, weight = y - s, None
                else:
                    share = 1 / (1 + np.exp(-s)) if kind == "logistic" else np.exp(s - whole[at_unit[j]].take(rows))
                    step, weight = _newton(y, share)
                    step = step * weight
                cells = len(trees[j].open) * wide[part]
                for (key, n), size, start in zip(keys, sizes[part], starts[part]):
                    to = slice(start, start + size)
                    held[j][0][:, to] += n.reshape(-1, wide[part])[:, :size]
                    held[j][1][:, to] += np.bincount(key, step, minlength=cells).reshape(-1, wide[part])[:, :size]
                    if not plain:
                        held[j][2][:, to] += np.bincount(key, weight, minlength=cells).reshape(-1, wide[part])[:, :size]

        def run(part: int, blocks: Iterator[_Block]) -> Iterator:
            held = {}
            for b in blocks:
                for j in (j for j in groups[b.group] if j in trees and j not in held):
                    width = starts[set_of[j]][-1]
                    sums = [np.zeros((len(trees[j].open), width)) for _ in range(1 if plain else 2)]
                    held[j] = (np.zeros((counted[j], width), np.int32), *sums)
                block_sums(b, held)
            for j, sums in held.items():
                yield (j, part), sums

        found, out = self._totals(run, len(trees)), {}
        for j, tree in trees.items():
            here, above = sizes[set_of[j]], self.above.get(j, [])
            out[j] = np.zeros((len(tree.open), len(here), max(here), 3))
            if j in found:
                filled = np.concatenate([np.arange(size) + f * max(here) for f, size in enumerate(here)])
                flat, first = out[j].reshape(len(tree.open), -1, 3), order[j][: counted[j]]
                flat[np.ix_(first, filled, [0])] = found[j][0][:, :, None]
                for i, (whole, c) in enumerate(above):
                    out[j][2 * i + 1 - c, :, :, 0] = whole - out[j][2 * i + c, :, :, 0]
                flat[np.ix_(order[j], filled, [2])] = found[j][1][:, :, None]
                if plain:
                    out[j][..., 1] = out[j][..., 0]
                else:
                    flat[np.ix_(order[j], filled, [1])] = found[j][2][:, :, None]
        return out

    def _grow(self, todo: Sequence[int], number: int) -> None:
        """The trees of one round, level by level."""
        p = self.params
        self.grown = {j: Tree() for j in todo}
        for depth in range(p.depth):
            still = {j: t for j, t in self.grown.items() if t.open}
            if not still:
                break
            for j, sums in self._sums(still, number).items():
                tree, fresh, self.above[j] = still[j], [], []
                if not depth:
                    n, w, s = sums[0][0].sum(axis=0)
                    tree.value[0] = s / w if w else 0.0
                splits = _best_splits(sums, self.models[j].bins, p, number, tree.open)
                for at, (node, found) in enumerate(zip(tree.open, splits)):
                    if found is not None:
                        fresh += tree.split(node, *found)
                        tree.depth = depth + 1
                        rows = sums[at, :, :, 0]
                        right = 2 * rows[found[0]][found[1]].sum() > rows[found[0]].sum()
                        self.above[j].append((rows, int(right)))
                tree.open = fresh
        self.above = {}

    def _fit_tree(self, j: int, number: int) -> Tree:
        """The tree of a task that a round has grown."""
        return self.grown.pop(j)

    def _losses(self, active: Sequence[int]) -> dict[int, list[float]]:
        """Per active unit, the loss on its held-out fold after each round of the block. One pass."""
        kind, lines, set_of, rate = self.kind, self.lines, self.set_of, self.params.rate
        units = {u: self._unit(u) for u in active}
        if kind != "softmax":  # one label, one sum: the first task of a unit has the curve
            units = {u: js[:1] for u, js in units.items()}
        fold_of = {u: self.tasks[js[0]].fold for u, js in units.items()}
        (at_line, at_label, _), groups = self._places(), self.groups
        new = {j: self.models[j].trees[self.done[j] :] for js in units.values() for j in js}
        rounds = {u: max(len(new[j]) for j in js) for u, js in units.items()}

        def run(part: int, blocks: Iterator[_Block]) -> Iterator:
            held = {}
            for b in blocks:
                for u, js in ((u, js) for u, js in units.items() if js[0] in groups[b.group]):
                    held.setdefault(u, (np.zeros(rounds[u], np.int64), np.zeros(rounds[u])))
                    rows = np.flatnonzero(b.folds == fold_of[u])
                    if not len(rows):
                        continue
                    seen = [b.bins[at].take(rows) for at in lines[set_of[js[0]]]]
                    y, s = b.labels[[at_label[j] for j in js]][:, rows], b.scores[[at_line[j] for j in js]][:, rows]
                    for r in range(rounds[u]):
                        for i, j in enumerate(js):
                            if r < len(new[j]):
                                s[i] += rate * new[j][r].apply(seen)
                        held[u][0][r] += len(rows)
                        held[u][1][r] += _loss(kind, y, s)
            for u, sums in held.items():
                yield (u, part), sums

        found = self._totals(run, len(units))
        none = {u: [float("inf")] * n for u, n in rounds.items()}
        return none | {u: [x / n if n else float("inf") for n, x in zip(*sums)] for u, sums in found.items()}

    def _carry(self) -> None:
        moved, whole_of = self._mover(), self._whole()

        def run(blocks: Iterator[_Block]) -> Iterator[_Block]:
            for b in blocks:
                scores = moved(b)
                yield replace(b, scores=scores, whole=whole_of(b.group, scores))

        self._keep(self.state.mapPartitions(run, preservesPartitioning=True))
        self.done = [len(m.trees) for m in self.models]

    def fit(self, stop: bool = True, by: int | None = None) -> list[Boosted]:
        """The models of all tasks. With ``stop`` each unit ends by its curve and is cut to its best round, or,
        with ``by``, all by the curve of that unit; otherwise all rounds are fitted."""
        p = self.params
        active = sorted({t.unit for t in self.tasks})
        curves: dict[int, list[float]] = {u: [] for u in active}
        judge = dict.fromkeys(active, by) if by is not None else {u: u for u in active}
        fitted = 0
        while active and fitted < p.rounds:
            for _ in range(min(p.block, p.rounds - fitted)):
                fitted += 1
                # a class without rows keeps its start: there is nothing to split on
                todo = [j for u in active for j in self._unit(u) if self._worth(j)]
                self._grow(todo, fitted)
                for j in todo:
                    self.models[j].trees.append(self._fit_tree(j, fitted))
            if stop:
                for u, found in self._losses(sorted({judge[u] for u in active})).items():
                    curves[u] += found
                active = [u for u in active if fitted - best_of_curve(curves[judge[u]], p.patience) < p.patience]
            if active and fitted < p.rounds:
                self._carry()
        out = []
        for j, t in enumerate(self.tasks):
            curve = curves[judge[t.unit]]
            best = best_of_curve(curve, p.patience) if stop and curve else fitted
            out.append(replace(self.models[j].cut(best), losses=curve))
        self.release()
        return out

    def _worth(self, j: int) -> bool:
        return self.kind != "softmax" or self.models[j].base > log(2 * LEAST_SHARE)


def columns_tried(params: Boosting, width: int, number: int, node: int) -> np.ndarray:
    """The columns a node of the tree ``number`` looks at."""
    tried = params.tried(width)
    if tried == width:
        return np.arange(width)
    return np.random.default_rng([params.seed + number, node]).choice(width, tried, replace=False)


def _best_split(
    sums: np.ndarray, bins: Bins, params: Boosting, number: int, node: int
) -> tuple[int, np.ndarray, float, tuple[float, float]] | None:
    """Feature, bins that go left, gain and values of both sides of a node's best split, if it has one.
    Categories are put in the order of their means, which holds the best set of them."""
    return _best_splits(sums[None], bins, params, number, [node])[0]


def _best_splits(
    sums: np.ndarray, bins: Bins, params: Boosting, number: int, nodes: Sequence[int]
) -> list[tuple[int, np.ndarray, float, tuple[float, float]] | None]:
    """The best split of each of some nodes of a tree, looked for together."""
    many, width, size, _ = sums.shape
    sets, order = [f for f, e in enumerate(bins.edges) if e is None], None
    if sets:
        order = np.tile(np.arange(size), (many, width, 1))
        for f in sets:
            n, w, s = np.moveaxis(sums[:, f], -1, 0)
            order[:, f] = np.argsort(np.where(n > 0, s / np.where(w > 0, w, 1.0), np.inf), axis=1, kind="stable")
    parts = [sums[..., i] if order is None else np.take_along_axis(sums[..., i], order, axis=2) for i in range(3)]
    n, w, s = (np.cumsum(x, axis=2) for x in parts)
    rest_n, rest_w, rest_s = n[..., -1:] - n, w[..., -1:] - w, s[..., -1:] - s
    fits = (n >= max(1, params.min_rows)) & (rest_n >= max(1, params.min_rows)) & (w > 0) & (rest_w > 0)
    if params.tried(width) < width:
        for i, node in enumerate(nodes):
            fits[i, np.setdiff1d(np.arange(width), columns_tried(params, width, number, node))] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        explained = np.where(fits, s * s / w + rest_s * rest_s / rest_w, -np.inf).reshape(many, -1)
    out, best = [], np.argmax(explained, axis=1)
    for i, at in enumerate(best):
        if not np.isfinite(explained[i, at]) and not fits[i].any():
            out.append(None)
            continue
        f, k = divmod(int(at), size)
        gain = explained[i, at] - s[i, f, -1] ** 2 / w[i, f, -1]
        if not gain > LEAST_GAIN * explained[i, at]:
            out.append(None)
            continue
        left = np.zeros(size, dtype=bool)
        left[np.arange(k + 1) if order is None else order[i, f, : k + 1]] = True
        out.append((f, left, float(gain), (float(s[i, f, k] / w[i, f, k]), float(rest_s[i, f, k] / rest_w[i, f, k]))))
    return out
