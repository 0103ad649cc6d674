"""Dense embeddings of sparse one-hot rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordstack.constants import IS_TEST, ROW_ID, SEED, TARGET
from ordstack.functions.numeric import quoted
from ordstack.session import ship, store

MAX_COLUMNS = 4096  # of the learned embedding: its solver holds a square matrix on the driver


def _placed(idx: int, k: int, seed: int) -> tuple[int, int]:
    """Component and sign of a column index."""
    digest = md5(f"{seed}:{idx}".encode()).hexdigest()
    return int(digest[:8], 16) % k, -1 if int(digest[8], 16) % 2 else 1


def project(rows: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """The columns of ``rows`` but ``cells``, then ``e_0 .. e_<k-1>``: a seeded sparse projection of
    ``cells``, an array of ``(idx, value)``.

    Every column index is hashed to one of ``k`` components and a sign; a component is the signed sum
    of its cells, so inner products of rows are kept in expectation. Nothing is fitted, nothing depends on
    the width, which may grow with the data, and no row moves: a row's few cells are summed in the row, with work
    that follows its cells and not, per component, a search among them.
    """
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != "cells"]
    # names of any form pass as plain ones
    slim = rows.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], "cells")
    schema = slim.drop("cells").withColumn("_e", F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, int]] = {}
        for batch in _parts(batches, k):
            n, value = batch.num_rows, batch.column(len(names)).flatten().field(1)
            row, idx, v = _matrices(batch, len(names))
            met, back = np.unique(idx, return_inverse=True)
            met = met.tolist()
            for i in met:
                if i not in known:
                    known[i] = _placed(i, k, seed)
            places = np.array([known[i] for i in met], dtype=np.int64).reshape(-1, 2)[back]
            at = row * k + places[:, 0]
            sums = np.bincount(at, places[:, 1] * v, n * k)  # adds up in the order of the cells
            if value.null_count:
                sums[at[value.is_null().to_numpy(zero_copy_only=False)]] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], _lists(sums.reshape(n, k))], names=schema.names)

    made = slim.mapInArrow(run, schema)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return made.select(*kept, *[F.get("_e", F.lit(i)).alias(f"e_{i}") for i in range(k)])


# --- learned: randomised subspace iteration -----------------------------------------------------

BLOCK_BYTES = 64 << 20  # of the part of a basis that is broadcast at once
EXTRA = 8  # columns the iteration carries beside the wanted ones
STEP = 1 << 17  # rows times components a task multiplies at once
PASSES = 3  # multiplications by the matrix and its transpose before the last one
PART_ROWS = 1 << 14  # rows dealt together, of the same rarest columns
PAIR_ROWS = 1 << 13  # rows whose pairs of columns are looked for at once
DENSE_PAIRS = 512  # products that a dense multiplication may take for one pair that is looked for
PAIRS = 1 << 22  # sums of pairs a task holds before it gives them away
DENSE_LINES = 64  # lines of a basis that a dense multiplication may take for one cell
TASK_VALUES = 1 << 20  # values of a basis that a task works out


def _matrices(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every cell of a batch."""
    lists = batch.column(at)
    ends = lists.offsets.to_numpy()
    cells = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    return row, cells.field(0).to_numpy(zero_copy_only=False), cells.field(1).to_numpy(zero_copy_only=False)


def _times(row: np.ndarray, idx: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Rows times the basis, some cells at once; rows come in order."""
    out, step = np.zeros((n, basis.shape[1])), max(1, 8 * STEP // max(1, basis.shape[1]))
    for lo in range(0, len(row), step):
        part = row[lo : lo + step]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[starts]] += np.add.reduceat(value[lo : lo + step, None] * basis[idx[lo : lo + step]], starts, axis=0)
    return out


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose rows times ``width`` stay short: a row has some cells of each component."""
    step = max(1, STEP // max(1, width))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _summed(parts: DataFrame, key: str, length: int) -> DataFrame:
    """Arrays ``z`` of one key added element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums = np.add.reduceat(batch.column(1).flatten().to_numpy().reshape(-1, length), starts, axis=0)
            keys = keys[starts]
            if last == keys[0]:
                sums[0] += held
            elif last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last]), _lists(held[None])], names=[key, "z"])
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), _lists(sums[:-1])], names=[key, "z"])
            last, held = keys[-1], sums[-1].copy()
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), _lists(held[None])], names=[key, "z"])

    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} long, z array<double>")


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def _meetings(row: np.ndarray, idx: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns ``i`` and ``j`` that meet in a row, and their products added up over ``n`` rows; rows come in order."""
    met, at = np.unique(idx, return_inverse=True)
    size, count = len(met), np.bincount(row, minlength=n)
    if n * size**2 <= DENSE_PAIRS * (count**2).sum():  # few columns: a multiplication costs less than a sort
        dense = np.bincount(row * size + at, value, n * size).reshape(n, size)
        sums = dense.T @ dense
        i, j = np.nonzero(sums)
        return met[i], met[j], sums[i, j]
    many = count[row]
    one = np.repeat(np.arange(len(row)), many)
    first = (np.cumsum(count) - count)[row]
    other = first[one] + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
    found, back = np.unique(at[one] * size + at[other], return_inverse=True)
    return met[found // size], met[found % size], np.bincount(back, value[one] * value[other], len(found))


def _added(code: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``g`` under equal codes, in their order."""
    if not len(code):
        return code, g
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[starts], np.add.reduceat(g[order], starts)


def _lines(code: np.ndarray, g: np.ndarray, width: int) -> pa.RecordBatch:
    """``(idx, j, g)`` of ordered pairs, a row per first column."""
    i, j = np.divmod(code, width)
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
    ends = pa.array(np.r_[starts, len(i)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (j, g)]
    return pa.RecordBatch.from_arrays([pa.array(i[starts]), *lists], names=["idx", "j", "g"])


def _crossed(cells: DataFrame, width: int, k: int) -> DataFrame:
    """``(idx, j, g)``: the matrix's transpose times the matrix, stored, per column the columns it meets and the sums
    of their products. A row's pairs follow its cells, of which there are as many as raw columns; a pair is met in
    few tasks, as rows of the same rarest column lie together."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums, size = [], [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, PAIR_ROWS):
                batch = whole.slice(lo, PAIR_ROWS)
                row, idx, value = _matrices(batch, 0)
                if not len(row):
                    continue
                i, j, g = _meetings(row, idx, value, batch.num_rows)
                codes.append(i * width + j)
                sums.append(g)
                size += len(g)
                if size > PAIRS:
                    code, g = _added(np.concatenate(codes), np.concatenate(sums))
                    codes, sums, size = [code], [g], len(code)
                    if size > PAIRS // 2:
                        yield _lines(code, g, width)
                        codes, sums, size = [], [], 0
        if codes:
            yield _lines(*_added(np.concatenate(codes), np.concatenate(sums)), width)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, g = np.empty(0, np.int64), np.empty(0)  # of the last column so far, whose pairs may go on
        for batch in batches:
            row, j, new = _entries(batch)
            i = batch.column(0).to_numpy()[row]
            code, g = _added(np.r_[code, i * width + j], np.r_[g, new])
            if len(code):
                cut = np.searchsorted(code, code[-1] // width * width)
                yield _lines(code[:cut], g[:cut], width)
                code, g = code[cut:], g[cut:]
        yield _lines(code, g, width)

    schema = "idx long, j array<long>, g array<double>"
    dealt = cells.select("cells").mapInArrow(pairs, schema)
    tasks = max(1, width * k // TASK_VALUES)
    return store(dealt.repartition(tasks, "idx").sortWithinPartitions("idx").mapInArrow(added, schema), "crossed")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, partner and sum of all pairs of a batch."""
    lists = batch.column(1)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def _gathered(crossed: DataFrame, basis: np.ndarray) -> DataFrame:
    """``(idx, z)``: the matrix's transpose times the matrix times ``basis``, a line per row of ``crossed``."""
    shared = crossed.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, shared.value.shape[1]):
            z = _times(*_entries(batch), batch.num_rows, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(z)], names=["idx", "z"])

    return crossed.mapInArrow(run, "idx long, z array<double>")


def _outer(pairs: DataFrame, length: int) -> np.ndarray:
    """Sum over the rows of the outer product of ``a`` and ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((length, length))
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy().reshape(-1, length) for i in range(2))
            held += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), _lists(held)], names=["i", "z"])

    rows = _summed(pairs.select("a", "b").mapInArrow(run, "i long, z array<double>"), "i", length).toArrow()
    out = np.zeros((length, length))
    for i, z in zip(rows["i"].to_pylist(), rows["z"].to_pylist()):
        out[i] = z
    return out


@dataclass(frozen=True)
class Basis:
    """Right singular vectors of a sparse matrix, ``(idx, v)`` per column that has a cell."""

    table: DataFrame
    width: int
    k: int
    strength: list[float]

    def blocks(self) -> list[tuple[int, int]]:
        return _blocks(self.width, self.k)

    def part(self, lo: int, hi: int) -> np.ndarray:
        return _part(self.table, self.width, lo, hi)


def _blocks(width: int, k: int) -> list[tuple[int, int]]:
    step = max(1, min(k, BLOCK_BYTES // (8 * max(1, width))))
    return [(lo, min(k, lo + step)) for lo in range(0, k, step)]


def _part(table: DataFrame, width: int, lo: int, hi: int) -> np.ndarray:
    """Columns ``lo`` to ``hi`` of a basis, at most about BLOCK_BYTES."""
    rows = table.select("idx", F.slice("v", lo + 1, hi - lo).alias("v")).toArrow()
    out = np.zeros((width, hi - lo))
    if rows.num_rows:
        out[rows["idx"].to_numpy()] = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, hi - lo)
    return out


def _turned(table: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``(idx, v)`` with every ``v`` multiplied by the matrix."""
    shared = table.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, shared.value.shape[0]) @ shared.value
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(v)], names=["idx", "v"])

    return store(table.select("idx", "v").mapInArrow(run, "idx long, v array<double>"), "basis")


def _product(crossed: DataFrame, width: int, k: int, part: Callable[[int, int], np.ndarray]) -> DataFrame:
    """``(idx, v)``: one multiplication, a block of basis columns after the other."""
    blocks, out = _blocks(width, k), None
    if len(blocks) == 1:
        return store(_gathered(crossed, part(0, k)).withColumnRenamed("z", "v"), "product")
    for b, (lo, hi) in enumerate(blocks):
        made = store(_gathered(crossed, part(lo, hi)), "gathered").withColumnRenamed("z", f"_{b}")
        out = made if out is None else out.join(made, "idx")
    arrays = [c for c in out.columns if c != "idx"]
    return store(out.select("idx", F.concat(*arrays).alias("v")), "product")


def _orthonormal(product: DataFrame, k: int) -> DataFrame:
    gram = _outer(product.select(F.col("v").alias("a"), F.col("v").alias("b")), k)
    strength, turn = np.linalg.eigh(gram)
    keep = strength > strength[-1] * 1e-12
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, strength, 1.0)), 0.0)
    return _turned(product, turn * scale)


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``key``, the rarest column of a row (-1 without cells), and ``part``: rows of a key have the same
    one, unless they are many. A column is then met in few parts, so that what is needed or summed per part and
    column follows the columns, not columns times parts."""
    counts = np.zeros(width, dtype=np.int64)
    met = rows.select(F.explode("cells").alias("x")).groupBy(F.col("x.idx").alias("idx")).agg(F.count("*").alias("n")).toArrow()
    if met.num_rows:
        counts[met["idx"].to_numpy()] = met["n"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    parts, at = max(1, -(-rows.count() // PART_ROWS)), rows.columns.index("cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx, _ = _matrices(batch, at)
            key = np.full(batch.num_rows, -1, dtype=np.int64)
            if len(row):
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                key[row[starts]] = np.minimum.reduceat(shared.value[idx] * width + idx, starts) % width
            # the rows of a hot column, and those without cells, are spread by their hash
            spread = np.where(key < 0, parts, shared.value[key] // PART_ROWS + 1).astype(np.uint64)
            x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + batch.column(at + 1).to_numpy().view(np.uint64) % spread
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            part = ((x ^ (x >> np.uint64(27))) % np.uint64(parts)).astype(np.int64)
            columns = [c for i, c in enumerate(batch.columns) if i != at + 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(key), pa.array(part)], names=schema.names)

    schema = rows.withColumns({"key": F.lit(0).cast("bigint"), "part": F.lit(0).cast("bigint")}).schema
    names = rows.columns
    salted = rows.select(*map(quoted, names[: at + 1]), F.xxhash64("cells").alias("_salt"), *map(quoted, names[at + 1 :]))
    return salted.mapInArrow(run, schema)


def _clustered(cells: DataFrame, width: int) -> DataFrame:
    """The rows' cells, rows with the same rarest column together; those without cells are left out."""
    keyed = _dealt(cells.select("cells"), width).filter("key >= 0")
    return keyed.repartition("part").sortWithinPartitions("part", "key").select("cells")


def deal(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` stored with ``part`` (see ``_dealt``), rows of a part together: ``learn_basis`` and ``embed_rows``
    take them as they are."""
    dealt = _dealt(rows, width).repartition("part").sortWithinPartitions("part", "key")
    return store(dealt.drop("key"), "dealt")


def learn_basis(cells: DataFrame, width: int, k: int, passes: int = PASSES, seed: int = SEED) -> Basis:
    """The first ``k`` right singular vectors of the rows of ``cells`` (an array of ``(idx, value)`` per row,
    indices below ``width``), by randomised subspace iteration.

    The rows are read once, for the sums of products of the columns that meet in them; a pass multiplies by those
    sums, of which there are far fewer than cells, and moves no row. No matrix is as wide as it is high but that of
    ``k`` components; the basis is a table, and only blocks of its columns of at most BLOCK_BYTES (one column at
    least) are broadcast.
    """
    if k < 1 or width < 1:
        raise ValueError("at least one component of one column")
    ship(cells.sparkSession)
    inner = min(k + EXTRA, width)
    k = min(k, inner)

    def start(lo: int, hi: int) -> np.ndarray:
        return np.random.default_rng([seed, lo]).standard_normal((width, hi - lo))

    crossed = _crossed(cells if "part" in cells.columns else _clustered(cells, width), width, inner)
    basis = _orthonormal(_product(crossed, width, inner, start), inner)
    for _ in range(passes - 1):
        product = _product(crossed, width, inner, lambda lo, hi: _part(basis, width, lo, hi))
        basis = _orthonormal(product, inner)
    product = _product(crossed, width, inner, lambda lo, hi: _part(basis, width, lo, hi))
    both = basis.select("idx", F.col("v").alias("a")).join(product.select("idx", F.col("v").alias("b")), "idx")
    ritz = _outer(both, inner)
    strength, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-strength)[:k]
    turn = turn[:, order]
    turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return Basis(_turned(basis, turn), width, k, np.sqrt(np.maximum(strength[order], 0)).tolist())


def embed_rows(rows: DataFrame, basis: Basis, keys: Sequence[str], k: int | None = None) -> DataFrame:
    """``keys`` of ``rows``, then ``e_0 .. e_<k-1>``: their cells times the basis, and 0 for components
    beyond its own (a matrix has no more than columns). A basis of one block is broadcast; of a larger one, its lines
    travel to the parts of the rows that need them. Either way a row is multiplied once and nothing dense is stored."""
    blocks = basis.blocks()
    slim = rows.select(*[quoted(c) for c in keys], *[c for c in ("cells", "part") if c in rows.columns])
    made = _with_block(slim, basis.part(*blocks[0]), "_e") if len(blocks) == 1 else _with_lines(slim, basis, "_e")
    values = [F.get("_e", F.lit(i)) for i in range(basis.k)] + [F.lit(0.0)] * ((k or 0) - basis.k)
    return made.select(*[quoted(c) for c in keys], *[v.alias(f"e_{n}") for n, v in enumerate(values)])


def _with_lines(rows: DataFrame, basis: Basis, out: str) -> DataFrame:
    """``rows`` and their cells times the basis, a part's rows after the lines of the basis that they need."""
    if "part" not in rows.columns:
        rows = deal(rows, basis.width)
    names, k = rows.columns, basis.k
    at, place = names.index("cells"), names.index("part")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx, _ = _matrices(batch, 1)
            part = batch.column(0).to_numpy()[row]
            order = np.lexsort((idx, part))
            part, idx = part[order], idx[order]
            new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (idx[1:] != idx[:-1])]) if len(row) else order
            yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(idx[new])], names=["part", "idx"])

    needs = rows.select("part", "cells").mapInArrow(needed, "part long, idx long").distinct()
    lines = needs.join(basis.table.select("idx", "v"), "idx").withColumnRenamed("idx", "_idx").withColumnRenamed("v", "_v")
    both = rows.unionByName(lines, allowMissingColumns=True)
    dealt = both.repartition("part").sortWithinPartitions(F.col("part"), F.col("_idx").isNull())
    schema = rows.withColumn(out, F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, found, held = None, [], [], None
        for batch in batches:
            part, line = batch.column(place).to_numpy(), batch.column(len(names)).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (line[1:] != line[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
                if lo == hi:
                    continue
                if part[lo] != now:
                    now, ids, found, held = part[lo], [], [], None
                piece = batch.slice(lo, hi - lo)
                if line[lo]:
                    ids.append(piece.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64))
                    found.append(piece.column(len(names) + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
                    continue
                if held is None:
                    known = np.concatenate([*ids, np.empty(0, np.int64)])
                    order = np.argsort(known)
                    # a line of zeros for columns that the basis does not hold
                    held = known[order], np.vstack([*found, np.zeros((1, k))])[np.r_[order, len(known)].astype(np.int64)]
                    ids, found = [], []
                for rest in _parts([piece], max(k, len(held[0]))):
                    row, idx, value = _matrices(rest, at)
                    to = np.searchsorted(held[0], idx)
                    to[(np.r_[held[0], -1])[to] != idx] = len(held[0])
                    y = _times_few(row, to, value, rest.num_rows, held[1])
                    yield pa.RecordBatch.from_arrays([*rest.columns[: len(names)], _lists(y)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _times_few(row: np.ndarray, idx: np.ndarray, value: np.ndarray, n: int, lines: np.ndarray) -> np.ndarray:
    """As ``_times``, by a dense multiplication where there are few lines."""
    size = len(lines)
    if n * size > DENSE_LINES * len(row):
        return _times(row, idx, value, n, lines)
    return np.bincount(row * size + idx, value, n * size).reshape(n, size) @ lines


def _with_block(rows: DataFrame, basis: np.ndarray, out: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    at = rows.columns.index("cells")
    schema = rows.withColumn(out, F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, shared.value.shape[1]):
            y = _times(*_matrices(batch, at), batch.num_rows, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(y)], names=schema.names)

    return rows.mapInArrow(run, schema)


def embed(df: DataFrame, k: int, width: int, features: str = "features") -> DataFrame:
    """First ``k`` principal components, fitted on train and test rows together: ``e_0`` ….

    The components of the rows are computed where the rows are; only the width-by-width covariance
    is held on the driver, so the width is checked. Wider input goes by ``project``.
    """
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} columns are too many for principal components; project them")
    if k > width:
        raise ValueError(f"{k} components of {width} columns")
    model = PCA(k=k, inputCol=features, outputCol="_pca").fit(df)
    values = vector_to_array("_pca")
    keys = [c for c in (ROW_ID, IS_TEST, TARGET) if c in df.columns]
    return (
        model.transform(df)
        .withColumn("_e", values)
        .select(*keys, *[F.get("_e", F.lit(i)).alias(f"e_{i}") for i in range(k)])
    )
