"""Tables of the same rows put side by side by row id, and their aggregates over folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordstack.constants import FOLD, IS_TEST, N_FOLD, ROW_ID, TARGET
from ordstack.functions.numeric import argmax_class, quoted, row_mean
from ordstack.operators.columns import drop_constant, feature_columns


def check_same_rows(sets: dict[str, DataFrame]) -> None:
    """All sets must hold the same row ids, each equally often: one narrow aggregate per set compares
    their number and two sums over hashes of the ids."""
    hashed = F.xxhash64(ROW_ID)
    seen = {
        name: tuple(df.agg(F.count(ROW_ID), F.bit_xor(hashed), F.sum(hashed.cast("decimal(20,0)"))).first())
        for name, df in sets.items()
    }
    if len(set(seen.values())) > 1:
        raise ValueError(f"feature sets differ in rows: { {k: v[0] for k, v in seen.items()} }")


def checked_row_id(bad: Column) -> Column:
    """The row id, raising on a bad row: whatever reads the id runs the check."""
    error = F.raise_error(F.lit("row without a partner")).cast("bigint")
    return F.when(bad, error).otherwise(F.col(ROW_ID)).alias(ROW_ID)


def _matched(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Left join that raises where the other table lacks the row."""
    joined = df.join(other.withColumn("_found", F.lit(True)), on, "left")
    keep = [c for c in joined.columns if c not in ("_found", ROW_ID)]
    return joined.select(checked_row_id(F.col("_found").isNull()), *[quoted(c) for c in keep])


def combine(
    sets: dict[str, DataFrame], drop_constants: bool = True, check: bool = True
) -> DataFrame:
    """Feature sets column by column, each name prefixed with its set, constant columns dropped.

    All joins are on the unique row id, so one hash partitioning serves the whole chain; sets saved
    bucketed by row id join without any shuffle.
    """
    if check:
        check_same_rows(sets)
    keys = [ROW_ID, IS_TEST, TARGET]
    renamed = []
    for k, (name, df) in enumerate(sets.items()):
        head = [c for c in keys if c in df.columns] if k == 0 else [ROW_ID]
        cols = [quoted(c).alias(f"{name}_{c}") for c in feature_columns(df)]
        renamed.append(df.select(*head, *cols))
    out, missing = renamed[0], F.lit(False)
    for k, right in enumerate(renamed[1:]):
        out = out.join(right.withColumn(f"_found_{k}", F.lit(True)), ROW_ID, "left")
        missing = missing | F.col(f"_found_{k}").isNull()
    out = out.select(
        checked_row_id(missing), *[quoted(c) for df in renamed for c in df.columns if c != ROW_ID]
    )
    return drop_constant(out) if drop_constants else out


def stack(label: DataFrame, preds: dict[str, DataFrame], value: str = "prediction") -> DataFrame:
    """Label first, then one column per base model.

    The prediction vectors are unioned and turned by one aggregate on the row id: a single shuffle
    whatever the number of models. A row must have exactly one label row and one prediction of every
    model; a missing, null or repeated one raises.
    """
    keys = [c for c in label.columns if c != ROW_ID]
    names = list(preds)
    blank = [F.lit(None).cast("double").alias("_p"), F.lit(-1).alias("_m")]
    parts = [label.select(ROW_ID, *[quoted(k) for k in keys], *blank)]
    types = {f.name: f.dataType for f in label.schema.fields}
    for m, name in enumerate(names):
        empty = [F.lit(None).cast(types[k]).alias(k) for k in keys]
        parts.append(
            preds[name].select(
                ROW_ID, *empty, quoted(value).cast("double").alias("_p"), F.lit(m).alias("_m")
            )
        )
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    # the long rows are shuffled, not the wide and at that point nearly empty aggregation buffers
    wide = long.repartition(ROW_ID).groupBy(ROW_ID).agg(
        (
            (F.count("*") != len(names) + 1)
            | F.greatest(F.lit(False), *[F.count_if((F.col("_m") == m) & F.col("_p").isNotNull()) != 1
                                         for m in range(len(names))])
        ).alias("_bad"),
        *[F.max(quoted(k)).alias(k) for k in keys],
        *[
            F.max(F.when(F.col("_m") == m, F.col("_p"))).alias(f"pred_{name}")
            for m, name in enumerate(names)
        ],
    )
    return wide.select(
        checked_row_id(F.col("_bad")),
        *[quoted(k) for k in keys],
        *[quoted(f"pred_{n}") for n in names],
    )


def append_features(stacked: DataFrame, extra: DataFrame) -> DataFrame:
    """More feature columns (such as class probabilities) to the right of a stack."""
    cols = feature_columns(extra)
    return _matched(stacked, extra.select(ROW_ID, *[quoted(c) for c in cols]), [ROW_ID])


def with_fold_features(df: DataFrame, fold_df: DataFrame, i: int) -> DataFrame:
    """Common features plus those encoded for fold ``i``."""
    part = fold_df.filter(F.col(FOLD) == i)
    cols = feature_columns(part)
    return _matched(df, part.select(ROW_ID, *[quoted(c) for c in cols]), [ROW_ID])


def with_fold_vectors(
    df: DataFrame, fold_df: DataFrame, cols: Sequence[str], folds: int = N_FOLD, missing: float = -1.0
) -> DataFrame:
    """``df`` with ``fold_features``: per fold the array of the row's ``cols`` encoded for that fold.

    One aggregate turns the long table, one join adds it, whatever the number of folds; a missing value is
    filled. A row without all its folds, or with one twice, raises.
    """
    values = F.array(*[F.coalesce(quoted(c).cast("double"), F.lit(missing)) for c in cols])
    # the short rows of a fold are moved, once, not the nearly empty buffers of all folds
    turned = fold_df.select(ROW_ID, FOLD, values.alias("_v")).repartition(ROW_ID).groupBy(ROW_ID).agg(
        *[F.max(F.when(F.col(FOLD) == i, F.col("_v"))).alias(f"_{i}") for i in range(1, folds + 1)],
        F.count("*").alias("_n"),
    )
    absent = [F.col(f"_{i}").isNull() for i in range(1, folds + 1)]
    arrays = turned.select(
        ROW_ID,
        F.array(*[f"_{i}" for i in range(1, folds + 1)]).alias("fold_features"),
        ((F.col("_n") != folds) | F.greatest(F.lit(False), *absent)).alias("_bad"),
    )
    joined = df.drop("fold_features").join(arrays, ROW_ID, "left")
    keep = [quoted(c) for c in joined.columns if c not in ("_bad", ROW_ID)]
    return joined.select(checked_row_id(F.coalesce("_bad", F.lit(True))), *keep)


def attach_predictions(ids: DataFrame, preds: DataFrame, value: str = "prediction") -> DataFrame:
    """Submission rows ``(row_id, id, target)`` with the prediction as target."""
    return _matched(
        ids.select(ROW_ID, "id"), preds.select(ROW_ID, quoted(value).alias(TARGET)), [ROW_ID]
    )


def fold_average(df: DataFrame, value: str = "prediction", folds: int = N_FOLD) -> DataFrame:
    """Mean over the fold models per row, from stored ``(fold, row_id, prediction)``. A row that lacks
    the prediction of a fold, or has more, raises."""
    means = df.groupBy(ROW_ID).agg(F.avg(value).alias(value), F.count(value).alias("_n"))
    return means.select(checked_row_id(F.col("_n") != folds), value)


def fold_average_classes(df: DataFrame, cols: Sequence[str], folds: int = N_FOLD) -> DataFrame:
    """Mean class probabilities over the fold models, then the most likely class. A row that lacks a
    probability of a fold, or has more, raises."""
    means = df.groupBy(ROW_ID).agg(
        *[F.avg(quoted(c)).alias(c) for c in cols],
        F.greatest(F.lit(False), *[F.count(quoted(c)) != folds for c in cols]).alias("_bad"),
    )
    return means.select(
        checked_row_id(F.col("_bad")), argmax_class([quoted(c) for c in cols]).alias("rating")
    )


def mean_best_rounds(df: DataFrame, rounds: str = "best_round") -> DataFrame:
    return df.agg(
        F.call_function("div", F.sum(rounds), F.count("*")).cast("bigint").alias("mean_rounds")
    )


def average_models(stacked: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Plain mean of base models as a prediction."""
    return stacked.select(ROW_ID, row_mean([quoted(c) for c in cols]).alias("prediction"))


# --- sparse sets --------------------------------------------------------------------------------


@dataclass(frozen=True)
class CellSet:
    """A sparse feature set: ``(row_id, is_test, idx, value)`` per cell that is not 0, and the names and
    types of its columns by position."""

    cells: DataFrame
    columns: tuple[tuple[str, str], ...]


def cells_of(df: DataFrame, typed: Sequence[tuple[str, str]]) -> CellSet:
    """A dense set as cells: ``typed`` are its columns with their types. Missing values and zeros have no
    cell. No row moves."""
    pairs = [
        F.struct(F.lit(i).cast("bigint").alias("idx"), quoted(c).cast("double").alias("value"))
        for i, (c, _) in enumerate(typed)
    ]
    cells = df.select(ROW_ID, IS_TEST, F.inline(F.array(*pairs))).filter("value <> 0")
    return CellSet(cells, tuple(typed))


def constant_cells(cells: DataFrame, n_rows: int, width: int) -> list[int]:
    """Columns with a single value over ``n_rows`` rows, rows without a cell holding 0. One aggregate of
    counts and extremes, so no rounding takes part. Its result has a row per column."""
    found = cells.groupBy("idx").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    filled = F.col("n") < n_rows
    lo = F.when(filled, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(filled, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    varying = {r["idx"] for r in found.filter(lo != hi).select("idx").collect()}
    return [i for i in range(width) if i not in varying]


def combine_cells(
    sets: dict[str, CellSet], keys: DataFrame, drop_constants: bool = True
) -> CellSet:
    """Sparse and dense sets side by side without densifying: columns of a set follow those of the sets
    before it, names get the set's prefix, columns constant over the train rows of ``keys`` (``row_id``,
    ``is_test``) go and the rest are numbered anew. Cells are moved by arithmetic on their index: no join,
    no shuffle but that of the test for constant columns."""
    first, parts, columns = 0, [], []
    for name, s in sets.items():
        parts.append(s.cells.select(ROW_ID, IS_TEST, (F.col("idx") + first).alias("idx"), "value"))
        columns += [(f"{name}_{c}", kind) for c, kind in s.columns]
        first += len(s.columns)
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    if not drop_constants:
        return CellSet(cells, tuple(columns))
    n_rows = keys.filter(~F.col(IS_TEST)).count()
    gone = constant_cells(cells.filter(~F.col(IS_TEST)), n_rows, len(columns))
    if gone:
        # columns that go before a column, looked up in the sorted list of those that go
        before = F.size(F.filter(F.lit(gone), lambda g: g < F.col("idx")))
        cells = cells.filter(~F.col("idx").isin(gone)).withColumn("idx", F.col("idx") - before)
    lost = set(gone)
    return CellSet(cells, tuple(c for i, c in enumerate(columns) if i not in lost))
