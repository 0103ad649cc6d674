"""Whole-table column handling: roles, nulls, constant columns, names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordstack.constants import FOLD, H1_CATEGORICAL, H1_NUMERIC, IS_TEST, ROW_ID, TARGET
from ordstack.functions.numeric import ident, quoted

KEYS = (ROW_ID, IS_TEST, FOLD, TARGET, "id")


class Roles(NamedTuple):
    categorical: list[str]
    floating: list[str]
    integer: list[str]


def feature_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = {*KEYS, *exclude}
    return [c for c in df.columns if c not in skip]


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def column_roles(
    df: DataFrame, categorical: Sequence[str] = (), exclude: Iterable[str] = ()
) -> Roles:
    """Split feature columns by type; ``categorical`` names integer ids to treat as categories."""
    cols = feature_columns(df, exclude)
    kind = {f.name: f.dataType for f in df.schema.fields}
    cat = [c for c in categorical if c in cols]
    cat += [c for c in cols if isinstance(kind[c], T.StringType) and c not in cat]
    floating = [c for c in cols if isinstance(kind[c], T.FractionalType) and c not in cat]
    integer = [c for c in cols if isinstance(kind[c], T.IntegralType) and c not in cat]
    return Roles(cat, floating, integer)


def listed_roles(df: DataFrame) -> Roles:
    """Split by the fixed lists, keeping the columns that exist."""
    have = set(df.columns)
    return Roles(
        [c for c in H1_CATEGORICAL if c in have], [], [c for c in H1_NUMERIC if c in have]
    )


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    chosen = set(cols)
    return df.select(
        *[quoted(c).cast("double").alias(c) if c in chosen else quoted(c) for c in df.columns]
    )


def fill_missing(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    number: float = -1,
    text: str = "NA",
) -> DataFrame:
    return df.na.fill(number, list(numeric)).na.fill(text, list(categorical))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column that holds a null, with the number of nulls; one pass for all."""
    one = df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in cols])
    return long_form(one, cols, "column", "n_null").filter("n_null > 0")


def long_form(one: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Turn a one-row aggregate into a row per column."""
    pairs = [
        F.struct(F.lit(c).alias(name), quoted(c).alias(value)) for c in cols
    ]
    return one.select(F.inline(F.array(*pairs)))


def integer_like(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Which columns hold whole numbers in every row (missing values do not count)."""
    one = df.agg(*[F.bool_and(quoted(c) == F.floor(quoted(c))).alias(c) for c in cols])
    return long_form(one, cols, "column", "is_integer")


def column_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.stddev_pop(quoted(c)).alias(c) for c in cols])
    return long_form(one, cols, "column", "std")


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column, one pass, as a row per column."""
    one = df.selectExpr(*[f"CAST({ident(c)} AS DOUBLE) AS {ident(c)}" for c in cols]).agg(
        *[F.expr(f"struct(min({ident(c)}) AS lo, max({ident(c)}) AS hi) AS {ident(c)}") for c in cols]
    )
    rows = [f"struct('{c}' AS column, {ident(c)}.lo AS lo, {ident(c)}.hi AS hi)" for c in cols]
    return one.selectExpr(f"inline(array({', '.join(rows)}))")


def varying_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that are not one single value throughout; a column with a null counts as varying.
    One aggregate settles all columns."""
    if not cols:
        return []
    row = df.agg(
        *[
            F.expr(
                f"count({ident(c)}) < count(*) OR "
                f"coalesce(min({ident(c)}) <> max({ident(c)}), true) AS {ident(c)}"
            )
            for c in cols
        ]
    ).first()
    return [c for c in cols if row[c]]


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop feature columns that are constant over the train rows, for both sides alike."""
    cols = feature_columns(df) if cols is None else list(cols)
    train = df.filter(~F.col(IS_TEST)) if IS_TEST in df.columns else df
    keep = set(varying_columns(train, cols))
    return df.drop(*[c for c in cols if c not in keep])


def fold_train(df: DataFrame, i: int) -> DataFrame:
    return df.filter(F.col(FOLD) != i)


def fold_valid(df: DataFrame, i: int) -> DataFrame:
    return df.filter(F.col(FOLD) == i)


def split_stacked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test side of a stacked table."""
    return df.filter(~F.col(IS_TEST)), df.filter(IS_TEST)


def stack_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)
