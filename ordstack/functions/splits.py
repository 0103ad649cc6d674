"""Stable row assignment by hash of the row id: no shuffle, same result on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordstack.constants import FOLD, N_FOLD, ROW_ID, SEED


def row_hash(row_id: Column, seed: int = SEED) -> Column:
    """First 32 bits of an md5 over seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def fold_of(row_id: Column, n: int = N_FOLD, seed: int = SEED) -> Column:
    return (row_hash(row_id, seed) % n + 1).cast("int")


def assign_folds(df: DataFrame, n: int = N_FOLD, seed: int = SEED) -> DataFrame:
    return df.withColumn(FOLD, fold_of(F.col(ROW_ID), n, seed))


def is_validation(row_id: Column, share: float = 0.2, seed: int = SEED) -> Column:
    """Whether a row falls into the held-out share."""
    return row_hash(row_id, seed) < int(share * 2**32)


def train_valid_split(
    df: DataFrame, share: float = 0.2, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    held_out = is_validation(F.col(ROW_ID), share, seed)
    return df.filter(~held_out), df.filter(held_out)
