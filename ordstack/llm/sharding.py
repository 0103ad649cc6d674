"""Shards by jump consistent hashing.

A stable key decides a row's shard; there is no ring table and no state. Going from n to n + 1 shards
moves about 1 / (n + 1) of the rows, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordstack.llm.corpus import columns, read, text_of
from ordstack.session import store

#: Multiplier of the generator in the published algorithm (Lamping and Veach, 2014); fixed value.
MULTIPLIER = np.uint64(2862933555777941757)
#: Rows numbered by one task. The number of blocks follows the rows.
ROWS_PER_BLOCK = 50_000


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. All keys jump together until every one has landed."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    nxt = np.zeros(len(key), dtype=np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        shard[open_] = nxt[open_]
        key[open_] = key[open_] * MULTIPLIER + np.uint64(1)
        slots = (key[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[open_] = ((shard[open_] + 1) * (float(1 << 31) / slots)).astype(np.int64)
        open_ = open_[nxt[open_] < n_shards]
    return shard


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard 0 to ``n_shards - 1`` of a key of any type, by its 64-bit hash. A null key is a key."""
    if n_shards < 1:
        raise ValueError("there must be at least one shard")

    @F.pandas_udf("int")
    def landed(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(dtype=np.int64).view(np.uint64), n_shards).astype(np.int32))

    return landed(F.xxhash64(key))


def shards(df: DataFrame, key: str, n_shards: int, order: list[Column] | None = None) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.

    Slots are dealt in two steps, so that no task sees a whole shard: rows of a shard fall into
    blocks by a second hash of the key, a block numbers its rows, and the blocks' counts (one row per
    shard and block) give the offsets. Input columns of those names are replaced. Repeated keys share
    a shard and get a slot each; an empty table gives an empty table.
    """
    placed = store(
        df.drop("shard", "slot", "grown_shard", "_block")
        .withColumn("shard", shard_of(F.col(key), n_shards))
        .withColumn("grown_shard", shard_of(F.col(key), n_shards + 1)),
        "shards",
    )
    n_blocks = max(1, -(-placed.count() // (n_shards * ROWS_PER_BLOCK)))
    blocked = placed.withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(n_blocks)))
    counted = blocked.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    offsets = counted.select(
        "shard", "_block",
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_offset"),
    )
    within = Window.partitionBy("shard", "_block").orderBy(F.col(key), *(order or []))
    numbered = blocked.withColumn("_row", F.row_number().over(within) - 1)
    return (
        numbered.join(offsets, ["shard", "_block"])
        .withColumn("slot", (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_block", "_row", "_offset")
    )


def write_shards(df: DataFrame, key: str, n_shards: int, path: str, files_per_shard: int = 1) -> None:
    """Whole rows as Parquet, one folder per shard; a shard is spread over ``files_per_shard`` tasks."""
    out = df.withColumn("shard", shard_of(F.col(key), n_shards))
    spread = F.pmod(F.xxhash64(F.lit("file"), F.col(key)), F.lit(files_per_shard))
    out.repartition(n_shards * files_per_shard, "shard", spread).write.partitionBy("shard").parquet(path)


def op7_jump_hash_shards(spark, sf_dir: str, n_shards: int = 24) -> DataFrame:
    """Shard and slot of every document; ``doc_id`` and the shard count alone decide (law ``key``).

    A null text has no bytes and the checksum of the empty text. A null ``doc_id`` is a key like any
    other. Ties are ordered by checksum and size.
    """
    text = text_of()
    sized = columns(read(spark, sf_dir), "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    placed = shards(sized, "doc_id", n_shards, [F.col("text_crc32"), F.col("size")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
