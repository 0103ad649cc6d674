"""Left join of a wide table to a unique-key mapping, by measured size.

A mapping that is small when measured is broadcast. A larger one is shuffle-joined, and the keys
that hold a large part of the rows are spread over several partitions: their rows get a salt, and
their (few) mapping rows are repeated once per salt. The result is the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordstack.constants import IS_TEST, ROW_ID
from ordstack.functions.numeric import ident, number, quoted
from ordstack.session import store

BROADCAST_BYTES = 64 << 20  # largest measured mapping that is broadcast
HOT_SHARE = 200  # a key with more than 1/HOT_SHARE of the rows is spread
HOT_SALTS = 64


@dataclass(frozen=True)
class Mapping:
    """A stored table that is unique on ``key``, and its measured size."""

    table: DataFrame
    key: str
    size: int


def row_bytes(df: DataFrame) -> Column:
    """Payload bytes of a row: text by its length, anything else by 8 (arrays by element)."""
    parts = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.size(c), F.lit(0)) * 8 + 16)
        else:
            parts.append(F.lit(8))
    total = F.lit(16).cast("bigint")
    for p in parts:
        total = total + p
    return total


def mapping(df: DataFrame, key: str, label: str = "mapping") -> Mapping:
    """Store ``df`` and measure it."""
    table = store(df, label)
    size = table.agg(F.coalesce(F.sum(row_bytes(table)), F.lit(0)).alias("b")).first()["b"]
    return Mapping(table, key, size)


def literal(value: object) -> str:
    """Default value as SQL text: a number, nothing, or a list of numbers."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(literal(v) for v in value)})"
    return number(value) if isinstance(value, float) else str(int(value))


def hot_values(df: DataFrame, key: str) -> list:
    """Keys holding more than 1/HOT_SHARE of the rows: at most HOT_SHARE of them. One narrow pass
    with a mergeable frequency sketch, no shuffle by key; only the salting depends on it."""
    k = quoted(key)
    row = df.select(k.alias("k")).agg(
        F.expr(f"approx_top_k(k, {HOT_SHARE}, 20000)").alias("top"), F.count("*").alias("n")
    ).first()
    return [
        t["item"]
        for t in row["top"] or []
        if t["item"] is not None and t["count"] * HOT_SHARE > row["n"]
    ]


def lookup(
    df: DataFrame,
    m: Mapping,
    on: str,
    fields: dict[str, str],
    defaults: dict[str, object] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Append mapping columns ``fields`` (mapping name to new name) by equality with column ``on``.

    Keys the mapping does not hold give NULL, or the entry of ``defaults``; a NULL the mapping does
    hold stays NULL. With ``null_safe`` a NULL key matches a NULL key.
    """
    wanted = [f"{ident(f)} AS {ident('_v_' + n)}" for f, n in fields.items()]
    right = m.table.selectExpr(f"{ident(m.key)} AS _key", "true AS _hit", *wanted)
    left_key = quoted(on)
    same = F.expr(f"{ident(on)} {'<=>' if null_safe else '='} _key")
    if m.size <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(right), same, "left")
    else:
        hot = hot_values(df, on)
        spread_left = left_key.isNull() | (left_key.isin(hot) if hot else F.lit(False))
        spread_right = F.col("_key").isNull() | (
            F.col("_key").isin(hot) if hot else F.lit(False)
        )
        salts = F.array(*[F.lit(i) for i in range(HOT_SALTS)])
        right = right.withColumn(
            "_salt_r",
            F.explode(F.when(spread_right, salts).otherwise(F.array(F.lit(0)))),
        )
        salt = F.pmod(F.xxhash64(ROW_ID), F.lit(HOT_SALTS)).cast("int")
        left = df.withColumn("_salt_l", F.when(spread_left, salt).otherwise(0))
        joined = left.join(right, same & (F.col("_salt_l") == F.col("_salt_r")), "left")
    defaults = defaults or {}
    new = [
        f"CASE WHEN _hit IS NULL THEN {literal(defaults[n])} ELSE {ident('_v_' + n)} END AS {ident(n)}"
        if n in defaults
        else f"{ident('_v_' + n)} AS {ident(n)}"
        for n in fields.values()
    ]
    helpers = ["_key", "_hit", "_salt_l", "_salt_r", *[f"_v_{n}" for n in fields.values()]]
    replaced = [n for n in fields.values() if n in df.columns]
    return joined.drop(*replaced).selectExpr("*", *new).drop(*helpers)


def side_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key on each side; partial aggregation shrinks hot keys before the shuffle."""
    return df.groupBy(quoted(key).alias(key)).agg(
        F.count_if(~F.col(IS_TEST)).alias("n_train"), F.count_if(F.col(IS_TEST)).alias("n_test")
    )


def overlap_flag(df: DataFrame, key: str, out: str = "cid_both") -> DataFrame:
    """1 where the key of a row occurs on the other side (train or test) too, else 0."""
    both = side_counts(df, key).filter("n_train > 0 AND n_test > 0").select(key, F.lit(1).alias("f"))
    return lookup(df, mapping(both, key, "overlap"), key, {"f": out}, {out: 0})
