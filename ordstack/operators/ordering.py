"""Numbering, order statistics and running totals without a single-partition window over rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordstack.constants import RATING_COUNTS
from ordstack.functions.numeric import count_reached, quoted
from ordstack.session import store

BINS = 1 << 16


def with_sum_before(
    df: DataFrame, order: Sequence[str], weight: str | None = None, out: str = "_before"
) -> DataFrame:
    """Append the total weight (rows, by default) strictly before each row in ``order``, which
    must be unique. Ranges of the order are stored with their number; a running total over the
    ranges (one row per range, so at most the number of shuffle partitions) gives every range its
    start, and a window inside each range does the rest."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    stored = store(ranged, "ranged")
    w = quoted(weight) if weight else F.lit(1)
    starts = (
        stored.groupBy("_range")
        .agg(F.sum(w).alias("_total"))
        .select(
            "_range",
            F.coalesce(
                F.sum("_total").over(
                    Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_start"),
        )
    )
    inside = (
        Window.partitionBy("_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        stored.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(w).over(inside), F.lit(0)))
        .drop("_range", "_start")
    )


def number_within(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """Number rows 1, 2, … within each of the few groups, by a unique order column."""
    ranked = with_sum_before(df, [group, order])
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    starts = sizes.select(
        group,
        F.coalesce(
            F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_first"),
    )
    return (
        ranked.join(F.broadcast(starts), group)
        .withColumn(out, (F.col("_before") - F.col("_first") + 1).cast("bigint"))
        .drop("_before", "_first")
    )


def value_counts_of(df: DataFrame, *cols: str) -> DataFrame:
    """Count per distinct value; a value shared by many rows is summed before the shuffle."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


class OrderIndex:
    """Exact order statistics of a column without sorting its rows.

    One pass takes the range and the number of values, a second counts values in BINS equal bins of
    the range. Only the bins that hold a wanted position are looked at value by value, so what is
    shuffled by value is a small part of the rows unless the values cluster, and right in any case.
    Nulls are left out.
    """

    def __init__(self, df: DataFrame, c: str):
        # adding 0.0 turns a negative zero into zero
        self.values = df.select((quoted(c).cast("double") + F.lit(0.0)).alias("value")).filter(
            "value IS NOT NULL"
        )
        row = self.values.agg(F.min("value"), F.max("value"), F.count("value")).first()
        self.low, self.high, self.n = row[0], row[1], row[2]

    def bin(self) -> Column:
        """Bin of a value, never decreasing in it."""
        width = self.high - self.low if self.n else 0.0
        if not (0.0 < width < math.inf):
            return F.lit(0)
        scale = BINS / width
        return F.floor((F.col("value") - F.lit(self.low)) * F.lit(scale)).cast("int")

    def at(self, positions: Sequence[int]) -> DataFrame:
        """``(position, value)`` at 0-based positions of the ascending order."""
        wanted = sorted(set(int(p) for p in positions))
        binned = self.values.withColumn("bin", self.bin())
        order = Window.orderBy("bin")  # at most BINS + 1 rows
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        ranked = value_counts_of(binned, "bin").withColumn("_before", F.coalesce(before, F.lit(0)))
        literal = F.array(*[F.lit(p).cast("bigint") for p in wanted])
        end = F.col("_before") + F.col("n")
        hits = F.filter(literal, lambda p: (p >= F.col("_before")) & (p < end))
        rows = (
            ranked.select("bin", "n", "_before", hits.alias("hits"))
            .filter(F.size("hits") > 0)
            .orderBy("bin")
            .collect()  # at most one row per wanted position
        )
        skipped, local, kept = 0, {}, 0
        for r in rows:
            skipped = r["_before"] - kept
            local.update({p - skipped: p for p in r["hits"]})
            kept += r["n"]
        chosen = binned.filter(F.col("bin").isin([r["bin"] for r in rows]))
        found = _stats_at(value_counts_of(chosen, "value"), list(local))
        back = F.create_map(*[F.lit(x).cast("bigint") for kv in local.items() for x in kv])
        return found.select(back[F.col("position")].alias("position"), "value")


def order_stats(df: DataFrame, c: str, indices: Sequence[int]) -> DataFrame:
    """Values at 0-based positions of the ascending order, exact: ``(position, value)``."""
    return OrderIndex(df, c).at(indices)


def _stats_at(hist: DataFrame, indices: Sequence[int]) -> DataFrame:
    wanted = F.array(*[F.lit(int(i)).cast("bigint") for i in sorted(set(indices))])
    ranked = with_sum_before(hist, ["value"], "n")
    end = F.col("_before") + F.col("n")
    hit = F.filter(wanted, lambda i: (i >= F.col("_before")) & (i < end))
    return ranked.select(F.explode(hit).alias("position"), "value")


def share_positions(counts: Sequence[int], n: int) -> list[int]:
    """Position of the last row of each class but the top one, when ``n`` rows in order get the
    given class counts in proportion."""
    total = float(sum(counts))
    positions, reached = [], 0
    for k in counts[:-1]:
        reached += k
        positions.append(int(reached / total * n))
    return positions


def share_thresholds(
    df: DataFrame, c: str, counts: Sequence[int] = RATING_COUNTS
) -> list[float]:
    """Order statistics of ``c`` at the cumulative class shares: one number per class boundary."""
    index = OrderIndex(df, c)
    if index.n == 0:
        raise ValueError("no rows to take order statistics of")
    positions = share_positions(counts, index.n)
    if max(positions) >= index.n:
        raise ValueError("the top class has no share, so its threshold is past the last row")
    found = {r["position"]: r["value"] for r in index.at(positions).collect()}
    return [found[p] for p in positions]


def assign_by_shares(
    df: DataFrame, c: str, counts: Sequence[int] = RATING_COUNTS, out: str = "rating"
) -> DataFrame:
    """Rating of a row = number of thresholds at or below its value."""
    thresholds = share_thresholds(df, c, counts)
    return df.withColumn(out, count_reached(quoted(c), thresholds))


def class_shares(hist: DataFrame, cls: str, n: str) -> DataFrame:
    """Cumulative share per class of a histogram with one row per rating class."""
    upto = Window.orderBy(cls).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(cls).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return hist.select(
        cls,
        (F.sum(n).over(upto).cast("double") / F.sum(n).over(everything).cast("double")).alias(
            "share"
        ),
    )


def best_round(curve: DataFrame, round_col: str = "round", loss_col: str = "loss") -> DataFrame:
    """Round with the smallest loss, the earliest on ties."""
    key = F.struct(quoted(loss_col), quoted(round_col))
    return curve.agg(F.min_by(quoted(round_col), key).alias("best_round"))


def importance(df: DataFrame, value: str = "gain") -> DataFrame:
    """Share of each feature in the total, largest first; a row per feature."""
    total = df.agg(F.sum(value)).first()[0]
    share = F.col(value) / F.nullif(F.lit(total), F.lit(0.0))
    return df.withColumn(value, share).orderBy(F.col(value).desc(), "name")
