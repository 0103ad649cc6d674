"""Row-wise numeric columns. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordstack.constants import MAX_RATING, MIN_RATING


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col(f"`{name}`")


def ident(name: str) -> str:
    """Exact column name as SQL text. Wide projections are written as text: the plan is the same,
    and building it takes one call to the JVM per column instead of one per operator."""
    return f"`{name}`"


def number(x: float) -> str:
    """Exact double literal as SQL text."""
    return f"({float(x)!r}D)"


def int_div(c: Column, n: int) -> Column:
    """Integer division that stays exact beyond 2**53."""
    return F.call_function("div", c.cast("bigint"), F.lit(n).cast("bigint"))


def add_cols(a: Column, b: Column) -> Column:
    return a + b


def scaled_sum(a: Column, b: Column, factor: int = 10) -> Column:
    return a * factor + b


def log1p_sql(c: str) -> str:
    """``log(1 + x)``, NULL at and below -1."""
    return f"log1p(CAST({c} AS DOUBLE))"


def pairwise_names(cols: Sequence[str]) -> list[str]:
    return [f"{a}{op}{b}" for a, b in combinations(cols, 2) for op in "+-x/"]


def pairwise_exprs(cols: Sequence[str], prefix: str = "") -> tuple[list[str], list[str]]:
    """SQL of the logarithm of every column (as ``_log_<column>``), and of every pair by them."""
    logs = [f"{log1p_sql(ident(prefix + c))} AS {ident('_log_' + c)}" for c in cols]
    pairs = []
    for a, b in combinations(cols, 2):
        va, vb = ident(prefix + a), ident(prefix + b)
        la, lb = ident(f"_log_{a}"), ident(f"_log_{b}")
        pairs += [
            f"{va} + {vb} AS {ident(f'{prefix}{a}+{b}')}",
            f"{va} - {vb} AS {ident(f'{prefix}{a}-{b}')}",
            f"{la} + {lb} AS {ident(f'{prefix}{a}x{b}')}",
            f"{la} - {lb} AS {ident(f'{prefix}{a}/{b}')}",
        ]
    return logs, pairs


def with_pairwise(df: DataFrame, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Append sum, difference, log sum and log difference of every pair of ``cols``.

    Two projections: the first takes each logarithm once, the second combines them. ``prefix``
    stands before the names of both the columns read and the columns made.
    """
    logs, pairs = pairwise_exprs(cols, prefix)
    return df.selectExpr("*", *logs).selectExpr("*", *pairs).drop(*[f"_log_{c}" for c in cols])


def row_min(cols: Sequence[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def row_max(cols: Sequence[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def row_median(cols: Sequence[Column]) -> Column:
    """Median of the non-null values of a row; NULL when there is none."""
    ranked = F.sort_array(F.array(*cols), asc=False)  # nulls last
    n = reduce(add, [c.isNotNull().cast("int") for c in cols])
    low = F.get(ranked, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ranked, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def row_mean(cols: Sequence[Column]) -> Column:
    return reduce(add, cols) / len(cols)


def linear_combine(cols: Sequence[Column], weights: Sequence[float]) -> Column:
    if len(cols) != len(weights):
        raise ValueError("one weight per column")
    return reduce(add, [c * float(w) for c, w in zip(cols, weights)])


def to_rating(p: Column) -> Column:
    """Round half to even and clamp to the rating range. A missing prediction raises: ``least``
    and ``greatest`` would otherwise turn it into a valid rating."""
    rounded = F.least(F.greatest(F.rint(p), F.lit(float(MIN_RATING))), F.lit(float(MAX_RATING)))
    missing = p.isNull() | F.isnan(p)
    return F.when(missing, F.raise_error(F.lit("missing prediction")).cast("int")).otherwise(
        rounded.cast("int")
    )


def apply_cutoffs(p: Column, cutoffs: Sequence[float]) -> Column:
    """Index of the first cutoff above ``p``; past all of them, or missing, the last class."""
    chain = F.when(p < float(cutoffs[0]), 0)
    for k, c in enumerate(cutoffs[1:], 1):
        chain = chain.when(p < float(c), k)
    return chain.otherwise(len(cutoffs))


def count_reached(x: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds are at or below ``x``."""
    return reduce(add, [(x >= float(t)).cast("int") for t in thresholds])


def argmax_class(cols: Sequence[Column]) -> Column:
    """Position of the largest value, the first one on ties."""
    values = F.array(*cols)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def exact_labels(target: Column, max_class: int) -> dict[str, Column]:
    return {f"eq_{k}": (target == k).cast("int") for k in range(max_class + 1)}


def below_labels(target: Column, max_class: int) -> dict[str, Column]:
    return {f"lt_{k}": (target < k).cast("int") for k in range(2, max_class + 1)}
