"""Registered queries: each reads the given tables; most have an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordstack.functions.numeric import ident, quoted
from ordstack.plans import fixture

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def lazy_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table with its fold, straight from the given tables."""
    return fixture.with_fold(fixture.base(spark, sf_dir))


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero. Scaled and rounded as doubles, half to even: the same
    arithmetic on both sides, and far cheaper than decimal rounding on wide tables."""
    c = quoted(c) if isinstance(c, str) else c
    return F.rint(c.cast("double") * 1e6) / 1e6 + F.lit(0.0)


def rounded(df: DataFrame, keep: list[str] | tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Doubles to six decimals, other columns and those of ``keep`` as they are."""
    return df.selectExpr(
        *[
            f"rint({ident(c)} * 1e6D) / 1e6D + 0.0D AS {ident(c)}" if t == "double" and c not in keep
            else ident(c)
            for c, t in df.dtypes
        ]
    )


# --- SQL text -----------------------------------------------------------------------------------

FOLD_SQL = "('0x' || substr(md5('42:' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT"

BASE_SQL = f"""base AS (
  SELECT o_orderkey AS row_id,
         100000000000 + o_custkey * 670000 AS customer_id,
         CAST(month(o_orderdate) * 1000000 + day(o_orderdate) * 10000 + year(o_orderdate) AS INT)
           AS date,
         concat('M', CAST(c_nationkey AS VARCHAR)) AS market,
         c_mktsegment AS f_1, o_orderpriority AS f_7, nullif(o_orderstatus, 'P') AS f_9,
         coalesce(f_0, 0) AS f_0, o_totalprice AS f_5, coalesce(f_8, 0.0) + 0.0 AS f_8,
         CAST(1 AS INT) AS f_10, coalesce(f_11, 0) AS f_11, coalesce(f_12, 0.0) + 0.0 AS f_12,
         c_acctbal AS f_13, coalesce(f_15, 0.0) + 0.0 AS f_15, coalesce(f_18, 0.0) + 0.0 AS f_18,
         coalesce(f_21, 0.0) + 0.0 AS f_21, f_8 AS f_22, coalesce(f_26, 0.0) + 0.0 AS f_26,
         CAST(coalesce(target, 0) AS INT) AS target, year(o_orderdate) >= 2000 AS is_test
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS target, count(DISTINCT l_partkey) AS f_0,
                    max(l_quantity) AS f_8, count(DISTINCT l_suppkey) AS f_11,
                    max(l_discount) AS f_12, max(l_tax) AS f_15, max(l_extendedprice) AS f_18,
                    min(l_quantity) AS f_21, min(l_extendedprice) AS f_26
             FROM lineitem GROUP BY l_orderkey) a ON l_orderkey = o_orderkey),
b AS (SELECT *, CAST({FOLD_SQL} % 5 + 1 AS INT) AS fold FROM base),
p AS (SELECT row_id, is_test, fold, target, round(f_8 / 10, 6) AS pred,
             round(f_0 * CAST(0.9 AS DOUBLE), 6) AS pred2 FROM b)"""


def over_base(select: str, *ctes: str) -> str:
    """SQL over ``b`` (the raw table with its fold) and ``p`` (the stand-in predictions)."""
    return "WITH " + ",\n".join([BASE_SQL, *ctes]) + "\n" + select


def s6(x: str) -> str:
    return f"(round_even(CAST({x} AS DOUBLE) * 1e6::DOUBLE, 0) / 1e6::DOUBLE + 0.0)"


def tag(c: str) -> str:
    """Text key of a value, null included."""
    return f"(CASE WHEN {c} IS NULL THEN 'n' ELSE concat('v', {c}) END)"


def label_ctes(name: str, expr: str, src: str, min_obs: int, where: str = "NOT is_test") -> list[str]:
    """Mapping ``m_<name>(v, lab)`` of text keys to labels."""
    return [
        f"""k_{name} AS (SELECT {tag(expr)} AS v, count(*) AS n, min(row_id) AS first_row
            FROM {src} WHERE {where} GROUP BY 1)""",
        f"""e_{name} AS (SELECT v, row_number() OVER (ORDER BY first_row) AS lab,
            count(*) OVER () AS top FROM k_{name} WHERE n >= {min_obs})""",
        f"""m_{name} AS (SELECT v, CASE WHEN lab = top AND
            (SELECT count(*) FROM k_{name} WHERE n < {min_obs}) = 0 THEN 0 ELSE lab END AS lab
            FROM e_{name})""",
    ]


def fold_mean_ctes(name: str, expr: str, src: str) -> list[str]:
    """Mapping ``t_<name>(k, fold, te)``: mean target outside each fold per value."""
    return [
        f"""a_{name} AS (SELECT {expr} AS k, fold, sum(target) AS s, count(*) AS n FROM {src}
            WHERE NOT is_test GROUP BY 1, 2)""",
        f"""o_{name} AS (SELECT k, sum(s) AS s, sum(n) AS n FROM a_{name} GROUP BY k)""",
        f"""t_{name} AS (SELECT o.k, ff.fold, CAST(o.s - coalesce(a.s, 0) AS DOUBLE)
              / nullif(o.n - coalesce(a.n, 0), 0) AS te
            FROM o_{name} o CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS fold) ff
            LEFT JOIN a_{name} a ON a.k = o.k AND a.fold = ff.fold)""",
    ]


def kappa_sql(source: str, y: str, q: str, by: str = "") -> str:
    """Kappa by its definition, from the table of rating pairs and its marginals."""
    g = f"{by}, " if by else ""
    on = f"hy.{by} = hq.{by}" if by else "TRUE"
    join = f"num.{by} = den.{by}" if by else "TRUE"
    group = f"GROUP BY {by}" if by else ""
    group_hy = f"GROUP BY hy.{by}" if by else ""
    return f"""o AS (SELECT {g}{y} AS y, {q} AS q, count(*) AS n FROM {source} GROUP BY ALL),
hy AS (SELECT {g}y, sum(n) AS n FROM o GROUP BY ALL),
hq AS (SELECT {g}q, sum(n) AS n FROM o GROUP BY ALL),
num AS (SELECT {g}sum((y - q) * (y - q) * n) AS v, sum(n) AS n FROM o {group}),
den AS (SELECT {'hy.' + by + ', ' if by else ''}sum((y - q) * (y - q) * hy.n * hq.n) AS v
        FROM hy JOIN hq ON {on} {group_hy}),
kappa AS (SELECT {'num.' + by + ', ' if by else ''}
          1 - CAST(num.v AS DOUBLE) * CAST(num.n AS DOUBLE) / nullif(CAST(den.v AS DOUBLE), 0)
            AS kappa
          FROM num JOIN den ON {join})"""


def rating_sql(p: str) -> str:
    return f"CAST(least(greatest(round_even({p}, 0), 0), 20) AS INT)"


def cutoff_sql(p: str, cuts: tuple[float, ...]) -> str:
    whens = " ".join(f"WHEN {p} < {c}::DOUBLE THEN {k}" for k, c in enumerate(cuts))
    return f"CAST(CASE {whens} ELSE {len(cuts)} END AS INT)"
