"""Queries over the feature-set recipes and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordstack.catalog.encoders import FLOATS, bounds_cte, one_hot_sql, scaled_sql
from ordstack.catalog.projections import DAY, composite_sql, pairwise_sql
from ordstack.catalog.registry import fold_mean_ctes, label_ctes, over_base, query, r6, rounded, s6, tag
from ordstack.catalog.relational import mean_ctes, stand_in_sql, stand_ins
from ordstack.constants import J1_INTERACTIONS, J4_INTERACTIONS, J8_INTERACTIONS
from ordstack.operators.combine import cells_of, combine_cells
from ordstack.plans import fixture, recipes, stacks

KEYS = ("row_id", "is_test", "target")
KEY_SQL = "s.row_id, s.is_test, s.target"
TEXT = ("market", "f_1", "f_7", "f_9")
NINE = ("customer_id", "cid_5", "cid_3", "cid_5_month_market", "cid_3_month_market", *TEXT)

SOURCE = f"""s AS (SELECT *, CAST(year({DAY}) - 2016 AS INT) AS year_2017,
  CAST(month({DAY}) AS INT) AS month, customer_id // 10000 AS cid_8,
  customer_id // 10000000 AS cid_5, customer_id // 10000 % 1000 AS cid_3,
  {composite_sql('customer_id // 10000000')} AS cid_5_month_market,
  {composite_sql('customer_id // 10000 % 1000')} AS cid_3_month_market FROM b)"""


def labels_cte(cols, name="l", min_obs=10) -> list[str]:
    """Labels ``<column>`` of all rows as a table, after their mappings."""
    ctes = [t for c in cols for t in label_ctes(c, c, "s", min_obs)]
    picks = ", ".join(f"CAST(coalesce(m_{c}.lab, 0) AS INT) AS {c}" for c in cols)
    joins = " ".join(f"LEFT JOIN m_{c} ON m_{c}.v = {tag('s.' + c)}" for c in cols)
    keys = "s.row_id, s.is_test, s.target, s.fold"
    return [*ctes, f"{name} AS (SELECT {keys}, {picks} FROM s {joins})"]


def scaled_cte() -> list[str]:
    picks = ", ".join(f"{scaled_sql(c)} AS {c}" for c in FLOATS)
    rest = "row_id, customer_id, f_0, f_10, f_11, year_2017, month"
    return [bounds_cte(FLOATS, "s"), f"z AS (SELECT {rest}, {picks} FROM s CROSS JOIN sc)"]


def renamed(picks: list[str], prefix: str) -> list[str]:
    """``expr AS name`` with the name prefixed."""
    out = []
    for p in picks:
        expr, name = p.rsplit(" AS ", 1)
        out.append(f'{expr} AS "{prefix}{name.strip(chr(34))}"')
    return out


# --- h1, j0, j1, j2 -----------------------------------------------------------------------------


@query(
    "i1_h1",
    over_base(
        """SELECT row_id, is_test, target, market, f_1, f_7, coalesce(f_9, 'NA') AS f_9,
           CAST(date // 1000000 AS VARCHAR) AS month, CAST(date % 10000 AS VARCHAR) AS year,
           customer_id, customer_id // 100000000 AS customer_id_4,
           customer_id // 1000000000 AS customer_id_3, customer_id // 10000000000 AS customer_id_2,
           f_0, f_5, f_8, f_11, f_12, f_13, f_15, f_18, f_21, coalesce(f_22, -1) AS f_22, f_26
           FROM b"""
    ),
)
def h1(spark, sf):
    return recipes.h1(fixture.base(spark, sf)).table


@query(
    "i2_j0",
    over_base(
        f"""SELECT {KEY_SQL}, l.customer_id, {', '.join('l.' + c for c in TEXT)},
            {', '.join('s.' + c for c in FLOATS)}, s.f_0, s.f_10, s.f_11, s.year_2017, s.month
            FROM s JOIN l ON l.row_id = s.row_id""",
        SOURCE,
        *labels_cte(("customer_id", *TEXT)),
    ),
)
def j0(spark, sf):
    return recipes.j0(fixture.staged(spark, sf)).table


def _j1_picks() -> list[str]:
    z = lambda c: f"z.{c}"
    return [
        "l.cid_8 AS cid_8",
        *[f"l.{c} AS {c}" for c in TEXT],
        *[f"{s6('z.' + c)} AS {c}" for c in FLOATS],
        *[f"z.{c} AS {c}" for c in ("f_0", "f_10", "f_11", "year_2017", "month")],
        f'{s6("z.f_5 + z.f_21")} AS "f_5+f_21"',
        *pairwise_sql(J1_INTERACTIONS, z),
    ]


_JOINED = "FROM s JOIN l ON l.row_id = s.row_id JOIN z ON z.row_id = s.row_id"
_J1_CTES = [SOURCE, *labels_cte(("cid_8", *TEXT)), *scaled_cte()]


@query("i3_j1", over_base(f"SELECT {KEY_SQL}, {', '.join(_j1_picks())} {_JOINED}", *_J1_CTES))
def j1(spark, sf):
    return rounded(recipes.j1(fixture.staged(spark, sf)).table)


_J2_PICKS = [*_j1_picks(), "z.customer_id AS customer_id"]


@query("i4_j2", over_base(f"SELECT {KEY_SQL}, {', '.join(_J2_PICKS)} {_JOINED}", *_J1_CTES))
def j2(spark, sf):
    return rounded(recipes.j2(fixture.staged(spark, sf)).table)


# --- j4 -----------------------------------------------------------------------------------------


def _fives(cols) -> list[str]:
    return [f'{s6(f"z.f_5 * 10 + z.{c}")} AS "f_5+{c}"' for c in cols]


_J4_PICKS = [*_fives(J4_INTERACTIONS), *pairwise_sql(J4_INTERACTIONS, lambda c: f"z.{c}")]


@query(
    "i6_j4",
    over_base(
        f"SELECT {KEY_SQL}, {', '.join(_J4_PICKS)} FROM s JOIN z ON z.row_id = s.row_id",
        SOURCE,
        *scaled_cte(),
    ),
)
def j4(spark, sf):
    return rounded(recipes.j4(fixture.staged(spark, sf)).table)


def encoded_sql(cols, src) -> str:
    """Per-fold encodings of all rows with their row statistics."""
    joins = " ".join(f"LEFT JOIN t_{c} ON t_{c}.k = {src}.{c} AND t_{c}.fold = ff.fold" for c in cols)
    picks = ", ".join(f"t_{c}.te AS {c}" for c in cols)
    out = ", ".join(f"{s6(c)} AS {c}" for c in cols)
    return f"""SELECT fold, row_id, is_test, target, {out},
      {s6('list_min(v)')} AS min_target_encoding, {s6('list_max(v)')} AS max_target_encoding,
      {s6("list_aggregate(v, 'median')")} AS median_target_encoding
      FROM (SELECT *, [{', '.join(cols)}] AS v FROM
        (SELECT ff.fold, {src}.row_id, {src}.is_test, {src}.target, {picks} FROM {src}
         CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS fold) ff {joins}))"""


_J4_CATS = ("cid_5", "cid_3", *TEXT)


@query(
    "i6_j4_folds",
    over_base(
        encoded_sql(_J4_CATS, "s"),
        SOURCE,
        *[t for c in _J4_CATS for t in fold_mean_ctes(c, c, "s")],
    ),
)
def j4_folds(spark, sf):
    return rounded(recipes.j4_folds(fixture.staged(spark, sf)))


# --- j6 -----------------------------------------------------------------------------------------

_COMP = ("cid_5_month_market", "cid_3_month_market")
FEW = 3  # rows of a value that is no longer rare: composite keys have few in this data
_J6_CTES = [*labels_cte(_COMP, "lc", FEW), *[mean_ctes(c, c, "lc") for c in _COMP]]
_BOTH = """CAST(CASE WHEN s.is_test THEN s.customer_id IN
    (SELECT customer_id FROM b WHERE NOT is_test)
    ELSE s.customer_id IN (SELECT customer_id FROM b WHERE is_test) END AS INT)"""
_J6_PICKS = [
    f"{_BOTH} AS cid_both",
    *[f"{s6(f'w_{c}.te')} AS mt_{c}" for c in _COMP],
    *[f"lc.{c} AS {c}" for c in _COMP],
]
_J6_JOINS = "JOIN lc ON lc.row_id = s.row_id " + " ".join(
    f"LEFT JOIN w_{c} ON w_{c}.k = lc.{c}" for c in _COMP
)


@query(
    "i8_j6",
    over_base(f"SELECT {KEY_SQL}, {', '.join(_J6_PICKS)} FROM s {_J6_JOINS}", SOURCE, *_J6_CTES),
)
def j6(spark, sf):
    return rounded(recipes.j6(fixture.staged(spark, sf), FEW).table)


# --- j5, j7 -------------------------------------------------------------------------------------


def _varying(picks: list[str]) -> list[str]:
    return [p for p in picks if p != "z.f_10 AS f_10"]  # constant, so dropped


@query(
    "i7_j5",
    over_base(
        f"""SELECT {KEY_SQL}, {', '.join(renamed(_varying(_J2_PICKS), 'j2_'))},
            {', '.join(renamed(_J4_PICKS, 'j4_'))} {_JOINED}""",
        *_J1_CTES,
    ),
)
def j5(spark, sf):
    return rounded(recipes.j5(fixture.staged(spark, sf)).table)


@query(
    "i9_j7",
    over_base(
        f"""SELECT {KEY_SQL}, {', '.join(renamed(_J2_PICKS, 'j5_j2_'))},
            {', '.join(renamed(_J4_PICKS, 'j5_j4_'))}, {', '.join(renamed(_J6_PICKS, 'j6_'))}
            {_JOINED} {_J6_JOINS}""",
        *_J1_CTES,
        *_J6_CTES,
    ),
)
def j7(spark, sf):
    # which columns are constant hangs on the data; dropping them has its own query
    return rounded(recipes.j7(fixture.staged(spark, sf), FEW, drop_constants=False).table)


# --- j8 -----------------------------------------------------------------------------------------


@query(
    "i10_j8",
    over_base(
        f"""SELECT {KEY_SQL}, {', '.join('l.' + c for c in NINE)},
            {', '.join(f"{s6('z.' + c)} AS {c}" for c in FLOATS)},
            z.f_0, z.f_11, z.year_2017, z.month, {_BOTH} AS cid_both,
            {', '.join(_fives(J8_INTERACTIONS))},
            {', '.join(pairwise_sql(J8_INTERACTIONS, lambda c: f'z.{c}'))} {_JOINED}""",
        SOURCE,
        *labels_cte(NINE, min_obs=FEW),
        *scaled_cte(),
    ),
)
def j8(spark, sf):
    return rounded(recipes.j8(fixture.staged(spark, sf), FEW).table)


@query(
    "i10_j8_folds",
    over_base(
        encoded_sql(NINE, "l"),
        SOURCE,
        *labels_cte(NINE, min_obs=FEW),
        *[t for c in NINE for t in fold_mean_ctes(c, c, "l")],
    ),
)
def j8_folds(spark, sf):
    return rounded(recipes.j8(fixture.staged(spark, sf), FEW).folds)


# --- n1 … n4 ------------------------------------------------------------------------------------

_N1_HOT = ("f_0", "f_10", "f_11", "year_2017", "month", "customer_id", *TEXT)
_n1_cells, _n1_ctes = one_hot_sql(_N1_HOT, "r", len(FLOATS))


_N1_CELLS = (
    " UNION ALL ".join(
        f"""SELECT row_id, CAST({i} AS BIGINT) AS idx, {scaled_sql(c)} AS value
            FROM r CROSS JOIN sc WHERE {c} IS NOT NULL"""
        for i, c in enumerate(FLOATS)
    )
    + " UNION ALL "
    + _n1_cells
)
_N1_CTES = [
    SOURCE,
    "r AS (SELECT * REPLACE (cid_5 AS customer_id) FROM s)",
    bounds_cte(FLOATS, "r", "TRUE"),
    *_n1_ctes,
    f"cells AS ({_N1_CELLS})",
]


@query("i11_n1", over_base(f"SELECT row_id, idx, {s6('value')} AS value FROM cells", *_N1_CTES))
def n1(spark, sf):
    cells = recipes.n1(fixture.staged(spark, sf)).cells()
    return cells.select("row_id", "idx", r6("value").alias("value"))


def projected_cte(k: int) -> str:
    """``e(row_id, c, v)``: signed sums of the cells of every component."""
    digest = "md5('42:' || CAST(idx AS VARCHAR))"
    return f"""e AS (SELECT row_id, CAST(('0x' || substr({digest}, 1, 8))::BIGINT % {k} AS INT) AS c,
      sum(CASE WHEN ('0x' || substr({digest}, 9, 1))::INT % 2 = 0 THEN value ELSE -value END) AS v
      FROM cells GROUP BY 1, 2)"""


def _components(k: int) -> list[str]:
    return [f"{s6(f'coalesce(sum(v) FILTER (WHERE c = {i}), 0)')} AS e_{i}" for i in range(k)]


def _embedded_sql(k: int) -> str:
    return over_base(
        f"""SELECT b.row_id, any_value(is_test) AS is_test, any_value(target) AS target,
            {', '.join(_components(k))} FROM b JOIN e ON e.row_id = b.row_id GROUP BY b.row_id""",
        *_N1_CTES,
        projected_cte(k),
    )


@query("h8_embed", _embedded_sql(16))
def embedded(spark, sf):
    return rounded(recipes.n2(fixture.staged(spark, sf), k=16).table)


@query("i12_n2", _embedded_sql(64))
def n2(spark, sf):
    return rounded(recipes.n2(fixture.staged(spark, sf)).table)


@query("i12_n3", _embedded_sql(128))
def n3(spark, sf):
    return rounded(recipes.n3(fixture.staged(spark, sf)).table)


@query("i12_n4", _embedded_sql(1024))
def n4(spark, sf):
    return rounded(recipes.n4(fixture.staged(spark, sf)).table)


# --- learned embeddings and sparse combinations --------------------------------------------------


def _register_learned(name: str, k: int) -> None:
    @query(name)
    def run(spark, sf):
        return rounded(recipes.n2(fixture.staged(spark, sf), k, learned=True).table)


for _name, _k in (("h8_learned", 16), ("i12_n2_learned", 64), ("i12_n3_learned", 128), ("i12_n4_learned", 1024)):
    _register_learned(_name, _k)


@query("i5_j3_learned")
def j3_learned(spark, sf):
    return rounded(recipes.j3(fixture.staged(spark, sf), drop_constants=False, learned=True).table)


@query(
    "h8_learned_contract",
    over_base(
        """SELECT count(DISTINCT row_id) AS n, round(sum(value * value), 3) AS energy, TRUE AS strongest_first,
           TRUE AS mostly_kept, TRUE AS orthogonal FROM cells""",
        *_N1_CTES,
    ),
)
def learned_contract(spark, sf):
    """Sixteen learned components hold most of the cells' sum of squares and no more than all of it, the
    first the most, and are orthogonal over the rows."""
    raw = fixture.staged(spark, sf)
    energy = recipes.n1(raw).cells().agg(F.round(F.sum(F.col("value") ** 2), 3)).first()[0]
    made = recipes.n2(raw, 16, learned=True).table
    e = [F.col(f"e_{i}") for i in range(16)]
    squares = [F.sum(x * x) for x in e]
    kept = sum(squares[1:], squares[0])
    crossed = [F.abs(F.sum(a * b)) for a, b in zip(e, e[1:])]
    return made.agg(
        F.count("row_id").alias("n"),
        F.lit(energy).alias("energy"),
        (F.greatest(*squares) <= squares[0] * (1 + 1e-9)).alias("strongest_first"),
        ((kept > 0.5 * energy) & (kept < energy * (1 + 1e-6))).alias("mostly_kept"),
        (F.greatest(*crossed) < 1e-6 * energy).alias("orthogonal"),
    )


_DENSE = ("f_0", "f_10", "f_12", "f_22")


@query(
    "d4_combine_sparse",
    over_base(
        f"""SELECT row_id, new AS idx, {s6('value')} AS value FROM wide JOIN kept USING (idx)""",
        *_N1_CTES,
        f"""wide AS (SELECT row_id, idx + {len(_DENSE)} AS idx, value FROM cells WHERE value <> 0 UNION ALL """
        + " UNION ALL ".join(
            f"SELECT row_id, CAST({i} AS BIGINT), CAST({c} AS DOUBLE) FROM b WHERE {c} <> 0" for i, c in enumerate(_DENSE)
        )
        + ")",
        """st AS (SELECT idx, count(*) AS n, min(value) AS lo, max(value) AS hi FROM wide
           JOIN (SELECT row_id, is_test FROM b) USING (row_id) WHERE NOT is_test GROUP BY idx)""",
        """kept AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new FROM st
           CROSS JOIN (SELECT count(*) AS n_rows FROM b WHERE NOT is_test)
           WHERE CASE WHEN n < n_rows THEN least(lo, 0) ELSE lo END
              <> CASE WHEN n < n_rows THEN greatest(hi, 0) ELSE hi END)""",
    ),
)
def combine_sparse(spark, sf):
    """A dense set and the sparse one side by side, columns constant over the train rows dropped."""
    raw = fixture.staged(spark, sf)
    dense = cells_of(raw, [(c, "q") for c in _DENSE])
    made = combine_cells({"raw": dense, "n1": recipes.n1(raw).cell_set()}, raw.select("row_id", "is_test"))
    return made.cells.select("row_id", "idx", r6("value").alias("value"))


@query(
    "i5_j3",
    over_base(
        f"""SELECT {KEY_SQL}, {', '.join(renamed(_J2_PICKS, 'j2_'))},
            {', '.join(f'n3.e_{i} AS n3_e_{i}' for i in range(128))}
            {_JOINED} JOIN n3 ON n3.row_id = s.row_id""",
        *_J1_CTES,
        f"""n3 AS (WITH {', '.join(_N1_CTES[1:])}, {projected_cte(128)}
            SELECT row_id, {', '.join(_components(128))} FROM e GROUP BY row_id)""",
    ),
)
def j3(spark, sf):
    return rounded(recipes.j3(fixture.staged(spark, sf), drop_constants=False).table)


@query(
    "i13_binary_targets",
    over_base(
        "SELECT row_id, target, "
        + ", ".join(
            [f"CAST(target = {k} AS INT) AS eq_{k}" for k in range(11)]
            + [f"CAST(target < {k} AS INT) AS lt_{k}" for k in range(2, 11)]
        )
        + " FROM b WHERE NOT is_test"
    ),
)
def binary_targets(spark, sf):
    df = fixture.base(spark, sf).filter("NOT is_test").select("row_id", "target")
    return recipes.binary_targets(df)


# --- stacks -------------------------------------------------------------------------------------


def model_names(n: int) -> list[str]:
    return [f"base{i + 1}" for i in range(n)]


def stacked(spark, sf, names):
    df = fixture.predictions(fixture.staged(spark, sf))
    return stacks.stack_models(df.select(*KEYS), stand_ins(df, names), names)


def probabilities(df):
    """Stand-in class probabilities: how close the prediction is to k, and how far below k."""
    p = F.col("pred")
    zero, one = F.lit(0.0), F.lit(1.0)
    exact = [F.greatest(zero, one - F.abs(p - k)).alias(f"pr_eq_{k}") for k in range(11)]
    below = [F.least(one, F.greatest(zero, k - p)).alias(f"pr_lt_{k}") for k in range(2, 11)]
    return df.select("row_id", *exact, *below)


_PROBABILITY_SQL = ", ".join(
    [f"{s6(f'greatest(0, 1 - abs(pred - {k}))')} AS pr_eq_{k}" for k in range(11)]
    + [f"{s6(f'least(1, greatest(0, {k} - pred))')} AS pr_lt_{k}" for k in range(2, 11)]
)


def _register_stack(name: str, n: int) -> None:
    sql = over_base(f"SELECT {', '.join(KEYS)}, {stand_in_sql(model_names(n))} FROM p")

    @query(name, sql)
    def run(spark, sf):
        return stacked(spark, sf, model_names(n))


def _register_stack_pr(name: str, n: int) -> None:
    sql = over_base(
        f"SELECT {', '.join(KEYS)}, {stand_in_sql(model_names(n))}, {_PROBABILITY_SQL} FROM p"
    )

    @query(name, sql)
    def run(spark, sf):
        extra = probabilities(fixture.predictions(fixture.staged(spark, sf)))
        out = stacks.stack_with_probabilities(stacked(spark, sf, model_names(n)), extra)
        return rounded(out)


for _name, _n in stacks.STACK_SIZES.items():
    _register_stack(f"i14_stack_{_name}", _n)
for _name, _n in (("esb8_pr", 20), ("esb9_pr", 22), ("esb10_pr", 24)):
    _register_stack_pr(f"i15_stack_{_name}", _n)
for _name, _n in stacks.SECOND_LEVEL_SIZES.items():
    _register_stack(f"i16_stack_{_name}", _n)
