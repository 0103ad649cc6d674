"""Queries over derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordstack.catalog.registry import (
    cutoff_sql,
    lazy_base,
    over_base,
    query,
    r6,
    rating_sql,
    rounded,
    s6,
)
from ordstack.constants import DEFAULT_CUTOFFS, J8_INTERACTIONS
from ordstack.catalog.sources import data_map, map_ctes
from ordstack.functions import dates, ids
from ordstack.functions import numeric as num
from ordstack.operators import columns
from ordstack.plans import fixture
from ordstack.sources import feature_map

DAY = "make_date(date % 10000, date // 1000000, date // 10000 % 100)"


def col(c):
    return F.col(c)


@query("b1_parse_mdy", over_base(f"SELECT row_id, {DAY} AS day FROM b"))
def parse_mdy(spark, sf):
    return fixture.base(spark, sf).select("row_id", dates.parse_mdy(col("date")).alias("day"))


@query(
    "b2_month_year_arith",
    over_base(
        """SELECT row_id, CAST(date // 1000000 AS INT) AS month,
           CAST(date % 10000 AS INT) AS year FROM b"""
    ),
)
def month_year_arith(spark, sf):
    return fixture.base(spark, sf).select(
        "row_id",
        dates.month_arith(col("date")).alias("month"),
        dates.year_arith(col("date")).alias("year"),
    )


@query(
    "b3_year_offset",
    over_base(f"SELECT row_id, CAST(year({DAY}) - 2016 AS INT) AS year_2017 FROM b"),
)
def year_offset(spark, sf):
    day = dates.parse_mdy(col("date"))
    return fixture.base(spark, sf).select("row_id", dates.year_offset(day).alias("year_2017"))


@query("b4_month", over_base(f"SELECT row_id, CAST(month({DAY}) AS INT) AS month FROM b"))
def month(spark, sf):
    day = dates.parse_mdy(col("date"))
    return fixture.base(spark, sf).select("row_id", dates.month_of(day).alias("month"))


@query(
    "b5_id_prefixes",
    over_base(
        """SELECT row_id, CAST(floor(customer_id / 1e8) AS BIGINT) AS customer_id_4,
           CAST(floor(customer_id / 1e9) AS BIGINT) AS customer_id_3,
           CAST(floor(customer_id / 1e10) AS BIGINT) AS customer_id_2 FROM b"""
    ),
)
def id_prefixes(spark, sf):
    new = ids.id_prefixes(col("customer_id"))
    return fixture.base(spark, sf).select("row_id", *[c.alias(n) for n, c in new.items()])


@query("b6_cid8", over_base("SELECT row_id, customer_id // 10000 AS cid_8 FROM b"))
def cid8(spark, sf):
    return fixture.base(spark, sf).select("row_id", ids.cid8(col("customer_id")).alias("cid_8"))


@query(
    "b7_cid5_cid3",
    over_base(
        """SELECT row_id, CAST(floor(customer_id / 1e7) AS BIGINT) AS cid_5,
           CAST(floor(customer_id / 1e4) AS BIGINT) % 1000 AS cid_3 FROM b"""
    ),
)
def cid5_cid3(spark, sf):
    c = col("customer_id")
    return fixture.base(spark, sf).select(
        "row_id", ids.cid5(c).alias("cid_5"), ids.cid3(c).alias("cid_3")
    )


@query("b8_code_number", over_base("SELECT row_id, CAST(substr(market, 2) AS INT) AS code FROM b"))
def code_number(spark, sf):
    return fixture.base(spark, sf).select("row_id", ids.code_number(col("market")).alias("code"))


def composite_sql(prefix: str) -> str:
    return (
        f"CAST({prefix} AS BIGINT) * 10000 + month({DAY}) * 100 + CAST(substr(market, 2) AS INT)"
    )


@query(
    "b9_composite_key",
    over_base(
        f"""SELECT row_id, CAST({composite_sql('customer_id // 10000000')} AS BIGINT) AS k5,
            CAST({composite_sql('customer_id // 10000 % 1000')} AS BIGINT) AS k3 FROM b"""
    ),
)
def composite_key(spark, sf):
    c, m = col("customer_id"), dates.month_of(dates.parse_mdy(col("date")))
    return fixture.base(spark, sf).select(
        "row_id",
        ids.composite_key(ids.cid5(c), m, col("market")).alias("k5"),
        ids.composite_key(ids.cid3(c), m, col("market")).alias("k3"),
    )


@query(
    "b10_drop_columns",
    over_base("SELECT * EXCLUDE (date, f_10, customer_id, fold) FROM b"),
)
def drop_columns(spark, sf):
    df = columns.drop_columns(
        fixture.base(spark, sf), ["customer_id", "date", "f_10", "f_19", "f_39"]
    )
    return df


_ROLES = {
    "customer_id": "categorical", "market": "categorical", "f_1": "categorical",
    "f_7": "categorical", "f_9": "categorical", "f_5": "float", "f_8": "float", "f_12": "float",
    "f_13": "float", "f_15": "float", "f_18": "float", "f_21": "float", "f_22": "float",
    "f_26": "float", "date": "int", "f_0": "int", "f_10": "int", "f_11": "int",
}


@query(
    "b11_column_roles",
    over_base(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{r}' AS role, count({c}) AS n FROM b"
            for c, r in _ROLES.items()
        )
    ),
)
def column_roles(spark, sf):
    df = lazy_base(spark, sf)
    roles = columns.column_roles(df, ["customer_id"])
    named = {
        **{c: "categorical" for c in roles.categorical},
        **{c: "float" for c in roles.floating},
        **{c: "int" for c in roles.integer},
    }
    one = df.agg(*[F.count(c).alias(c) for c in named])
    pairs = [
        F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), F.col(c).alias("n"))
        for c, r in named.items()
    ]
    return one.select(F.inline(F.array(*pairs)))


@query(
    "b12_to_double",
    over_base(
        """SELECT row_id, CAST(f_0 AS DOUBLE) AS f_0, CAST(f_10 AS DOUBLE) AS f_10,
           CAST(date AS DOUBLE) AS date, f_22 FROM b"""
    ),
)
def to_double(spark, sf):
    df = fixture.base(spark, sf).select("row_id", "f_0", "f_10", "date", "f_22")
    return columns.to_double(df, ["f_0", "f_10", "date", "f_22"])


@query(
    "b13_fill_missing",
    over_base("SELECT row_id, coalesce(f_9, 'NA') AS f_9, coalesce(f_22, -1) AS f_22 FROM b"),
)
def fill_missing(spark, sf):
    df = fixture.base(spark, sf).select("row_id", "f_9", "f_22")
    return columns.fill_missing(df, ["f_22"], ["f_9"])


_NULLABLE = ("market", "f_1", "f_7", "f_9", "f_0", "f_5", "f_8", "f_13", "f_22", "f_26")


@query(
    "b14_null_columns",
    over_base(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM b"
            for c in _NULLABLE
        )
        + ") WHERE n_null > 0"
    ),
)
def null_columns(spark, sf):
    return columns.null_counts(fixture.base(spark, sf), _NULLABLE)


def pairwise_sql(cols, ref=lambda c: c) -> list[str]:
    """Named expressions of every pair, rounded."""
    from itertools import combinations

    def log(c):
        return f"CASE WHEN {ref(c)} > -1 THEN ln(1 + CAST({ref(c)} AS DOUBLE)) END"

    out = []
    for a, b in combinations(cols, 2):
        out.append(f'{s6(f"{ref(a)} + {ref(b)}")} AS "{a}+{b}"')
        out.append(f'{s6(f"{ref(a)} - {ref(b)}")} AS "{a}-{b}"')
        out.append(f'{s6(f"{log(a)} + {log(b)}")} AS "{a}x{b}"')
        out.append(f'{s6(f"{log(a)} - {log(b)}")} AS "{a}/{b}"')
    return out


@query(
    "b15_pairwise",
    over_base("SELECT row_id, " + ", ".join(pairwise_sql(J8_INTERACTIONS)) + " FROM b"),
)
def pairwise(spark, sf):
    df = fixture.base(spark, sf).select("row_id", *J8_INTERACTIONS)
    return rounded(num.with_pairwise(df, J8_INTERACTIONS).drop(*J8_INTERACTIONS))


@query("b16_add_cols", over_base(f'SELECT row_id, {s6("f_5 + f_21")} AS "f_5+f_21" FROM b'))
def add_cols(spark, sf):
    return fixture.base(spark, sf).select(
        "row_id", r6(num.add_cols(col("f_5"), col("f_21"))).alias("f_5+f_21")
    )


@query(
    "b17_scaled_sum",
    over_base(
        "SELECT row_id, "
        + ", ".join(f'{s6(f"f_5 * 10 + {c}")} AS "f_5+{c}"' for c in J8_INTERACTIONS)
        + " FROM b"
    ),
)
def scaled_sum(spark, sf):
    return fixture.base(spark, sf).select(
        "row_id",
        *[r6(num.scaled_sum(col("f_5"), col(c))).alias(f"f_5+{c}") for c in J8_INTERACTIONS],
    )


@query(
    "b18_row_stats",
    over_base(
        f"""SELECT row_id, {s6("list_min(v)")} AS lo, {s6("list_max(v)")} AS hi,
            {s6("list_aggregate(v, 'median')")} AS mid,
            {s6("list_aggregate(v[1:3], 'median')")} AS mid3
            FROM (SELECT row_id, [f_22, f_21, f_13, f_5] AS v FROM b)"""
    ),
)
def row_stats(spark, sf):
    v = [col("f_22"), col("f_21"), col("f_13"), col("f_5")]
    return fixture.base(spark, sf).select(
        "row_id",
        r6(num.row_min(v)).alias("lo"),
        r6(num.row_max(v)).alias("hi"),
        r6(num.row_median(v)).alias("mid"),
        r6(num.row_median(v[:3])).alias("mid3"),
    )


@query(
    "b19_row_mean", over_base(f"SELECT row_id, {s6('(f_5 + f_8 + f_13) / 3')} AS mean FROM b")
)
def row_mean(spark, sf):
    mean = num.row_mean([col("f_5"), col("f_8"), col("f_13")])
    return fixture.base(spark, sf).select("row_id", r6(mean).alias("mean"))


@query(
    "b20_to_rating",
    over_base(
        f"""SELECT row_id, {rating_sql('f_8 / 4')} AS by_quantity,
            {rating_sql('f_5 / 20000 - 1')} AS by_price FROM b"""
    ),
)
def to_rating(spark, sf):
    return fixture.base(spark, sf).select(
        "row_id",
        num.to_rating(col("f_8") / 4).alias("by_quantity"),
        num.to_rating(col("f_5") / 20000 - 1).alias("by_price"),
    )


_UNSORTED = (3.0, 1.5, 4.5, 2.5)


@query(
    "b21_apply_cutoffs",
    over_base(
        f"""SELECT row_id, {cutoff_sql('f_22 / 4', DEFAULT_CUTOFFS)} AS rating,
            {cutoff_sql('f_22 / 10', _UNSORTED)} AS first_match FROM b"""
    ),
)
def apply_cutoffs(spark, sf):
    return fixture.base(spark, sf).select(
        "row_id",
        num.apply_cutoffs(col("f_22") / 4, DEFAULT_CUTOFFS).alias("rating"),
        num.apply_cutoffs(col("f_22") / 10, _UNSORTED).alias("first_match"),
    )


@query(
    "b22_argmax",
    over_base(
        """SELECT row_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS class
           FROM (SELECT row_id, [f_8, f_21, CAST(target * 5 AS DOUBLE), f_13 / 100] AS v FROM b)"""
    ),
)
def argmax(spark, sf):
    cols = [col("f_8"), col("f_21"), (col("target") * 5).cast("double"), col("f_13") / 100]
    return fixture.base(spark, sf).select("row_id", num.argmax_class(cols).alias("class"))


@query(
    "b23_linear_combine",
    over_base(
        f"""SELECT row_id, {s6("pred * CAST(0.7 AS DOUBLE) + pred2 * CAST(0.25 AS DOUBLE)")}
            AS blend FROM p"""
    ),
)
def linear_combine(spark, sf):
    df = fixture.predictions(lazy_base(spark, sf))
    blend = num.linear_combine([col("pred"), col("pred2")], [0.7, 0.25])
    return df.select("row_id", r6(blend).alias("blend"))


@query(
    "b24_exact_labels",
    over_base(
        "SELECT row_id, "
        + ", ".join(f"CAST(target = {k} AS INT) AS eq_{k}" for k in range(15))
        + " FROM b"
    ),
)
def exact_labels(spark, sf):
    new = num.exact_labels(col("target"), 14)
    return fixture.base(spark, sf).select("row_id", *[c.alias(n) for n, c in new.items()])


@query(
    "b25_below_labels",
    over_base(
        "SELECT row_id, "
        + ", ".join(f"CAST(target < {k} AS INT) AS lt_{k}" for k in range(2, 15))
        + " FROM b"
    ),
)
def below_labels(spark, sf):
    new = num.below_labels(col("target"), 14)
    return fixture.base(spark, sf).select("row_id", *[c.alias(n) for n, c in new.items()])


@query(
    "b26_integer_like",
    over_base("SELECT name AS \"column\", type = 'int' AS is_integer FROM fm", map_ctes()),
)
def integer_like(spark, sf):
    from ordstack.catalog.sources import WHOLE_CANDIDATES

    return columns.integer_like(fixture.base(spark, sf), WHOLE_CANDIDATES)


@query(
    "b27_prefix_names",
    over_base("SELECT idx, concat_ws('_', 'raw', name) AS name, type FROM fm", map_ctes()),
)
def prefix_names(spark, sf):
    return feature_map.prefix_names(data_map(spark, sf), "raw")
