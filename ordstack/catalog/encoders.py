"""Queries over the encoders and fold assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordstack.catalog.registry import (
    FOLD_SQL,
    fold_mean_ctes,
    kappa_sql,
    label_ctes,
    lazy_base,
    over_base,
    query,
    r6,
    rating_sql,
    s6,
    tag,
)
from ordstack.functions.splits import train_valid_split
from ordstack.operators import columns, encode, metric
from ordstack.plans import fixture, recipes

# --- encoders -----------------------------------------------------------------------------------

LABELS = ("f_9", "market", "customer_id")


def label_sql(cols) -> tuple[str, str, list[str]]:
    """Select list, joins and mappings of label columns."""
    picks = ", ".join(f"CAST(coalesce(m_{c}.lab, 0) AS INT) AS {c}" for c in cols)
    joins = " ".join(f"LEFT JOIN m_{c} ON m_{c}.v = {tag('b.' + c)}" for c in cols)
    ctes = [t for c in cols for t in label_ctes(c, c, "b", 10)]
    return picks, joins, ctes


_picks, _joins, _ctes = label_sql(LABELS)


@query("h1_label_encode", over_base(f"SELECT row_id, {_picks} FROM b {_joins}", *_ctes))
def label_encode(spark, sf):
    df = fixture.staged(spark, sf).select("row_id", "is_test", *LABELS)
    out = encode.LabelEncoder(min_obs=10).fit(df, LABELS).transform(df)
    return out.select("row_id", *LABELS)


def scaled_sql(c: str) -> str:
    return f"({c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END)"


def bounds_cte(cols, src="b", where="NOT is_test") -> str:
    parts = ", ".join(
        f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in cols
    )
    return f"sc AS (SELECT {parts} FROM {src} WHERE {where})"


FLOATS = ("f_5", "f_8", "f_12", "f_13", "f_15", "f_18", "f_21", "f_22", "f_26")
_SCALE = (*FLOATS, "f_10")


def _minmax_sql(where):
    picks = ", ".join(f"{s6(scaled_sql(c))} AS {c}" for c in _SCALE)
    return over_base(f"SELECT row_id, {picks} FROM b CROSS JOIN sc", bounds_cte(_SCALE, "b", where))


@query("h2_minmax_train", _minmax_sql("NOT is_test"))
def minmax_train(spark, sf):
    df = fixture.staged(spark, sf)
    out = encode.MinMax(_SCALE).fit(df.filter("NOT is_test")).transform(df)
    return out.select("row_id", *[r6(c).alias(c) for c in _SCALE])


@query("h3_minmax_all", _minmax_sql("TRUE"))
def minmax_all(spark, sf):
    df = fixture.staged(spark, sf)
    out = encode.MinMax(_SCALE).fit(df).transform(df)
    return out.select("row_id", *[r6(c).alias(c) for c in _SCALE])


def one_hot_sql(cols, src, first=0) -> tuple[str, list[str]]:
    """Cells of the one-hot columns as a union over the source columns, and the mappings."""
    ctes = [t for c in cols for t in label_ctes(c, c, src, 100, "TRUE")]
    parts, offset = [], f"{first}"
    for c in cols:
        parts.append(
            f"""SELECT row_id, CAST(m_{c}.lab - 1 + {offset} AS BIGINT) AS idx,
                CAST(1.0 AS DOUBLE) AS value
                FROM {src} JOIN m_{c} ON m_{c}.v = {tag(c)} WHERE m_{c}.lab > 0"""
        )
        offset += f" + (SELECT coalesce(max(lab), 0) FROM m_{c})"
    return " UNION ALL ".join(parts), ctes


_HOT = ("f_1", "f_7", "f_9", "market", "f_0", "f_10")
_cells, _hot_ctes = one_hot_sql(_HOT, "b")


@query("h4_one_hot", over_base(_cells, *_hot_ctes))
def one_hot(spark, sf):
    df = fixture.staged(spark, sf)
    return encode.OneHot(min_obs=100).fit(df, _HOT).transform_long(df)


@query(
    "h5_target_encode_labels",
    over_base(
        f"""SELECT l.row_id, l.customer_id, l.f_9, {s6('t_c.te')} AS te_customer_id,
            {s6('t_f.te')} AS te_f_9
            FROM l LEFT JOIN t_c ON t_c.k = l.customer_id AND t_c.fold = 2
            LEFT JOIN t_f ON t_f.k = l.f_9 AND t_f.fold = 2""",
        *label_sql(("customer_id", "f_9"))[2],
        f"""l AS (SELECT row_id, is_test, fold, target, {label_sql(('customer_id', 'f_9'))[0]}
            FROM b {label_sql(('customer_id', 'f_9'))[1]})""",
        *fold_mean_ctes("c", "customer_id", "l"),
        *fold_mean_ctes("f", "f_9", "l"),
    ),
)
def target_encode_labels(spark, sf):
    df = fixture.staged(spark, sf)
    cols = ("customer_id", "f_9")
    fitted = encode.fit_categories(df, cols, min_obs=10, target="target", n_fold=5)
    out = df
    for c in cols:
        out = fitted.apply(out, c, {"label": f"l_{c}", "te_folds": f"te_{c}"})
    return out.select(
        "row_id",
        *[F.col(f"l_{c}").alias(c) for c in cols],
        *[r6(F.get(f"te_{c}", F.lit(1))).alias(f"te_{c}") for c in cols],
    )


@query("h6_assign_folds", over_base("SELECT row_id, fold FROM b"))
def assign_folds(spark, sf):
    return lazy_base(spark, sf).select("row_id", "fold")


@query(
    "h7_train_valid_split",
    over_base(
        f"""SELECT row_id, CASE WHEN {FOLD_SQL} < {int(0.2 * 2**32)} THEN 'valid'
            ELSE 'train' END AS part FROM b"""
    ),
)
def split(spark, sf):
    train, valid = train_valid_split(fixture.base(spark, sf).select("row_id"))
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid"))
    )


# --- end to end ---------------------------------------------------------------------------------


@query(
    "flagship_oof_kappa",
    over_base(
        "SELECT fold, round(kappa, 9) AS kappa FROM kappa",
        *fold_mean_ctes("a", "customer_id", "b"),
        f"""src AS (SELECT b.fold, b.target, {rating_sql('coalesce(t_a.te, 0)')} AS r FROM b
            LEFT JOIN t_a ON t_a.k = b.customer_id AND t_a.fold = b.fold WHERE NOT is_test)""",
        kappa_sql("src", "target", "r", "fold"),
    ),
)
def flagship(spark, sf):
    df = encode.target_encode_oof(fixture.staged(spark, sf), ["customer_id"])
    filled = columns.fill_missing(df, ["te_customer_id"], [], 0)
    out = metric.qwk_by_fold(filled, "target", "te_customer_id")
    return out.select("fold", F.round("kappa", 9).alias("kappa"))
