"""Queries over filters, joins, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordstack.catalog.registry import (
    fold_mean_ctes,
    kappa_sql,
    label_ctes,
    lazy_base,
    over_base,
    query,
    r6,
    rating_sql,
    rounded,
    s6,
    tag,
)
from ordstack.catalog.sources import WHOLE_CANDIDATES, data_map, map_ctes
from ordstack.constants import RATING_COUNTS
from ordstack.operators import columns, combine, encode, lookup, metric, ordering
from ordstack.plans import fixture
from ordstack.sources import feature_map

# --- filters ------------------------------------------------------------------------------------


@query(
    "c1_fold_selection",
    over_base(
        """SELECT 'train' AS part, row_id, fold FROM b WHERE NOT is_test AND fold <> 2
           UNION ALL SELECT 'valid', row_id, fold FROM b WHERE NOT is_test AND fold = 2"""
    ),
)
def fold_selection(spark, sf):
    df = lazy_base(spark, sf).filter("NOT is_test").select("row_id", "fold")
    return (
        columns.fold_train(df, 2)
        .withColumn("part", F.lit("train"))
        .unionByName(columns.fold_valid(df, 2).withColumn("part", F.lit("valid")))
    )


@query(
    "c2_drop_constant",
    over_base("SELECT row_id, is_test, target, f_5, f_8, f_22, f_0 FROM b"),
)
def drop_constant(spark, sf):
    cols = ["f_5", "f_8", "f_22", "f_10", "f_0"]  # f_10 is constant
    df = fixture.base(spark, sf).select("row_id", "is_test", "target", *cols)
    return columns.drop_constant(df, cols)


@query(
    "c3_frequent",
    over_base(
        "SELECT customer_id, count(*) AS n FROM b WHERE NOT is_test GROUP BY 1 HAVING count(*) >= 10"
    ),
)
def frequent(spark, sf):
    train = fixture.base(spark, sf).filter("NOT is_test")
    return encode.frequent(train, "customer_id", 10)


@query(
    "c4_null_category",
    over_base(f"SELECT {tag('f_9')} AS category, count(*) AS n FROM b GROUP BY 1"),
)
def null_category(spark, sf):
    df = fixture.base(spark, sf).select(encode.null_category(F.col("f_9")).alias("category"))
    return encode.value_counts(df, "category")


@query(
    "c5_split_stacked",
    over_base(
        """SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS side, row_id, f_5 FROM b"""
    ),
)
def split_stacked(spark, sf):
    train, test = columns.split_stacked(fixture.base(spark, sf).select("row_id", "f_5", "is_test"))
    return (
        train.withColumn("side", F.lit("train"))
        .unionByName(test.withColumn("side", F.lit("test")))
        .select("side", "row_id", "f_5")
    )


# --- joins --------------------------------------------------------------------------------------


@query(
    "d1_overlap_flag",
    over_base(
        """SELECT row_id, CAST(CASE WHEN is_test THEN customer_id IN
             (SELECT customer_id FROM b WHERE NOT is_test)
           ELSE customer_id IN (SELECT customer_id FROM b WHERE is_test) END AS INT) AS cid_both
           FROM b"""
    ),
)
def overlap_flag(spark, sf):
    df = lookup.overlap_flag(fixture.staged(spark, sf), "customer_id")
    return df.select("row_id", "cid_both")


_MEANS = """m AS (SELECT market, CAST(sum(target) AS DOUBLE) / count(*) AS mean FROM b
                 WHERE NOT is_test AND fold = 1 AND market <> 'M3' GROUP BY 1)"""


@query(
    "d2_lookup_mean",
    over_base(
        f"SELECT row_id, {s6('mean')} AS mean FROM b LEFT JOIN m ON m.market = b.market", _MEANS
    ),
)
def lookup_mean(spark, sf):
    df = fixture.staged(spark, sf)
    means = (
        df.filter("NOT is_test AND fold = 1 AND market <> 'M3'")
        .groupBy("market")
        .agg((F.sum("target").cast("double") / F.count("*")).alias("mean"))
    )
    m = lookup.mapping(means, "market")
    return lookup.lookup(df, m, "market", {"mean": "mean"}).select("row_id", r6("mean").alias("mean"))


@query(
    "d3_lookup_label",
    over_base(
        f"""SELECT row_id, CAST(coalesce(lab, 0) AS INT) AS label
            FROM b LEFT JOIN m_c ON v = {tag('customer_id')}""",
        *label_ctes("c", "customer_id", "b", 10),
    ),
)
def lookup_label(spark, sf):
    df = fixture.staged(spark, sf)
    fitted = encode.fit_categories(df, ["customer_id"], min_obs=10)
    m = lookup.Mapping(
        fitted.mapping("customer_id").table, "_k0", fitted.sizes["customer_id"]
    )
    out = lookup.lookup(df, m, "customer_id", {"label": "label"}, {"label": 0}, null_safe=True)
    return out.select("row_id", F.col("label").cast("int").alias("label"))


@query(
    "d4_combine",
    over_base(
        "SELECT row_id, is_test, target, f_5 AS a_f_5, f_22 AS a_f_22, f_12 AS b_f_12, f_0 AS b_f_0 FROM b"
    ),
)
def combine_sets(spark, sf):
    df = fixture.staged(spark, sf)
    keys = ["row_id", "is_test", "target"]
    return combine.combine(
        {"a": df.select(*keys, "f_5", "f_10", "f_22"), "b": df.select(*keys, "f_12", "f_0")}
    )


def stand_ins(df, names, parts=24):
    """Prediction vectors of stand-in base models: model j mixes the two stand-ins."""
    return {
        n: df.select(
            "row_id",
            r6(F.col("pred") * ((parts - j) / parts) + F.col("pred2") * (j / parts)).alias(
                "prediction"
            ),
        )
        for j, n in enumerate(names)
    }


def stand_in_sql(names, parts=24) -> str:
    return ", ".join(
        s6(f"pred * ({float(parts - j)}::DOUBLE / {float(parts)}::DOUBLE) + "
           f"pred2 * ({float(j)}::DOUBLE / {float(parts)}::DOUBLE)")
        + f' AS "pred_{n}"'
        for j, n in enumerate(names)
    )


@query(
    "d5_stack",
    over_base(
        f"SELECT row_id, is_test, target, {stand_in_sql(['m1', 'm2', 'm3'])} FROM p"
    ),
)
def stack(spark, sf):
    df = fixture.predictions(fixture.staged(spark, sf))
    return combine.stack(
        df.select("row_id", "is_test", "target"), stand_ins(df, ["m1", "m2", "m3"])
    )


@query(
    "d6_append_features",
    over_base(
        """SELECT row_id, is_test, target, pred AS pred_m1, pred2 AS pr_0,
           CAST(target < 3 AS INT) AS pr_1 FROM p"""
    ),
)
def append_features(spark, sf):
    df = fixture.predictions(fixture.staged(spark, sf))
    stacked = df.select("row_id", "is_test", "target", F.col("pred").alias("pred_m1"))
    extra = df.select(
        "row_id", F.col("pred2").alias("pr_0"), (F.col("target") < 3).cast("int").alias("pr_1")
    )
    return combine.append_features(stacked, extra)


@query(
    "d7_with_fold_features",
    over_base(
        f"""SELECT row_id, f_5, {s6('te')} AS market FROM b
            LEFT JOIN t_m ON k = b.market AND t_m.fold = 3""",
        *fold_mean_ctes("m", "market", "b"),
    ),
)
def with_fold_features(spark, sf):
    df = fixture.staged(spark, sf)
    folds = encode.target_encode_folds(df, ["market"])
    out = combine.with_fold_features(df.select("row_id", "f_5"), folds, 3)
    return rounded(out, ("row_id", "f_5"))


@query(
    "d8_attach_predictions",
    over_base("SELECT row_id, row_id + 7 AS id, pred AS target FROM p WHERE is_test"),
)
def attach_predictions(spark, sf):
    df = fixture.predictions(fixture.staged(spark, sf)).filter("is_test")
    ids = df.select("row_id", (F.col("row_id") + 7).alias("id"))
    return combine.attach_predictions(ids, df, "pred")


# --- aggregates ---------------------------------------------------------------------------------


def mean_ctes(name, expr, src="b"):
    return f"""w_{name} AS (SELECT {expr} AS k, CAST(sum(target) AS DOUBLE) / count(*) AS te
               FROM {src} WHERE NOT is_test GROUP BY 1)"""


@query(
    "e1_target_encode",
    over_base(
        f"""SELECT row_id, {s6('w_a.te')} AS mt_market, {s6('w_b.te')} AS mt_f_9,
            {s6('w_c.te')} AS mt_customer_id
            FROM b LEFT JOIN w_a ON w_a.k = market LEFT JOIN w_b ON w_b.k = f_9
            LEFT JOIN w_c ON w_c.k = customer_id""",
        mean_ctes("a", "market"),
        mean_ctes("b", "f_9"),
        mean_ctes("c", "customer_id"),
    ),
)
def target_encode(spark, sf):
    cols = ["market", "f_9", "customer_id"]
    df = encode.target_encode(fixture.staged(spark, sf), cols)
    return df.select("row_id", *[r6(f"mt_{c}").alias(f"mt_{c}") for c in cols])


@query(
    "e2_target_encode_folds",
    over_base(
        f"""SELECT ff.fold, row_id, {s6('t_a.te')} AS market, {s6('t_b.te')} AS customer_id
            FROM b CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS fold) ff
            LEFT JOIN t_a ON t_a.k = b.market AND t_a.fold = ff.fold
            LEFT JOIN t_b ON t_b.k = b.customer_id AND t_b.fold = ff.fold""",
        *fold_mean_ctes("a", "market", "b"),
        *fold_mean_ctes("b", "customer_id", "b"),
    ),
)
def target_encode_folds(spark, sf):
    cols = ["market", "customer_id"]
    df = encode.target_encode_folds(fixture.staged(spark, sf), cols)
    return df.select("fold", "row_id", *[r6(c).alias(c) for c in cols])


@query(
    "e3_target_encode_oof",
    over_base(
        f"""SELECT row_id, {s6('t_a.te')} AS te_market, {s6('t_b.te')} AS te_customer_id FROM b
            LEFT JOIN t_a ON t_a.k = b.market AND t_a.fold = b.fold
            LEFT JOIN t_b ON t_b.k = b.customer_id AND t_b.fold = b.fold WHERE NOT is_test""",
        *fold_mean_ctes("a", "market", "b"),
        *fold_mean_ctes("b", "customer_id", "b"),
    ),
)
def target_encode_oof(spark, sf):
    cols = ["market", "customer_id"]
    df = encode.target_encode_oof(fixture.staged(spark, sf), cols)
    return df.select("row_id", *[r6(f"te_{c}").alias(f"te_{c}") for c in cols])


@query("e4_value_counts", over_base("SELECT f_9, count(*) AS n FROM b GROUP BY 1"))
def value_counts(spark, sf):
    return encode.value_counts(fixture.base(spark, sf), "f_9")


_SCALED = ("f_0", "f_5", "f_8", "f_10", "f_13", "f_22")


@query(
    "e5_fit_minmax",
    over_base(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS lo,
                CAST(max({c}) AS DOUBLE) AS hi FROM b WHERE NOT is_test"""
            for c in _SCALED
        )
    ),
)
def fit_minmax(spark, sf):
    return columns.min_max(fixture.base(spark, sf).filter("NOT is_test"), _SCALED)


@query(
    "e6_column_std",
    over_base(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", round(stddev_pop({c}), 3) AS std FROM b"""
            for c in _SCALED
        )
    ),
)
def column_std(spark, sf):
    df = columns.column_std(fixture.base(spark, sf), _SCALED)
    return df.select("column", F.round("std", 3).alias("std"))


_RATED = "src AS (SELECT fold, target, " + rating_sql("pred") + " AS r FROM p WHERE NOT is_test)"


def _train_predictions(spark, sf):
    return fixture.predictions(lazy_base(spark, sf)).filter("NOT is_test")


@query(
    "e7_qwk",
    over_base(
        "SELECT round(kappa, 9) AS kappa FROM kappa", _RATED, kappa_sql("src", "target", "r")
    ),
)
def qwk(spark, sf):
    df = metric.qwk(_train_predictions(spark, sf), "target", "pred")
    return df.select(F.round("kappa", 9).alias("kappa"))


@query(
    "e8_qwk_by_fold",
    over_base(
        "SELECT fold, round(kappa, 9) AS kappa FROM kappa",
        _RATED,
        kappa_sql("src", "target", "r", "fold"),
    ),
)
def qwk_by_fold(spark, sf):
    df = metric.qwk_by_fold(_train_predictions(spark, sf), "target", "pred")
    return df.select("fold", F.round("kappa", 9).alias("kappa"))


@query(
    "e9_confusion",
    over_base("SELECT target AS y, r AS p, count(*) AS n FROM src GROUP BY 1, 2", _RATED),
)
def confusion(spark, sf):
    return metric.confusion(_train_predictions(spark, sf), "target", "pred")


_GAINS_SQL = over_base(
    f"""SELECT name, {s6('gain / sum(gain) OVER ()')} AS gain FROM
        (SELECT market AS name, CAST(sum(target) AS DOUBLE) AS gain FROM b GROUP BY 1)"""
)


def _importance(spark, sf):
    gains = (
        fixture.base(spark, sf)
        .groupBy(F.col("market").alias("name"))
        .agg(F.sum("target").cast("double").alias("gain"))
    )
    return ordering.importance(gains).select("name", r6("gain").alias("gain"))


@query("e10_importance", _GAINS_SQL)
def importance(spark, sf):
    return _importance(spark, sf)


_PER_FOLD = "CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS i) ff"


@query(
    "e11_fold_average",
    over_base(
        f"SELECT row_id, {s6('avg(pred + i * 0.5::DOUBLE)')} AS prediction FROM p {_PER_FOLD} "
        "WHERE is_test GROUP BY 1"
    ),
)
def fold_average(spark, sf):
    df = fixture.predictions(lazy_base(spark, sf)).filter("is_test")
    five = df.select("row_id", "pred", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("i"))
    per_fold = five.select("row_id", (F.col("pred") + F.col("i") * F.lit(0.5)).alias("prediction"))
    out = combine.fold_average(per_fold)
    return out.select("row_id", r6("prediction").alias("prediction"))


def _class_sql(k):
    return f"CAST((target * 7 + i * 3 + {k} * 5 + f_0 * {k}) % 11 AS DOUBLE)"


@query(
    "e12_fold_average_classes",
    over_base(
        """SELECT row_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS rating FROM
           (SELECT row_id, ["""
        + ", ".join(f"avg({_class_sql(k)})" for k in range(4))
        + f"] AS v FROM b {_PER_FOLD} WHERE is_test GROUP BY 1)"
    ),
)
def fold_average_classes(spark, sf):
    df = fixture.base(spark, sf).filter("is_test")
    five = df.select(
        "row_id", "target", "f_0", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("i")
    )
    names = [f"c{k}" for k in range(4)]
    weights = five.select(
        "row_id",
        *[
            ((F.col("target") * 7 + F.col("i") * 3 + k * 5 + F.col("f_0") * k) % 11)
            .cast("double")
            .alias(n)
            for k, n in enumerate(names)
        ],
    )
    return combine.fold_average_classes(weights, names)


_CURVE = """curve AS (SELECT fold, date // 1000000 AS round,
              CAST(sum(target) AS DOUBLE) / count(*) AS loss FROM b WHERE NOT is_test GROUP BY 1, 2)"""


def _curve(spark, sf, by):
    df = lazy_base(spark, sf).filter("NOT is_test")
    return df.groupBy(*by, F.expr("date div 1000000").alias("round")).agg(
        (F.sum("target").cast("double") / F.count("*")).alias("loss")
    )


@query(
    "e13_mean_best_rounds",
    over_base(
        """SELECT CAST(sum(best_round) // count(*) AS BIGINT) AS mean_rounds FROM
           (SELECT fold, min_by(round, loss) AS best_round FROM curve GROUP BY 1)""",
        _CURVE,
    ),
)
def mean_best_rounds(spark, sf):
    curve = _curve(spark, sf, ["fold"])
    best = curve.groupBy("fold").agg(F.min_by("round", F.struct("loss", "round")).alias("best_round"))
    return combine.mean_best_rounds(best)


@query(
    "e14_class_shares",
    over_base(
        """SELECT target, CAST(sum(count(*)) OVER (ORDER BY target) AS DOUBLE)
             / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
           FROM b WHERE NOT is_test GROUP BY target"""
    ),
)
def class_shares(spark, sf):
    hist = encode.value_counts(fixture.base(spark, sf).filter("NOT is_test"), "target")
    return ordering.class_shares(hist, "target", "n")


# --- ordering -----------------------------------------------------------------------------------

_POSITIONS = (0, 1, 250, 500, 999, 1500, 2500)


@query(
    "f1_order_stats",
    over_base(
        f"""SELECT position, value FROM (SELECT f_5 AS value,
              row_number() OVER (ORDER BY f_5) - 1 AS position FROM b WHERE is_test)
            WHERE position IN {_POSITIONS}"""
    ),
)
def order_stats(spark, sf):
    return ordering.order_stats(fixture.base(spark, sf).filter("is_test"), "f_5", _POSITIONS)


def shares_ctes(p="pred", where="is_test"):
    cum = 0
    lines = []
    for i, n in enumerate(RATING_COUNTS[:-1]):
        cum += n
        lines.append(f"({i}, {cum})")
    total = float(sum(RATING_COUNTS))
    return [
        f"rk AS (SELECT {p} AS v, row_number() OVER (ORDER BY {p}) - 1 AS i FROM p WHERE {where})",
        f"""th AS (SELECT v AS t FROM (VALUES {', '.join(lines)}) c(cls, reached)
            JOIN rk ON rk.i = CAST(floor(CAST(reached AS DOUBLE) / {total}::DOUBLE *
              (SELECT count(*) FROM rk)) AS BIGINT))""",
    ]


_SHARES_SQL = over_base(
    """SELECT row_id, CAST((SELECT count(*) FROM th WHERE t <= pred) AS INT) AS rating
       FROM p WHERE is_test""",
    *shares_ctes(),
)


def assigned(spark, sf):
    df = fixture.predictions(fixture.staged(spark, sf)).filter("is_test")
    return ordering.assign_by_shares(df, "pred").select("row_id", "rating")


@query(
    "f2_assign_by_shares",
    over_base(
        """SELECT row_id, CAST((SELECT count(*) FROM th WHERE t <= f_5) AS INT) AS rating
           FROM b WHERE is_test""",
        *[c.replace("FROM p ", "FROM b ") for c in shares_ctes("f_5")],
    ),
)
def assign_prices(spark, sf):
    df = fixture.staged(spark, sf).filter("is_test")
    return ordering.assign_by_shares(df, "f_5").select("row_id", "rating")


@query(
    "f3_number_labels",
    over_base(
        "SELECT v AS value, CAST(lab AS INT) AS label FROM m_c", *label_ctes("c", "customer_id", "b", 10)
    ),
)
def number_labels(spark, sf):
    fitted = encode.fit_categories(fixture.staged(spark, sf), ["customer_id"], min_obs=10)
    return fitted.mapping("customer_id").table.select(
        encode.null_category(F.col("_k0")).alias("value"), "label"
    )


@query("f4_sort_importance", _GAINS_SQL)
def sort_importance(spark, sf):
    return _importance(spark, sf)


@query(
    "f5_enumerate_columns",
    over_base(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INT) AS idx, '{c}' AS name, count({c}) AS n FROM b"
            for i, c in enumerate(WHOLE_CANDIDATES)
        )
    ),
)
def enumerate_columns(spark, sf):
    df = fixture.base(spark, sf).select(*WHOLE_CANDIDATES)
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [
        F.struct(F.lit(i).alias("idx"), F.lit(c).alias("name"), F.col(c).alias("n"))
        for i, c in feature_map.enumerate_columns(df)
    ]
    return one.select(F.inline(F.array(*rows)))


@query(
    "f6_best_round",
    over_base(
        "SELECT min_by(round, loss) AS best_round FROM curve",
        _CURVE.replace("SELECT fold, ", "SELECT ").replace("GROUP BY 1, 2", "GROUP BY 1"),
    ),
)
def best_round(spark, sf):
    return ordering.best_round(_curve(spark, sf, []))


# --- set operations -----------------------------------------------------------------------------


@query(
    "g1_stack_rows",
    over_base(
        """SELECT row_id, is_test, f_5, CASE WHEN NOT is_test THEN target END AS target FROM b"""
    ),
)
def stack_rows(spark, sf):
    df = fixture.base(spark, sf)
    train, test = columns.split_stacked(df.select("row_id", "is_test", "f_5", "target"))
    return columns.stack_rows(train, test.drop("target"))


_MAP_A, _MAP_B = ("f_0", "f_5", "f_10"), ("f_8", "f_12", "f_13")


def _two_maps():
    return [
        map_ctes(_MAP_A).replace("fm AS", "fa AS"),
        map_ctes(_MAP_B).replace("fm AS", "fb AS"),
    ]


@query(
    "g2_concat_maps",
    over_base(
        """SELECT CAST(row_number() OVER (ORDER BY s, idx) - 1 AS INT) AS idx, name, type FROM
           (SELECT 0 AS s, * FROM fa UNION ALL SELECT 1, * FROM fb)""",
        *_two_maps(),
    ),
)
def concat_maps(spark, sf):
    return feature_map.concat_maps([data_map(spark, sf, _MAP_A), data_map(spark, sf, _MAP_B)])


@query(
    "g3_concat_maps_prefixed",
    over_base(
        """SELECT CAST(row_number() OVER (ORDER BY s, idx) - 1 AS INT) AS idx, name, type FROM
           (SELECT 0 AS s, idx, concat('a_', name) AS name, type FROM fa
            UNION ALL SELECT 1, idx, concat('b_', name), type FROM fb)
           WHERE name <> 'a_f_10'""",
        *_two_maps(),
    ),
)
def concat_maps_prefixed(spark, sf):
    df = fixture.base(spark, sf)
    sets = {"a": _MAP_A, "b": _MAP_B}
    train = df.filter("NOT is_test")
    kept = columns.varying_columns(train, [*_MAP_A, *_MAP_B])
    names = [f"{s}_{c}" for s, cols in sets.items() for c in cols if c in kept]
    maps = {s: data_map(spark, sf, cols) for s, cols in sets.items()}
    return feature_map.concat_maps_prefixed(maps, names)
