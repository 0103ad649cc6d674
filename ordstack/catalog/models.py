"""Queries over the model jobs, cutoffs and blends."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordstack.catalog.feature_sets import model_names, probabilities, stacked
from ordstack.catalog.registry import (
    cutoff_sql,
    kappa_sql,
    lazy_base,
    over_base,
    query,
    r6,
    rating_sql,
    s6,
)
from ordstack.catalog.relational import _SHARES_SQL, assigned, stand_in_sql
from ordstack.constants import DEFAULT_CUTOFFS, N_FOLD
from ordstack.functions.numeric import apply_cutoffs, quoted
from ordstack.models import blend, cutoffs, jobs
from ordstack.operators import combine, encode, metric
from ordstack.operators.columns import feature_columns
from ordstack.plans import fixture, recipes, stacks
from ordstack.session import scratch_path, store
from ordstack.sources import feature_map, tables

LEAKY = ("f_0", "f_11")  # counts over the rows the target counts; left out of model features
#: Rounds end by the validation curve; the tables of the tests give 10 to 20.
STOPPED = jobs.Boosting(rounds=20, depth=4, rate=0.35, bins=32, patience=3, block=4)


def usable(df) -> list[str]:
    """Feature columns that do not derive from the leaky ones."""
    return [
        c for c in feature_columns(df) if not set(LEAKY) & set(re.findall(r"f_\d+", c))
    ]


def with_fold(df):
    return store(fixture.with_fold(df), "features")


def made_of_one(df) -> list[str]:
    """Columns that are no interaction of two."""
    return [c for c in df.columns if len(re.findall(r"f_\d+", c)) < 2]


def with_contract(name: str) -> Callable:
    """Register a model query, and ``<name>_contract``, which runs it too: per side the number of rows, of
    row ids and of missing predictions, and whether predictions of rows the model did not see err less than
    the mean."""

    def register(make: Callable) -> Callable:
        run = query(name)(make)

        @query(f"{name}_contract", _CONTRACT_SQL)
        def contract(spark, sf):
            truth = fixture.base(spark, sf).select("row_id", "target")
            got = run(spark, sf).join(truth, "row_id")
            error = F.avg((F.col("prediction") - F.col("target")) ** 2)
            return got.groupBy("side").agg(
                F.count("*").alias("n"),
                F.count_distinct("row_id").alias("ids"),
                F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("missing"),
                F.when(F.col("side") == "oof", error < F.var_pop("target")).alias("beats_mean"),
            )

        return run

    return register


_CONTRACT_SQL = over_base(
    """SELECT CASE WHEN is_test THEN 'test' ELSE 'oof' END AS side, count(*) AS n,
       count(DISTINCT row_id) AS ids, CAST(0 AS BIGINT) AS missing,
       CASE WHEN NOT is_test THEN TRUE END AS beats_mean FROM b GROUP BY is_test"""
)


def both_sides(result: jobs.Result):
    """Out-of-fold and test predictions as one table."""
    oof = result.oof.select("row_id", F.lit("oof").alias("side"), "prediction")
    test = result.test.select("row_id", F.lit("test").alias("side"), "prediction")
    return oof.unionByName(test)


@with_contract("j1_boosted_regression")
def boosted(spark, sf):
    df = with_fold(recipes.j0(fixture.staged(spark, sf)).table)
    return both_sides(jobs.boosted_regression(df, usable(df), STOPPED))


@query("j1_importance")
def boosted_importance(spark, sf):
    df = with_fold(recipes.j0(fixture.staged(spark, sf)).table)
    return jobs.boosted_regression(df, usable(df), STOPPED).importance


@with_contract("j2_boosted_no_importance")
def boosted_plain(spark, sf):
    df = with_fold(recipes.j0(fixture.staged(spark, sf)).table)
    result = jobs.boosted_regression(df, usable(df), STOPPED, with_importance=False, refit=True)
    return both_sides(result)


def labelled_h1(spark, sf):
    """``h1`` with its text columns as labels."""
    df = recipes.h1(fixture.staged(spark, sf)).table
    text = [c for c, t in df.dtypes if t == "string"]
    return with_fold(encode.LabelEncoder(min_obs=10).fit(df, text).transform(df))


@with_contract("j3_boosted_every_fold")
def boosted_every(spark, sf):
    df = labelled_h1(spark, sf)
    return both_sides(
        jobs.boosted_regression(df, usable(df), STOPPED, stop_in="every", refit=True)
    )


@with_contract("j4_boosted_fold_features")
def boosted_folds(spark, sf):
    made = recipes.j8(fixture.staged(spark, sf))
    plain = [c for c in usable(made.table) if c in made_of_one(made.table)]
    # only what the models see is stored
    df = with_fold(made.table.select(*recipes.KEYS, *[quoted(c) for c in plain]))
    folds = store(made.folds, "folds", partition_by="fold")
    return both_sides(jobs.boosted_regression(df, plain, STOPPED, fold_features=folds))


@with_contract("j5_class_regression")
def classes(spark, sf):
    df = with_fold(recipes.j0(fixture.staged(spark, sf)).table)
    return both_sides(jobs.class_regression(df, usable(df), trees=5, depth=5))


def _classes_boosted(spark, sf) -> jobs.Result:
    df = with_fold(recipes.j0(fixture.staged(spark, sf)).table)
    return jobs.boosted_classes(df, usable(df), jobs.Boosting(rounds=8, depth=5, rate=0.3, bins=32, patience=2))


@query("j5_boosted_classes")
def classes_boosted(spark, sf):
    return both_sides(_classes_boosted(spark, sf))


@query(
    "j5_boosted_classes_contract",
    over_base(
        """SELECT CASE WHEN is_test THEN 'test' ELSE 'oof' END AS side, count(*) AS n,
           count(DISTINCT row_id) AS ids, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS no_class,
           CASE WHEN NOT is_test THEN TRUE END AS beats_forest FROM b GROUP BY is_test"""
    ),
)
def classes_boosted_contract(spark, sf):
    """Each row once with one of the classes, and a kappa above that of the plain forest of classes."""
    made = _classes_boosted(spark, sf)
    forest = classes(spark, sf).filter("side = 'oof'").join(made.oof.select("row_id", "target"), "row_id")
    kappa = [metric.qwk(df, "target", "prediction").first()["kappa"] for df in (made.oof, forest)]
    p = F.col("prediction")
    return both_sides(made).groupBy("side").agg(
        F.count("*").alias("n"),
        F.count_distinct("row_id").alias("ids"),
        F.count_if(p.isNull() | F.isnan(p)).alias("missing"),
        F.count_if((p != F.floor(p)) | (p < 0) | (p > 20)).alias("no_class"),
        F.when(F.col("side") == "oof", F.lit(kappa[0] > kappa[1])).alias("beats_forest"),
    )


def _depth_limited(spark, sf) -> tuple[jobs.Result, list[str]]:
    df = with_fold(recipes.j1(fixture.staged(spark, sf)).table)
    params = jobs.Boosting(rounds=20, depth=4, rate=0.35, min_rows=100, subrow=0.7, bins=32, patience=3, block=4)
    return jobs.boosted_regression(df, usable(df), params), usable(df)


@with_contract("j6_boosted_depth_limited")
def boosted_depth(spark, sf):
    return both_sides(_depth_limited(spark, sf)[0])


@query("j6_split_counts")
def boosted_splits(spark, sf):
    """How often the models of the five folds split on each feature."""
    made, names = _depth_limited(spark, sf)
    return jobs.split_counts(spark, made.models, names)


ORDERED = ("customer_id", "market", "f_1", "f_7", "f_9")


def _ordered_sql(cols: tuple[str, ...]) -> str:
    """Running sums in the order of the hash, for train rows; totals for test rows."""
    at = "(('0x' || substr(md5('43:' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT)"
    parts = []
    for c in cols:
        over = f"(PARTITION BY is_test, {c} ORDER BY {at}, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        total = f"(PARTITION BY {c})"
        s = f"CASE WHEN is_test THEN sum(CASE WHEN NOT is_test THEN target END) OVER {total} ELSE sum(target) OVER {over} END"
        n = f"CASE WHEN is_test THEN count(CASE WHEN NOT is_test THEN target END) OVER {total} ELSE count(target) OVER {over} END"
        parts.append(s6(f"(coalesce({s}, 0) + prior) / ({n} + 1)") + f" AS {c}")
    return over_base(
        f"SELECT row_id, {', '.join(parts)} FROM b CROSS JOIN pr",
        "pr AS (SELECT sum(target) / CAST(count(*) AS DOUBLE) AS prior FROM b WHERE NOT is_test)",
    )


@query("j7_ordered_statistics", _ordered_sql(ORDERED))
def ordered_statistics(spark, sf):
    df = fixture.staged(spark, sf)
    made = encode.ordered_target_stats(df, list(ORDERED), run_rows=2_000)
    one = F.get("stats", F.lit(0))
    return made.select("row_id", *[r6(F.get(one, F.lit(i))).alias(c) for i, c in enumerate(ORDERED)])


@with_contract("j7_boosted_categorical")
def boosted_categorical(spark, sf):
    """Categories of few values are split as sets, the others go by ordered target statistics per fold."""
    made = recipes.j2(fixture.staged(spark, sf))
    df = with_fold(made.table)
    features = usable(df)
    fmap = feature_map.feature_map(df.select(*[quoted(c) for c in features]), whole=made.whole)
    named = [r["name"] for r in feature_map.categorical_features(fmap).collect()]
    ranges = df.agg(
        *[F.max(quoted(c)).alias(f"hi_{i}") for i, c in enumerate(named)],
        *[F.min(quoted(c)).alias(f"lo_{i}") for i, c in enumerate(named)],
    ).first()
    fits = {
        c: int(ranges[f"hi_{i}"]) + 1
        for i, c in enumerate(named)
        if ranges[f"lo_{i}"] >= 0 and ranges[f"hi_{i}"] + 1 <= STOPPED.bins
    }
    large = [c for c in named if c not in fits]
    stats = encode.ordered_target_stats(df, large, n_fold=N_FOLD).withColumnRenamed("stats", "fold_features")
    plain = [c for c in features if c not in large]
    return both_sides(
        jobs.boosted_regression(df.join(stats, "row_id"), plain, STOPPED, categories=fits, fold_names=large)
    )


def stored_stack(spark, sf, n):
    return with_fold(stacked(spark, sf, model_names(n)))


@with_contract("j8_randomised_trees")
def trees(spark, sf):
    df = stored_stack(spark, sf, 15)
    return both_sides(jobs.randomised_trees(df, feature_columns(df), trees=5, depth=6))


@with_contract("j8_random_thresholds")
def random_trees(spark, sf):
    """Extremely randomised trees: every forest of the sum looks through random cuts of its own."""
    df = stored_stack(spark, sf, 15)
    return both_sides(jobs.random_threshold_trees(df, feature_columns(df), trees=20, depth=8, groups=4, min_rows=2))


@with_contract("j9_linear_regression")
def linear(spark, sf):
    df = with_fold(recipes.j1(fixture.staged(spark, sf)).table)
    return both_sides(jobs.linear_regression(df, usable(df)))


_LINE = """line AS (SELECT ff.i, regr_slope(target, f_8) AS a, regr_intercept(target, f_8) AS c
  FROM b JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS i) ff ON b.fold <> ff.i
  WHERE NOT is_test GROUP BY ff.i)"""


@query(
    "j9_linear_one_feature",
    over_base(
        """SELECT row_id, 'oof' AS side, round(c + a * f_8, 6) AS prediction
            FROM b JOIN line ON i = fold WHERE NOT is_test
            UNION ALL SELECT row_id, 'test', round(avg(c + a * f_8), 6)
            FROM b CROSS JOIN line WHERE is_test GROUP BY row_id""",
        _LINE,
    ),
)
def linear_one(spark, sf):
    return both_sides(jobs.linear_regression(fixture.staged(spark, sf), ["f_8"]))


@query("j9_coefficients")
def coefficients(spark, sf):
    df = with_fold(recipes.j1(fixture.staged(spark, sf)).table)
    return jobs.linear_regression(df, usable(df), refit=True).importance


@with_contract("j10_linear_on_stack_pr")
def linear_pr(spark, sf):
    extra = probabilities(fixture.predictions(fixture.staged(spark, sf)))
    wide = stacks.stack_with_probabilities(stacked(spark, sf, model_names(20)), extra)
    df = with_fold(wide)
    return both_sides(jobs.linear_regression(df, feature_columns(df), coefficients=False))


@with_contract("j11_blend")
def blended(spark, sf):
    df = stored_stack(spark, sf, 13)
    oof, test, _ = blend.train_predict_blend(
        df, [f"pred_{m}" for m in model_names(13)], restarts=20
    )
    return oof.select("row_id", F.lit("oof").alias("side"), "prediction").unionByName(
        test.select("row_id", F.lit("test").alias("side"), "prediction")
    )


@query(
    "j12_average",
    over_base(
        f"""SELECT row_id, {s6('(pred_base1 + pred_base2 + pred_base3) / 3')} AS prediction
            FROM (SELECT row_id, {stand_in_sql(model_names(3))} FROM p)"""
    ),
)
def average(spark, sf):
    df = stacked(spark, sf, model_names(3))
    out = combine.average_models(df, [f"pred_{m}" for m in model_names(3)])
    return out.select("row_id", r6("prediction").alias("prediction"))


BINARY = jobs.Boosting(rounds=10, depth=3, rate=0.4, bins=32, patience=2, block=5)


def _binary(spark, sf, targets: list[str] | None = None) -> DataFrame:
    df = labelled_h1(spark, sf)
    wide = recipes.binary_targets(df)
    targets = targets or [c for c in wide.columns if c not in df.columns]
    result = jobs.binary_probabilities(wide, usable(df), targets, BINARY)
    pr = [c for c in result.test.columns if c.startswith("pr_")]
    return result.oof.select("row_id", F.lit("oof").alias("side"), *pr).unionByName(
        result.test.select("row_id", F.lit("test").alias("side"), *pr)
    )


@query("j13_binary_probabilities")
def binary(spark, sf):
    return _binary(spark, sf)


@query(
    "j13_binary_probabilities_contract",
    over_base(
        """SELECT CASE WHEN is_test THEN 'test' ELSE 'oof' END AS side, count(*) AS n,
           count(DISTINCT row_id) AS ids, CAST(0 AS BIGINT) AS outside,
           CASE WHEN NOT is_test THEN TRUE END AS beats_share FROM b GROUP BY is_test"""
    ),
)
def binary_contract(spark, sf):
    """Three of the targets: each row once, probabilities between 0 and 1, and for rows the model did not
    see a log loss below that of the share of ones."""
    truth = fixture.base(spark, sf).select("row_id", "target")
    got = _binary(spark, sf, ["eq_1", "lt_3", "lt_6"]).join(truth, "row_id")
    checks, outside = [], F.lit(0)
    for c, y in (("eq_1", F.col("target") == 1), ("lt_3", F.col("target") < 3), ("lt_6", F.col("target") < 6)):
        p = F.col(f"pr_{c}")
        outside = outside + F.count_if(p.isNull() | (p < 0) | (p > 1))
        loss = -F.avg(F.log(F.greatest(F.when(y, p).otherwise(1 - p), F.lit(1e-15))))
        share = F.avg(y.cast("double"))
        checks.append(loss < -(share * F.log(share) + (1 - share) * F.log(1 - share)))
    return got.groupBy("side").agg(
        F.count("*").alias("n"),
        F.count_distinct("row_id").alias("ids"),
        outside.alias("outside"),
        F.when(F.col("side") == "oof", checks[0] & checks[1] & checks[2]).alias("beats_share"),
    )


# --- from raw tables to a submission ------------------------------------------------------------

CHAIN = ("f_8", "f_0", "f_5")


def _line_sql(name: str, source: str, x: str) -> list[str]:
    """Least squares of the target on ``x`` per fold left out, and its predictions of both sides."""
    return [
        f"""line_{name} AS (SELECT ff.i, regr_slope(target, {x}) AS a, regr_intercept(target, {x}) AS c
            FROM {source} s JOIN (SELECT CAST(unnest(range(1, 6)) AS INT) AS i) ff ON s.fold <> ff.i
            WHERE NOT is_test GROUP BY ff.i)""",
        f"""pred_{name} AS (SELECT row_id, round(c + a * {x}, 6) AS p FROM {source} JOIN line_{name} ON i = fold
            WHERE NOT is_test UNION ALL SELECT row_id, round(avg(c + a * {x}), 6)
            FROM {source} CROSS JOIN line_{name} WHERE is_test GROUP BY row_id)""",
    ]


_CHAIN_CTES = [t for f in CHAIN for t in _line_sql(f, "b", f)] + [
    f"""m AS (SELECT b.row_id, is_test, target, fold,
        ({' + '.join(f'pred_{f}.p' for f in CHAIN)}) / {len(CHAIN)} AS mean
        FROM b {' '.join(f'JOIN pred_{f} ON pred_{f}.row_id = b.row_id' for f in CHAIN)})""",
    *_line_sql("second", "m", "mean"),
]


@query(
    "i17_linear_chain",
    over_base(
        f"""SELECT pred_second.row_id, p AS prediction, {cutoff_sql('p', DEFAULT_CUTOFFS)} AS rating
            FROM pred_second JOIN b ON b.row_id = pred_second.row_id WHERE is_test""",
        *_CHAIN_CTES,
    ),
)
def linear_chain(spark, sf):
    """Base models, their stack, their mean, a second-level model on it, and ratings by cutoffs."""
    raw = fixture.staged(spark, sf)
    preds = {}
    for f in CHAIN:
        made = jobs.linear_regression(raw, [f], coefficients=False)
        preds[f] = made.oof.select("row_id", "prediction").unionByName(made.test)
    wide = with_fold(combine.stack(raw.select("row_id", "is_test", "target"), preds))
    mean = combine.average_models(wide, [f"pred_{f}" for f in CHAIN])
    level = wide.join(mean.withColumnRenamed("prediction", "mean"), "row_id")
    out = jobs.linear_regression(level, ["mean"], coefficients=False).test
    return out.select("row_id", "prediction", apply_cutoffs(F.col("prediction"), DEFAULT_CUTOFFS).alias("rating"))


LEVELS = {"esb_a": ("f_8", "f_0"), "esb_b": ("f_0", "f_5"), "esb_c": ("f_8", "f_13")}
_BASE_MODELS = sorted({f for fs in LEVELS.values() for f in fs})


def _level_sql(name: str, members: tuple[str, ...]) -> list[str]:
    """The mean of a stack's members per row, and a line fitted on it."""
    mean = " + ".join(f"pred_{f}.p" for f in members)
    joins = " ".join(f"JOIN pred_{f} ON pred_{f}.row_id = b.row_id" for f in members)
    stack = f"""s_{name} AS (SELECT b.row_id, is_test, target, fold, ({mean}) / {len(members)} AS mean
                FROM b {joins})"""
    return [stack, *_line_sql(name, f"s_{name}", "mean")]


@query(
    "i16_fitted_stack",
    over_base(
        f"""SELECT b.row_id, is_test, target, {', '.join(f'pred_{n}.p AS pred_{n}' for n in LEVELS)}
            FROM b {' '.join(f'JOIN pred_{n} ON pred_{n}.row_id = b.row_id' for n in LEVELS)}""",
        *[t for f in _BASE_MODELS for t in _line_sql(f, "b", f)],
        *[t for n, fs in LEVELS.items() for t in _level_sql(n, fs)],
    ),
)
def fitted_stack(spark, sf):
    """A second-level stack: models fitted on stacks of the stored predictions of base models."""
    raw = fixture.staged(spark, sf)
    label = raw.select("row_id", "is_test", "target")
    kept = stacks.PredictionStore(spark, scratch_path(spark, "predictions"))

    def base(f: str) -> DataFrame:
        return kept.get("line", f, {"folds": N_FOLD}, lambda: jobs.linear_regression(raw, [f], coefficients=False))

    def second(name: str) -> DataFrame:
        members = LEVELS[name]
        wide = with_fold(stacks.stack_models(label, {f: base(f) for f in members}, members))
        mean = combine.average_models(wide, [f"pred_{f}" for f in members])
        level = wide.join(mean.withColumnRenamed("prediction", "mean"), "row_id")
        fit = lambda: jobs.linear_regression(level, ["mean"], coefficients=False)
        return kept.get("line", name, {"members": members}, fit)

    return stacks.stack_models(label, {n: second(n) for n in LEVELS}, list(LEVELS))


# --- cutoffs and blends -------------------------------------------------------------------------


def _scored(spark, sf):
    df = fixture.predictions(lazy_base(spark, sf))
    return df.select("row_id", "is_test", "target", F.col("pred").alias("prediction"))


@query("k1_fit_cutoffs")
def fit_cutoffs(spark, sf):
    df = _scored(spark, sf)
    out, _ = cutoffs.learn_and_apply(df.filter("NOT is_test"), df.filter("is_test"))
    return out.select("row_id", "prediction", "rating")


@query(
    "k1_contract",
    over_base(
        """SELECT TRUE AS at_least_start, TRUE AS rising, count(*) AS n_rated
           FROM p WHERE is_test"""
    ),
)
def cutoffs_contract(spark, sf):
    """Learnt cutoffs rise and reach at least the kappa of the cutoffs the search starts from."""
    df = _scored(spark, sf)
    rated, cuts = cutoffs.learn_and_apply(df.filter("NOT is_test"), df.filter("is_test"))
    both = {
        name: metric.qwk(
            df.filter("NOT is_test").withColumn("rating", apply_cutoffs(F.col("prediction"), c)), "target", "rating"
        ).first()["kappa"]
        for name, c in (("start", DEFAULT_CUTOFFS), ("learnt", cuts))
    }
    return rated.filter("rating IS NOT NULL").agg(
        F.lit(both["learnt"] >= both["start"] - 1e-9).alias("at_least_start"),
        F.lit(list(cuts) == sorted(cuts)).alias("rising"),
        F.count("*").alias("n_rated"),
    )


@query("k4_contract", "SELECT TRUE AS at_least_best_single")
def blend_contract(spark, sf):
    """A learnt blend reaches at least the kappa of the best single model."""
    df = fixture.predictions(fixture.staged(spark, sf)).filter("NOT is_test")
    names = ["pred", "pred2"]
    _, reached = blend.fit_blend(df, names, restarts=4)
    single = max(blend.score(df, names, [[1.0, 0.0], [0.0, 1.0]]))
    return df.limit(1).select(F.lit(reached >= single - 1e-12).alias("at_least_best_single"))


@query(
    "k1_prediction_grid",
    over_base(
        """SELECT CAST(floor(round(pred * 100, 4)) AS INT) AS step, count(*) AS n,
           CAST(sum(target) AS BIGINT) AS y, CAST(sum(target * target) AS BIGINT) AS yy
           FROM p WHERE NOT is_test GROUP BY 1"""
    ),
)
def prediction_grid(spark, sf):
    return cutoffs.prediction_grid(_scored(spark, sf).filter("NOT is_test"), "target", "prediction")


_CUTOFF_SQL = over_base(
    f"SELECT row_id, {cutoff_sql('pred', DEFAULT_CUTOFFS)} AS rating FROM p WHERE is_test"
)


@query("k2_default_cutoffs", _CUTOFF_SQL)
def default_cutoffs(spark, sf):
    df = _scored(spark, sf).filter("is_test")
    return df.select("row_id", apply_cutoffs(F.col("prediction"), DEFAULT_CUTOFFS).alias("rating"))


@query("k3_saved_cutoffs", _CUTOFF_SQL)
def saved_cutoffs(spark, sf):
    path = scratch_path(spark, "cutoffs")
    tables.save_cutoffs(spark, DEFAULT_CUTOFFS, path)
    df = _scored(spark, sf).filter("is_test")
    cuts = tables.load_cutoffs(spark, path)
    return df.select("row_id", apply_cutoffs(F.col("prediction"), cuts).alias("rating"))


@query("k4_fit_blend")
def fit_blend(spark, sf):
    df = fixture.predictions(fixture.staged(spark, sf))
    weights, _ = blend.fit_blend(df.filter("NOT is_test"), ["pred", "pred2"], restarts=10)
    return blend.blend(df.filter("is_test"), ["pred", "pred2"], weights)


_CANDIDATES = ((1.0, 0.0), (0.0, 1.0), (0.5, 0.5), (0.25, 1.25))
_CANDIDATE_ROWS = ", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_CANDIDATES)
)


@query(
    "k4_candidate_scores",
    over_base(
        "SELECT CAST(id AS INT) AS id, round(kappa, 9) AS kappa FROM kappa",
        f"""src AS (SELECT id, target, {rating_sql('pred * w0 + pred2 * w1')} AS r
            FROM p CROSS JOIN (VALUES {_CANDIDATE_ROWS}) w(id, w0, w1) WHERE NOT is_test)""",
        kappa_sql("src", "target", "r", "id"),
    ),
)
def candidate_scores(spark, sf):
    df = fixture.predictions(lazy_base(spark, sf)).filter("NOT is_test")
    scores = blend.candidate_scores(df, ["pred", "pred2"], _CANDIDATES)
    return scores.select("id", F.round("kappa", 9).alias("kappa"))


@query("k5_assign_by_shares", _SHARES_SQL)
def assign_by_shares(spark, sf):
    return assigned(spark, sf)
