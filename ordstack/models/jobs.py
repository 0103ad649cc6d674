"""Model jobs: out-of-fold and test predictions with a shared fold column.

Every job fits once per fold on the other folds, predicts the fold itself, and either averages the
fold models on the test rows or refits on all train rows. The learners are MLlib's.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordstack.constants import FOLD, IS_TEST, N_CLASS, N_FOLD, ROW_ID, SEED, TARGET
from ordstack.functions.numeric import argmax_class, quoted, row_mean
from ordstack.functions.splits import assign_folds
from ordstack.models.boosting import (  # noqa: F401  parameters and curve are part of this module's interface
    PARALLEL,
    Bins,
    Boosted,
    Boosting,
    Stagewise,
    Task,
    best_of_curve,
    log_sum_exp,
    split_counts,
    sum_of_own,
    sums_of,
)
from ordstack.models.random_trees import Forest, grow, tasks_for
from ordstack.operators.columns import feature_columns
from ordstack.operators.combine import with_fold_vectors
from ordstack.operators.ordering import importance
from ordstack.session import store

MAX_DEPTH = 30  # of the tree learner
PARTITION_ROWS = 50_000  # of the cached input of a fit
BOOSTED_ROWS = 100_000  # of that of boosted jobs, whose passes are short


@dataclass
class Result:
    """Predictions per train row (by the model that did not see it) and per test row."""

    oof: DataFrame
    test: DataFrame
    importance: DataFrame | None = None
    rounds: list[int] | None = None
    models: list = field(default_factory=list)


def assemble(
    df: DataFrame,
    features: Sequence[str],
    categories: dict[str, int] | None = None,
    missing: float = -1.0,
    keep: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(row_id, is_test, target, fold, label, features)``, missing values filled. ``categories``
    declares columns of labels 0..k-1 as categorical, which trees then split as sets, not ranges.
    Columns of ``keep`` (further labels) go along as doubles, those of ``carry`` as they are."""
    cols = []
    for i, f in enumerate(features):
        c = F.coalesce(quoted(f).cast("double"), F.lit(missing))
        if categories and f in categories:
            meta = {"ml_attr": {"type": "nominal", "num_vals": categories[f], "name": f"x{i}"}}
            cols.append(c.alias(f"x{i}", metadata=meta))
        else:
            cols.append(c.alias(f"x{i}"))
    keys = [c for c in (ROW_ID, IS_TEST, TARGET, FOLD) if c in df.columns]
    label = quoted(TARGET).cast("double").alias("label")
    slim = df.select(
        *keys, label, *[quoted(c).cast("double").alias(c) for c in keep], *[quoted(c) for c in carry], *cols
    )
    assembler = VectorAssembler(
        inputCols=[f"x{i}" for i in range(len(features))], outputCol="features"
    )
    others = [quoted(c) for c in [*keep, *carry]]
    return assembler.transform(slim).select(*keys, "label", *others, "features")


def partitions_for(n_rows: int, rows: int = PARTITION_ROWS) -> int:
    """Partitions of a fit's input, from its rows alone: the same on any cluster, more for more data."""
    return max(1, -(-n_rows // rows))


def cached(df: DataFrame, rows: int = PARTITION_ROWS) -> DataFrame:
    """Keep assembled features for the many passes of a fit. What learners sample is seeded per
    partition, so rows are dealt by a hash of their id, ordered by it, into partitions of about ``rows``
    rows: the same rows give the same model on any cluster."""
    n = df.select(ROW_ID).count()
    dealt = df.repartition(partitions_for(n, rows), ROW_ID).sortWithinPartitions(ROW_ID)
    return dealt.persist(StorageLevel.MEMORY_AND_DISK)


def _in_threads(f: Callable[[int], Model], items: Sequence[int]) -> list[Model]:
    with ThreadPool(min(PARALLEL, len(items))) as pool:
        return pool.map(f, items)


def _oof(train: DataFrame, models: list[Model], column: Callable[[int], str]) -> DataFrame:
    """Each row predicted by the one model of its fold; folds are read apart, so none twice."""
    parts = [
        m.transform(train.filter(F.col(FOLD) == i)).select(
            ROW_ID, FOLD, TARGET, F.expr(column(i)).cast("double").alias("prediction")
        )
        for i, m in enumerate(models, 1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fold_mean(test: DataFrame, models: list[Model]) -> DataFrame:
    """Mean prediction of the fold models: all models applied in one pass, no shuffle."""
    names = []
    for i, m in enumerate(models, 1):
        names.append(f"_p{i}")
        test = m.copy({m.predictionCol: f"_p{i}"}).transform(test)
    return test.select(ROW_ID, row_mean([F.col(n) for n in names]).alias("prediction"))


def _single(test: DataFrame, model: Model) -> DataFrame:
    return model.transform(test).select(ROW_ID, F.col("prediction").cast("double"))


def _finish(
    data: DataFrame, oof: DataFrame, test: DataFrame, label: str
) -> tuple[DataFrame, DataFrame]:
    """Predictions are written, with six decimals, and the cached features released."""
    rounded = F.round("prediction", 6).alias("prediction")
    keep = [c for c in oof.columns if c != "prediction"]
    stored = (
        store(oof.select(*keep, rounded), f"{label}-oof"),
        store(test.select(ROW_ID, rounded), f"{label}-test"),
    )
    data.unpersist()
    return stored


def _sides(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    return data.filter(~F.col(IS_TEST)), data.filter(IS_TEST)


def importance_table(
    df: DataFrame, features: Sequence[str], values: Sequence[float], signed: bool = False
) -> DataFrame:
    """``(name, gain)``, shares of the total, largest first; signed coefficients stay as they are."""
    rows = [(f, float(v)) for f, v in zip(features, values)]
    table = df.sparkSession.createDataFrame(rows, "name string, gain double")
    return table.orderBy(F.col("gain").desc(), "name") if signed else importance(table)


# --- boosted trees ------------------------------------------------------------------------------


def _used(df: DataFrame, features: Sequence[str]) -> list[Column]:
    return [quoted(c) for c in dict.fromkeys([ROW_ID, IS_TEST, TARGET, FOLD, *features])]


def partitions_of(data: DataFrame) -> int:
    """Partitions of a boosted fit. Its rows are packed where they lie and then dealt, so wide rows are neither
    moved nor kept: ``data`` is read a few times, from a stored table at best."""
    return partitions_for(data.select(ROW_ID).count(), BOOSTED_ROWS)


def _own_features(fold: int | None) -> Column:
    return F.get("fold_features", F.lit(fold - 1))


def _fold_vector(fold: int | None) -> Column:
    """Common features followed by those encoded for the fold."""
    return array_to_vector(F.concat(vector_to_array("features"), _own_features(fold)))


def boosted_regression(
    df: DataFrame,
    features: Sequence[str],
    params: Boosting = Boosting(),
    fold_features: DataFrame | None = None,
    stop_in: str = "first",
    refit: bool = False,
    categories: dict[str, int] | None = None,
    with_importance: bool = True,
    label: str = "boost",
    fold_names: Sequence[str] = (),
) -> Result:
    """Boosted regression over the folds.

    ``stop_in="first"`` finds the number of rounds on fold 1 and uses it in all; ``"every"`` finds it per
    fold and refits with the mean. ``fold_features`` holds, per fold, features encoded without that fold
    (``fold``, ``row_id`` and columns): a row carries them as one array per fold, and the model of a fold
    reads its own. A refit then averages the fold models instead, as no encoding fits all rows. With
    ``fold_names`` the rows hold these arrays already, as ``fold_features``.
    """
    source = df if FOLD in df.columns else assign_folds(df)
    if fold_features is not None:
        fold_names = feature_columns(fold_features)
        source = with_fold_vectors(source, fold_features, fold_names)
    if fold_names:  # joined once
        source = store(source.select(*_used(source, features), "fold_features"), "fold-vectors")
    names = [*features, *[f"cv_{c}" for c in fold_names]]  # common features may have the same names
    vector = _fold_vector if fold_names else None
    extra = ["fold_features"] if fold_names else []
    data = assemble(source, features, categories, carry=extra)
    parts, folds = partitions_of(data), list(range(1, N_FOLD + 1))
    # all folds grow together; with "first" they end where fold 1 does
    own = _own_features if fold_names else None
    fits = Stagewise(data, [Task(i, unit=i) for i in folds], params, own=own, partitions=parts)
    models = fits.fit(by=None if stop_in == "every" else folds[0])
    rounds = [len(m.trees) for m in models]

    train, test = _sides(data)
    seen = vector_to_array("features")
    if vector:
        seen = F.concat(seen, F.get("fold_features", F.col(FOLD) - 1))
    own_sum = sum_of_own(models, F.col(FOLD) - 1, seen).alias("prediction")
    oof = train.filter(F.col(FOLD).isin(folds)).select(ROW_ID, FOLD, TARGET, own_sum)
    if refit and vector is None:
        fixed = replace(params, rounds=sum(rounds) // len(rounds))
        final = Stagewise(data, [Task(None)], fixed, partitions=parts).fit(stop=False)[0]
        test_p = final.apply(test, "prediction").select(ROW_ID, "prediction")
    else:
        for i, m in zip(folds, models):
            at = f"_f{i}" if vector else "features"
            test = test.withColumn(at, vector(i)) if vector else test
            test = m.apply(test, f"_p{i}", at)
        test_p = test.select(ROW_ID, row_mean([F.col(f"_p{i}") for i in folds]).alias("prediction"))
    table = None
    if with_importance:
        table = importance_table(df, names, models[0].importances())
    oof, test_p = _finish(data, oof, test_p, label)
    return Result(oof, test_p, table, rounds, models)


# --- other regressors ---------------------------------------------------------------------------


def fold_regression(
    df: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    refit: bool = False,
    values: Callable[[Model], Sequence[float]] | None = None,
    signed: bool = False,
    label: str = "regression",
) -> Result:
    """Any regressor over the folds; ``values`` reads its importances or coefficients."""
    source = df if FOLD in df.columns else assign_folds(df)
    data = cached(assemble(source, features))
    train, test = _sides(data)
    models = _in_threads(
        lambda i: estimator.fit(train.filter(F.col(FOLD) != i)), range(1, N_FOLD + 1)
    )
    final = estimator.fit(train) if refit else None
    oof = _oof(train, models, lambda i: "prediction")
    test_p = _single(test, final) if final else _fold_mean(test, models)
    table = importance_table(df, features, values(models[0]), signed) if values else None
    oof, test_p = _finish(data, oof, test_p, label)
    return Result(oof, test_p, table)


def randomised_trees(
    df: DataFrame, features: Sequence[str], trees: int = 20, depth: int = 10, seed: int = SEED
) -> Result:
    """Forest over all rows (no bootstrap) whose trees differ by their feature subsets."""
    if depth > MAX_DEPTH:
        raise ValueError(f"trees grow to depth {MAX_DEPTH} at most, not {depth}")
    forest = RandomForestRegressor(
        labelCol="label", numTrees=trees, maxDepth=depth, bootstrap=False, seed=seed, maxBins=64
    )
    return fold_regression(df, features, forest, label="trees")


def random_cuts(
    bounds: dict[str, tuple[float, float]], cuts: int, seed: int
) -> list[list[float]]:
    """Per column, seeded cut points drawn uniformly from its range, between two infinities. A column
    with a single value gets none."""
    rng = random.Random(seed)
    made = []
    for lo, hi in bounds.values():
        drawn = {rng.uniform(lo, hi) for _ in range(cuts)} if hi > lo else set()
        made.append([-float("inf"), *sorted(drawn), float("inf")])
    return made


def random_threshold_trees(
    df: DataFrame,
    features: Sequence[str],
    trees: int = 20,
    depth: int = 10,
    groups: int = 5,
    cuts: int = 16,
    min_rows: int = 1,
    seed: int = SEED,
) -> Result:
    """Extremely randomised trees over the folds: splits are chosen among random thresholds.

    The forest consists of ``groups`` forests. Each draws ``cuts`` thresholds per column from the column's
    range over its train rows, looks at the columns through these cuts only, tries a random third of the
    columns at a node, and sees all rows (no bootstrap). With one tree per group every tree has cuts of its
    own. All trees grow together, a pass per level. Trees of over 30 levels are refused.
    """
    if depth > MAX_DEPTH:
        raise ValueError(f"trees grow to depth {MAX_DEPTH} at most, not {depth}")
    groups = min(groups, trees)
    source = df if FOLD in df.columns else assign_folds(df)
    slim = assemble(source, features)
    data = slim.repartition(tasks_for(slim.select(ROW_ID).count()), ROW_ID).sortWithinPartitions(ROW_ID)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    train, test = _sides(data)
    folds = list(range(1, N_FOLD + 1))
    ends = Summarizer.metrics("min", "max").summary(F.col("features"))
    ranges = train.groupBy(FOLD).agg(ends.alias("ends")).select(FOLD, "ends.min", "ends.max").collect()

    forests = []
    for i in folds:
        mine = [r for r in ranges if r[FOLD] != i]
        bounds = {f: (float(min(r["min"][j] for r in mine)), float(max(r["max"][j] for r in mine))) for j, f in enumerate(features)}
        for g in range(groups):
            edges = [np.array(x[1:-1]) for x in random_cuts(bounds, cuts, seed * 1_000_003 + i * 1009 + g)]
            first = (i - 1) * trees + sum(trees // groups + (h < trees % groups) for h in range(g))
            numbers = range(first, first + trees // groups + (g < trees % groups))
            forests.append(Forest(i, Bins(edges, [len(e) + 1 for e in edges]), tuple(numbers)))
    params = Boosting(depth=depth, min_rows=min_rows, subcol="onethird", seed=seed)
    grown = grow(train, forests, params)
    models = [Boosted(0.0, 1.0 / trees, g.bins, [grown[j] for j in g.numbers]) for g in forests]

    def predicted(rows: DataFrame, i: int) -> DataFrame:
        parts = sums_of(models[(i - 1) * groups : i * groups])
        return rows.withColumn(f"_p{i}", F.aggregate(parts, F.lit(0.0), lambda a, p: a + p))

    oof = None
    for i in folds:
        part = predicted(train.filter(F.col(FOLD) == i), i)
        part = part.select(ROW_ID, FOLD, TARGET, F.col(f"_p{i}").alias("prediction"))
        oof = part if oof is None else oof.unionByName(part)
    for i in folds:
        test = predicted(test, i)
    test_p = test.select(ROW_ID, row_mean([F.col(f"_p{i}") for i in folds]).alias("prediction"))
    gains = sum(np.array(m.importances()) * len(m.trees) for m in models[:groups])
    table = importance_table(df, features, gains)
    oof, test_p = _finish(data, oof, test_p, "random-trees")
    return Result(oof, test_p, table, None, models)


def linear_regression(
    df: DataFrame, features: Sequence[str], refit: bool = False, coefficients: bool = True
) -> Result:
    """Least squares, with the table of coefficients unless ``coefficients`` is off."""
    values = (lambda m: m.coefficients.toArray()) if coefficients else None
    return fold_regression(
        df, features, LinearRegression(labelCol="label"), refit, values, True, "linear"
    )


# --- classifiers --------------------------------------------------------------------------------


def class_regression(
    df: DataFrame, features: Sequence[str], trees: int = 20, depth: int = 8, seed: int = SEED
) -> Result:
    """21-class forest; a row gets its most likely class, test rows that of the mean over folds."""
    source = df if FOLD in df.columns else assign_folds(df)
    meta = {"ml_attr": {"type": "nominal", "num_vals": N_CLASS, "name": "label"}}
    data = assemble(source, features).withColumn(
        "label", F.col("label").alias("label", metadata=meta)
    )
    data = cached(data)
    train, test = _sides(data)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64
    )
    models = _in_threads(
        lambda i: forest.fit(train.filter(F.col(FOLD) != i)), range(1, N_FOLD + 1)
    )
    oof = _oof(train, models, lambda i: "prediction")
    names = []
    for i, m in enumerate(models, 1):
        names.append(f"_c{i}")
        mine = m.copy(
            {
                m.predictionCol: f"_p{i}",
                m.rawPredictionCol: f"_r{i}",
                m.probabilityCol: f"_v{i}",
            }
        )
        test = mine.transform(test).withColumn(f"_c{i}", vector_to_array(f"_v{i}"))
    means = [row_mean([F.get(F.col(n), F.lit(k)) for n in names]) for k in range(N_CLASS)]
    test_p = test.select(ROW_ID, argmax_class(means).cast("double").alias("prediction"))
    oof, test_p = _finish(data, oof, test_p, "classes")
    return Result(oof, test_p)


def boosted_classes(
    df: DataFrame, features: Sequence[str], params: Boosting = Boosting(), n_class: int = N_CLASS
) -> Result:
    """Boosted 21-class model: per round one tree per class on the class residuals of the softmax.

    Rounds end by the multi-class log loss of fold 1, and that many are fitted in the other folds. A row
    gets its most likely class, test rows that of the mean probabilities over the folds. A class without
    train rows is never predicted.
    """
    source = df if FOLD in df.columns else assign_folds(df)
    met = source.filter(~F.col(IS_TEST) & F.col(TARGET).between(0, n_class - 1)).select(TARGET).distinct()
    numbers = sorted(r[TARGET] for r in met.collect())  # at most n_class
    classes = [f"is_{k}" for k in numbers]
    flags = [(F.col(TARGET) == k).cast("double").alias(c) for k, c in zip(numbers, classes)]
    data = assemble(source.select("*", *flags), features, keep=classes)
    folds = list(range(1, N_FOLD + 1))

    # all folds grow together and end where fold 1 does
    tasks = [Task(i, c, unit=i) for i in folds for c in classes]
    fitted = Stagewise(data, tasks, params, "softmax", partitions=partitions_of(data)).fit(by=folds[0])
    best = max(len(m.trees) for m in fitted)
    models = [fitted[i * len(classes) : (i + 1) * len(classes)] for i in range(N_FOLD)]

    def most_likely(p: list[Column]) -> Column:
        return F.get(F.array(*[F.lit(float(k)) for k in numbers]), argmax_class(p)).alias("prediction")

    def with_probabilities(rows: DataFrame, i: int) -> tuple[DataFrame, list[Column]]:
        rows = rows.withColumn(f"_s{i}", sums_of(models[i]))
        scores = [F.get(f"_s{i}", F.lit(k)) for k in range(len(classes))]
        rows = rows.withColumn(f"_z{i}", log_sum_exp(scores))
        return rows, [F.exp(s - F.col(f"_z{i}")) for s in scores]

    train, test = _sides(data)
    oof, sums = None, None
    for i in range(N_FOLD):
        rows, p = with_probabilities(train.filter(F.col(FOLD) == i + 1), i)
        part = rows.select(ROW_ID, FOLD, TARGET, most_likely(p))
        oof = part if oof is None else oof.unionByName(part)
        test, p = with_probabilities(test, i)
        sums = p if sums is None else [a + b for a, b in zip(sums, p)]
    test_p = test.select(ROW_ID, most_likely(sums))
    oof, test_p = _finish(data, oof, test_p, "boosted-classes")
    return Result(oof, test_p, None, [best] * N_FOLD, models)


def binary_probabilities(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    params: Boosting = Boosting(rounds=50, depth=4, patience=5),
    refit: bool = False,
) -> Result:
    """One boosted classifier per 0/1 target and fold: the probability of 1, out of fold and for
    test rows, one column ``pr_<target>`` each. Every classifier stops by its own log loss. All share one
    cached table and carry their scores in it; the fits run several at a time."""
    source = df if FOLD in df.columns else assign_folds(df)
    data = assemble(source, features, keep=targets)
    parts = partitions_of(data)
    folds = list(range(1, N_FOLD + 1))
    tasks = [Task(i, t, unit=k * N_FOLD + i) for k, t in enumerate(targets) for i in folds]
    fitted = Stagewise(data, tasks, params, "logistic", partitions=parts).fit()
    rounds = [len(m.trees) for m in fitted]
    by_target = {t: fitted[k * N_FOLD : (k + 1) * N_FOLD] for k, t in enumerate(targets)}

    def scored(rows: DataFrame, models: dict[str, Boosted]) -> DataFrame:
        kept = [quoted(c) for c in rows.columns]
        rows = rows.withColumn("_s", sums_of(list(models.values())))
        return rows.select(
            *kept, *[(1 / (1 + F.exp(-F.get("_s", F.lit(j))))).alias(f"pr_{t}") for j, t in enumerate(models)]
        )

    train, test = _sides(data)
    oof = None
    for i in range(1, N_FOLD + 1):
        part = scored(train.filter(F.col(FOLD) == i), {t: ms[i - 1] for t, ms in by_target.items()})
        part = part.select(ROW_ID, FOLD, TARGET, *[quoted(f"pr_{t}") for t in targets])
        oof = part if oof is None else oof.unionByName(part)
    if refit:
        final = {}
        for t in targets:
            mean = sum(len(m.trees) for m in by_target[t]) // N_FOLD
            fixed = replace(params, rounds=mean)
            final[t] = Stagewise(data, [Task(None, t)], fixed, "logistic", partitions=parts).fit(False)[0]
        test_p = scored(test, final).select(ROW_ID, *[quoted(f"pr_{t}") for t in targets])
    else:
        # a fold's models score the test rows together; the five results are averaged by row
        parts = None
        for i in range(N_FOLD):
            part = scored(test.select(ROW_ID, "features"), {t: ms[i] for t, ms in by_target.items()})
            part = part.drop("features")
            parts = part if parts is None else parts.unionByName(part)
        test_p = parts.groupBy(ROW_ID).agg(
            *[F.avg(quoted(f"pr_{t}")).alias(f"pr_{t}") for t in targets]
        )
    oof = store(oof, "binary-oof")
    test_p = store(test_p, "binary-test")
    data.unpersist()
    return Result(oof, test_p, None, rounds, fitted)
