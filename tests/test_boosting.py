"""Stage-wise boosting, random-threshold trees, ordered statistics, learned embeddings, sparse sets."""

import math
import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ordstack.functions.splits import assign_folds
from ordstack.models import boosting, embed, jobs
from ordstack.operators import combine, encode, metric
from ordstack.plans import fixture, recipes, stacks
from ordstack.session import scratch_path, store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def noisy(spark):
    """Little signal, much noise: many rounds overfit."""
    rng = random.Random(3)
    rows = []
    for i in range(500):
        x, z = rng.uniform(0, 4), rng.uniform(0, 1)
        rows.append((i, i % 6 == 0, int(min(20, max(0, round(x + rng.gauss(0, 3) + 5)))), x, z))
    d = spark.createDataFrame(rows, "row_id bigint, is_test boolean, target int, x double, z double")
    return store(assign_folds(d), "noisy")


PARAMS = boosting.Boosting(rounds=40, depth=4, rate=0.5, min_rows=2, subrow=0.8, bins=32, patience=3, block=3)


def data_of(df):
    return jobs.cached(jobs.assemble(df, ["x", "z"]))


def test_an_early_stop_saves_fits_and_cuts_to_a_prefix(spark, noisy, monkeypatch):
    data, fits = data_of(noisy), []
    fit_tree = boosting.Stagewise._fit_tree
    monkeypatch.setattr(boosting.Stagewise, "_fit_tree", lambda self, j, n: fits.append(n) or fit_tree(self, j, n))
    stopped = boosting.Stagewise(data, [boosting.Task(1)], PARAMS).fit()[0]
    best = len(stopped.trees)
    assert len(fits) < PARAMS.rounds and best <= len(fits) - PARAMS.patience + PARAMS.block
    assert stopped.losses.index(min(stopped.losses)) + 1 == best
    fixed = boosting.replace(PARAMS, rounds=best)
    again = boosting.Stagewise(data, [boosting.Task(1)], fixed).fit(stop=False)[0]
    both = again.apply(stopped.apply(data, "a"), "b").select("a", "b").collect()
    assert max(abs(r.a - r.b) for r in both) < 1e-9
    # the curve is the plain mean of squared errors of the prefixes
    valid = data.filter("NOT is_test AND fold = 1")
    for n in (1, best):
        rows = stopped.cut(n).apply(valid, "p").select("label", "p").collect()
        assert stopped.losses[n - 1] == pytest.approx(np.mean([(r.label - r.p) ** 2 for r in rows]))
    data.unpersist()


def test_block_size_changes_nothing(noisy):
    data = data_of(noisy)
    made = [
        boosting.Stagewise(data, [boosting.Task(2)], boosting.replace(PARAMS, rounds=5, block=b)).fit(stop=False)[0]
        for b in (1, 5)
    ]
    rows = made[1].apply(made[0].apply(data, "a"), "b").select("a", "b").collect()
    assert max(abs(r.a - r.b) for r in rows) < 1e-6


def test_softmax_losses_are_those_of_numpy(noisy):
    d = noisy.withColumn("target", F.least(F.floor(F.col("target") / 4), F.lit(2)).cast("int"))
    classes = [f"is_{k}" for k in range(3)]
    flags = [(F.col("target") == k).cast("double").alias(c) for k, c in enumerate(classes)]
    data = jobs.cached(jobs.assemble(d.select("*", *flags), ["x", "z"], keep=classes))
    params = boosting.replace(PARAMS, rounds=3, rate=0.3)
    models = boosting.Stagewise(data, [boosting.Task(1, c) for c in classes], params, "softmax").fit()
    valid = data.filter("NOT is_test AND fold = 1")
    for k, m in enumerate(models):
        valid = m.apply(valid, f"s{k}")
    rows = valid.select("target", *[f"s{k}" for k in range(3)]).toPandas()
    s = rows[[f"s{k}" for k in range(3)]].to_numpy()
    loss = np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), rows["target"]]
    assert models[0].losses[len(models[0].trees) - 1] == pytest.approx(loss.mean())
    # the first step of each class is the Newton step of its leaves: it lowers the loss on the train rows
    shares = [math.exp(m.base) for m in models]
    assert sum(shares) == pytest.approx(1)


def test_boosted_classes_contract(noisy):
    d = noisy.withColumn("target", F.when(F.col("x") < 2, 1).otherwise(4))
    made = jobs.boosted_classes(d, ["x", "z"], boosting.Boosting(rounds=2, depth=2, rate=0.5, bins=16, patience=2))
    assert metric.qwk(made.oof, "target", "prediction").first().kappa > 0.9
    assert {r.prediction for r in made.oof.select("prediction").distinct().collect()} == {1.0, 4.0}
    assert made.test.count() == noisy.filter("is_test").count()


def test_partitions_follow_the_rows(noisy):
    assert jobs.partitions_for(10 * 3_000_000) == 10 * jobs.partitions_for(3_000_000)
    assert jobs.partitions_for(0) == 1
    assert jobs.cached(jobs.assemble(noisy, ["x"]), rows=50).rdd.getNumPartitions() == 10


def test_split_counts_of_a_known_tree(spark, noisy):
    d = noisy.withColumn("target", F.when(F.col("x") < 2, 0).otherwise(10))
    params = boosting.Boosting(rounds=3, depth=1, rate=0.5, subrow=1.0, bins=32)
    made = jobs.boosted_regression(d, ["x", "z"], params)
    got = {r["name"]: (r["n"], r["share"]) for r in boosting.split_counts(spark, made.models, ["x", "z"]).collect()}
    assert got["x"][0] == sum(len(m.trees) for m in made.models) and got["z"][0] == 0
    assert got["x"][1] + got["z"][1] == pytest.approx(1)


def test_fold_vectors_are_one_join(spark, noisy):
    folds = None
    for i in range(1, 6):
        part = noisy.select("row_id", F.lit(i).alias("fold"), (F.col("x") * i).alias("x"))
        folds = part if folds is None else folds.unionByName(part)
    folds = store(folds, "folds")
    made = combine.with_fold_vectors(noisy.select("row_id", "z"), folds, ["x"])
    for i in (1, 4):
        one = combine.with_fold_features(noisy.select("row_id", "z"), folds, i)
        a = {r.row_id: r.fold_features[i - 1][0] for r in made.collect()}
        assert a == {r.row_id: r.x for r in one.collect()}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    with pytest.raises(Exception, match="row without a partner"):
        combine.with_fold_vectors(noisy, folds.filter("NOT (row_id = 3 AND fold = 2)"), ["x"]).collect()


def test_random_thresholds(noisy):
    bounds = {"x": (0.0, 4.0), "z": (1.0, 1.0)}
    a, b = (jobs.random_cuts(bounds, 8, seed) for seed in (1, 2))
    assert a != b and jobs.random_cuts(bounds, 8, 1) == a
    assert len(a[0]) == 10 and a[1] == [-math.inf, math.inf] and all(0 <= c <= 4 for c in a[0][1:-1])
    d = noisy.withColumn("target", F.round("x").cast("int"))
    made = jobs.random_threshold_trees(d, ["x", "z"], trees=6, depth=5, groups=6, cuts=12)
    assert metric.qwk(made.oof, "target", "prediction").first().kappa > 0.5
    assert made.oof.count() + made.test.count() == noisy.count()
    with pytest.raises(ValueError):
        jobs.random_threshold_trees(d, ["x"], depth=40)


# --- ordered target statistics ------------------------------------------------------------------


def brute_stats(rows, n_fold, weight=1.0):
    import hashlib

    at = lambda i: (int(hashlib.md5(f"43:{i}".encode()).hexdigest()[:8], 16), i)
    train = sorted((r for r in rows if not r[1] and r[2] is not None), key=lambda r: at(r[0]))
    out = {}
    for f in range(1, n_fold + 1) if n_fold else [None]:
        mine = [r for r in train if f is None or r[3] != f]
        prior = sum(r[2] for r in mine) / len(mine)
        for r in rows:
            before = not r[1] and r[2] is not None and (f is None or r[3] != f)
            same = [q for q in mine if q[4] == r[4] and (not before or at(q[0]) < at(r[0]))]
            value = (sum(q[2] for q in same) + weight * prior) / (len(same) + weight)
            out.setdefault(r[0], []).append(value)
    return out


@pytest.mark.parametrize("n_fold", [0, 3])
def test_ordered_statistics(spark, n_fold):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        c = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "rare" if i == 7 else "c"])
        rows.append((i, rng.random() < 0.2, None if rng.random() < 0.1 else rng.randint(0, 9), rng.randint(1, 3), c))
    d = spark.createDataFrame(rows, "row_id bigint, is_test boolean, target int, fold int, c string")
    want = brute_stats(rows, n_fold)
    for run_rows in (20, 100_000):
        got = {r.row_id: [x[0] for x in r.stats] for r in encode.ordered_target_stats(d, ["c"], n_fold, run_rows=run_rows).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i]) for i in want)


# --- learned embedding --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sparse(spark):
    made = recipes.n1(fixture.staged(spark, SMALL))
    return made, store(made.rows(), "sparse-rows")


def dense_of(rows, width):
    held = rows.orderBy("row_id").collect()
    out = np.zeros((len(held), width))
    for i, r in enumerate(held):
        for c in r.cells:
            out[i, c.idx] = c.value
    return out


@pytest.mark.parametrize("block", [64 << 20, 4000])
def test_learned_embedding_is_near_the_best(spark, sparse, monkeypatch, block):
    made, rows = sparse
    monkeypatch.setattr(embed, "BLOCK_BYTES", block)
    matrix = dense_of(rows, made.width)
    basis = embed.learn_basis(rows, made.width, 12)
    got = embed.embed_rows(rows, basis, ["row_id"]).orderBy("row_id").toPandas()
    e = got[[f"e_{i}" for i in range(12)]].to_numpy()
    u = np.linalg.qr(e)[0]
    error = np.linalg.norm(matrix - u @ (u.T @ matrix))
    strength = np.linalg.svd(matrix, compute_uv=False)
    best = np.sqrt((strength[12:] ** 2).sum())
    assert best <= error * (1 + 1e-9) and error < 1.03 * best
    assert basis.strength[0] == pytest.approx(strength[0], rel=1e-3)


def test_embedding_of_more_columns_than_a_square_matrix_could_have(spark):
    cells = spark.range(3000).selectExpr("id AS row_id", "array(struct(id * 100 AS idx, 2.0D AS value), struct(7L AS idx, 1.0D AS value)) AS cells")
    basis = embed.learn_basis(cells, 300_000, 2, passes=1)
    assert embed.embed_rows(cells, basis, ["row_id"], 4).filter("e_3 = 0").count() == 3000


def test_projection_moves_no_rows(sparse):
    p = plan(embed.project(sparse[1], 64))
    assert "Exchange" not in p and "Join" not in p


# --- sparse sets and stored predictions ---------------------------------------------------------


def test_sparse_combination_equals_the_dense_one(spark, noisy):
    d = noisy.withColumn("gaps", F.when(F.col("row_id") % 3 == 0, 0.0).otherwise(F.col("z")))
    d = d.withColumns({"one": F.lit(1.0), "none": F.lit(0.0)})
    keys = ["row_id", "is_test", "target"]
    sets = {"a": ["x", "one"], "b": ["none", "gaps"]}
    dense = combine.combine({n: d.select(*keys, *cs) for n, cs in sets.items()})
    made = combine.combine_cells(
        {n: combine.cells_of(d, [(c, "q") for c in cs]) for n, cs in sets.items()}, d.select("row_id", "is_test")
    )
    names = [c for c, _ in made.columns]
    assert names == dense.columns[3:] == ["a_x", "b_gaps"]
    got = {(r.row_id, names[r.idx]): r.value for r in made.cells.collect()}
    want = {(r.row_id, c): r[c] for r in dense.collect() for c in names if r[c]}
    assert got == want


def test_predictions_are_fitted_once(spark, noisy):
    kept = stacks.PredictionStore(spark, scratch_path(spark, "kept"))
    fit = lambda: jobs.linear_regression(noisy, ["x"], coefficients=False)
    first = kept.get("line", "x", {"folds": 5}, fit)
    assert kept.get("line", "x", {"folds": 5}, fit).count() == first.count() == 500
    assert kept.fitted == ["line"]
    kept.get("line", "x", {"folds": 4}, fit)
    assert kept.fitted == ["line", "line"]


def test_missing_class_probabilities_raise(spark):
    d = spark.createDataFrame([(1, f, 0.5, 0.5) for f in range(1, 5)], "row_id long, fold int, p0 double, p1 double")
    with pytest.raises(Exception, match="row without a partner"):
        combine.fold_average_classes(d, ["p0", "p1"]).collect()
