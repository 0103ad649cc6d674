"""Contracts of cutoffs, blends and model jobs, and of tables put side by side."""

import random

import pytest
from pyspark.sql import functions as F

from ordstack.constants import DEFAULT_CUTOFFS
from ordstack.functions.splits import assign_folds
from ordstack.models import blend, cutoffs, jobs
from ordstack.operators import combine, metric
from ordstack.session import scratch_path, store
from ordstack.sources import feature_map, tables


def kappa_of(pairs):
    n = len(pairs)
    y, q = sum(a for a, _ in pairs), sum(b for _, b in pairs)
    yy, qq = sum(a * a for a, _ in pairs), sum(b * b for _, b in pairs)
    d = sum((a - b) ** 2 for a, b in pairs)
    return 1 - n * d / (n * yy - 2 * y * q + n * qq)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    out = []
    for _ in range(800):
        y = rng.choice([0, 1, 2, 3, 5, 8, 13])
        out.append((y, round(y * 0.6 + rng.gauss(1, 1.2), 6)))
    return out + [(3, 0.29), (3, 0.57), (4, 1.1), (2, -4.0), (19, 33.0)]


def bucket(p, cuts):
    return next((k for k, c in enumerate(cuts) if p < c), len(cuts))


def test_cutoffs_beat_their_start_exactly(spark, pairs):
    d = spark.createDataFrame(pairs, "target int, prediction double").repartition(4)
    cuts, kappa = cutoffs.fit_cutoffs(d)
    assert list(cuts) == sorted(cuts) and len(cuts) == len(DEFAULT_CUTOFFS)
    assert kappa == pytest.approx(kappa_of([(y, bucket(p, cuts)) for y, p in pairs]), abs=1e-9)
    assert kappa >= kappa_of([(y, bucket(p, DEFAULT_CUTOFFS)) for y, p in pairs])


def test_missing_prediction_is_rejected_by_the_search(spark):
    d = spark.createDataFrame([(1, None)], "target int, prediction double")
    with pytest.raises(Exception, match="missing prediction"):
        cutoffs.fit_cutoffs(d)


def test_saved_cutoffs(spark):
    path = scratch_path(spark, "cuts")
    tables.save_cutoffs(spark, (0.5, 1.25), path)
    assert tables.load_cutoffs(spark, path) == (0.5, 1.25)
    assert tables.load_cutoffs(spark) == DEFAULT_CUTOFFS


def test_blend_beats_every_single_model(spark, pairs):
    rng = random.Random(2)
    data = [(i, False, y, p, y + rng.gauss(0, 3)) for i, (y, p) in enumerate(pairs)]
    d = spark.createDataFrame(data, "row_id bigint, is_test boolean, target int, a double, b double")
    singles = [metric.qwk(d, "target", m).first().kappa for m in ("a", "b")]
    weights, kappa = blend.fit_blend(d, ["a", "b"], restarts=4)
    assert kappa >= max(singles)
    scored = blend.blend(d, ["a", "b"], weights)
    assert metric.qwk(scored, "target", "prediction").first().kappa == pytest.approx(kappa)


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        x, z = rng.uniform(0, 10), rng.randint(0, 3)
        rows.append((i, i % 5 == 0, int(min(20, max(0, round(x + z)))), x, float(z)))
    d = spark.createDataFrame(
        rows, "row_id bigint, is_test boolean, target int, x double, z double"
    )
    return store(assign_folds(d), "frame")


QUICK = jobs.Boosting(rounds=5, depth=3, rate=0.4, bins=32)
JOBS = {
    "boosted": lambda d: jobs.boosted_regression(d, ["x", "z"], QUICK),
    "boosted refit": lambda d: jobs.boosted_regression(d, ["x", "z"], QUICK, refit=True),
    "boosted every": lambda d: jobs.boosted_regression(
        d, ["x", "z"], QUICK, stop_in="every", refit=True
    ),
    "boosted categories": lambda d: jobs.boosted_regression(
        d, ["x", "z"], QUICK, categories={"z": 4}
    ),
    "trees": lambda d: jobs.randomised_trees(d, ["x", "z"], trees=4, depth=5),
    "linear": lambda d: jobs.linear_regression(d, ["x", "z"], refit=True),
    "classes": lambda d: jobs.class_regression(d, ["x", "z"], trees=4, depth=5),
}


@pytest.mark.parametrize("name", JOBS)
def test_job_contract(frame, name):
    result = JOBS[name](frame)
    train = {r.row_id for r in frame.filter("NOT is_test").collect()}
    test = {r.row_id for r in frame.filter("is_test").collect()}
    oof = [r.row_id for r in result.oof.collect()]
    assert len(oof) == len(train) and set(oof) == train
    assert {r.row_id for r in result.test.collect()} == test
    assert result.oof.filter("prediction IS NULL").count() == 0
    kappa = metric.qwk(result.oof, "target", "prediction").first().kappa
    assert kappa > 0.5  # a constant prediction has 0


def test_fold_features_job(frame):
    folds = None
    for i in range(1, 6):
        part = frame.select("row_id", F.lit(i).alias("fold"), (F.col("x") + i).alias("x"))
        folds = part if folds is None else folds.unionByName(part)
    result = jobs.boosted_regression(frame, ["z"], QUICK, fold_features=folds)
    assert metric.qwk(result.oof, "target", "prediction").first().kappa > 0.5
    assert {r["name"] for r in result.importance.collect()} == {"z", "cv_x"}


def test_binary_probabilities(frame):
    d = frame.select("*", (F.col("target") < 5).cast("int").alias("lt_5"))
    params = jobs.Boosting(rounds=2, depth=3, rate=0.3, bins=32)
    for refit in (False, True):
        result = jobs.binary_probabilities(d, ["x", "z"], ["lt_5"], params, refit)
        low, high = (
            result.oof.join(d.select("row_id", "lt_5"), "row_id")
            .groupBy("lt_5")
            .agg(F.avg("pr_lt_5").alias("p"))
            .orderBy("p")
            .collect()
        )
        assert (low.lt_5, high.lt_5) == (0, 1) and high.p - low.p > 0.2
        assert result.test.filter("pr_lt_5 BETWEEN 0 AND 1").count() == 120


@pytest.mark.parametrize(
    "curve, patience, best",
    [([3, 2, 1], 9, 3), ([3, 1, 2, 0.5], 9, 4), ([3, 1, 2, 2, 0.5], 2, 2), ([1, 1], 5, 1)],
)
def test_best_round(curve, patience, best):
    assert jobs.best_of_curve(curve, patience) == best


# --- side by side -------------------------------------------------------------------------------


def test_combine_rejects_rows_that_differ(frame):
    keys = ["row_id", "is_test", "target"]
    a, b = frame.select(*keys, "x"), frame.select(*keys, "z")
    with pytest.raises(ValueError, match="differ in rows"):
        combine.combine({"a": a, "b": b.filter("row_id <> 4")})
    shifted = b.withColumn("row_id", F.when(F.col("row_id") == 4, 9999).otherwise(F.col("row_id")))
    with pytest.raises(Exception, match="row without a partner|differ in rows"):
        combine.combine({"a": a, "b": shifted}, drop_constants=False).collect()


def test_stack_rejects_a_missing_prediction(frame):
    label = frame.select("row_id", "is_test", "target")
    p = frame.select("row_id", F.col("x").alias("prediction"))
    assert combine.stack(label, {"m": p, "n": p}).count() == 600
    with pytest.raises(Exception, match="row without a partner"):
        combine.stack(label, {"m": p, "n": p.filter("row_id <> 7")}).collect()


def test_fold_features_of_a_missing_row_raise(frame):
    extra = frame.select("row_id", F.lit(1).alias("fold"), "x").filter("row_id <> 3")
    with pytest.raises(Exception, match="row without a partner"):
        combine.with_fold_features(frame.select("row_id", "z"), extra, 1).collect()


def test_prefixed_maps_follow_the_table(spark, frame):
    keys = ["row_id", "is_test", "target"]
    sets = {
        "a": frame.select(*keys, "x", F.lit(1.0).alias("one")),
        "b": frame.select(*keys, "z"),
    }
    table = combine.combine(sets)
    maps = {n: feature_map.feature_map(d) for n, d in sets.items()}
    fmap = feature_map.concat_maps_prefixed(maps, table.columns)
    assert [tuple(r) for r in fmap.orderBy("idx").collect()] == [(0, "a_x", "q"), (1, "b_z", "q")]
    assert table.columns[3:] == ["a_x", "b_z"]
