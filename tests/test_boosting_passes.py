"""Boosted tasks share their passes; categories stay sets."""

import random

import pytest

from ordstack.functions.splits import assign_folds
from ordstack.models import boosting, jobs
from ordstack.session import store


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(5)
    rows = [(i, i % 6 == 0, rng.randint(0, 9), rng.uniform(0, 4), float(rng.randint(0, 4))) for i in range(400)]
    d = spark.createDataFrame(rows, "row_id bigint, is_test boolean, target int, x double, c double")
    return store(assign_folds(d), "noisy")


def test_a_round_takes_the_same_jobs_for_any_number_of_tasks(spark, noisy):
    data = jobs.cached(jobs.assemble(noisy, ["x", "c"]))
    params = boosting.Boosting(rounds=2, depth=2, bins=16)
    made = []
    for folds in ([1], [1, 2, 3, 4, 5]):
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        boosting.Stagewise(data, [boosting.Task(i, unit=i) for i in folds], params).fit(stop=False)
        made.append(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before)
    data.unpersist()
    assert made[1] <= made[0] + 2


def test_folds_that_end_with_the_first_are_those_fitted_alone(noisy):
    data = jobs.cached(jobs.assemble(noisy, ["x", "c"]))
    params = boosting.Boosting(rounds=8, depth=2, rate=0.5, bins=16, patience=2, block=2, min_rows=2)
    tasks = [boosting.Task(i, unit=i) for i in (1, 2)]
    first, second = boosting.Stagewise(data, tasks, params).fit(by=1)
    alone = boosting.Stagewise(data, tasks[:1], params).fit()[0]
    fixed = boosting.replace(params, rounds=len(alone.trees))
    other = boosting.Stagewise(data, tasks[1:], fixed).fit(stop=False)[0]
    assert len(first.trees) == len(second.trees) == len(alone.trees)
    rows = other.apply(second.apply(data, "a"), "b").select("a", "b").collect()
    data.unpersist()
    assert max(abs(r.a - r.b) for r in rows) < 1e-9


def test_categories_are_split_as_sets(noisy):
    d = noisy.withColumn("target", (noisy.c.isin(0.0, 3.0)).cast("int"))
    data = jobs.cached(jobs.assemble(d, ["c"], {"c": 5}))
    params = boosting.Boosting(rounds=1, depth=1, rate=1.0, subrow=1.0, bins=8)
    model = boosting.Stagewise(data, [boosting.Task(None)], params).fit(stop=False)[0]
    rows = model.apply(data, "p").select("label", "p").collect()
    data.unpersist()
    assert all(abs(r.p - r.label) < 1e-9 for r in rows)
