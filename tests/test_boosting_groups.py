"""Blocks hold the scores of a group of tasks; rows are packed before they are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from ordstack.functions.splits import assign_folds
from ordstack.models import boosting, jobs
from ordstack.session import store

PARAMS = boosting.Boosting(rounds=2, depth=3, rate=0.5, bins=16, min_rows=2, patience=2)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(11)
    rows = [(i, i % 6 == 0, rng.randint(0, 10), rng.uniform(0, 4), float(rng.randint(0, 4))) for i in range(700)]
    d = spark.createDataFrame(rows, "row_id bigint, is_test boolean, target int, x double, c double")
    return store(assign_folds(d), "noisy")


def trees_of(models):
    return [(t.feature, t.child, t.value, t.gain) for m in models for t in m.trees]


def test_a_block_holds_the_scores_of_its_group(noisy, monkeypatch):
    classes = [f"is_{k}" for k in range(11)]
    flags = [(F.col("target") == k).cast("double").alias(c) for k, c in enumerate(classes)]
    data = jobs.assemble(noisy.select("*", *flags), ["x", "c"], {"c": 5}, keep=classes)
    tasks = [boosting.Task(i, c, unit=i) for i in (1, 2, 3) for c in classes]
    fits = boosting.Stagewise(data, tasks, PARAMS, "softmax", partitions=2)
    assert fits.state.getNumPartitions() == 3 * 2
    assert {b.scores.shape[0] for b in fits.state.collect()} == {11}
    made = fits.fit(by=1)
    monkeypatch.setattr(boosting, "TASKS_EACH", 1000)
    whole = boosting.Stagewise(data, tasks, PARAMS, "softmax", partitions=2)
    assert whole.state.getNumPartitions() == 2
    together = whole.fit(by=1)
    assert trees_of(made) == trees_of(together)
    assert made[0].losses == together[0].losses


def test_wide_rows_are_neither_dealt_nor_kept(noisy, monkeypatch):
    data = jobs.cached(jobs.assemble(noisy, ["x", "c"]), rows=300)
    tasks = [boosting.Task(i, unit=i) for i in range(1, 6)]
    dealt = boosting.Stagewise(data, tasks, PARAMS).fit(stop=False)
    lazy = boosting.Stagewise(jobs.assemble(noisy, ["x", "c"]), tasks, PARAMS, partitions=3).fit(stop=False)
    assert trees_of(dealt) == trees_of(lazy)
    data.unpersist()

    def refuse(*args):
        raise AssertionError("wide rows are kept")

    monkeypatch.setattr(jobs, "cached", refuse)
    made = jobs.boosted_regression(noisy, ["x", "c"], PARAMS)
    rows = jobs.assemble(noisy, ["x", "c"]).filter("NOT is_test")
    for i, m in enumerate(made.models, 1):
        want = m.apply(rows.filter(F.col("fold") == i), "p").select("row_id", F.round("p", 6).alias("p"))
        both = want.join(made.oof, "row_id")
        assert both.count() == want.count() and both.filter("p <> prediction").count() == 0


def test_counts_of_the_larger_child_are_what_its_parent_has_left(noisy, monkeypatch):
    seen = []
    total = boosting.Stagewise._totals
    monkeypatch.setattr(boosting.Stagewise, "_totals", lambda self, *a: seen.append(total(self, *a)) or seen[-1])
    data = jobs.assemble(noisy, ["x", "c"])
    boosting.Stagewise(data, [boosting.Task(1)], PARAMS, partitions=1).fit(stop=False)
    assert [len(s[0][0]) * 2 for s in seen[1:3]] == [len(s[0][1]) for s in seen[1:3]]
