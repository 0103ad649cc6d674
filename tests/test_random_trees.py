"""Trees of random cuts grow together, a pass per level."""

import random

import numpy as np
import pytest

from ordstack.functions.splits import assign_folds
from ordstack.models import boosting, jobs, random_trees
from ordstack.session import store


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(i, i % 6 == 0, rng.randint(0, 9), rng.uniform(0, 4), rng.uniform(-1, 1)) for i in range(600)]
    d = spark.createDataFrame(made, "row_id bigint, is_test boolean, target int, x double, z double")
    return store(assign_folds(d), "random-trees")


def test_jobs_do_not_grow_with_trees(spark, rows):
    made = []
    for trees, groups in ((1, 1), (12, 4)):
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        jobs.random_threshold_trees(rows, ["x", "z"], trees=trees, depth=3, groups=groups, cuts=6)
        made.append(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before)
    assert made[1] <= made[0] + 4


def test_a_tree_takes_the_best_of_its_cuts(rows):
    data = jobs.assemble(rows, ["x"])
    bins = [boosting.Bins([np.array(e)], [len(e) + 1]) for e in ([0.7, 2.0, 3.1], [1.1, 2.4])]
    forests = [random_trees.Forest(f, b, (i,)) for i, (f, b) in enumerate(zip((1, 2), bins))]
    params = boosting.Boosting(depth=1, min_rows=5, subcol="all")
    grown = random_trees.grow(data.filter("NOT is_test"), forests, params)
    for forest in forests:
        mine = [(r.x, r.target) for r in rows.filter("NOT is_test").collect() if r.fold != forest.fold]

        def left_over(cut):
            sides = [[y for x, y in mine if x <= cut], [y for x, y in mine if x > cut]]
            return sum(np.var(s) * len(s) for s in sides)

        edges = forest.bins.edges[0]
        best = min(edges, key=left_over)
        tree = grown[forest.numbers[0]]
        assert tree.left[0].tolist()[: len(edges) + 1] == [e <= best for e in edges] + [False]
        assert tree.value[1] == pytest.approx(np.mean([y for x, y in mine if x <= best]))
        assert tree.value[2] == pytest.approx(np.mean([y for x, y in mine if x > best]))


def test_tasks_follow_rows_and_the_root_of_many():
    assert [random_trees.tasks_for(n) for n in (0, 1, 100_001, 3_600_000)] == [1, 1, 2, 36]
    assert random_trees.tasks_for(4 * 3_600_000) == 72


def test_values_that_are_no_numbers_are_refused(spark, rows):
    odd = rows.withColumn("x", rows.x * float("nan"))
    with pytest.raises(Exception, match="NaN|not a number"):
        jobs.random_threshold_trees(odd, ["x", "z"], trees=1, depth=2, groups=1)
