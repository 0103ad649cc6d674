"""Boosting packs what folds share once, and walks trees by masks."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ordstack.functions.splits import assign_folds
from ordstack.models import boosting, jobs
from ordstack.session import store

PARAMS = boosting.Boosting(rounds=3, depth=4, rate=0.5, bins=16, min_rows=2, block=2)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(7)
    rows = [(i, i % 6 == 0, rng.randint(0, 1), rng.uniform(0, 4), float(rng.randint(0, 4)), rng.random()) for i in range(600)]
    d = spark.createDataFrame(rows, "row_id bigint, is_test boolean, target int, x double, c double, z double")
    return store(assign_folds(d), "noisy")


def trees_of(models):
    return [(t.feature, t.child, np.round(t.value, 9).tolist()) for m in models for t in m.trees]


def test_common_features_are_packed_once(noisy):
    own = noisy.withColumn("fold_features", F.array(*[F.array(F.col("z") * i, F.col("c") + i) for i in range(1, 6)]))
    data = jobs.cached(jobs.assemble(own, ["x", "c"], carry=["fold_features"]))
    tasks = [boosting.Task(i, unit=i) for i in range(1, 6)]
    fits = boosting.Stagewise(data, tasks, PARAMS, own=jobs._own_features)
    assert len(fits.state.first().bins) == 2 + 5 * 2
    made = fits.fit(stop=False)
    for i in (1, 4):
        mine = array_to_vector(F.concat(vector_to_array("features"), F.get("fold_features", F.lit(i - 1))))
        alone = boosting.Stagewise(data.withColumn("features", mine), [boosting.Task(i)], PARAMS).fit(stop=False)
        assert trees_of(made[i - 1 : i]) == trees_of(alone)
    data.unpersist()


def test_masks_and_walks_end_in_the_same_nodes(monkeypatch):
    rng = np.random.default_rng(3)
    bins, tree, open_ = rng.integers(0, 16, (6, 500)).astype(np.uint8), boosting.Tree(), [0]
    for depth in range(3):
        fresh = []
        for i, node in enumerate(open_):
            left = np.arange(16) < 5 + i if depth % 2 else rng.random(16) < 0.5
            fresh += tree.split(node, node % 6, left, 1.0, (0.0, 0.0))
        tree.depth, open_ = depth + 1, fresh
    masked = tree.nodes(bins)
    monkeypatch.setattr(boosting, "MASKED_NODES", 0)
    assert (masked == tree.nodes(bins)).all() and len(set(masked)) > 4
