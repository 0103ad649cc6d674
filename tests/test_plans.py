"""What the plans must look like at scale."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ordstack.catalog import REGISTRY, models
from ordstack.operators import combine, encode, lookup, metric
from ordstack.plans import fixture, recipes
from ordstack.session import scratch_path
from ordstack.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_base_prunes_what_a_query_does_not_use(spark):
    p = plan(fixture.base(spark, SMALL).select("row_id", "f_7"))
    assert "l_quantity" not in p and "c_acctbal" not in p
    p = plan(fixture.base(spark, SMALL).select("row_id", "f_8"))
    assert "l_partkey" not in p and "Expand" not in p


def test_kappa_is_one_small_shuffle(spark):
    df = fixture.predictions(fixture.staged(spark, SMALL))
    p = plan(metric.qwk_by_fold(df, "target", "pred"))
    assert p.count("Exchange") == 1
    assert "Join" not in p


def test_applying_encoders_moves_no_rows(spark):
    df = fixture.staged(spark, SMALL)
    fitted = encode.fit_categories(df, ["market", "f_9"], min_obs=10)
    out = df
    for c in ("market", "f_9"):
        out = fitted.apply(out, c, {"label": f"l_{c}"})
    p = plan(out)
    assert p.count("BroadcastHashJoin") == 2
    assert "hashpartitioning" not in p.replace("BroadcastExchange", "")


def test_per_fold_encoding_has_one_lookup_per_column(spark):
    p = plan(encode.target_encode_folds(fixture.staged(spark, SMALL), ["market", "customer_id"]))
    assert p.count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in p and "NestedLoop" not in p


def test_stored_features_prune_columns_and_folds(spark):
    path = scratch_path(spark, "by-fold")
    tables.save_features(fixture.staged(spark, SMALL), path, by="fold")
    p = plan(tables.load_features(spark, path).filter("fold = 2").select("row_id", "f_5"))
    assert re.search(r"PartitionFilters: \[.*fold", p)
    assert "struct<row_id:bigint,f_5:double>" in p


def test_bucketed_sets_join_without_a_shuffle(spark):
    df = fixture.staged(spark, SMALL)
    keys = ["row_id", "is_test", "target"]
    for name, col in (("set_a", "f_5"), ("set_b", "f_8")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tables.save_features(df.select(*keys, col), scratch_path(spark, name), name, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = {n: spark.table(n) for n in ("set_a", "set_b")}
        p = plan(combine.combine(sets, drop_constants=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "Exchange" not in p


def test_wide_recipe_reads_the_table_once(spark):
    p = plan(recipes.j5(fixture.staged(spark, SMALL)).table)
    assert "SortMergeJoin" not in p
    assert len(re.findall(r"FileScan parquet \[[^\]]*row_id", p)) == 1


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", ["b15_pairwise", "e2_target_encode_folds", "i10_j8", "f2_assign_by_shares"])
def test_no_python_in_the_plan(spark, name):
    p = plan(REGISTRY[name].run(spark, SMALL))
    assert not any(n in p for n in PYTHON_NODES)
    assert "CartesianProduct" not in p


def test_no_global_window_over_rows(spark):
    p = plan(REGISTRY["f1_order_stats"].run(spark, SMALL))
    for window in re.findall(r"Window \[.*", p):
        assert "_range" in window


def test_a_set_joined_to_its_embedding_moves_cells_not_components(spark, monkeypatch):
    stored, store = [], recipes.store
    monkeypatch.setattr(recipes, "store", lambda df, label: stored.append(df.columns) or store(df, label))
    made = recipes.j3(fixture.staged(spark, SMALL), k=4, learned=True, drop_constants=False)
    assert {f"n3_e_{i}" for i in range(4)} <= set(made.table.columns) and "cells" not in made.table.columns
    assert stored and not any(c.startswith("e_") for columns in stored for c in columns)
    rows = made.table.select("row_id", "n3_e_0", "n3_e_3").orderBy("row_id").collect()
    alone = recipes.n3(fixture.staged(spark, SMALL), 4, learned=True).table.orderBy("row_id").collect()
    assert len(rows) == len(alone)
    assert all(a.row_id == b.row_id and a.n3_e_0 == pytest.approx(b.e_0, abs=1e-6) for a, b in zip(rows, alone))


def test_large_lookups_move_raw_rows_not_derived_columns(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    made = recipes.j7(fixture.staged(spark, SMALL), drop_constants=False).table
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    first = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("f_5+f_8" in line for line in lines[:first])
    assert not any("f_5+f_8" in line or "f_5+f_21" in line for line in lines[first:])


def test_fold_vectors_move_their_rows_once(spark):
    long = spark.range(40).selectExpr("id AS row_id", "explode(sequence(1, 5)) AS fold").withColumn("x", F.rand(3))
    df = spark.range(40).selectExpr("id AS row_id", "id % 2 = 0 AS is_test", "1 AS target")
    made = combine.with_fold_vectors(df, long, ["x"])
    assert plan(made).count("Exchange hashpartitioning") <= 1  # the small other side is broadcast
    assert made.selectExpr("size(fold_features) AS n").distinct().first().n == 5
    for bad in (long.filter("row_id <> 7 OR fold <> 2"), long.unionByName(long.filter("row_id = 7 AND fold = 2"))):
        with pytest.raises(Exception, match="row without a partner"):
            combine.with_fold_vectors(df, bad, ["x"]).collect()


def test_a_model_on_fold_features_stores_only_what_it_sees(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "with_fold", lambda df: seen.append(df.columns) or fixture.with_fold(df))
    monkeypatch.setattr(models.jobs, "boosted_regression", lambda df, features, *a, **k: seen.append(features))
    monkeypatch.setattr(models, "both_sides", lambda made: made)
    models.boosted_folds(spark, SMALL)
    assert set(seen[0]) == {*recipes.KEYS, *seen[1]}
