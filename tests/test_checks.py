"""Inputs that must raise, and results that must not hang on how the data is laid out."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ordstack.models import embed, jobs
from ordstack.operators import combine, encode, ordering
from ordstack.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def stacked(spark, a, b):
    label = frame(spark, [(i, False, i) for i in range(4)], "row_id bigint, is_test boolean, target int")
    preds = {n: frame(spark, rows, "row_id bigint, prediction double") for n, rows in (("a", a), ("b", b))}
    return combine.stack(label, preds).collect()


WHOLE = [(i, float(i)) for i in range(4)]


def test_stack_of_whole_predictions(spark):
    assert sorted((r.row_id, r.pred_a, r.pred_b) for r in stacked(spark, WHOLE, WHOLE)) == [
        (i, float(i), float(i)) for i in range(4)
    ]


@pytest.mark.parametrize(
    "a, b",
    [
        ([*WHOLE, (1, 9.0)], [w for w in WHOLE if w[0] != 1]),  # doubled here, missing there
        (WHOLE, [(0, None), *WHOLE[1:]]),
        ([*WHOLE, (2, 2.0)], WHOLE),
        (WHOLE, [*WHOLE, (7, 1.0)]),
    ],
)
def test_stack_raises(spark, a, b):
    with pytest.raises(PySparkException):
        stacked(spark, a, b)


def test_combine_raises_on_other_rows(spark):
    left = frame(spark, [(1, 1.0), (2, 2.0), (2, 3.0)], "row_id bigint, x double")
    right = frame(spark, [(1, 1.0), (2, 2.0), (3, 3.0)], "row_id bigint, y double")
    with pytest.raises(ValueError):
        combine.combine({"a": left, "b": right}, drop_constants=False)


def test_fold_average_raises_on_a_missing_fold(spark):
    rows = [(1, i, float(i)) for i in range(1, 6)] + [(2, i, 1.0) for i in range(1, 5)]
    df = frame(spark, rows, "row_id bigint, fold int, prediction double")
    assert combine.fold_average(df.filter("row_id = 1")).first().prediction == 3.0
    with pytest.raises(PySparkException):
        combine.fold_average(df).collect()


def write_lines(path, lines):
    path.mkdir()
    (path / "part.csv").write_text("\n".join(lines) + "\n")
    return str(path)


def test_malformed_text_raises(spark, tmp_path):
    path = write_lines(tmp_path / "bad", ["x,y", "1.5,2", "abc,3"])
    df = tables.read_raw(spark, path, "x double, y int")
    with pytest.raises(Exception, match="abc|MALFORMED|CANNOT_PARSE"):
        df.collect()


def test_types_and_numbers_of_undeclared_files(spark, tmp_path):
    n = 3000
    train = write_lines(tmp_path / "train", ["date,f_1,target", *[f"{i},{'a' if i < n - 1 else 'b'},{i % 3}" for i in range(n)]])
    test = write_lines(tmp_path / "test", ["date,f_1", "7,a", "8,b"])
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            pair = tables.read_pair(spark, train, test)
            assert dict(pair.dtypes)["f_1"] == "string" and dict(pair.dtypes)["date"] == "int"
            seen.append(sorted((r.row_id, r.date, r.is_test) for r in pair.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]
    assert [r[0] for r in seen[0] if not r[2]] == list(range(n)) == [r[1] for r in seen[0] if not r[2]]


def test_means_leave_rows_without_a_label_out(spark):
    rows = [(1, False, "k", 4, 1), (2, False, "k", None, 1), (3, False, "k", 2, 2), (4, True, "k", None, 1)]
    df = frame(spark, rows, "row_id bigint, is_test boolean, c string, target int, fold int")
    assert {r.mt_c for r in encode.target_encode(df, ["c"]).collect()} == {3.0}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, i % 5 == 0, i % 7, i // 5 % 5 + 1, float(i % 7 + i % 3), float(i * 37 % 101)) for i in range(600)]
    return frame(spark, rows, "row_id bigint, is_test boolean, target int, fold int, x double, z double")


def test_models_do_not_hang_on_partitions(spark, table):
    params = jobs.Boosting(rounds=2, depth=3, rate=0.5, subrow=0.7, bins=16)
    got = [
        sorted((r.row_id, r.prediction) for r in jobs.boosted_regression(df, ["x", "z"], params).oof.collect())
        for df in (table.repartition(4), table.repartition(7, "z"))
    ]
    assert got[0] == got[1]


def test_too_deep_trees_raise(table):
    with pytest.raises(ValueError):
        jobs.randomised_trees(table, ["x"], trees=1, depth=40)


def test_targets_go_along_without_a_join(table):
    made = jobs.assemble(table.withColumn("t", F.lit(1)), ["x", "z"], keep=["t"])
    assert "t" in made.columns and "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_projection_of_any_width(spark):
    cells = spark.range(20_000).selectExpr("id % 50 AS row_id", "struct(id AS idx, 1.0D AS value) AS cell")
    made = embed.project(cells.groupBy("row_id").agg(F.collect_list("cell").alias("cells")), 64)
    rows = made.collect()
    assert len(rows) == 50 and made.columns == ["row_id", *[f"e_{i}" for i in range(64)]]
    norms = [sum(r[f"e_{i}"] ** 2 for i in range(64)) for r in rows]
    assert 300 < sum(norms) / 50 < 500  # 400 cells of one a row: kept in expectation


def test_one_outlier_does_not_change_order_statistics(spark):
    df = spark.range(2000).selectExpr("CASE WHEN id = 7 THEN 1e12D ELSE CAST(id AS DOUBLE) END AS p")
    got = {r.position: r.value for r in ordering.order_stats(df, "p", [0, 1000, 1999]).collect()}
    assert got == {0: 0.0, 1000: 1001.0, 1999: 1e12}
