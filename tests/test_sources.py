"""Files without row ids, declared layout, submissions."""

from pyspark.sql import functions as F

from ordstack.plans import recipes
from ordstack.session import scratch_path, scratch_root
from ordstack.sources import tables


def raw_files(spark):
    head = [f.name for f in tables.RAW_SCHEMA.fields]
    assert len(head) == 46 and head[-1] == "target"
    base = spark.range(60).select(
        (F.lit(1012016) + (F.col("id") % 2)).cast("int").alias("date"),
        (F.lit(123456780000) + F.col("id")).alias("customer_id"),
        F.concat(F.lit("M"), (F.col("id") % 3).cast("string")).alias("market"),
        *[
            F.when(F.col("id") % 10 != i % 10, (F.col("id") * (i + 1)) % 17).cast("double").alias(f"f_{i}")
            for i in range(42)
        ],
        (F.col("id") % 4).cast("int").alias("target"),
        "id",
    )
    train, test = scratch_path(spark, "train"), scratch_path(spark, "test")
    base.filter("id < 40").drop("id").select(*head).write.csv(train, header=True)
    base.filter("id >= 40").select("id", *head[:-1]).write.csv(test, header=True)
    test_schema = tables.T.StructType(
        [tables.T.StructField("id", tables.T.LongType()), *tables.RAW_SCHEMA.fields[:-1]]
    )
    return tables.read_pair(spark, train, test, tables.RAW_SCHEMA, test_schema)


def test_raw_files_get_row_ids(spark):
    df = raw_files(spark)
    assert df.count() == 60
    assert df.select("row_id").distinct().count() == 60
    assert df.filter("is_test").agg(F.min("row_id")).first()[0] >= tables.TEST_IDS
    assert df.filter("is_test AND target IS NOT NULL").count() == 0
    assert df.filter("is_test").agg(F.min("id"), F.max("id")).first()[:] == (40, 59)


def test_recipes_run_on_the_declared_layout(spark):
    df = raw_files(spark)
    made = recipes.j8(df)
    assert "f_19" not in made.table.columns and "f_5+f_11" in made.table.columns
    assert "id" not in made.table.columns
    fmap = made.feature_map().orderBy("idx").collect()
    assert [r.idx for r in fmap] == list(range(len(fmap)))
    assert fmap[0].name == "customer_id" and fmap[-1].name == "median_target_encoding"
    types = recipes.n1(df).feature_map().groupBy("type").count().collect()
    assert {r["type"] for r in types} <= {"q", "i"}
    assert made.table.count() == 60 and made.folds.count() == 300
    for make in (recipes.h1, recipes.j0, recipes.j4, recipes.j6, recipes.j5):
        assert make(df).table.count() == 60
    assert len(recipes.j1(df).table.columns) == len(recipes.j2(df).table.columns) - 1


def test_target_by_position(spark):
    df = raw_files(spark).drop("row_id", "id").withColumn("row_id", F.lit(1).cast("bigint"))
    by_position = tables.extract_target(df, 46)
    assert by_position.agg(F.sum("target")).first() == tables.extract_target(df).agg(
        F.sum("target")
    ).first()


def test_scratch_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert scratch_root(spark).startswith(shared)


def test_gzip_submission(spark):
    path = scratch_path(spark, "sub")
    d = spark.createDataFrame([(1, 7, 2.5)], "row_id bigint, id bigint, target double")
    tables.write_submission(d, path, gzip=True)
    assert [tuple(r) for r in tables.read_submission(spark, path).collect()] == [(7, 2.5)]
    names = spark.read.format("binaryFile").load(path + "/*.csv.gz").select("path").collect()
    assert len(names) >= 1
