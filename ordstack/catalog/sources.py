"""Queries over sources and sinks: tables written to scratch folders and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordstack.catalog.registry import (
    cutoff_sql,
    kappa_sql,
    lazy_base,
    over_base,
    query,
    r6,
    rating_sql,
    s6,
)
from ordstack.constants import DEFAULT_CUTOFFS
from ordstack.functions.numeric import apply_cutoffs
from ordstack.operators import columns, metric, ordering
from ordstack.plans import fixture
from ordstack.session import scratch_path
from ordstack.sources import feature_map, tables

WHOLE_CANDIDATES = ("f_0", "f_5", "f_8", "f_10", "f_11", "f_12", "f_13", "f_21")


@query(
    "a1_read_pair",
    over_base(
        """SELECT row_id, is_test, customer_id, date, market, f_1, f_9, f_5, f_22,
           CASE WHEN NOT is_test THEN target END AS target FROM b"""
    ),
)
def read_pair(spark, sf):
    df = lazy_base(spark, sf).select(
        "row_id", "customer_id", "date", "market", "f_1", "f_9", "f_5", "f_22", "target", "is_test"
    )
    trn, tst = scratch_path(spark, "train"), scratch_path(spark, "test")
    train, test = columns.split_stacked(df)
    train, test = train.drop("is_test"), test.drop("is_test", "target")
    train.write.csv(trn, header=True)
    test.write.csv(tst, header=True)
    return tables.read_pair(spark, trn, tst, train.schema, test.schema)


@query(
    "a2_extract_target",
    over_base(
        """SELECT how, row_id, target FROM b
           CROSS JOIN (SELECT unnest(['name', 'position']) AS how) WHERE NOT is_test"""
    ),
)
def extract_target(spark, sf):
    df = fixture.base(spark, sf)
    by_name = tables.extract_target(df).withColumn("how", F.lit("name"))
    at = df.columns.index("target") + 1
    return by_name.unionByName(
        tables.extract_target(df, at).withColumn("how", F.lit("position"))
    )


@query(
    "a3_sample_parts",
    over_base(
        """SELECT 'id' AS part, row_id, row_id AS value FROM b WHERE is_test
           UNION ALL SELECT 'target', row_id, 0 FROM b WHERE is_test"""
    ),
)
def sample_parts(spark, sf):
    sample = fixture.base(spark, sf).filter("is_test").select(
        "row_id", F.col("row_id").alias("id"), F.lit(0).alias("target")
    )
    ids, placeholder = tables.sample_parts(sample)
    return ids.select(F.lit("id").alias("part"), "row_id", F.col("id").alias("value")).unionByName(
        placeholder.select(
            F.lit("target").alias("part"), "row_id", F.col("target").cast("bigint").alias("value")
        )
    )


@query(
    "a4_save_load_features",
    over_base(
        """SELECT row_id, is_test, f_5, f_8, f_22,
           CASE WHEN NOT is_test THEN target END AS target FROM b"""
    ),
)
def save_load_features(spark, sf):
    path = scratch_path(spark, "features")
    df = fixture.base(spark, sf).select("row_id", "is_test", "f_5", "f_8", "f_22", "target")
    tables.save_features(df, path)
    return tables.load_features(spark, path)


@query("a5_predictions", over_base("SELECT row_id, round(f_5 / 7, 6) AS prediction FROM b"))
def predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    df = fixture.base(spark, sf).select("row_id", (F.col("f_5") / 7).alias("prediction"))
    tables.save_predictions(df, path)
    return tables.load_predictions(spark, path)


def data_map(spark, sf, cols=WHOLE_CANDIDATES):
    """Feature map whose ``int`` type is what the values of a column show."""
    df = fixture.base(spark, sf).select(*cols)
    rows = columns.integer_like(df, cols).filter("is_integer").collect()  # a row per column
    return feature_map.feature_map(df, whole=[r["column"] for r in rows])


def map_ctes(cols=WHOLE_CANDIDATES):
    lines = [
        f"""SELECT CAST({i} AS INT) AS idx, '{c}' AS name,
            CASE WHEN bool_and({c} = floor({c})) THEN 'int' ELSE 'q' END AS type FROM b"""
        for i, c in enumerate(cols)
    ]
    return "fm AS (" + " UNION ALL ".join(lines) + ")"


@query("a6_feature_map", over_base("SELECT idx, name, type FROM fm", map_ctes()))
def write_feature_map(spark, sf):
    path = scratch_path(spark, "fmap")
    feature_map.write_map(data_map(spark, sf), path)
    return feature_map.read_map(spark, path)


@query(
    "a7_categorical_features",
    over_base("SELECT idx, name FROM fm WHERE type <> 'q'", map_ctes()),
)
def categorical_features(spark, sf):
    return feature_map.categorical_features(data_map(spark, sf))


@query(
    "a8_export_csv",
    over_base(
        """SELECT printf('%.6f', f_5) AS c0, printf('%.6f', f_12) AS c1,
           printf('%.6f', CAST(f_0 AS DOUBLE)) AS c2 FROM b"""
    ),
)
def export_csv(spark, sf):
    path = scratch_path(spark, "export")
    tables.export_csv(fixture.base(spark, sf), path, ["f_5", "f_12", "f_0"])
    return spark.read.schema("c0 string, c1 string, c2 string").csv(path)


def _submission(spark, sf):
    df = fixture.predictions(lazy_base(spark, sf)).filter("is_test")
    ids = df.select("row_id", F.col("row_id").alias("id"))
    return ids, df.select("row_id", F.col("pred").alias("prediction"))


SUBMISSION_SQL = over_base("SELECT row_id AS id, pred AS target FROM p WHERE is_test")


@query("a9_write_submission", SUBMISSION_SQL)
def write_submission(spark, sf):
    path = scratch_path(spark, "submission")
    tables.write_submission(tables.assemble_submission(*_submission(spark, sf)), path, gzip=True)
    return tables.read_submission(spark, path)


@query("a10_assemble_submission", SUBMISSION_SQL)
def assemble_submission(spark, sf):
    return tables.assemble_submission(*_submission(spark, sf))


@query(
    "a11_metric_row",
    over_base(
        "SELECT 'pred' AS model, round(kappa, 6) AS kappa FROM kappa",
        "src AS (SELECT target, " + rating_sql("pred") + " AS r FROM p WHERE NOT is_test)",
        kappa_sql("src", "target", "r"),
    ),
)
def metric_row(spark, sf):
    df = fixture.predictions(lazy_base(spark, sf)).filter("NOT is_test")
    return metric.metric_row(df, "pred", "target", "pred")


@query(
    "a12_cutoffs",
    over_base(f"SELECT row_id, {cutoff_sql('pred', DEFAULT_CUTOFFS)} AS rating FROM p"),
)
def cutoffs(spark, sf):
    path = scratch_path(spark, "cutoffs")
    tables.save_cutoffs(spark, DEFAULT_CUTOFFS, path)
    cuts = tables.load_cutoffs(spark, path)
    df = fixture.predictions(lazy_base(spark, sf))
    return df.select("row_id", apply_cutoffs(F.col("pred"), cuts).alias("rating"))


@query(
    "a13_write_importance",
    over_base(
        f"""SELECT name, {s6('gain / sum(gain) OVER ()')} AS gain FROM
            (SELECT market AS name, CAST(sum(target) AS DOUBLE) AS gain FROM b GROUP BY 1)"""
    ),
)
def write_importance(spark, sf):
    path = scratch_path(spark, "importance")
    gains = (
        fixture.base(spark, sf)
        .groupBy(F.col("market").alias("name"))
        .agg(F.sum("target").cast("double").alias("gain"))
    )
    tables.write_importance(ordering.importance(gains), path)
    back = spark.read.schema("name string, gain double").csv(path, header=True)
    return back.select("name", r6("gain").alias("gain"))
