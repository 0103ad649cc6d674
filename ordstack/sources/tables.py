"""Raw tables, feature tables, prediction vectors, submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordstack.constants import DEFAULT_CUTOFFS, IS_TEST, ROW_ID, TARGET
from ordstack.functions.numeric import quoted
from ordstack.operators.combine import attach_predictions
from ordstack.operators.ordering import with_sum_before
from ordstack.session import store

TEST_IDS = 1 << 61  # first row id of a test file that has none

# Layout of the raw files, 46 columns with the label last.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("date", T.IntegerType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("market", T.StringType()),
        *[T.StructField(f"f_{i}", T.DoubleType()) for i in range(42)],
        T.StructField(TARGET, T.IntegerType()),
    ]
)


def read_raw(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """One raw file or folder with a declared schema: no inference pass over the data. Text that does
    not parse as its declared type raises when the column is read."""
    reader = spark.read.schema(schema)
    if fmt != "csv":
        return reader.parquet(path)
    return reader.csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    """Types of a CSV file whose layout is not declared, from all of its rows."""
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=1.0).schema


def read_pair(
    spark: SparkSession,
    train: str,
    test: str,
    train_schema: T.StructType | None = None,
    test_schema: T.StructType | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """Train and test as one table with ``is_test``, so both sides get the same projections.

    Row order means nothing in a distributed table, so rows are told apart by ``row_id``. Files
    without one get it here, by their place in the files. A schema that is not given is inferred from
    the whole train file, and the test file gets the same types.
    """
    if fmt == "csv" and train_schema is None:
        train_schema = infer_schema(spark, train)
    if fmt == "csv" and test_schema is None:
        kinds = {f.name: f for f in train_schema.fields}
        test_schema = T.StructType([kinds.get(f.name, f) for f in infer_schema(spark, test).fields])
    trn = read_raw(spark, train, train_schema, fmt).withColumn(IS_TEST, F.lit(False))
    tst = read_raw(spark, test, test_schema, fmt).withColumn(IS_TEST, F.lit(True))
    if ROW_ID in trn.columns:
        return trn.unionByName(tst, allowMissingColumns=True)
    return number_rows(trn).unionByName(number_rows(tst, TEST_IDS), True)


def number_rows(df: DataFrame, start: int = 0) -> DataFrame:
    """Ids from ``start`` on, gapless, by file name and place in the file. However the reader splits
    the files, parts of a file start in order and are read in order, so a row keeps its number."""
    place = df.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_part"),
        F.monotonically_increasing_id().alias("_line"),
        *[quoted(c) for c in df.columns],
    )
    ranked = with_sum_before(place, ["_file", "_part", "_line"], out="_at")
    numbered = (F.col("_at") + F.lit(start)).cast("bigint").alias(ROW_ID)
    return ranked.select(numbered, *[quoted(c) for c in df.columns])


def extract_target(df: DataFrame, position: int | None = None) -> DataFrame:
    """Label of the train rows, found by name or by 1-based column position."""
    name = df.columns[position - 1] if position else TARGET
    return df.filter(~F.col(IS_TEST)).select(ROW_ID, quoted(name).alias(TARGET))


def sample_parts(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and placeholder labels of a sample submission."""
    return sample.select(ROW_ID, "id"), sample.select(ROW_ID, TARGET)


def save_features(
    df: DataFrame,
    path: str,
    table: str | None = None,
    buckets: int = 0,
    by: str | None = None,
    keep_test_label: bool = False,
) -> None:
    """Feature table as Parquet, label null on test rows unless it is to be kept.

    With ``table`` and ``buckets`` it is saved bucketed and sorted by row id, so that sets saved
    alike are combined without a shuffle. ``by`` partitions the files, e.g. by fold.
    """
    if IS_TEST in df.columns and TARGET in df.columns and not keep_test_label:
        df = df.withColumn(TARGET, F.when(~F.col(IS_TEST), F.col(TARGET)))
    writer = df.write.mode("error")
    if by:
        writer = writer.partitionBy(by)
    if table and buckets:
        writer.bucketBy(buckets, ROW_ID).sortBy(ROW_ID).option("path", path).saveAsTable(table)
    else:
        writer.parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def six_decimals(p: str) -> F.Column:
    return F.round(quoted(p).cast("double"), 6)


def save_predictions(df: DataFrame, path: str, value: str = "prediction") -> None:
    df.select(ROW_ID, six_decimals(value).alias("prediction")).write.parquet(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ROW_ID} bigint, prediction double").parquet(path)


def fixed_decimals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers as text with six decimals."""
    return df.select(
        *[F.format_string("%.6f", quoted(c).cast("double")).alias(c) for c in cols]
    )


def export_csv(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Plain CSV of a matrix: fixed decimals, no header, no label."""
    fixed_decimals(df, cols).write.csv(path)


def write_submission(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.select("id", TARGET).write
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path, header=True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"id bigint, {TARGET} double").csv(path, header=True)


def assemble_submission(ids: DataFrame, preds: DataFrame, value: str = "prediction") -> DataFrame:
    """``(id, target)`` rows from the id column and the prediction column of the same rows."""
    return attach_predictions(ids, preds, value).select("id", TARGET)


def save_cutoffs(spark: SparkSession, cutoffs: Sequence[float], path: str) -> None:
    rows = [([float(c) for c in cutoffs],)]
    spark.createDataFrame(rows, "cutoffs array<double>").write.parquet(path)


def load_cutoffs(spark: SparkSession, path: str | None = None) -> tuple[float, ...]:
    """Saved cutoffs, or the defaults where no path is given."""
    if path is None:
        return DEFAULT_CUTOFFS
    return tuple(spark.read.schema("cutoffs array<double>").parquet(path).first()["cutoffs"])


def write_importance(df: DataFrame, path: str) -> None:
    """Importance table (a row per feature) as one CSV file, in its order."""
    df.coalesce(1).write.csv(path, header=True)
