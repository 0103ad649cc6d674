"""The raw train/test table in the expected shape, derived from the order tables: a row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordstack.functions.splits import fold_of
from ordstack.session import store

_staged: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy plan; columns a query does not use are pruned down to the scans, and with them the
    aggregates they feed."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    lines = table(spark, sf_dir, "lineitem")
    items = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("n_items"),
        F.max("l_quantity").alias("a_8"),
        F.max("l_discount").alias("a_12"),
        F.max("l_tax").alias("a_15"),
        F.max("l_extendedprice").alias("a_18"),
        F.min("l_quantity").alias("a_21"),
        F.min("l_extendedprice").alias("a_26"),
    )
    # Two distinct counts in one aggregate would write every line three times, wide, and move it twice. Each
    # apart moves its two columns once.
    for key, name in (("l_partkey", "a_0"), ("l_suppkey", "a_11")):
        dealt = lines.select("l_orderkey", key).repartition("l_orderkey")
        counts = dealt.groupBy("l_orderkey").agg(F.countDistinct(key).alias(name))
        items = items.join(counts, "l_orderkey", "left")
    day = F.col("o_orderdate")

    def zero(c: str):  # missing as 0, and -0.0 as 0.0
        return F.coalesce(F.col(c), F.lit(0.0)) + F.lit(0.0)

    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("row_id"),
            (F.lit(100000000000) + F.col("o_custkey") * 670000).alias("customer_id"),
            (F.month(day) * 1000000 + F.dayofmonth(day) * 10000 + F.year(day))
            .cast("int")
            .alias("date"),
            F.concat(F.lit("M"), F.col("c_nationkey").cast("string")).alias("market"),
            F.col("c_mktsegment").alias("f_1"),
            F.col("o_orderpriority").alias("f_7"),
            F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("f_9"),
            F.coalesce(F.col("a_0"), F.lit(0)).alias("f_0"),
            F.col("o_totalprice").alias("f_5"),
            zero("a_8").alias("f_8"),
            F.lit(1).alias("f_10"),
            F.coalesce(F.col("a_11"), F.lit(0)).alias("f_11"),
            zero("a_12").alias("f_12"),
            F.col("c_acctbal").alias("f_13"),
            zero("a_15").alias("f_15"),
            zero("a_18").alias("f_18"),
            zero("a_21").alias("f_21"),
            F.col("a_8").alias("f_22"),
            zero("a_26").alias("f_26"),
            F.coalesce(F.col("n_items"), F.lit(0)).cast("int").alias("target"),
            (F.year(day) >= 2000).alias("is_test"),
        )
    )


def with_fold(df: DataFrame) -> DataFrame:
    return df.withColumn("fold", fold_of(F.col("row_id")))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``base`` plus ``fold`` as a written table, once per application: the raw file pair that
    feature jobs with several passes start from."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _staged:
        _staged[key] = store(with_fold(base(spark, sf_dir)), "base")
    return _staged[key]


def predictions(df: DataFrame) -> DataFrame:
    """Two stand-in base models per row."""
    return df.select(
        "row_id",
        "is_test",
        "fold",
        "target",
        F.round(F.col("f_8") / 10, 6).alias("pred"),
        F.round(F.col("f_0") * F.lit(0.9), 6).alias("pred2"),
    )
