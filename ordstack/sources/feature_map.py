"""Feature maps ``(idx, name, type)``: ``q`` numeric, ``int`` whole numbers, ``i`` indicator.

A map has a row per column, so its size is that of the schema, not of the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordstack.operators.columns import feature_columns

SCHEMA = "idx int, name string, type string"


def enumerate_columns(df: DataFrame) -> list[tuple[int, str]]:
    return list(enumerate(df.columns))


def from_names(spark: SparkSession, typed: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(typed)], SCHEMA)


def feature_map(df: DataFrame, whole: Sequence[str] = (), indicator: Sequence[str] = ()) -> DataFrame:
    """Map of the feature columns of ``df`` in order; columns named in ``whole`` are ``int``, those
    in ``indicator`` are ``i``, the others ``q``."""
    whole_set, indicator_set = set(whole), set(indicator)
    typed = [
        (c, "int" if c in whole_set else "i" if c in indicator_set else "q")
        for c in feature_columns(df)
    ]
    return from_names(df.sparkSession, typed)


def model_map(spark: SparkSession, models: Sequence[str]) -> DataFrame:
    """Map of a stack: one numeric feature per base model."""
    return from_names(spark, [(m, "q") for m in models])


def write_map(fmap: DataFrame, path: str) -> None:
    fmap.coalesce(1).sortWithinPartitions("idx").write.csv(path, sep="\t")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).csv(path, sep="\t")


def categorical_features(fmap: DataFrame) -> DataFrame:
    """Features of any type but ``q``."""
    return fmap.filter("type <> 'q'").select("idx", "name")


def concat_maps(maps: Sequence[DataFrame]) -> DataFrame:
    """One map after the other, indices renumbered from 0."""
    long = None
    for k, m in enumerate(maps):
        part = m.withColumn("_set", F.lit(k))
        long = part if long is None else long.unionByName(part)
    order = Window.orderBy("_set", "idx")  # a row per column of the schema
    return long.select(
        (F.row_number().over(order) - 1).alias("idx"), "name", "type"
    )


def prefix_names(fmap: DataFrame, name: str) -> DataFrame:
    return fmap.withColumn("name", F.concat_ws("_", F.lit(name), F.col("name")))


def concat_maps_prefixed(maps: dict[str, DataFrame], kept: Sequence[str]) -> DataFrame:
    """Maps with prefixed names, cut to the columns that were kept, then numbered: positions in the
    result are positions in the combined table."""
    keep = F.col("name").isin(list(kept))
    return concat_maps([prefix_names(m, name).filter(keep) for name, m in maps.items()])
