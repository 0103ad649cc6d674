"""The near-duplicate stage takes both kinds of near copies: equal fingerprints, and a coefficient of 0.8."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stage_goes_by_fingerprints_first(spark):
    # three-word shingles and so fingerprints of the first two are equal, five-word shingles are not
    words = [f"w{i}" for i in range(60)]
    rows = [(1, "x x x"), (2, "x x x x x x x x x"), (3, " ".join(words)), (4, " ".join([*words[:-1], "other"])), (5, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit(1), "fp": F.lit(2), "_rank": F.lit(3)})
    made = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert made.columns == docs.columns
    assert sorted(tuple(r) for r in made.select("doc_id", "_key", "fp", "_rank").collect()) == [(1, 1, 2, 3), (3, 1, 2, 3), (5, 1, 2, 3)]
