"""Corpus pipeline: stages over the documents table, each stored and read again by the next.

Columns beside those of ``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordstack.llm import near_dedup, simhash
from ordstack.llm.bpe import round_trip, vocabulary
from ordstack.llm.corpus import columns, read, ship
from ordstack.llm.language_id import accepted, fit
from ordstack.llm.mixing import in_training_order
from ordstack.llm.suffix_dedup import dedup
from ordstack.session import passing, scratch_path, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is fitted on the labelled documents given.

    Null texts and texts without a letter go, and those no language fits; all others stay as they are.
    """
    ship(spark)
    return accepted(docs, fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near duplicates: first by SimHash, those whose
    fingerprints link as in op10. Its two bits tell almost exact copies only, so of what is left, texts whose
    five-word shingles have a Jaccard coefficient of 0.8 or more become one too.

    Only the keys of those that stay outlive the search; the texts are then taken from ``docs``."""
    ship(spark)
    with passing(spark):
        kept = store(simhash.keep_one(docs), "simhash-kept")
        keys = near_dedup.kept_keys(kept)
        path = scratch_path(spark, "near-kept")
        keys.write.parquet(path)
    return near_dedup.rows_of(docs, spark.read.schema(keys.schema).parquet(path))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 100 bytes that start earlier; ``n_chars`` follows. No row
    goes, even if its text is left empty."""
    ship(spark)
    return dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, one row each, in training order."""
    return in_training_order(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every copy and the digests of ids and decoded text."""
    ship(spark)
    return round_trip(columns(docs, "doc_id", "text"), vocabulary())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]

#: SQL has no n-gram model, no XXH64 and no byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored and read again."""
    docs = read(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
