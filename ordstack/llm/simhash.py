"""Near duplicates by SimHash and pigeonhole blocks.

A text's fingerprint has 64 bits, each the majority vote of its shingles' hashes. Two fingerprints
within ``DISTANCE`` bits of each other agree on all but ``DISTANCE`` of ``BLOCKS`` blocks, so they meet
under one of the keys made of the remaining blocks. All work after fingerprinting is on distinct
fingerprints; copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordstack.llm.corpus import columns, read, spans, unused
from ordstack.llm.graph import components
from ordstack.session import store

BITS = 64
DISTANCE = 2
#: Keys of BLOCKS - DISTANCE blocks: with five, ten keys of 38 or 39 bits, selective up to some 10^11
#: distinct fingerprints. More blocks make keys longer and their number larger.
BLOCKS = 5
SHINGLE = 3
SEED = 42
#: Fingerprints under one key that are compared pair by pair. Fuller keys go by shared neighbours.
MOST_COMPARED = 48
_STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a whole text; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(starts), _STEP):
        at = zip(starts[lo : lo + _STEP].tolist(), ends[lo : lo + _STEP].tolist())
        votes += _bit_counts(np.array([digest(joined[s:e], SEED) for s, e in at], dtype=np.uint64))
    bits = votes * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit. Eight one-byte counters are added at a time."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(hashes), 255), axis=0)
    return sums.view(np.uint8).sum(axis=0, dtype=np.int64)


def with_fingerprint(df: DataFrame, name: str = "fp") -> DataFrame:
    """``df`` with its rows' fingerprints as a signed bigint (a column of that name is replaced)."""
    df = df.drop(name)
    at = df.columns.index("text")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in spans(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                made = np.array([fingerprint(t) for t in part.column(at).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made.view(np.int64))], names=schema.names)

    return df.mapInArrow(run, schema)


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Unsigned masks of the bits each key keeps."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(fps: DataFrame, most: int = MOST_COMPARED) -> DataFrame:
    """Links ``(a, b)`` among the distinct fingerprints ``fp``: their components are those of all pairs
    within DISTANCE bits.

    Fingerprints under one key: two are compared as they stand, up to ``most`` pair by pair. In a
    fuller key each lists itself and its neighbours at one differing bit among the bits the key leaves
    open; two within two bits share such a neighbour, and those that share one are within two bits of
    each other, so each is linked to the smallest. That is exact, and its rows grow with the number of
    fingerprints, not with its square.
    """
    kept = masks()
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in kept])).alias("k", "key"),
    )
    met = store(
        keyed.groupBy("k", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        .filter("n > 1"),
        "simhash-keys",
    )
    two = met.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).filter(
        _apart(F.col("a"), F.col("b")) <= DISTANCE
    )
    several = keyed.join(met.filter(f"n > 2 AND n <= {most}").select("k", "key"), ["k", "key"])
    paired = (
        several.groupBy("k", "key")
        .agg(F.collect_list("fp").alias("of"))
        .select(F.explode(F.transform("of", lambda a: F.struct(
            a.alias("a"), F.filter("of", lambda b: (b < a) & (_apart(a, b) <= DISTANCE)).alias("b")))).alias("x"))
        .select("x.a", F.explode("x.b").alias("b"))
    )
    many = keyed.join(met.filter(f"n > {most}").select("k", "key"), ["k", "key"])
    open_bits = F.array(*[
        F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]).cast("array<bigint>")
        for m in kept
    ])
    shared = (
        many.select("fp", "k", F.explode(F.transform(F.get(open_bits, F.col("k")), lambda bit: F.col("fp").bitwiseXOR(bit))).alias("near"))
        .groupBy("k", "near")
        .agg(F.collect_list("fp").alias("of"), F.min("fp").alias("b"))
        .filter(F.size("of") > 1)
        .select(F.explode("of").alias("a"), "b")
        .filter("a != b")
    )
    return two.union(paired).union(shared).distinct()


def _groups(prints: DataFrame) -> DataFrame:
    """``(fp, label, component_id)`` of each distinct fingerprint of the stored ``(doc_id, fp)``."""
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(near_links(distinct.select("fp")))
    labelled = distinct.join(roots, distinct.fp == roots.u, "left").select(
        "fp", "first_id", F.coalesce("v", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return store(labelled.join(smallest, "label").select("fp", "label", "component_id"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, label, component_id)`` per row of ``docs`` (``doc_id``, ``text``).

    Null and empty texts have fingerprint 0. A null ``doc_id`` never names a component; where all of a
    component are null, so is its id. Repeated rows keep a row each. ``label`` names the component too
    and is never null. An empty table gives no rows.
    """
    prints = store(with_fingerprint(columns(docs, "doc_id", "text")).drop("text"), "simhash")
    return prints.join(_groups(prints), "fp").select("doc_id", "fp", "label", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of the smallest ``doc_id`` of every component, all columns as they are.

    Rows that tie for it (a repeated ``doc_id``, or none at all) leave the one of the smallest
    fingerprint, then of the smallest hash of the text. Texts are shuffled once, by a nearly unique key.
    """
    fp, key, rank = unused(docs, "fp"), unused(docs, "key"), unused(docs, "rank")
    chosen = (
        near_duplicates(docs)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("label")
        .agg(F.min(F.struct("fp", "doc_id")).alias("kept"))
        .select(_key(F.col("kept.doc_id"), F.col("kept.fp")).alias(key))
    )
    keyed = with_fingerprint(docs, fp).withColumn(key, _key(F.col("doc_id"), F.col(fp)))
    order = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    return (
        keyed.join(chosen, key, "left_semi")
        .withColumn(rank, F.row_number().over(order))
        .filter(F.col(rank) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def _key(doc_id: Column, fp: Column) -> Column:
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), fp.cast("string"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, sf_dir)).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
