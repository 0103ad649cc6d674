"""Hard negatives of anchor vectors by Fagin's threshold algorithm over integer inner products.

Every task holds blocks of vectors and, per dimension, the block's rows sorted by that component. An
anchor reads the lists from the end its own sign favours, a few rows deeper each round. Rows met for the
first time are scored by their whole vectors. No row still unmet can score more than the threshold, the
sum of the anchor's components times the values reached; the search ends once that lies strictly below
the last wanted score of every window (strictly, since a tie goes to the smaller id).

Anchors come in chunks of bounded size, broadcast one after the other; vectors are never shuffled again
after they are dealt out. A task carries an anchor's best rows from block to block, so later blocks stop
early, and returns a handful of rows per anchor. All anchors against all vectors stay a product, as asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordstack.llm.corpus import columns, read
from ordstack.session import store

#: Components are floor(SCALE * x).
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least LEAST and at most 100 hundredths of the positive's score.
LEAST = 80
#: Bytes of one chunk of anchors, which every task gets.
ANCHOR_BYTES = 16 << 20
#: Vectors per sorted block, and per partition at most: a partition returns rows for every anchor.
BLOCK_ROWS = 1 << 16
PARTITION_ROWS = 1 << 18
#: Rows read from every list in the first round; each round reads twice as many as the one before.
FIRST_DEPTH = 8
#: Doubles hold integers exactly below this.
_EXACT = 1 << 53


@dataclass(frozen=True)
class Block:
    """Vectors of one length with their per-dimension sorted lists, ascending."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray  # rows x dimensions
    order: np.ndarray  # dimensions x rows
    sorted: np.ndarray  # dimensions x rows

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> Block:
        order = np.argsort(values.T, axis=1, kind="stable").astype(np.int32)
        return Block(ids, labels, values, order, np.take_along_axis(values.T, order.astype(np.int64), axis=1))

    def met(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rounds of sorted access: rows met for the first time, their scores, and the threshold, which is
        None once every row has been met."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):  # no list to read: all scores are 0
            yield np.arange(n), np.zeros(n, dtype=np.int64), None
            return
        largest = np.abs(self.sorted[:, [0, -1]]).max(axis=1).astype(object)
        exact = int((np.abs(anchor.astype(object)) * largest).sum()) < _EXACT
        whole = anchor.astype(np.float64) if exact else anchor.astype(object)
        unmet = np.ones(n, dtype=bool)
        lo, step = 0, FIRST_DEPTH
        while lo < n:
            hi = min(n, lo + step)
            rows = np.concatenate([self.order[up, n - hi : n - lo].ravel(), self.order[down, lo:hi].ravel()])
            rows = np.unique(rows[unmet[rows]])
            unmet[rows] = False
            scores = self.values[rows].astype(whole.dtype) @ whole
            if hi == n:
                yield rows, scores.astype(np.int64), None
                return
            reached = (anchor[up].astype(object) * self.sorted[up, n - hi].astype(object)).sum()
            reached += (anchor[down].astype(object) * self.sorted[down, hi - 1].astype(object)).sum()
            yield rows, scores.astype(np.int64), int(reached)
            lo, step = hi, 2 * step


Found = tuple[np.ndarray, np.ndarray]  # scores, ids; best first
_NONE: Found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _merge(found: Found, scores: np.ndarray, ids: np.ndarray, k: int) -> Found:
    """The first ``k`` different (score, id): higher scores first, then smaller ids."""
    if not len(ids):
        return found
    scores, ids = np.concatenate([found[0], scores]), np.concatenate([found[1], ids])
    if len(scores) > 4 * k:  # nothing below the kth score can be wanted
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, ids = scores[keep], ids[keep]
    at = np.lexsort((ids, -scores))
    scores, ids = scores[at], ids[at]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
    return scores[new][:k], ids[new][:k]


def best_positives(block: Block, anchor: np.ndarray, own: int, label: int, found: Found, k: int) -> Found:
    """``found`` after a block: the first ``k`` rows of the anchor's label but those of its own id."""
    for rows, scores, threshold in block.met(anchor):
        fits = (block.labels[rows] == label) & (block.ids[rows] != own)
        found = _merge(found, scores[fits], block.ids[rows[fits]], k)
        if threshold is None or (len(found[0]) == k and found[0][-1] > threshold):
            break
    return found


def best_negatives(
    block: Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], found: list[Found], k: int
) -> list[Found]:
    """``found`` after a block: per window of scores (both ends included) the first ``k`` rows of another
    label. A window is settled when its kth score, or else its lower end, is above the threshold."""
    found = list(found)
    open_ = [i for i, (lo, hi) in enumerate(windows) if lo <= hi]
    if not open_:
        return found
    for rows, scores, threshold in block.met(anchor):
        other = block.labels[rows] != label
        ids, scores = block.ids[rows[other]], scores[other]
        for i in open_:
            lo, hi = windows[i]
            fits = (scores >= lo) & (scores <= hi)
            found[i] = _merge(found[i], scores[fits], ids[fits], k)
        if threshold is None:
            break
        open_ = [
            i for i in open_ if (found[i][0][-1] if len(found[i][0]) == k else windows[i][0]) <= threshold
        ]
        if not open_:
            break
    return found


def window(positive_score: int, least: int = LEAST) -> tuple[int, int]:
    """Smallest and largest score of a negative; empty (the first larger) for a negative score."""
    return -((-least * positive_score) // 100), positive_score


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part: labels changed, components as integers."""
    usable = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return (
        columns(embeddings, "vec_id", "embedding", "label")
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .filter(usable)
        .selectExpr(
            "CAST(vec_id AS BIGINT) AS vec_id",
            "CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1L) % 10 ELSE label END AS BIGINT) AS label",
            f"transform(embedding, x -> CAST(floor({SCALE}D * CAST(x AS DOUBLE)) AS BIGINT)) AS v",
        )
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of a partition's rows, apart by the length of their vectors."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def made(parts: list) -> Block:
        return Block.of(*[np.concatenate([p[i] for p in parts]) for i in range(3)])

    for batch in batches:
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        sizes, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            values = flat[ends[rows][:, None] + np.arange(size)]
            parts = held.setdefault(size, [])
            for lo in range(0, len(rows), BLOCK_ROWS):
                at = slice(lo, lo + BLOCK_ROWS)
                parts.append((ids[rows[at]], labels[rows[at]], values[at]))
                if sum(len(p[0]) for p in parts) >= BLOCK_ROWS:
                    yield made(parts)
                    parts.clear()
    for parts in held.values():
        if parts:
            yield made(parts)


#: An anchor in a chunk: its id, label and vector, and for negatives its positives as (id, score).
Anchor = tuple[int, int, np.ndarray, list[tuple[int, int]]]


def _positives_in(anchors: list[Anchor], k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_NONE] * len(anchors.value)
        for block in _blocks(batches):
            for i, (own, label, v, _) in enumerate(anchors.value):
                if len(v) == block.values.shape[1]:
                    found[i] = best_positives(block, v, own, label, found[i], k)
        yield from _rows([(i, f) for i, f in enumerate(found)], ["a"])

    return run


def _negatives_in(anchors: list[Anchor], least: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = [[window(s, least) for _, s in positives] for *_, positives in anchors.value]
        found = [[_NONE] * len(w) for w in windows]
        for block in _blocks(batches):
            for i, (_, label, v, _) in enumerate(anchors.value):
                if len(v) == block.values.shape[1]:
                    found[i] = best_negatives(block, v, label, windows[i], found[i], k)
        yield from _rows([((i, j), f) for i, fs in enumerate(found) for j, f in enumerate(fs)], ["a", "p"])

    return run


def _rows(found: list[tuple], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Found rows as batches: the keys, then ``score`` and ``id``."""
    for lo in range(0, len(found), 1 << 14):
        part = [(k if isinstance(k, tuple) else (k,), f) for k, f in found[lo : lo + (1 << 14)] if len(f[0])]
        if not part:
            continue
        sizes = [len(f[0]) for _, f in part]
        made = [np.repeat(np.array([k[i] for k, _ in part], dtype=np.int64), sizes) for i in range(len(keys))]
        made += [np.concatenate([f[i] for _, f in part]) for i in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=[*keys, "score", "id"])


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per key the first ``k`` different (score, id) of all partitions, numbered ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` and ``anchors`` hold ``(vec_id, label, v)`` of integers. An anchor is compared with the
    rows whose vectors have its length, never with rows of its own id. Rows that share id, label and score
    count once; anchors that share an id but differ in label or vector have rows each. An anchor without
    positives, and a positive without negatives in its window, have no rows; empty tables give none.
    """
    spark = vectors.sparkSession
    held = store(vectors, "vectors")
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-held.count() // PARTITION_ROWS))
    dealt = store(held.repartition(parts, F.xxhash64("vec_id", "v")), "vector-blocks")
    chosen = store(anchors.dropDuplicates(["vec_id", "label", "v"]), "anchors")
    n, longest = chosen.agg(F.count("*"), F.max(F.size("v"))).first()
    made = []
    per_chunk = max(1, ANCHOR_BYTES // (8 * max(1, longest or 1)))
    # chunks are ranges of a hash; the hash covers the whole row, so equal ids do not gather in one
    n_chunks = -(-n // per_chunk)
    place = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(max(1, n_chunks)))
    for c in range(n_chunks):
        rows = chosen.filter(place == c).orderBy("vec_id", "label", "v").toArrow().to_pylist()
        chunk: list[Anchor] = [(r["vec_id"], r["label"], np.array(r["v"], dtype=np.int64), []) for r in rows]
        shared = spark.sparkContext.broadcast(chunk)
        near = dealt.mapInArrow(_positives_in(shared, positives), "a long, score long, id long")
        for r in _first(near, ["a"], positives).orderBy("a", "rank").toArrow().to_pylist():
            chunk[r["a"]][3].append((r["id"], r["score"]))
        windows = spark.sparkContext.broadcast(chunk)
        hard = dealt.mapInArrow(_negatives_in(windows, least, negatives), "a long, p long, score long, id long")
        names = spark.createDataFrame(
            [(a, p, own, *pos) for a, (own, _, _, all_) in enumerate(chunk) for p, pos in enumerate(all_)],
            "a long, p long, anchor_id long, positive_id long, positive_score long",
        )
        made.append(
            store(
                _first(hard, ["a", "p"], negatives)
                .join(F.broadcast(names), ["a", "p"])
                .select(
                    "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score"),
                ),
                "hard-negatives",
            )
        )
        shared.unpersist()
        windows.unpersist()
    if not made:
        return spark.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100, against all vectors.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part.
    Scaled components beyond 64 bits become the largest or smallest such number. Repeated rows count once
    and ties go to the smaller id; see ``mine``. Columns beside the three that are read do no harm.
    """
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"))
    return mine(vectors, vectors.filter("vec_id % 100 = 0"))


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT DISTINCT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON b.vec_id <> a.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
WHERE rank <= 5
"""
