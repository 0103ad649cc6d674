"""Hard negatives against scoring everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordstack.llm import hard_negatives as h
from ordstack.llm.corpus import ship

SCHEMA = "vec_id long, embedding array<float>, label int"


def integers(rows):
    out = set()
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None:
            continue
        if any(v is None or not np.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        out.add((vec_id, label, tuple(int(np.floor(256 * float(np.float32(v)))) for v in x)))
    return out


def brute(rows):
    vectors, made = integers(rows), []
    for own, label, v in sorted(x for x in vectors if x[0] % 100 == 0):
        scored = {
            (-sum(a * b for a, b in zip(v, w)), i, same == label)
            for i, same, w in vectors
            if i != own and len(w) == len(v)
        }
        for minus, i, _ in sorted(x for x in scored if x[2])[:5]:
            ok = sorted(x for x in scored if not x[2] and -80 * minus <= -100 * x[0] <= -100 * minus)
            made += [(own, i, r, j, -minus, -s) for r, (s, j, _) in enumerate(ok[:5], 1)]
    return sorted(made)


def rows_of(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, d))
    return [
        (i, (centres[i % 4] + spread * rng.standard_normal(d)).round(2).tolist(), int(rng.integers(0, 3)))
        for i in range(n)
    ]


def got_of(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[x] for x in names) for r in df.collect())


def run(spark, rows):
    ship(spark)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("x")).withColumn("score", F.lit(1))
    vectors = h.integer_vectors(df)
    return got_of(h.mine(vectors, vectors.filter("vec_id % 100 = 0")))


@pytest.mark.parametrize("block, chunk, first", [(1 << 16, 16 << 20, 8), (37, 200, 1)])
def test_equals_scoring_everything(spark, monkeypatch, block, chunk, first):
    monkeypatch.setattr(h, "BLOCK_ROWS", block)
    monkeypatch.setattr(h, "ANCHOR_BYTES", chunk)
    monkeypatch.setattr(h, "FIRST_DEPTH", first)
    rows = rows_of(700, 5, 1)
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_ties_nulls_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist(), int(i % 2)) for i in range(400)]
    rows += rows[:120] + [rows[200]] * 50
    rows += [(100, [1.0, 1.0, 2.0], 1), (300, [9.0, 1.0], 0), (301, [8.0, 1.0], 0), (302, [7.5, 1.0], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (500, None, 1), (501, [1.0, 1.0, 1.0], None), (502, [1.0, None, 1.0], 1)]
    rows += [(503, [float("nan"), 0.0, 1.0], 1), (504, [float("inf"), 0.0, 1.0], 0), (600, [0.0, 0.0, 0.0], 1), (700, [], 0)]
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**38 + 2**20 * (i % 5)), float(2**14 * i), -1.0], i % 2) for i in range(120)]
    want = [r for r in brute(rows)]
    if all(abs(x) < 2**63 for r in want for x in r):
        assert run(spark, rows) == want


def test_empty_table(spark):
    assert run(spark, []) == []


def test_search_stops_early_on_clustered_vectors():
    """Sorted access ends before all rows are met where the lists tell the rows apart."""
    rng = np.random.default_rng(0)
    n = 4000
    values = np.concatenate([rng.integers(200, 256, (40, 4)), rng.integers(0, 20, (n - 40, 4))]).astype(np.int64)
    block = h.Block.of(np.arange(n), np.zeros(n, dtype=np.int64), values)
    met = 0
    for rows, scores, threshold in block.met(values[0]):
        met += len(rows)
        if threshold is not None and np.partition(scores, -5)[-5] > threshold:
            break
    assert met < n / 2
