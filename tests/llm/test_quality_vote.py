"""Quality voting: held-out accuracy, exact neighbours, and inputs that must do no harm."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ordstack.llm import quality_vote as q
from ordstack.llm.corpus import columns, read, ship

MEDIUM_TENTH = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    made = q.op11_quality_vote(spark, MEDIUM_TENTH)
    assert made.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = read(spark, MEDIUM_TENTH, "labels").select("doc_id", "quality")
    unseen = made.filter("held_out").join(labels, "doc_id")
    by = {r["quality"]: r for r in unseen.groupBy("quality").agg(F.count("*").alias("n"), F.avg("predicted").alias("p")).collect()}
    assert by[1]["p"] > 0.98 and by[0]["p"] < 0.15, by
    bounds = made.agg(F.min("score"), F.max("score"), F.count("score"), F.count("*")).first()
    assert 0 <= bounds[0] and bounds[1] <= 1 and bounds[2] == bounds[3] == read(spark, MEDIUM_TENTH).count()


def _voters(n=200, seed=5):
    rng = np.random.default_rng(seed)
    vectors = q.unit(rng.standard_normal((n, q.WIDTH))).astype(np.float32)
    basis = rng.standard_normal((q.TERMS, q.WIDTH)).astype(np.float32)
    return q.Voters(np.ones(q.TERMS), basis, vectors, rng.integers(0, 2, n).astype(float))


def test_votes_are_those_of_the_nearest():
    voters, codes = _voters(), q.Codes()
    found = [q.terms(t, codes) for t in ("some words here", "ANOTHER text!! with 12 words", "x")] * 250
    got = voters.scores(found)
    for i in (0, 1, 2, 749):
        v = voters.embed([found[i]])[0].astype(np.float64)
        cosines = voters.vectors.astype(np.float64) @ v
        near = np.argsort(-cosines)[: q.NEIGHBOURS]
        votes = np.clip(cosines[near], 0, 1) ** q.POWER
        want = ((votes * voters.labels[near]).sum() + q.PRIOR * voters.labels.mean()) / (votes.sum() + q.PRIOR)
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_steps_do_not_change_terms(monkeypatch):
    text = "One two two THREE!!\nsame line here\nsame line here\n" * 40 + "é" * 300 + " end"
    whole = q.terms(text, q.Codes())
    monkeypatch.setattr(q, "STEP_BYTES", 64)
    cut = q.terms(text, q.Codes())
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_basis_spans_the_best_space():
    rng = np.random.default_rng(2)
    left, right = rng.standard_normal((60, 4)), rng.standard_normal((4, 80))
    dense = left @ right + 0.001 * rng.standard_normal((60, 80))
    rows = [(np.arange(80), r) for r in dense]
    basis = q.basis_of(rows, 4)[:80].astype(np.float64)
    exact = np.linalg.svd(dense, full_matrices=False)[2][:4].T
    assert np.linalg.norm(basis @ basis.T - exact @ exact.T) < 1e-2


def test_nulls_ties_and_other_columns(spark):
    ship(spark)
    long = "the words of a very long text\n" * 60_000
    rows = [(i, ("good words of plain text " if i % 2 else "BAD!! BAD!! BAD!! ") * 5, i) for i in range(40)]
    rows += [(None, "good words of plain text", 1), (50, None, 1), (51, "", 1), (52, "", 2), (52, "", 2), (53, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    docs = docs.withColumn("at", F.lit("x")).withColumn("quality", F.lit(7))
    marks = [(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (4, None), (5, 9), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int").withColumn("text", F.lit("y"))
    voters = q.fit(docs, labels)
    assert len(voters.labels) == 40
    got = q.scored(docs, voters).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 40:
            assert (r["score"] > 0.7) == bool(r["doc_id"] % 2)
    empties = {r["score"] for r in got if r["doc_id"] in (50, 51, 52)}
    assert len(empties) == 1
    none = q.fit(docs, labels.limit(0))
    assert {r["score"] for r in q.scored(docs, none).collect()} == {0.0}
    assert q.scored(columns(docs, "doc_id", "text").limit(0), voters).count() == 0


def test_the_sample_is_bounded(spark):
    ship(spark)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    again = docs.union(docs.filter("doc_id = 7")).union(docs.filter("doc_id = 7"))
    assert len(q.fit(again, labels, 50).labels) == 50


def test_small_query(spark):
    made = q.op11_quality_vote(spark, SMALL)
    assert made.count() == read(spark, SMALL).count()
