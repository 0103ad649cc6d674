"""Mixing, order MinHash and quality rules against plain Python."""

import hashlib
import random

import oracle
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from ordstack.llm import mixing, order_minhash, quality_rules
from ordstack.llm.queries import QUERIES, SQL

ROWS = [
    (1, None, None), (2, "a", "x y z"), (3, "a", ""), (4, "b", "w " * 1000), (4, "b", "w " * 1000),
    (None, "c", "q"), (7, "b", "one two three\nfour\tfive six seven eight nine ten"),
]


def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    return made.withColumns({"target": F.lit("z"), "n_words": F.lit("z"), "lang": F.lit(None).cast("string")})


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_matches_sql(spark, name, sf):
    assert oracle.differences(QUERIES[name](spark, sf), oracle.connect(sf), SQL[name]) == []


def water_filled(sizes, weights):
    total, bound = 1.5 * sum(sizes), [2.0 * x for x in sizes]
    got, fixed = [0.0] * len(sizes), set()
    while len(fixed) < len(sizes):
        rest = total - sum(bound[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        for i in free:
            got[i] = rest * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if got[i] > bound[i] + 1e-9]
        if not over:
            break
        for i in over:
            got[i] = bound[i]
            fixed.add(i)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_targets_reshare_what_sources_may_not_take(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 1, 5, 100, 1000, 100_000]) for _ in range(draw.randint(2, 9))] + [7]
    df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.targets(df).orderBy("rank").collect()]
    assert got == pytest.approx(water_filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_mix_of_odd_rows(spark):
    got = {(r.doc_id, r.source): r for r in mixing.mix(docs(spark)).collect()}
    assert (got[1, None].taken, got[1, None].copies) == (0, 1)
    assert (got[None, "c"].taken, got[None, "c"].source_size) == (2, 1)
    assert all(0 <= p <= 1 and list(r.progress) == sorted(r.progress) for r in got.values() for p in r.progress)
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    assert sum(r.copies for r in mixing.mix(docs(spark)).collect()) == mixing.in_training_order(docs(spark)).count()


def test_other_columns_go_along_whatever_their_names(spark):
    names = ("rank", "_at", "_bin", "due", "size", "progress", "others", "copies")
    df = docs(spark).withColumns({c: F.lit(c) for c in names})
    made = mixing.in_training_order(df)
    assert made.columns == df.columns
    assert {r[c] for r in made.collect() for c in names} == set(names)
    assert made.count() == mixing.in_training_order(docs(spark)).count()


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))])
def test_position_inverts_the_integrated_schedule(spark, schedule):
    def demand(u):
        total, at = 0.0, 0.0
        for (u0, w0), (u1, w1) in zip(schedule, schedule[1:]):
            total += (w0 + w1) / 2 * (u1 - u0)
            x = min(max(u - u0, 0), u1 - u0)
            at += w0 * x + (w1 - w0) / (u1 - u0) * x * x / 2
        return at / total

    df = spark.range(0, 101).withColumn("d", F.col("id") / 100)
    rows = df.withColumn("u", mixing.position(F.col("d"), F.lit(1), (schedule,))).collect()
    assert all(demand(r.u) == pytest.approx(r.d, abs=1e-7) for r in rows)


def signature_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    out = df.select("i", order_minhash.signature(F.coalesce("text", F.lit(""))).alias("s")).orderBy("i").collect()
    hashes = df.select("i", order_minhash.kmers(F.coalesce("text", F.lit(""))).alias("h")).orderBy("i").collect()
    return [r.s for r in out], [r.h for r in hashes]


def test_signature_against_its_definition(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.choice(words[: draw.randint(1, 40)]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 30, 400)]
    texts += ["a b c d e f " * 30, None, texts[-1]]
    got, hashes = signature_of(spark, texts)
    numbered = {}

    def xx(*values):
        if values not in numbered:
            args = ", ".join(f"CAST({v} AS {'INT' if i and len(values) == 2 else 'BIGINT'})" for i, v in enumerate(values))
            numbered[values] = spark.sql(f"SELECT xxhash64({args})").first()[0]
        return numbered[values]

    arc = 2**64 // order_minhash.COMPONENTS
    low = (1 << order_minhash.POSITION_BITS) - 1
    for sig, h in zip(got, hashes):
        assert len(sig) == order_minhash.COMPONENTS and all(0 <= x < 65536 for x in sig)
        if len(h) < 8:
            continue
        seen, occ = {}, []
        for x in h:
            n = seen[x] = seen.get(x, 0) + 1
            occ.append(x if n == 1 else xx(x, n - 1))
        order = sorted((x & ~low | i) for i, x in enumerate(occ))
        for j in (0, 17, 63):
            start = -(2**63) + j * arc
            chosen = sorted(order, key=lambda x: ((x & ~low) - start) % 2**64)[: order_minhash.SELECTED]
            at = sorted(x & low for x in chosen)
            array = ", ".join(f"CAST({occ[p]} AS BIGINT)" for p in at)
            assert spark.sql(f"SELECT xxhash64(array({array})) & 65535").first()[0] == sig[j]
    assert got[-3] == got[-3] and got[-1] == got[-4] and got[-2] == got[0]


def test_next_document_wraps_and_ties(spark):
    rows = [(i * 7 % 900 if i % 50 else None, f"t{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, text string")
    for size in (50, 10_000):
        made = order_minhash.with_next(df, "k", ["text"], size).collect()
        follows = {r.text: r.next_text for r in made}
        at, seen = "t1", []
        while at not in seen:
            seen.append(at)
            at = follows[at]
        assert len(seen) == len(rows) == len(made)
        keys = {t: 10**9 if k is None else k for k, t in rows}
        assert sum(keys[b] < keys[a] for a, b in follows.items()) == 1
    alone = order_minhash.with_next(df.limit(1), "k", ["text"]).first()
    assert alone.next_text == alone.text
    assert order_minhash.with_next(df.limit(0), "k", ["text"]).count() == 0


def test_order_minhash_query(spark):
    got = {r.doc_id: r for r in QUERIES["op5_order_minhash"](spark, SMALL).collect()}
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    for (a, text), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())


def test_measures_of_odd_rows(spark):
    got = [r.n_words for r in quality_rules.measures(docs(spark)).orderBy("doc_id").collect()]
    assert sorted(got) == [0, 0, 1, 3, 10, 1000, 1000]
    cuts = quality_rules.cutoffs(spark.createDataFrame([], "lang string, symbols_per_word double, repeat_share double"), "lang")
    judged = quality_rules.judge(quality_rules.measures(docs(spark)), "lang", cuts)
    assert judged.filter("kept").count() == 0 and judged.count() == len(ROWS)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(k, n) for n in (1, 10, 200) for k in (0, 1, 3, 7) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        want = sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(want if r.k < 0.05 * r.n else 1.0, rel=1e-9)


def test_cutoffs_keep_the_promise_and_use_it(spark):
    good = [("x", 0.0, 0.0)] * 990 + [("x", 0.6, 0.0)] * 10 + [("few", 5.0, 0.0)] * 30
    df = spark.createDataFrame(good, "lang string, symbols_per_word double, repeat_share double")
    cuts = {r.stratum: r for r in quality_rules.cutoffs(df, "lang").collect()}
    assert cuts["x"].symbols_per_word == 0.1  # 10 of 1,000 are rejected, which the test allows
    assert cuts["few"].symbols_per_word is None and cuts["few"].repeat_share is None
