"""SimHash and suffix-array dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from ordstack.llm import graph, simhash, suffix_dedup
from ordstack.llm.queries import QUERIES


def texts_of(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return sorted(tuple(r) for r in rows)


def fingerprint_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def component_of(ids, fps):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(list(zip(ids, fps)), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in ids]


def test_simhash_query(spark):
    docs = texts_of(spark, SMALL)
    fps = [fingerprint_of(t) for _, t in docs]
    want = list(zip([i for i, _ in docs], [f"{x:016x}" for x in fps], component_of([i for i, _ in docs], fps)))
    got = sorted(tuple(r) for r in QUERIES["op10_simhash_near_dedup"](spark, SMALL).collect())
    assert got == want


@pytest.mark.parametrize("most", [2, 48])
def test_links_are_whole_however_full_a_key_is(spark, most):
    draw = random.Random(1)
    fps = {draw.getrandbits(64)}
    while len(fps) < 250:
        x = draw.choice(sorted(fps))
        for _ in range(draw.randint(1, 3)):
            x ^= 1 << draw.randrange(64)
        fps.add(x)
    fps |= {draw.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.u: r.v for r in graph.components(simhash.near_links(df, most)).collect()}
    assert [roots.get(x, x) for x in signed] == component_of(signed, [x % (1 << 64) for x in signed])


ODD = [
    (3, "the cat sat on the mat"), (1, "The CAT sat on the mat"), (2, None), (5, ""), (5, " \n"), (None, "solo text here"),
    (None, "solo text here"), (9, "x"), (9, "x"),
]


def test_simhash_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[3, next(r.fp for r in got if r.doc_id == 1)] == 1
    assert {r.component_id for r in got if r.fp == 0} == {2}
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    kept = simhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 9, None]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_suffix_array():
    draw = random.Random(5)
    for _ in range(300):
        s = np.array([draw.randint(1, draw.choice([1, 2, 4, 250])) for _ in range(draw.randint(0, 60))], dtype=np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    long = np.array([draw.randint(1, 3) for _ in range(5000)], dtype=np.int64)
    assert suffix_dedup.suffix_array(long).tolist() == sorted(range(5000), key=lambda i: long[i:].tolist())


def left_over(docs):
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(x for x, y in zip(data, gone) if not y)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    draw = random.Random(5)
    shared = ["".join(draw.choice("abcdefgh é") for _ in range(draw.choice([90, 130, 260]))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(draw.randint(0, 5)):
            kind = draw.random()
            if kind < 0.45:
                parts.append(draw.choice(shared)[draw.randint(0, 30) :])
            elif kind < 0.6:
                parts.append(draw.choice("xyz") * draw.randint(50, 400))
            elif kind < 0.7:
                parts.append("ab" * draw.randint(20, 150))
            else:
                parts.append("".join(draw.choice("abcdefgh ") for _ in range(draw.randint(1, 200))))
        docs.append((i * 3, "".join(parts)))
    docs += [(1000, None), (1001, ""), (None, docs[5][1] + "zz"), (2, "q" * 99), (4, "q" * 100), (5, "q" * 101)]
    return docs


@pytest.mark.parametrize("limits", [{}, {"sorted_runs": 2}, {"bits": 64}])
def test_removed_bytes(spark, passages, limits, monkeypatch):
    marks = suffix_dedup.marks
    monkeypatch.setattr(suffix_dedup, "marks", lambda df: marks(df, **limits))
    df = spark.createDataFrame(passages, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.dedup_digests(df).collect()), key=str) == left_over(passages)


@pytest.mark.parametrize("limits", [{}, {"bits": 64}])
def test_copies_of_few_runs_do_not_meet_in_one_task(spark, limits, monkeypatch):
    """Two variants of a passage and a repetitive text, each copied very often, and a row repeated as often."""
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(150))
    kinds = ["left one " + passage + " and on", "right two " + passage + " so far", "xyz" * 60]
    docs = [(i, kinds[i % 3]) for i in range(3000)] + [(-1, kinds[0])] * 1000
    sort = suffix_dedup._sort_partition

    def bounded(table):
        if table.num_rows > 300:
            raise ValueError(f"{table.num_rows} runs in one partition")
        return sort(table)

    marks = suffix_dedup.marks
    monkeypatch.setattr(suffix_dedup, "_sort_partition", bounded)
    monkeypatch.setattr(suffix_dedup, "marks", lambda df: marks(df, **limits))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = sorted(map(tuple, suffix_dedup.dedup_digests(df).collect()), key=str)
    want = {row[0]: row for row in left_over(set(docs))}
    assert got == sorted((want[i] for i, _ in docs), key=str)


def test_suffix_query(spark):
    got = sorted(map(tuple, QUERIES["op4_suffix_array_dedup"](spark, MEDIUM).collect()), key=str)
    assert got == left_over(texts_of(spark, MEDIUM))


def test_dedup_keeps_rows_columns_and_characters(spark):
    passage = "éa" * 80
    rows = [(1, passage, 160, "x"), (2, "é" + passage + "z", 162, "y"), (2, "é" + passage + "z", 162, "y"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lo string")
    got = suffix_dedup.dedup(df)
    assert got.columns == df.columns and got.count() == 4
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text is None and by[3].n_chars is None and by[2].lo == "y"
    assert all(r.n_chars == len(r.text) for r in by.values() if r.text is not None)
    assert by[2].text.startswith("é") and by[2].text.endswith("z") and len(by[2].text) < 10
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_runs_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"ab", k=rng.choice([0, 5, 99, 100, 101, 250, 400]))) for _ in range(60)]
    texts += [b"x" * 300, bytes(range(256)) * 2, b"", b"ab" * 120]
    owner, keys, first, sizes, several = suffix_dedup.runs_of(texts)
    got = list(zip(owner.tolist(), keys.tolist(), first.tolist(), sizes.tolist(), several.tolist()))
    want = []
    for i, x in enumerate(texts):
        want += [(i, *r) for r in zip(*(c.tolist() for c in suffix_dedup.runs(x)))]
    assert got == want
    # every window lies in one run of one step
    for size in (64, 150, 1 << 18):
        met = []
        for text, begin, pieces in suffix_dedup.text_steps(texts, size):
            o, _, f, n, _ = suffix_dedup.runs_of(pieces)
            for a, b, m in zip(text[o].tolist(), (f + begin[o]).tolist(), n.tolist()):
                met += [(a, w) for w in range(b, b + m)]
        assert sorted(met) == [(i, w) for i, x in enumerate(texts) for w in range(len(x) - 99)]


def test_clashing_names_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 500)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    rows = [(1, "p " + passage, "x"), (2, passage + " q" + passage, "y"), (None, None, "z"), (3, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    df = df.withColumns({"_key": F.lit(1), "_ranges": F.lit(2), "ranges": F.lit(3), "run": F.lit(4), "h": F.lit(5)})
    got = suffix_dedup.dedup(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "p " + passage, 2: " q", 3: "", None: None}
