"""The pipeline's near-duplicate stage against brute force."""

import itertools
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ordstack.llm import near_dedup
from ordstack.llm.corpus import read


def shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def alike(a, b):
    x, y = shingles_of(a), shingles_of(b)
    return len(x & y) >= 0.8 * len(x | y)


def edited(draw, words, n):
    out = list(words)
    for i in draw.sample(range(len(out)), n):
        out[i] = f"edit{draw.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Groups of edited copies, one of them large, and other texts."""
    draw = random.Random(3)
    docs = []
    for g in range(40):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(150, 300))]
        for _ in range(120 if g == 0 else draw.randint(1, 4)):
            docs.append(" ".join(edited(draw, base, draw.choice([0, 0, 1, 2, 3, 6, 12]))))
    docs += [None, "", " ", "one two", "One  two", "three"]
    draw.shuffle(docs)
    return list(enumerate(docs))


_kept = {}


@pytest.mark.parametrize("rounds, block", [(0, 256), (0, 7), (3, 256), (3, 5)])
def test_edited_copies_go(spark, corpus, rounds, block):
    text = dict(corpus)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near_dedup.keep_one(df, rounds=rounds, block=block).collect()}
    assert not [(i, j) for i, j in itertools.combinations(sorted(kept), 2) if alike(text[i], text[j])]
    # what goes is alike, over others perhaps, to a smaller id that stays
    group = {i: i for i in text}
    for i, j in itertools.combinations(sorted(text), 2):
        if group[i] != group[j] and alike(text[i], text[j]):
            lo, hi = sorted((group[i], group[j]))
            group = {k: lo if v == hi else v for k, v in group.items()}
    assert {group[i] for i in text} <= kept
    # how pairs are dealt out changes nothing
    assert _kept.setdefault(rounds, kept) == kept


def test_other_columns_ties_and_repeated_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (1, "z y x w v u", "x", 1), (None, "q r s", "y", 2),
            (None, "q r s", "y", 2), (2, long, "z", 3), (3, long + " end", "z", 4), (4, None, "n", 5), (5, "", "n", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, rank long").withColumn("_key", F.lit("k"))
    df = df.withColumns({"sh": F.lit(0), "at": F.lit(0), "th": F.lit(0), "n": F.lit(0), "key_": F.lit(0)})
    got = near_dedup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.key, r.rank) for r in got.collect()) == [
        ("1", "x", 1), ("1", "x", 1), ("2", "z", 3), ("4", "n", 5), ("None", "y", 2),
    ]


def test_recall_on_documents(spark):
    """Of the pairs of different texts at 0.8 or more, none stays together."""
    docs = read(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    kept = {r.doc_id: shingles_of(r.text) for r in near_dedup.keep_one(docs).collect()}
    holders = {}
    for i, s in kept.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter()
    for who in holders.values():
        if len(who) < 400:
            shared.update(itertools.combinations(sorted(who), 2))
    near = [p for p, n in shared.items() if n >= 0.8 * (len(kept[p[0]]) + len(kept[p[1]]) - n)]
    assert near == []


def test_stage_drops_a_copy_with_one_edited_sentence(spark):
    draw = random.Random(4)
    base = [f"w{draw.randrange(5000)}" for _ in range(300)]
    other = base[:150] + [f"new{i}" for i in range(10)] + base[160:]
    rows = [(2, " ".join(base), "en", "web", 1), (1, " ".join(other), "en", "web", 1), (None, "x y z", "en", "web", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, None]
    assert corpus_pipeline.simhash_near_dedup(spark, df.limit(0), "").count() == 0
