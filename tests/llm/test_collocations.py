"""Collocations against counting everything, whatever the sample, the step and the bitmap."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ordstack.llm import collocations as c
from ordstack.llm.corpus import ship

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=c.TOP):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang or "und", tuple(words[i : i + m])] += 1
    f = {k: n for k, n in counts.items() if n >= least}
    inside = {}
    for (lang, p), n in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = lang, p[i : i + k]
                inside[key] = max(inside.get(key, 0), n)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or 100 * inside.get((lang, p), 0) >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((int(Fraction(1000 * a * totals[lang], l * r)), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(p), a, l, r, totals[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, seen = [], Counter()
    for lang, *rest in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], *rest))
    return ranked


def rows_of(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Éa", "x y", "B"]
    phrases = [[rng.choice(words) for _ in range(rng.randint(2, 6))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 14)):
            parts += rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(words)]
            if rng.random() < 0.25:
                parts.append(rng.choice([".", ", ", " ; ", "\n", "\t", "!?", "  "]))
        rows.append((i, " ".join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    same = "the hot passage. the hot passage of many copies"
    return rows + [(900, None, "en"), (901, "", None), (None, same, "en")] + [(902, same, "en")] * 30


def got_of(df):
    out = [tuple(r[x] for x in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()]
    return sorted(out, key=lambda x: (x[0], x[1]))


SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("sampling", [{}, {"sample": 1, "lowered": 1.0}, {"sample": 1000}, {"sample": 3, "size": 40}])
def test_equals_counting_everything(spark, sampling):
    ship(spark)
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs = docs.withColumn("phrase", F.lit("z")).withColumn("n", F.lit(1)).withColumn("words", F.lit(2))
    assert got_of(c.collocations(docs, least=6, **sampling)) == brute(rows, 6)


def test_a_full_bitmap_only_counts_more(spark):
    ship(spark)
    rows = rows_of(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got_of(c.collocations(docs, 5, bits=8)) == brute(rows, 5)


def test_top_and_ties(spark):
    ship(spark)
    rows = rows_of(80, 9)
    assert got_of(c.collocations(spark.createDataFrame(rows, SCHEMA), 4, top=3)) == brute(rows, 4, 3)


def test_one_long_text_is_counted_whole(spark):
    ship(spark)
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    text = " ".join(rng.choice(words) for _ in range(4000))
    rows = [(1, text, "en"), (2, "y" * 5000 + " z", "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got_of(c.collocations(docs, least=5, size=512)) == brute(rows, 5)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_exact_beyond_64_bits(spark):
    big = 10**12
    rows = [("en", "", 0, 7 * 10**15), ("en", "a", 1, 3 * big + 1), ("en", "b", 1, 2 * big + 7), ("en", "a b", 2, big)]
    got = c.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).first()
    assert got["score"] == 1000 * big * 7 * 10**15 // ((3 * big + 1) * (2 * big + 7))
