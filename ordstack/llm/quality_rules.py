"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Every rule rejects a document whose value lies above a cutoff. For each stratum and rule the cutoff is
the strictest of a fixed sequence for which an exact binomial test still rules out, on the labelled
good documents of the stratum, that more than a share ``alpha`` of good documents is rejected. The
sequence is tested from the loosest cutoff on and stops at the first that fails, so it needs no
correction of its own; strata and rules share the error ``delta``, and rules share ``alpha``.

DataFrame operations only: measures come from one pass over the texts without a shuffle, and the tests
run on one row per stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordstack.llm.corpus import SPACE, WORD, bound, columns, read, text_of
from ordstack.session import store

#: Rule: its measure, and its cutoffs from the loosest to the strictest. Fixed before any label is seen.
RULES = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1),
    "repeat_share": (0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
}
#: Good documents that may be rejected, and the chance that a stratum loses more.
ALPHA = 0.05
DELTA = 0.05
REPEAT_WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the same text.

    Windows are told apart by 64-bit hashes. Only texts with a repeated window are sorted.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            hit = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda t: (F.get(s, t)["h"] == F.get(s, t + 1)["h"]).eqNullSafe(True)
                | (F.get(s, t)["h"] == F.get(s, t - 1)["h"]).eqNullSafe(True),
            )
            return F.sort_array(F.transform(hit, lambda t: F.get(s, t)["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, t: F.least(F.coalesce(F.get(p, t + 1) - x, F.lit(width)), F.lit(width)))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, bound(bound(ordered, places), total)).otherwise(0)

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))
    )
    return F.when(F.size(words) > width, bound(windows, covered)).otherwise(0)


def measures(df: DataFrame) -> DataFrame:
    """``df`` without its text, with MEASURES (all long; 0 for a null text). Equal names are replaced."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    made = bound(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    return (
        df.drop(*MEASURES)
        .withColumns({
            "_w": made,
            "word_chars": (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        })
        .withColumns({"n_words": F.col("_w.n").cast("long"), "n_repeat_words": F.col("_w.r").cast("long")})
        .drop("_w", "text")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def value(rule: str) -> Column:
    """Measure of a rule; 0 without words."""
    top = {"symbols_per_word": "n_symbols", "repeat_share": "n_repeat_words"}[rule]
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col("n_words")), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p), summed exactly downward from the term of k; 1 where k >= n p,
    which no test at a level below one half can pass anyway."""
    log_term = (
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
            F.lit(0.0),
            lambda a, i: a + F.when(k > 0, F.log((n - i + 1) / i)).otherwise(0.0),
        )
        + k * math.log(p)
        + (n - k) * math.log1p(-p)
    )
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def down(a: Column, j: Column) -> Column:
        i = k - j  # from term i + 1 to term i
        t = F.when(i >= 0, a["t"] * (i + 1) / (n - i) * odds).otherwise(0.0)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), start, down)["s"]
    return F.when(k >= n * p, 1.0).otherwise(F.exp(log_term) * total)


def cutoffs(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, n_good, <rule>...)``: cutoff of each rule per stratum; null where none can be
    guaranteed. ``good`` has a row per labelled good document: the stratum and the rules' values.

    A null stratum is one of its own. No labels, no rows.
    """
    counts = [F.count("*").alias("n_good")]
    for rule, grid in RULES.items():
        counts += [F.count_if(F.col(rule) > c).alias(f"{rule}_{i}") for i, c in enumerate(grid)]
    per_stratum = store(good.groupBy(F.col(stratum).alias("stratum")).agg(*counts), "holdout")
    n_tests = per_stratum.count() * len(RULES)
    chosen = []
    for rule, grid in RULES.items():
        best = F.lit(None).cast("double")
        for i, c in enumerate(grid):  # counts rise along the sequence, so those that pass come first
            p = binomial_tail(F.col(f"{rule}_{i}"), F.col("n_good"), alpha / len(RULES))
            best = F.when(p <= delta / max(n_tests, 1), c).otherwise(best)
        chosen.append(best.alias(rule))
    return store(per_stratum.select("stratum", "n_good", *chosen), "cutoffs")


def judge(measured: DataFrame, stratum: str, cuts: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; a stratum without a cutoff loses nothing."""
    named = cuts.select(
        F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES]
    )
    few = named.limit(1025).count() <= 1024
    joined = measured.join(F.broadcast(named) if few else named, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    passes = F.lit(True)
    for rule in RULES:
        passes = passes & F.coalesce(value(rule) <= F.col(f"_{rule}"), F.lit(True))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & passes)
        .drop("_stratum", *[f"_{r}" for r in RULES])
    )


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document. Strata are the values of ``lang``; good documents are
    those labelled with quality 1 that pass the base rules. A document labelled twice counts once per
    row of ``documents``."""
    measured = store(measures(columns(read(spark, sf_dir), "doc_id", "text", "lang")), "measures")
    labels = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    good = measured.filter(~base_failed()).join(labels, "doc_id", "left_semi")
    cuts = cutoffs(good.select("lang", *[value(r).alias(r) for r in RULES]), "lang")
    return judge(measured, "lang", cuts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rule_sql(rule: str, top: str) -> str:
    """Cutoff per stratum: the strictest one whose exact binomial tail passes."""
    grid = ", ".join(map(str, RULES[rule]))
    a = ALPHA / len(RULES)
    return f"""{rule}_n AS (SELECT lang, c, count(*) AS n, CAST(count(*) FILTER (WHERE {top} / n_words > c) AS BIGINT) AS k
    FROM good, (SELECT CAST(unnest([{grid}]) AS DOUBLE) AS c) GROUP BY lang, c),
{rule}_c AS (SELECT lang, min(c) AS c FROM {rule}_n, tests
    WHERE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1)
      - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln({1 - a})))) <= {DELTA} / m GROUP BY lang)"""


OP8_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT id, i, array_to_string(ws[i:i + 7], ' ') AS s
    FROM (SELECT id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
r AS (SELECT id, i FROM g QUALIFY count(*) OVER (PARTITION BY id, s) > 1),
c AS (SELECT id, sum(step) AS n_repeat_words FROM (SELECT id,
    least(8, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 8)) AS step FROM r) GROUP BY id),
x AS (SELECT id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT d.id, d.doc_id, d.lang, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN w USING (id) JOIN x USING (id) LEFT JOIN c USING (id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS (SELECT count(*) * {len(RULES)} AS m FROM (SELECT DISTINCT lang FROM good)),
{_rule_sql("symbols_per_word", "n_symbols")},
{_rule_sql("repeat_share", "n_repeat_words")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(n_symbols / n_words <= s.c, TRUE) AND coalesce(n_repeat_words / n_words <= p.c, TRUE) AS kept
FROM b LEFT JOIN symbols_per_word_c s ON b.lang IS NOT DISTINCT FROM s.lang
LEFT JOIN repeat_share_c p ON b.lang IS NOT DISTINCT FROM p.lang"""
