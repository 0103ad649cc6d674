"""Numbering, order statistics and assignment against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from ordstack.constants import RATING_COUNTS
from ordstack.operators import metric, ordering


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    return [round(rng.uniform(0, 20), 2) for _ in range(1500)] + [4.25] * 700  # one hot value


@pytest.fixture(scope="module")
def df(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id bigint, p double").repartition(5)


def test_sum_before(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    d = spark.createDataFrame(rows, "o bigint, w bigint").repartition(4)
    got = {r.o: r._before for r in ordering.with_sum_before(d, ["o"], "w").collect()}
    total, want = 0, {}
    for o, w in sorted(rows):
        want[o] = total
        total += w
    assert got == want


def test_numbering_within_groups(spark):
    data = [(g, (i * 37) % 211 + g * 1000) for g in range(3) for i in range(40 + g)]
    d = spark.createDataFrame(data, "g int, o bigint").repartition(3)
    out = ordering.number_within(d, "g", "o", "n").collect()
    for g in range(3):
        mine = sorted((r.o, r.n) for r in out if r.g == g)
        assert [n for _, n in mine] == list(range(1, 41 + g))


def test_order_stats(df, values):
    ranked = sorted(values)
    want = {i: ranked[i] for i in (0, 5, 600, 1000, len(values) - 1)}
    got = {r.position: r.value for r in ordering.order_stats(df, "p", list(want)).collect()}
    assert got == want


@pytest.mark.parametrize(
    "data",
    [[5.0], [2.0] * 9, [0.0, -0.0, 1e300, -1e300], [1.0, float("inf"), 2.0], [1e-9, 2e-9, 1e9, 3.0]],
)
def test_order_stats_of_odd_ranges(spark, data):
    d = spark.createDataFrame([(v,) for v in [*data, None]], "p double")
    got = {r.position: r.value for r in ordering.order_stats(d, "p", range(len(data))).collect()}
    assert got == dict(enumerate(sorted(data)))


def test_top_class_without_share(df):
    with pytest.raises(ValueError, match="top class"):
        ordering.share_thresholds(df, "p", (1, 1, 0))


def test_assignment(df, values):
    ranked, total = sorted(values), float(sum(RATING_COUNTS))
    thresholds, reached = [], 0
    for k in RATING_COUNTS[:-1]:
        reached += k
        thresholds.append(ranked[int(reached / total * len(ranked))])
    got = {r.row_id: r.rating for r in ordering.assign_by_shares(df, "p").collect()}
    assert got == {i: bisect.bisect_right(thresholds, v) for i, v in enumerate(values)}


def test_kappa_by_definition(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 9), rng.uniform(-1, 12)) for _ in range(400)]
    d = spark.createDataFrame(pairs, "y int, p double")
    rated = [(y, min(max(round(p), 0), 20)) for y, p in pairs]
    n = len(rated)
    observed = sum((y - q) ** 2 for y, q in rated)
    expected = sum((y - q) ** 2 for y, _ in rated for _, q in rated) / n
    assert metric.qwk(d, "y", "p").first().kappa == pytest.approx(1 - observed / expected, abs=1e-12)


def test_kappa_properties(spark):
    d = spark.range(50).select((F.col("id") % 7).cast("int").alias("y"), (F.col("id") % 5).cast("double").alias("p"))
    assert metric.qwk(d, "y", "y").first().kappa == 1.0
    a, b = metric.qwk(d, "y", "p").first().kappa, metric.qwk(d, "p", "y").first().kappa
    assert a == pytest.approx(b) and a <= 1
    same = d.select(F.lit(3).alias("y"), F.lit(3.0).alias("p"))
    assert metric.qwk(same, "y", "p").first().kappa is None


def test_importance(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "name string, gain double")
    assert [tuple(r) for r in ordering.importance(d).collect()] == [("b", 0.75), ("a", 0.25)]
