"""Hand-made cases of the row-wise columns."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordstack.constants import DEFAULT_CUTOFFS
from ordstack.functions import dates, ids, numeric
from ordstack.operators import columns

QUICK = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_lost_leading_zero(spark):
    day = one(spark, 1012017, "int", dates.parse_mdy)
    assert (day.year, day.month, day.day) == (2017, 1, 1)
    assert one(spark, 1012017, "int", dates.month_arith) == 1
    assert one(spark, 12312016, "int", dates.year_arith) == 2016


def test_malformed_date_raises(spark):
    with pytest.raises(Exception, match="(?i)invalid|date"):
        one(spark, 13452017, "int", dates.parse_mdy)


def test_id_parts_stay_exact(spark):
    big = 9_007_199_254_740_993
    assert one(spark, big, "bigint", ids.cid8) == big // 10**4
    assert one(spark, 123456789012, "bigint", ids.cid5) == 12345
    assert one(spark, 123456789012, "bigint", ids.cid3) == 678


@pytest.mark.parametrize(
    "p, rating", [(-0.4, 0), (0.5, 0), (1.5, 2), (2.5, 2), (20.7, 20), (3.49, 3)]
)
def test_rating(spark, p, rating):
    assert one(spark, p, "double", numeric.to_rating) == rating


@pytest.mark.parametrize("p", [None, float("nan")])
def test_missing_prediction_is_rejected(spark, p):
    with pytest.raises(Exception, match="missing prediction"):
        one(spark, p, "double", numeric.to_rating)


def test_unsorted_cutoffs_first_match(spark):
    cut = lambda c: numeric.apply_cutoffs(c, (3.0, 1.0, 2.0))
    assert one(spark, 0.5, "double", cut) == 0
    assert one(spark, 3.5, "double", cut) == 3
    assert one(spark, None, "double", cut) == 3
    assert one(spark, float("nan"), "double", cut) == 3


def test_reached_thresholds_differ_from_cutoffs_at_equality(spark):
    assert one(spark, 1.5, "double", lambda c: numeric.count_reached(c, DEFAULT_CUTOFFS)) == 1
    assert one(spark, 1.5, "double", lambda c: numeric.apply_cutoffs(c, DEFAULT_CUTOFFS)) == 1


@QUICK
@given(
    st.lists(
        st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=3, max_size=3
    )
)
def test_row_statistics(spark, values):
    df = spark.createDataFrame([tuple(values)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    row = df.select(
        numeric.row_min(cols).alias("lo"),
        numeric.row_max(cols).alias("hi"),
        numeric.row_median(cols).alias("mid"),
    ).first()
    have = sorted(v for v in values if v is not None)
    if not have:
        assert (row.lo, row.hi, row.mid) == (None, None, None)
    else:
        n = len(have)
        mid = (have[(n - 1) // 2] + have[n // 2]) / 2
        assert (row.lo, row.hi) == (have[0], have[-1])
        assert math.isclose(row.mid, mid, abs_tol=1e-9)


def test_pairwise_logs_out_of_domain(spark):
    df = spark.createDataFrame([(-3.0, 1.0)], "a double, b double")
    row = numeric.with_pairwise(df, ["a", "b"]).first().asDict()
    assert row["a+b"] == -2.0 and row["a-b"] == -4.0
    assert row["axb"] is None and row["a/b"] is None


def test_argmax_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0)], "a double, b double, c double")
    assert df.select(numeric.argmax_class([F.col(c) for c in "abc"])).first()[0] == 1


def test_constant_columns(spark):
    rows = [(1, False, 5, 1.0, None, 1.0, 1.0), (2, False, 6, 1.0, None, None, 2.0),
            (3, True, 0, 9.0, 1.0, 3.0, 2.0)]
    df = spark.createDataFrame(
        rows, "row_id bigint, is_test boolean, target int, a double, b double, c double, d double"
    )
    kept = columns.drop_constant(df).columns
    assert kept == ["row_id", "is_test", "target", "b", "c", "d"]
