"""Rounding, decimal and date rules on the values where engines differ."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quitanda.functions import semantics as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def ts(text):
    return F.lit(datetime.fromisoformat(text)).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "number, digits, expected",
    [(1.005, 2, 1.0), (0.285, 2, 0.28), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (33.886666, 2, 33.89)],
)
def test_round_double_works_on_the_binary_value(spark, number, digits, expected):
    assert value(spark, S.round_double(F.lit(number), digits)) == expected


def test_round_double_keeps_null_and_infinity(spark):
    assert value(spark, S.round_double(F.lit(None).cast("double"), 2)) is None
    assert value(spark, S.round_double(F.lit(float("inf")), 2)) == float("inf")


@pytest.mark.parametrize("number, expected", [(0.125, 0.12), (1.005, 1.0), (1.5, 1.5), (-0.375, -0.38)])
def test_round_half_even(spark, number, expected):
    assert value(spark, S.round_half_even(F.lit(number), 2)) == expected == round(number, 2)


def test_money_rounds_twice(spark):
    # 1.0046 -> 1.005 -> 1.01
    assert value(spark, S.money(F.lit(Decimal("1.0046")))) == Decimal("1.01")


def test_four_digits_of_numeric_are_three(spark):
    assert value(spark, S.numeric(F.lit(0.12345), 4)) == Decimal("0.123")


def test_ratio_by_zero_is_null(spark):
    assert value(spark, S.ratio(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize(
    "helper, start, end, expected",
    [
        (S.hour_boundaries, "2017-01-31 00:59:00", "2017-01-31 01:01:00", 1),
        (S.hour_boundaries, "2017-01-31 23:59:00", "2017-02-01 01:00:00", 2),
        (S.hour_boundaries, "2017-01-02 10:30:00", "2017-01-01 11:00:00", -23),
        (S.day_boundaries, "2017-01-01 23:59:00", "2017-01-02 00:01:00", 1),
        (S.day_boundaries, "2017-01-02 00:01:00", "2017-01-01 23:59:00", -1),
        (S.whole_days, "2017-01-01 23:59:00", "2017-01-02 00:01:00", 0),
        (S.whole_days, "2017-01-01 09:00:00", "2017-01-03 09:00:00", 2),
        (S.whole_days, "2017-01-03 09:00:00", "2017-01-01 10:00:00", -2),
    ],
)
def test_date_distances(spark, helper, start, end, expected):
    assert value(spark, helper(ts(start), ts(end))) == expected


def test_calendar_helpers(spark):
    sunday, monday = ts("2017-03-05 23:00:00"), ts("2017-03-06 01:00:00")
    assert value(spark, S.weekday(sunday)) == 0
    assert value(spark, S.weekday(monday)) == 1
    assert value(spark, S.week_of(sunday)) == date(2017, 2, 27)
    assert value(spark, S.week_of(monday)) == date(2017, 3, 6)
    assert value(spark, S.month_of(sunday)) == date(2017, 3, 1)
    assert value(spark, S.month_index(ts("2018-01-01 00:00:00")) - S.month_index(ts("2017-11-30 00:00:00"))) == 2


def test_bucket_label_bounds_and_null(spark):
    buckets = ((None, 0, "low"), (1, 3, "mid"))
    rows = spark.createDataFrame([(-5,), (0,), (1,), (3,), (4,), (None,)], "x INT")
    labels = [r[0] for r in rows.select(S.bucket_label(F.col("x"), buckets, "high")).collect()]
    assert labels == ["low", "low", "mid", "mid", "high", "high"]


def test_round_half_even_equals_python(spark):
    import random

    rng = random.Random(7)
    values = [2.675, 1.115, 0.125, -2.675, 0.375, 1e300, 5e-324, 2.0**60, 0.0, *(rng.randrange(10**6) / 1000 for _ in range(3000))]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.round_half_even(F.col("x"), 2).alias("y"))
    assert all(r["y"] == round(r["x"], 2) for r in rows.collect())
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "x double")
    assert str([r[0] for r in odd.select(S.round_half_even(F.col("x"), 2)).collect()]) == "[None, inf, nan]"
