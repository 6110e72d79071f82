"""Band edges, segments and thresholds on the boundary values of FIXTURES F8."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.functions import bands
from spendlens.operators import segments


def _labels(spark, values, expr_fn, typ="double"):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr_fn(F.col("x"))).collect()]


def test_age_bands_match_pandas_cut(spark):
    ages = [0, 1, 30, 31, 35, 40, 50, 51, 100, 101]
    got = _labels(spark, ages, lambda c: bands.age_group(c))
    want = pd.cut(pd.Series(ages), bins=list(bands.AGE_EDGES), labels=list(bands.AGE_LABELS))
    assert got == [None if pd.isna(w) else w for w in want]


def test_income_bands_match_pandas_cut(spark):
    inc = [0, 40, 41, 50, 70, 71, 100, 150, 151]
    got = _labels(spark, inc, lambda c: bands.income_group(c))
    want = pd.cut(pd.Series(inc), bins=list(bands.INCOME_EDGES), labels=list(bands.INCOME_LABELS))
    assert got == [None if pd.isna(w) else w for w in want]


def test_open_bands_single_customer_rule(spark):
    got = _labels(spark, [-5, 0, 30, 31, 50, 51, 200], lambda c: bands.age_group(c, open_ends=True))
    assert got == ["Young", "Young", "Young", "Middle", "Senior", "Elderly", "Elderly"]


SCORES = [-3, 0, 29.99, 30, 50, 70, 100, 104, None]


def test_segment_cut_right_closed_null_outside(spark):
    got = _labels(spark, SCORES, lambda c: segments.segment(c, "cut", "segment"))
    want = pd.cut(pd.Series(SCORES, dtype=float), bins=list(bands.SCORE_EDGES), labels=list(bands.SEGMENT_LABELS))
    assert got == [None if pd.isna(w) else w for w in want]


def test_category_labels(spark):
    got = _labels(spark, [10, 40, 60, 90], lambda c: segments.segment(c, "cut", "category"))
    assert got == ["Low", "Medium", "High", "Very High"]


def test_threshold_left_closed_never_null(spark):
    got = _labels(spark, SCORES, lambda c: segments.segment(c, "threshold"))
    assert got == ["Low Spender", "Low Spender", "Low Spender", "Medium Spender", "High Spender",
                   "VIP Spender", "VIP Spender", "VIP Spender", None]


@pytest.mark.parametrize("x,want", [(17.948, 17.948), (28.400000000000002, 28.4), (0.012345, 0.0123), (70.0, 70.0)])
def test_round_frac(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(bands.round_frac(F.col("x"))).first()[0]
    assert got == pytest.approx(want)
