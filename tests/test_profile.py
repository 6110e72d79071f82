"""Profiling operators against pandas on small frames and on the customer file."""


import numpy as np
import pandas as pd
import pytest

from spendlens.operators import profile
from spendlens.sources import io


def _pdf(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ROWS = [(1, "a", 1.0), (2, None, 2.0), (3, "a", None), (4, "b", 4.0), (5, "a", 4.0)]
SCHEMA = "k long, g string, x double"


def test_missing_profile_and_completeness(spark):
    df = _pdf(spark, ROWS, SCHEMA)
    got = {r["column"]: (r["missing_count"], r["missing_pct"]) for r in profile.missing_profile(df).collect()}
    assert got == {"k": (0, 0.0), "g": (1, 20.0), "x": (1, 20.0)}
    only = [r["column"] for r in profile.missing_profile(df, only_missing=True).collect()]
    assert sorted(only) == ["g", "x"]
    c = profile.completeness(df).first()
    assert (c["n_rows"], c["n_columns"], c["total_missing"]) == (5, 3, 2)
    assert c["completeness_pct"] == pytest.approx((1 - 2 / 15) * 100)


def test_duplicate_count_matches_pandas(spark):
    rows = [(1, "x"), (1, "x"), (1, "x"), (2, "y"), (None, None), (None, None)]
    df = _pdf(spark, rows, "a long, b string")
    want = pd.DataFrame(rows, columns=["a", "b"]).duplicated().sum()
    assert profile.duplicate_count(df).first()[0] == want == 3


def test_duplicate_count_one_row_three_times(spark):
    df = _pdf(spark, [(1,), (1,), (1,), (2,)], "a long")
    assert profile.duplicate_count(df).first()[0] == 2


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 100, 57).astype(float)
    df = _pdf(spark, [(float(v),) for v in vals], "x double")
    got = profile.describe(df, ["x"]).first()
    want = pd.Series(vals).describe()
    for k, w in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                 ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got[k] == pytest.approx(want[w], abs=1e-6), k


def test_describe_quartiles_interpolate(spark):
    df = _pdf(spark, [(float(v),) for v in range(4)], "x double")
    r = profile.describe(df, ["x"]).first()
    assert (r["p25"], r["p50"], r["p75"]) == (0.75, 1.5, 2.25)


def test_value_counts_labels_keep_zero_and_bases(spark):
    df = _pdf(spark, [("A",), ("A",), ("B",), (None,)], "v string")
    got = {r["value"]: (r["count"], r["pct"]) for r in profile.value_counts(df, "v", labels=["A", "B", "C"]).collect()}
    assert got == {"A": (2, pytest.approx(200 / 3)), "B": (1, pytest.approx(100 / 3)), "C": (0, 0.0)}
    allb = {r["value"]: r["pct"] for r in profile.value_counts(df, "v", base="all").collect()}
    assert allb == {"A": 50.0, "B": 25.0}


def test_empty_frame(spark):
    df = spark.createDataFrame([], "k long, g string, x double")
    assert profile.duplicate_count(df).first()[0] == 0
    c = profile.completeness(df).first()
    assert c["n_rows"] == 0 and c["completeness_pct"] is None
