"""Order statistics by selection against NumPy, with few cells and values so that several passes run."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.functions import joins
from spendlens.operators import eda, profile, ranks


def _check(df, groups, probs=(0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0), cols=("x",), by=("g",), **small):
    got = {(r[by[0]] if by else None, r["__c"]): r for r in ranks.summary(df, cols, by, probs, **small).collect()}
    assert set(got) == set(groups)
    for key, vals in groups.items():
        r = got[key]
        assert r.n == len(vals)
        if vals:
            np.testing.assert_allclose(r.q, np.quantile(vals, probs), rtol=1e-12, atol=1e-300)
            assert (r.least, r.most) == (min(vals), max(vals))
        else:
            assert r.q is None


def _frame(spark, groups):
    rows = [(g, float(v)) for (g, _), vals in groups.items() for v in vals]
    return spark.createDataFrame(rows, "g string, x double").repartition(3)


def _groups():
    rng = random.Random(4)
    return {
        ("hot", 0): [rng.gauss(0, 1e3) for _ in range(3000)], ("ties", 0): [float(rng.randrange(3)) for _ in range(500)],
        ("one", 0): [7.5], ("two", 0): [1.0, 2.0], ("equal", 0): [3.0] * 200, (None, 0): [float(i) for i in range(300)],
        ("spread", 0): [math.copysign(2.0 ** rng.uniform(-12, 12), rng.random() - 0.4) for _ in range(400)],
        ("outlier", 0): [rng.random() for _ in range(400)] + [1.7e308, -1.7e308], ("tiny", 0): [5e-324 * i for i in range(30)]}


@pytest.mark.parametrize("cells,few", [(64, 20), (4096, 8192)])
def test_groups_of_all_kinds(spark, cells, few):
    groups = _groups()
    _check(_frame(spark, groups), groups, cells=cells, few=few)


def test_many_groups_take_the_shuffled_path(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MAX_BROADCAST_ROWS", 3)
    groups = {k: v for k, v in _groups().items() if k[0] != "spread"}
    _check(_frame(spark, groups), groups, cells=64, few=20)


def test_several_columns_nulls_and_empty(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else i, None) for i in range(100)], "a double, b long, c double")
    want = {(None, 0): [float(i) for i in range(100)], (None, 1): [float(i) for i in range(0, 100, 3)], (None, 2): []}
    _check(df, want, cols=("a", "b", "c"), by=(), cells=8, few=5)
    _check(df.limit(0), {(None, i): [] for i in range(3)}, cols=("a", "b", "c"), by=())
    assert ranks.summary(df.limit(0), ["a"], ["b"]).count() == 0


def test_infinite_and_nan_values(spark):
    vals = [float("-inf")] * 3 + [float(i) for i in range(50)] + [float("inf")] * 2
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = ranks.summary(df, ["x"], probs=(0.5, 1.0), cells=4, few=4).first().q
    assert q == [np.quantile(vals, 0.5), float("inf")]
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0] + [float("nan")] * 3], "x double")
    assert ranks.summary(df, ["x"], probs=(0.5,), cells=4, few=2).first().q == [4.0]


def test_no_buffer_above_the_bound(spark):
    """A group with a third of all rows: each range that is gathered holds at most ``few`` values."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
                                    F.abs(F.xxhash64("id")).cast("double").alias("x"))
    sizes, real = [], ranks._within

    def watched(rows, state, left):
        out = real(rows, state, left)
        sizes.append(out.groupBy("__g", "__c", "__lo").count().agg(F.max("count")).first()[0])
        return out

    ranks._within = watched
    try:
        got = {r.g: r.q for r in ranks.summary(df, ["x"], ["g"], cells=256, few=100).collect()}
    finally:
        ranks._within = real
    assert sizes[0] == 10_000 and sizes[-1] <= 100
    want = df.groupBy("g").agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("q")).collect()
    for r in want:
        assert got[r.g] == pytest.approx(r.q)


def test_reports_use_selection(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 10000)
    df = spark.createDataFrame([("a" if i % 2 else None, float(i * i % 101)) for i in range(200)], "g string, x double")
    rows = {r.g: r for r in profile.describe(df, ["x"], by="g").collect()}
    for g in ("a", None):
        vals = [float(i * i % 101) for i in range(200) if bool(i % 2) == (g == "a")]
        assert [rows[g].p25, rows[g].p50, rows[g].p75] == pytest.approx(list(np.quantile(vals, [0.25, 0.5, 0.75])))
    box = eda.box_stats(df, "x", by="g").collect()
    assert [b.group for b in box] == ["a"]
    near = {r.g: r for r in profile.describe(df, ["x"], by="g", method="approx").collect()}
    assert near["a"]["count"] == 100 and abs(near["a"].p50 - rows["a"].p50) < 5
