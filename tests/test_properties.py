"""Properties: results do not depend on how the input is partitioned, and box
statistics agree with NumPy on any sample."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from spendlens.functions.util import reported
from spendlens.functions import bands
from spendlens.operators import eda, encode, fill, profile
from spendlens.sources import demo


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("op", ["box", "hist", "density", "counts", "codes", "fill", "describe", "bands"])
def test_partition_count_does_not_matter(spark, op):
    base = demo.customers_with_gaps(spark, SF_SMALL)
    run = {
        "box": lambda d: eda.box_stats(d, "spending_score", by="gender"),
        "hist": lambda d: eda.histogram(d, "annual_income_k"),
        "density": lambda d: eda.density(d, "age", by="gender", method="binned", fine_bins=64),
        "counts": lambda d: profile.value_counts(d, "gender"),
        "codes": lambda d: encode.fit_label_codes(d, ["gender"]),
        "fill": lambda d: fill.ffill_bfill(d, "customer_id", n_buckets=5),
        "describe": lambda d: profile.describe(d, ["age", "spending_score"]),
        "bands": lambda d: eda.band_means(d, bands.age_group("age"), bands.AGE_LABELS, "spending_score"),
    }[op]
    # Sums of doubles depend on their order in the last digits; what a report prints doesn't.
    one = _rows(reported(run(base.repartition(1))))
    many = _rows(reported(run(base.repartition(13, "age"))))
    assert one == many


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 150), min_size=1, max_size=60))
def test_box_stats_match_numpy(spark, vals):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = eda.box_stats(df, "x").first()
    a = np.array(vals, dtype=float)
    q1, med, q3 = np.percentile(a, [25, 50, 75])
    iqr = q3 - q1
    lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    assert r["n"] == len(vals)
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx((round(q1, 6), round(med, 6), round(q3, 6)))
    assert r["lower_whisker"] == pytest.approx(a[a >= lo].min())
    assert r["upper_whisker"] == pytest.approx(a[a <= hi].max())
    assert r["n_outliers"] == int(((a < lo) | (a > hi)).sum())
