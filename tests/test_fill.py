"""Ordered fill and global row numbers against pandas, for several bucket counts."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.operators import fill


def _check(spark, vals, n_buckets):
    rows = [(i * 3 + 1, v, None, (None if v is None else str(v))) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "k long, x double, allnull double, s string")
    got = fill.ffill_bfill(df, "k", n_buckets=n_buckets).orderBy("k").toPandas()
    want = pd.DataFrame(rows, columns=["k", "x", "allnull", "s"]).ffill().bfill()
    assert got["x"].astype(float).tolist() == pytest.approx(want["x"].astype(float).tolist(), nan_ok=True)
    assert got["allnull"].isna().all()
    assert got["s"].tolist() == want["s"].tolist()


@pytest.mark.parametrize("n_buckets", [1, 3, 7])
def test_fill_start_middle_end(spark, n_buckets):
    _check(spark, [None, None, 1.0, None, 2.0, None, None, 5.0, None], n_buckets)


def test_fill_whole_bucket_null(spark):
    _check(spark, [1.0] + [None] * 20 + [2.0], 5)


def test_fill_one_row(spark):
    _check(spark, [None], 2)
    _check(spark, [3.0], 2)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-5, 5, allow_nan=False)), min_size=1, max_size=40),
       st.integers(1, 6))
def test_fill_property(spark, vals, nb):
    _check(spark, vals, nb)


@pytest.mark.parametrize("n_buckets", [1, 4])
def test_row_number(spark, n_buckets):
    keys = np.random.default_rng(3).permutation(np.arange(0, 500, 7)).tolist()
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    got = fill.with_row_number(df, "k", n_buckets=n_buckets).orderBy("k").collect()
    assert [r["row_number"] for r in got] == list(range(len(keys)))


def test_ordered_positions_across_partitions(spark):
    from pyspark.sql import functions as F

    from spendlens.operators import fill
    # Two groups, one much larger, values spread over many range partitions.
    df = spark.range(5000).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"),
                                  F.format_string("v%06d", (F.col("id") * 7919) % 100003).alias("v")).distinct()
    got = {(r["g"], r["v"]): r["pos"] for r in fill.ordered_positions(df, "g", "v", "pos", n_parts=7).collect()}
    want = {}
    for g in ("a", "b"):
        vals = sorted(v for (gg, v) in got if gg == g)
        want.update({(g, v): i for i, v in enumerate(vals)})
    assert got == want


def _filled(spark, rows, n):
    df = spark.createDataFrame(rows, "k string, v string, row long")
    return {r["row"]: r["v"] for r in fill.ffill_bfill(df, "k", cols=["v"], n_buckets=n).collect()}


def test_text_null_and_repeated_keys_do_not_depend_on_the_ranges(spark):
    rows = [("b", None, 1), ("a", "x", 2), (None, None, 3), ("c", "y", 4), ("c", None, 5), ("c", "z", 6), (None, "w", 7), ("d", None, 8)]
    one = _filled(spark, rows, 1)
    assert one == _filled(spark, rows, 3) == _filled(spark, rows, 8)
    assert one[1] == "x" and one[8] in ("y", "z") and one[2] == "x"
    df = spark.createDataFrame(rows, "k string, v string, row long")
    numbers = {n: [r["row"] for r in fill.with_row_number(df, "k", n_buckets=n).orderBy("row_number").collect()] for n in (1, 4)}
    assert numbers[1] == numbers[4] and numbers[1][:2] == [2, 1] and set(numbers[1][-2:]) == {3, 7}


def test_ranges_are_even_even_for_a_hot_key(spark):
    from pyspark.sql import functions as F
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    sizes = [r["count"] for r in fill.in_ranges(df, ["k"], 20).groupBy(fill.BUCKET).count().collect()]
    assert max(sizes) < 3 * 20_000 / 20
