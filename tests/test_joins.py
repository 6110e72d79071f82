"""Size-checked joins: the broadcast path and the salted shuffle path agree."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens.functions import joins
from spendlens.operators import eda
from spendlens.sources import demo


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bounded_rows_caps(spark):
    df = spark.range(10)
    assert len(joins.bounded_rows(df, 10)) == 10
    assert joins.bounded_rows(df, 9) is None


def test_salted_join_equals_plain_join(spark):
    # One hot key holding most rows: the salted join must still return every row once.
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50)).alias("g"),
                                   F.col("id").alias("v"))
    stats = big.groupBy("g").agg(F.max("v").alias("mx"))
    want = _rows(big.join(stats, "g"))
    got = _rows(joins.salted_join(big, stats, ["g"], salt_buckets=8))
    assert got == want
    assert _rows(joins.join_group_stats(big, stats, ["g"], max_rows=0)) == want
    assert _rows(joins.join_group_stats(big, stats, ["g"], max_rows=100)) == want


def test_box_stats_same_on_both_paths(spark, monkeypatch):
    cust = demo.customers(spark, SF_SMALL)
    want = _rows(eda.box_stats(cust, "spending_score", by="gender"))
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    got = _rows(eda.box_stats(cust, "spending_score", by="gender"))
    assert got == want
    d_salted = _rows(eda.density(cust, "age", by="gender"))
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 10000)
    assert [x for r in _rows(eda.density(cust, "age", by="gender")) for x in r[1:]] == pytest.approx([x for r in d_salted for x in r[1:]])
