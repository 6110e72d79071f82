"""Tables without a key: fill, numbers and head in the order of their files, as pandas has it."""

import os

import numpy as np
import pandas as pd
import pytest

from spendlens.sources import order


def _frame(n=5000):
    rng = np.random.default_rng(11)
    a = pd.Series(rng.normal(size=n).round(6))
    a[rng.random(n) < 0.6] = np.nan
    a[:40] = np.nan
    g = pd.Series(rng.choice(["x", "y", None], n))
    return pd.DataFrame({"a": a, "g": g, "all_null": pd.Series([None] * n, dtype=object), "same": 1})


def _write(frame, folder, fmt, files):
    os.makedirs(folder)
    step = -(-len(frame) // files)
    for i in range(files):
        part = frame.iloc[i * step:(i + 1) * step]
        name = f"{folder}/part-{i:05d}.{fmt}"
        part.to_csv(name, index=False, na_rep="NA") if fmt == "csv" else part.to_parquet(name, index=False, row_group_size=300)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("files", [1, 7])
def test_filled_as_pandas_fills(spark, tmp_path, fmt, files):
    frame = _frame()
    _write(frame, f"{tmp_path}/t", fmt, files)
    want = frame.ffill().bfill()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size, buckets in (("128m", 3), ("9000", 8)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = order.read_ordered(spark, f"{tmp_path}/t", fmt)
            filled = order.fill_in_file_order(df, n_buckets=buckets)
            got = order.number_in_file_order(filled, n_buckets=buckets).orderBy("row_number").toPandas()
            assert df.rdd.getNumPartitions() > 1 or size == "128m"
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got["row_number"].tolist() == list(range(len(frame)))
        np.testing.assert_array_equal(got["a"].to_numpy(dtype=float), want["a"].to_numpy())
        assert got["g"].tolist() == want["g"].tolist()
        assert got["all_null"].isna().all() and "row_order" not in got


def test_head_reads_only_the_files_it_needs(spark, tmp_path):
    frame = _frame(100)
    _write(frame, f"{tmp_path}/h", "parquet", 20)
    got = order.head_in_file_order(spark, f"{tmp_path}/h", 12)
    assert len(got.inputFiles()) == 4
    rows = got.orderBy("row_number").toPandas()
    assert rows["row_number"].tolist() == list(range(12))
    np.testing.assert_array_equal(rows["a"].to_numpy(), frame["a"][:12].to_numpy())
    assert order.head_in_file_order(spark, f"{tmp_path}/h", 1000).count() == 100
