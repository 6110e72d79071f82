"""Feature derivation, equal-width bins, encoder, split, scaler."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.operators import encode, features, scale, split


def _base(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, gender string, age long, annual_income_k long, "
                                       "spending_score long")


# Invented rows at the band edges; expected values worked out by hand.
ROWS = [(1, "Male", 30, 40, 10), (2, "Female", 31, 41, 20), (3, "Male", 35, 70, 30), (4, "Female", 34, 71, 40),
        (5, "Male", 50, 49, 50), (6, "Female", 51, 50, 60), (7, "Male", 52, 49, 70), (8, "Female", 101, 151, 80)]


def test_derive_features(spark):
    got = [tuple(r)[5:] for r in features.derive_features(_base(spark, ROWS)).orderBy("customer_id").collect()]
    bands_ = [r[:2] for r in got]
    assert bands_ == [("Young", "Low"), ("Middle", "Medium"), ("Middle", "Medium"), ("Middle", "High"), ("Senior", "Medium"),
                      ("Elderly", "Medium"), ("Elderly", "Medium"), (None, None)]
    assert [r[3:6] for r in got] == [(900, 1600, 1200), (961, 1681, 1271), (1225, 4900, 2450), (1156, 5041, 2414), (2500, 2401, 2450),
                                     (2601, 2500, 2550), (2704, 2401, 2548), (10201, 22801, 15251)]
    assert [r[7:] for r in got] == [(0, 0), (0, 0), (0, 0), (1, 0), (0, 0), (0, 0), (0, 1), (0, 0)]
    assert got[0][2] == pytest.approx(40 / 31) and got[0][6] == 0.0
    assert got[1][6] == pytest.approx(1 / 111) and got[7][6] == 1.0


def test_products_of_narrow_integers_do_not_overflow(spark):
    df = spark.createDataFrame([(1, "Male", 20, 70_000, 1)], "customer_id int, gender string, age int, annual_income_k int, spending_score int")
    assert features.derive_features(df).first()["income_squared"] == 4_900_000_000


def test_constant_income_capacity_zero(spark):
    df = _base(spark, [(1, "Male", 20, 50, 1), (2, "Male", 30, 50, 2)])
    assert [r[0] for r in features.derive_features(df).select("spending_capacity").collect()] == [0.0, 0.0]


def test_frozen_stats(spark):
    df = _base(spark, [(1, "Male", 20, 70, 1)])
    r = features.derive_features(df, stats={"income_min": 15, "income_max": 137}).first()
    assert r["spending_capacity"] == pytest.approx((70 - 15) / 122)


@pytest.mark.parametrize("vals", [[18, 70, 33, 45, 18, 61, 29], [5.5, 5.5, 5.5], [0.1, 0.25, 0.9, 0.3]])
def test_equal_width_bins_match_pandas(spark, vals):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = features.with_equal_width_bins(df, "x", 5, "b").toPandas()
    want = pd.cut(pd.Series(vals, dtype=float), bins=5)
    assert got["b_index"].tolist() == want.cat.codes.tolist()
    assert got["b"].tolist() == want.astype(str).tolist()


def test_label_codes_alphabetical_with_nan(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("C",)], "g string")
    codes = encode.collect_codes(encode.fit_label_codes(df, ["g"]))
    values = np.array(["b", "a", "nan", "C"])
    want = {v: i for i, v in enumerate(np.unique(values))}
    assert codes["g"] == want


def test_apply_codes_unseen_rules(spark):
    train = spark.createDataFrame([("Female",), ("Male",)], "g string")
    codes = encode.fit_label_codes(train, ["g"])
    batch = spark.createDataFrame([(1, "Male"), (2, "Other"), (3, "Female")], "k long, g string")
    per_value = {r["k"]: r["g"] for r in encode.apply_codes(batch, codes, ["g"]).collect()}
    assert per_value == {1: 1, 2: 0, 3: 0}
    frozen = encode.collect_codes(codes)
    assert {r["k"]: r["g"] for r in encode.apply_codes(batch, frozen).collect()} == per_value
    whole = {r["k"]: r["g"] for r in encode.apply_codes(batch, frozen, unseen="zero_column").collect()}
    assert whole == {1: 0, 2: 0, 3: 0}


def _sides(df, sides):
    return df.select("k", sides.side().alias("s"), sides.fold().alias("f")).collect()


def test_split_has_exact_sizes_in_any_partitioning(spark):
    for n in (1, 4, 7, 1003):
        df = spark.range(1, n + 1).withColumnRenamed("id", "k")
        sides = split.fit_split(df.repartition(7), "k", folds=3)
        assert sides == split.fit_split(df.repartition(2), "k", folds=3)
        rows = _sides(df, sides)
        test = -(-n // 5)
        assert sum(r.s == "test" for r in rows) == test
        folds = [sum(r.f == i for r in rows) for i in range(3)]
        assert folds == [(n - test) // 3 + (i < (n - test) % 3) for i in range(3)]
        assert all((r.f is None) == (r.s == "test") for r in rows)


def test_another_seed_is_another_split(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = split.fit_split(df, "k", seed=42), split.fit_split(df, "k", seed=43)
    moved = df.filter(a.is_test() != b.is_test()).count() / 5000
    assert 0.28 < moved < 0.36  # 2 * 0.2 * 0.8
    far = spark.createDataFrame([(i + (j << 32),) for i in range(200) for j in range(2)], "k long")
    sides = split.fit_split(far, "k")
    apart = far.withColumn("t", sides.is_test()).groupBy(F.col("k") % (1 << 32)).agg(F.min("t") != F.max("t")).collect()
    assert any(r[1] for r in apart)


def test_split_of_text_keys_repeated_and_null_keys(spark):
    keys = [f"c-{i}" for i in range(100)]
    df = spark.createDataFrame([(k,) for k in keys + keys[:50]] + [(None,)] * 3, "k string")
    sides = split.fit_split(df, "k", folds=2)
    rows = _sides(df, sides)
    assert len({(r.k, r.s, r.f) for r in rows}) == 101
    assert abs(sum(r.s == "test" for r in rows) - 31) <= 3
    none = split.fit_split(df, "k", test_fraction=0.0, folds=2)
    assert all(r.s == "train" for r in _sides(df, none))
    assert split.fit_split(df.limit(0), "k").test_end == -1
    assert all(r.s == "test" for r in _sides(df, split.fit_split(df, "k", test_fraction=1.0, folds=2)))


def test_standardise_population_sd(spark):
    vals = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(i, v, 7.0) for i, v in enumerate(vals)], "i long, x double, c double")
    got = scale.standardise(df, ["x", "c"]).orderBy("i").toPandas()
    arr = np.array(vals)
    assert got["x"].tolist() == pytest.approx(((arr - arr.mean()) / arr.std(ddof=0)).tolist())
    assert got["c"].tolist() == [0.0] * 4


def test_label_codes_same_on_both_paths(spark):
    from spendlens.operators import encode
    df = spark.range(300).selectExpr("format_string('k%03d', id % 120) AS a", "IF(id % 7 = 0, NULL, 'x') AS b")
    small = sorted(tuple(r) for r in encode.fit_label_codes(df, ["a", "b"]).collect())
    wide = sorted(tuple(r) for r in encode.fit_label_codes(df, ["a", "b"], max_levels=10).collect())
    assert small == wide and len(small) == 122
