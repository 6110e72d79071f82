"""Readers, column checks and projections around scoring (SRC1-SRC3, PRJ3, PRJ6-PRJ8, FEA11)."""

import tempfile

import pytest
from pyspark.sql import functions as F

from spendlens.functions import bands
from spendlens.operators import features, projections
from spendlens.schema import REQUIRED_FOR_SCORING
from spendlens.sources import io


def test_require_columns_names_every_missing_one(spark):
    df = spark.createDataFrame([(1, "Male")], "customer_id long, gender string")
    with pytest.raises(ValueError) as e:
        projections.require_columns(df, REQUIRED_FOR_SCORING)
    assert "age" in str(e.value) and "annual_income_k" in str(e.value)
    projections.require_columns(df, ["gender"])  # present: no error


def test_drop_ignores_absent(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert projections.drop_ignore(df, ["b", "zz"]).columns == ["a"]


def test_align_adds_zero_columns_in_training_order(spark):
    df = spark.createDataFrame([(3, 4, "x")], "b long, a long, extra string")
    out = projections.align_columns(df, ["a", "b", "c"])
    assert out.columns == ["a", "b", "c"]
    assert tuple(out.first()) == (4, 3, 0)


def test_bool_to_int(spark):
    df = spark.createDataFrame([(True,), (False,)], "f boolean")
    assert [r[0] for r in df.select(projections.bool_to_int("f")).collect()] == [1, 0]


def test_read_batch_infers_types_and_maps_names(spark):
    path = tempfile.mkdtemp(prefix="batch-", dir="/tmp") + "/in"
    rows = [(1, "Male", 19, 15, "note a"), (2, "Female", 21, 16, "note b")]
    df = spark.createDataFrame(rows, "customer_id long, gender string, age long, annual_income_k long, comment string")
    io.write_table(df, path, fmt="csv")
    back = io.read_batch(spark, path)
    types = dict(back.dtypes)
    assert types["age"] == "int" and types["annual_income_k"] == "int" and types["comment"] == "string"
    assert back.count() == 2


def test_read_customers_by_header_name(spark):
    # Columns in another order, decimals, missing values, a text id and a text that is no number.
    path = tempfile.mkdtemp(prefix="customers-", dir="/tmp") + "/in"
    rows = ["Age,Gender,CustomerID,Spending Score (1-100),Annual Income (k$)", "20.5,Female,a-1,NA,15.5", "NaN,Male,a-2,40,", "old,NA,a-3,7,60"]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    got = {r.customer_id: tuple(r)[1:] for r in io.read_customers(spark, path, id_type="string").collect()}
    assert got == {"a-1": ("Female", 20.5, 15.5, None, []), "a-2": ("Male", None, None, 40.0, []),
                   "a-3": (None, None, 60.0, 7.0, ["age"])}


def test_read_batch_keeps_numbers_beside_missing_marks(spark):
    path = tempfile.mkdtemp(prefix="batch-", dir="/tmp") + "/in"
    spark.createDataFrame([("Age,Note",), ("20,x",), ("NA,y",), ("31,NA",)], "value string").coalesce(1).write.text(path)
    got = io.read_batch(spark, path)
    assert dict(got.dtypes)["age"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == [(20, "x"), (31, None), (None, "y")]


def test_open_bands_for_new_customers(spark):
    # FEA11: ages and incomes beyond the table's range land in the open end bands.
    df = spark.createDataFrame([(80, 140), (18, 15), (30, 40)], "age long, annual_income_k long")
    st = {"income_min": 15, "income_max": 137}
    got = features.derive_features(df, bands_mode="open", stats=st).select("age_group", "income_group",
                                                                           "spending_capacity").collect()
    assert [tuple(r)[:2] for r in got] == [("Elderly", "Very High"), ("Young", "Low"), ("Young", "Low")]
    assert got[0][2] == pytest.approx((140 - 15) / (137 - 15))
    closed = features.derive_features(df, stats=st).select("age_group").collect()
    assert closed[0][0] == "Elderly" and bands.AGE_LABELS[0] == "Young"


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_ordered_result_and_its_manifest(spark, fmt):
    path = tempfile.mkdtemp(prefix="ordered-", dir="/tmp") + "/out"
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("customer_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("age"))
    io.write_ordered(df.repartition(6), path, ["age", "customer_id"], fmt)
    files = io.read_manifest(spark, path).collect()
    assert sum(f["rows"] for f in files) == 1000 and [f["file"] for f in files] == sorted(f["file"] for f in files)
    from spendlens.sources import order
    back = order.number_in_file_order(order.in_file_order(io.to_columns(io.read_written(spark, path, fmt=fmt)), fmt)).orderBy("row_number").collect()
    want = sorted(((r.age, r.customer_id) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.age, r.customer_id) for r in back] == want


def test_a_killed_write_leaves_the_result_before(spark):
    path = tempfile.mkdtemp(prefix="killed-", dir="/tmp") + "/out"
    df = spark.range(50).select(F.col("id").alias("customer_id"))
    first = io.write_ordered(df, path, ["customer_id"])
    broken = df.withColumn("customer_id", F.when(F.col("customer_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("customer_id")))
    with pytest.raises(Exception, match="lost"):
        io.write_ordered(broken, path, ["customer_id"])
    assert {r["run"] for r in io.read_manifest(spark, path).collect()} == {first}
    assert io.read_written(spark, path).count() == 50
    second = io.write_ordered(df.limit(0), path, ["customer_id"], "parquet")
    assert {r["run"] for r in io.read_manifest(spark, path).collect()} == {second}
    assert io.read_written(spark, path, fmt="parquet").count() == 0
