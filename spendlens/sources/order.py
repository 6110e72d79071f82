"""Rows in the order of their files, for tables without a key (SRC1, FILL1-FILL2, PRJ1, RES5).

A data frame of one file has a row order, a distributed table has none, but its files do: file by
file in the order of their names, and in a file from top to bottom. Parquet states the
position of a row in its file. Text formats state where the split of a row starts; a split is read by one
task from its start to its end, so ids that grow within a task order its rows. Both stay the same
however the files are packed into tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators import fill

ORDER = "row_order"


def _order(fmt: str) -> Column:
    place = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    start = F.lit(0).cast("long") if fmt == "parquet" else F.col("_metadata.file_block_start")
    return F.struct(F.col("_metadata.file_path").alias("file"), start.alias("block"), place.alias("row"))


def in_file_order(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """A table just read from files, with ``row_order``: a struct (file, block, row) that sorts its rows as the
    files have them. Only the comparison of two orders means something, not the numbers in them."""
    return df.withColumn(ORDER, _order(fmt))


def read_ordered(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """SRC1 / SRC2 with ``row_order``."""
    if fmt == "csv":
        frame = spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").csv(path)
    else:
        frame = spark.read.format(fmt).load(path)
    return in_file_order(frame, fmt)


def fill_in_file_order(df: DataFrame, cols: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """FILL1 + FILL2 without a key: ``df.ffill().bfill()`` over rows with ``row_order``, which is kept."""
    return fill.ffill_bfill(df, ORDER, cols, n_buckets)


def number_in_file_order(df: DataFrame, name: str = "row_number", n_buckets: int | None = None) -> DataFrame:
    """RES5 without a key: the position of every row (from 0) in file order; ``row_order`` goes."""
    return fill.with_row_number(df, ORDER, name, n_buckets).drop(ORDER)


def head_in_file_order(spark: SparkSession, path: str, n: int = 5, fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """PRJ1 without a key: the first ``n`` rows of the first files, with row_number. Only as many
    files are read as it takes, four times as many each time the rows are too few."""
    names = columns or [c for c in read_ordered(spark, path, fmt).columns if c != ORDER]
    files = sorted(read_ordered(spark, path, fmt).inputFiles())
    take = 1
    while True:
        some = read_ordered(spark, files[:take], fmt)
        if take >= len(files) or some.limit(n).count() >= n:
            break
        take *= 4
    first = some.select(ORDER, *[f"`{c}`" for c in names]).orderBy(ORDER).limit(n)
    numbered = first.agg(F.sort_array(F.collect_list(F.struct(ORDER, *[f"`{c}`" for c in names]))).alias("rows"))
    # n rows: a top-k, numbered in one array.
    each = numbered.select(F.posexplode("rows").alias("row_number", "r"))
    return each.select(F.col("row_number").cast("long").alias("row_number"), *[F.col("r")[c].alias(c) for c in names])
