"""Ordered operations without a global window: forward/backward fill
(FILL1-FILL2), global row numbers (RES5), label codes.

A window with no PARTITION BY runs in one task. Instead the rows are dealt to
ranges of the order (``in_ranges``), each range is ordered in its own task, and what
crosses the borders (the last value seen, the rows before a range) is carried
through a table with one row per range. The order is total: the key of any
type, nulls last, then a hash of the whole row, so repeated keys neither pile
into one range nor make a result depend on the number of ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.util import small
from spendlens.session import stable_copy

BUCKET = "__bucket"
TIE = "__tie"


def in_ranges(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """``df`` with ``__bucket``, the number of the row's range in the order of ``keys`` (nulls last) and
    ``__tie``, a hash of the row that breaks ties.

    Spark samples the range bounds, so ranges are even whatever the keys look like; the rows are
    then stored once, which fixes their ranges: a second sampling might draw other bounds."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(TIE, F.xxhash64(*df.columns))
    ranged = tied.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys], TIE)
    return stable_copy(ranged.withColumn(BUCKET, F.spark_partition_id()))


def _order(key: str) -> list[Column]:
    return [F.col(key).asc_nulls_last(), F.col(TIE)]


def ffill_bfill(df: DataFrame, key: str, cols: Sequence[str] | None = None,
                n_buckets: int | None = None) -> DataFrame:
    """``df.ffill().bfill()`` in ``key`` order over ``cols`` (default: all but the key).

    Within a range: ``last(c, ignorenulls)`` over the running frame. Across
    ranges: the last non-null value of every earlier range (carry) and the
    first non-null value of the whole column (for leading nulls). A column
    that is entirely null stays null. Rows with a null key come last, rows with
    equal keys in the order of a hash of the row.
    """
    cols = [c for c in (cols or df.columns) if c != key]
    b = in_ranges(df, [key], n_buckets)
    w = Window.partitionBy(BUCKET).orderBy(*_order(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.withColumns({f"__ff_{c}": F.last(c, ignorenulls=True).over(w) for c in cols})
    # Per range its first and last non-null value in the order, nulls of the key last.
    place = F.struct(F.col(key).isNull(), F.col(key), F.col(TIE))
    at = {c: F.when(F.col(c).isNotNull(), place) for c in cols}
    ends = b.groupBy(BUCKET).agg(*[F.max_by(c, at[c]).alias(f"__last_{c}") for c in cols],
                                 *[F.min_by(c, at[c]).alias(f"__first_{c}") for c in cols])
    # One row per range: these windows run on the small range table only.
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = ends.select(
        BUCKET,
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__carry_{c}") for c in cols],
        *[F.first(f"__first_{c}", ignorenulls=True).over(whole).alias(f"__head_{c}") for c in cols])
    j = local.join(small(carry), BUCKET, "left")
    filled = {c: F.coalesce(F.col(f"__ff_{c}"), F.col(f"__carry_{c}"), F.col(f"__head_{c}")) for c in cols}
    return j.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def with_row_number(df: DataFrame, key: str, name: str = "row_number", n_buckets: int | None = None,
                    start: int = 0) -> DataFrame:
    """Global position of each row in ``key`` order (RES5), without a
    single-task window: ``row_number`` within the range plus the row count of all
    earlier ranges."""
    b = in_ranges(df, [key], n_buckets)
    local = b.withColumn("__rn", F.row_number().over(Window.partitionBy(BUCKET).orderBy(*_order(key))))
    sizes = b.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__sz"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(BUCKET, F.coalesce(F.sum("__sz").over(before), F.lit(0)).alias("__off"))
    j = local.join(small(offs), BUCKET, "left")
    return j.withColumn(name, (F.col("__off") + F.col("__rn") - 1 + start).cast("long")) \
        .drop(BUCKET, TIE, "__rn", "__off")


def ordered_positions(df: DataFrame, by: str, value: str, name: str = "position",
                      n_parts: int | None = None) -> DataFrame:
    """0-based position of each row in ``value`` order within its ``by`` group,
    without a window that holds a whole group in one task (label codes over a
    column with any number of distinct values): rows are numbered inside each
    (range, group) part, and each part adds the row count of the earlier ranges
    of its group.
    """
    b = in_ranges(df, [by, value], n_parts)
    local = b.withColumn("__pos", F.row_number().over(Window.partitionBy(BUCKET, by).orderBy(*_order(value))) - 1)
    sizes = b.groupBy(BUCKET, by).agg(F.count(F.lit(1)).alias("__sz"))
    before = Window.partitionBy(by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(BUCKET, by, F.coalesce(F.sum("__sz").over(before), F.lit(0)).alias("__off"))
    return local.join(small(offs), [BUCKET, by], "left") \
        .withColumn(name, (F.col("__off") + F.col("__pos")).cast("long")).drop(BUCKET, TIE, "__pos", "__off")
