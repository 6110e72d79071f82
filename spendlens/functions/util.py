"""Small Column/DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    """A column as double, unrounded: operators pass full precision on."""
    return col(c).cast("double")


def reported(df: DataFrame) -> DataFrame:
    """The last step of a report: every double column rounded for printing."""
    return df.select(*[r6(f"`{n}`").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def r6(c, digits: int = 6) -> Column:
    """Round a double for printing; ``+ 0.0`` turns -0.0 into 0.0. Only reports use it."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def rows_from_one_row(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Unpivot a one-row aggregate into rows: ``inline(array(struct, ...))``."""
    return one_row.select(F.inline(F.array(*structs)))


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded by construction
    (one-row aggregates, label lists, bin lists, per-group statistics over a
    fixed set of groups). Sides without such a bound are left to AQE, which
    broadcasts only below ``spark.sql.autoBroadcastJoinThreshold``."""
    return F.broadcast(df)


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame to every row (broadcast nested-loop
    join against one row: no shuffle of ``df``)."""
    return df.crossJoin(small(stats))


def freeze(one_row: DataFrame) -> dict:
    """Turn a one-row statistics frame into Python literals (one small action).

    Later plans then carry the numbers as constants instead of re-running the
    aggregate inside every plan that uses them."""
    r = one_row.first()
    return r.asDict() if r is not None else {}


def with_position(df: DataFrame, keys: Sequence[Column], name: str = "position") -> DataFrame:
    """The rows of a small result (a top-k, one row per column or model) with their place (from 0) in ascending
    order of ``keys``, then of the rows themselves. Order is data then, not the accident of a fetch."""
    row = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    each = df.agg(F.sort_array(F.collect_list(row)).alias("rows")).select(F.posexplode("rows").alias(name, "r"))
    return each.select(F.col(name).cast("long").alias(name), *[F.col("r.row")[c].alias(c) for c in df.columns])
