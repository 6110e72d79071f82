"""Projections and checks used around scoring (SRC3, PRJ2-PRJ8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """SRC3: raise once, before any work, naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"input must contain columns: {', '.join(required)}; missing: {', '.join(missing)}")


def drop_ignore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ3: drop columns, absent ones ignored."""
    return df.drop(*cols)


def align_columns(df: DataFrame, cols: Sequence[str], fill_value=0) -> DataFrame:
    """PRJ6 + PRJ7: add model columns that are missing as ``fill_value``,
    then keep exactly ``cols`` in training order."""
    add = {c: F.lit(fill_value) for c in cols if c not in df.columns}
    return df.withColumns(add).select(*cols) if add else df.select(*cols)


def bool_to_int(c: str):
    """PRJ8: boolean as 0/1."""
    return F.col(c).cast("int")
