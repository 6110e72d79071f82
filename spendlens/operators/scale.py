"""Standardisation with population sd (FEA17), as sklearn's StandardScaler.

``pyspark.ml.feature.StandardScaler`` divides by the sample sd, so the
scaler is written as column arithmetic. A constant column scales to 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.util import with_stats


def scaler_stats(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """One row: mean and population sd of each column (over ``where`` rows)."""
    src = df.filter(where) if where is not None else df
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"__mu{i}"), F.stddev_pop(x).alias(f"__sd{i}")]
    return src.agg(*aggs)


def collect_scaler(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> dict[str, tuple]:
    """Freeze scaler statistics (one row, 2 values per column) for a fitted pipeline."""
    r = scaler_stats(df, cols, where).first()
    return {c: (r[f"__mu{i}"], r[f"__sd{i}"]) for i, c in enumerate(cols)}


def scaled(x: Column, mu: Column, sd: Column) -> Column:
    return F.when((sd == 0) | sd.isNull(), (x - mu) * 0.0).otherwise((x - mu) / sd)


def standardise(df: DataFrame, cols: Sequence[str], where: Column | None = None,
                stats: dict | None = None) -> DataFrame:
    """Replace ``cols`` by their standardised values.

    ``stats`` (frozen) are literals; otherwise they are fitted lazily on the
    ``where`` rows (the training part) and broadcast as one row.
    """
    if stats is not None:
        return df.withColumns({c: scaled(F.col(c).cast("double"), F.lit(stats[c][0]), F.lit(stats[c][1]))
                               for c in cols})
    base = with_stats(df, scaler_stats(df, cols, where))
    out = base.withColumns({c: scaled(F.col(c).cast("double"), F.col(f"__mu{i}"), F.col(f"__sd{i}"))
                            for i, c in enumerate(cols)})
    return out.drop(*[f"__mu{i}" for i in range(len(cols))], *[f"__sd{i}" for i in range(len(cols))])
