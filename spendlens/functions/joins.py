"""Joining a statistics table back to the rows it was computed from.

Per-group statistics (quartile fences, kernel bandwidths, code tables) have
one row per group. How many groups there are is not known from the plan, so
the size is checked before a broadcast is chosen:

* at most ``max_rows`` rows (counted with a cap, ``limit(max_rows + 1)``):
  the rows become a literal table that is broadcast; the big side is not
  shuffled at all;
* more: a shuffle join on the keys with a salt. Each row of the big side gets
  a salt from a hash of its own values (deterministic, so a recomputed task
  after a lost executor routes every row the same way) and every statistics
  row is copied once per salt value, so a group holding a third of all rows
  is spread over ``salt_buckets`` tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 10000
SALT_BUCKETS = 16
SALT = "__salt"


def bounded_rows(df: DataFrame, max_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows``, else ``None``.
    Never moves more than ``max_rows + 1`` rows to the driver."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def settled(stats: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """A statistics table used more than once, and whether it is small: its rows as a
    literal table when there are at most ``max_rows`` (computed once, checked size), else
    the lazy frame itself."""
    rows = bounded_rows(stats, MAX_BROADCAST_ROWS if max_rows is None else max_rows)
    return (stats, False) if rows is None else (stats.sparkSession.createDataFrame(rows, stats.schema), True)


def salted_join(big: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner",
                salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Shuffle join of ``big`` with a table that has one row per key, hot keys
    split over ``salt_buckets`` tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salt_buckets))
    b = big.withColumn(SALT, salt)
    s = stats.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt_buckets - 1).cast("long"))))
    return b.join(s, [*keys, SALT], how).drop(SALT)


def join_group_stats(big: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner",
                     max_rows: int | None = None, salt_buckets: int = SALT_BUCKETS, small: bool = False) -> DataFrame:
    """Attach per-group ``stats`` (unique on ``keys``) to ``big``: broadcast
    behind a checked row count (``max_rows``, default ``MAX_BROADCAST_ROWS``),
    salted shuffle join beyond it. ``small``: the count was checked before (``settled``)."""
    keys = list(keys)
    if small:
        return big.join(F.broadcast(stats), keys, how) if keys else big.crossJoin(F.broadcast(stats))
    max_rows = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    if not keys:
        rows = bounded_rows(stats, 1)
        if rows is None:
            raise ValueError("statistics without keys must have one row")
        return big.crossJoin(F.broadcast(big.sparkSession.createDataFrame(rows, stats.schema)))
    rows = bounded_rows(stats, max_rows)
    if rows is not None:
        lit = big.sparkSession.createDataFrame(rows, stats.schema)
        return big.join(F.broadcast(lit), keys, how)
    return salted_join(big, stats, keys, how, salt_buckets)
