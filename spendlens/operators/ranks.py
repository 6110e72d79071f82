"""Exact order statistics of any number of columns and groups, by selection instead of sorting.

A median of a group needs two of its values, not their order. One pass takes count, least and
largest value of every (group, column). Where that is more than ``FEW`` rows, a counting pass cuts the
range into ``CELLS`` cells of equal width and counts the rows, the least and the largest value of each;
the running sum of the counts tells which cell holds a wanted rank, and that cell is the next range.
A range is done when all its values are equal or at most ``FEW`` are left, which one last pass
gathers. All ranks of all columns and groups share the passes, two of them as a rule.

Counts are partial aggregates, so a group that holds most rows leaves each task as a few
thousand rows, and no buffer holds more than ``FEW`` values, whatever the data. The cells are cut
between values that occur, so every pass parts at least the least from the largest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.joins import MAX_BROADCAST_ROWS, bounded_rows, salted_join
from spendlens.session import stable_copy

QUARTILES = (0.25, 0.5, 0.75)
#: Cells of a range in one counting pass; values of a range that are gathered.
CELLS, FEW = 4096, 32768
_AT = ["__g", "__c"]


class Kept:
    """A table that the passes build on: literal rows, known to the driver, if there are few, else stored."""

    def __init__(self, df: DataFrame):
        self.rows = bounded_rows(df, MAX_BROADCAST_ROWS)
        self.df = df.sparkSession.createDataFrame(self.rows, df.schema) if self.rows is not None else stable_copy(df)

    def where(self, large: bool, few: int) -> DataFrame | None:
        """The rows whose range is still open and holds more than ``few`` rows (or any, if not ``large``); None if there is none."""
        # Spark's NaN equals itself.
        if self.rows is not None and not any(r["__lo"] != r["__hi"] and r["__lo"] == r["__lo"] and (r["__size"] > few or not large) for r in self.rows):
            return None
        open_ranges = self.df.where((F.col("__lo") != F.col("__hi")) & ((F.col("__size") > few) | F.lit(not large)))
        return None if self.rows is None and open_ranges.isEmpty() else open_ranges

    def join(self, rows: DataFrame, ranges: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(ranges), _AT) if self.rows is not None else salted_join(rows, ranges, _AT)

    def hinted(self, df: DataFrame) -> DataFrame:
        """``df``, which has at most as many rows as this table, broadcast if those are few."""
        return F.broadcast(df) if self.rows is not None else df


def group_key(by: Sequence[str]) -> Column:
    """The group columns as one key; nulls compare equal in it."""
    return F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))


def _values(cols: Sequence[str | Column]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols]


def long_rows(df: DataFrame, cols: Sequence[str | Column], by: Sequence[str]) -> DataFrame:
    """__g (the group), __c (number of the column), __v (its value as double)."""
    values = _values(cols)
    if len(values) == 1:
        return df.select(group_key(by).alias("__g"), F.lit(0).alias("__c"), values[0].alias("__v"))
    return df.select(group_key(by).alias("__g"), F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), v.alias("__v")) for i, v in enumerate(values)])))


def moments(df: DataFrame, cols: Sequence[str | Column], by: Sequence[str]) -> DataFrame:
    """__g, __c, n, mean, sd, least, most of the non-null values: one aggregate over the rows for all columns."""
    parts = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "least": F.min, "most": F.max}
    one = df.groupBy(*by).agg(*[f(v).alias(f"__{k}{i}") for i, v in enumerate(_values(cols)) for k, f in parts.items()])
    rows = [F.struct(F.lit(i).alias("__c"), *[F.col(f"__{k}{i}").alias(k) for k in parts]) for i in range(len(cols))]
    return one.select(group_key(by).alias("__g"), F.inline(F.array(*rows)))


def _cell(cells: int) -> Column:
    """Cell of a value in its range: the least value in the first, the largest in the last. Halves keep the width
    finite; values that the arithmetic can't place (an infinite or NaN end) share the middle."""
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    share = F.try_divide(v * 0.5 - lo * 0.5, hi * 0.5 - lo * 0.5)
    inner = F.when(share.isNull() | F.isnan(share), F.lit(cells // 2)).otherwise(F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(share * cells).cast("int"))))
    return F.when(v == lo, F.lit(0)).when(v == hi, F.lit(cells - 1)).otherwise(inner)


def _within(rows: DataFrame, state: Kept, open_ranges: DataFrame) -> DataFrame:
    """The rows in one of the disjoint ranges of their group and column."""
    v = F.col("__v")
    ranges = open_ranges.select(*_AT, "__lo", "__hi").distinct()
    return state.join(rows, ranges).where((v >= F.col("__lo")) & (v <= F.col("__hi")))


def value_at_ranks(rows: DataFrame, wanted: DataFrame, cells: int = CELLS, few: int = FEW) -> DataFrame:
    """__g, __c, __rank, __value: the value at each wanted rank (from 0) of long ``rows``.

    ``wanted`` has __g, __c, __rank and of its group and column __size (non-null values), __lo, __hi (their ends)."""
    state = Kept(wanted.withColumn("__before", F.lit(0).cast("long")))
    rows = rows.where(F.col("__v").isNotNull())
    while (todo := state.where(True, few)) is not None:
        counts = _within(rows, state, todo).groupBy(*_AT, "__lo", _cell(cells).alias("__cell")).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        # At most ``cells`` rows per range.
        upto = Window.partitionBy(*_AT, "__lo").orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = counts.withColumn("__end", F.sum("__n").over(upto))
        place = F.col("__rank") - F.col("__before")
        hit = ends.join(state.hinted(todo.drop("__size", "__hi")), [*_AT, "__lo"]).where((place < F.col("__end")) & (place >= F.col("__end") - F.col("__n")))
        closer = hit.select(*_AT, "__rank", F.col("__n").alias("__size"), F.col("__least").alias("__lo"), F.col("__most").alias("__hi"),
                            (F.col("__before") + F.col("__end") - F.col("__n")).alias("__before"))
        done = state.df.where((F.col("__lo") == F.col("__hi")) | (F.col("__size") <= few))
        state = Kept(closer.unionByName(done.select(*closer.columns)))
    left = state.where(False, few)
    settled = state.df.where(F.col("__lo") == F.col("__hi")).select(*_AT, "__rank", F.col("__lo").alias("__value"))
    if left is None:
        return settled
    gathered = _within(rows, state, left).groupBy(*_AT, "__lo").agg(F.sort_array(F.collect_list("__v")).alias("__all"))
    value = F.get("__all", (F.col("__rank") - F.col("__before")).cast("int"))
    found = gathered.join(state.hinted(left.select(*_AT, "__lo", "__rank", "__before")), [*_AT, "__lo"])
    return found.select(*_AT, "__rank", value.alias("__value")).unionByName(settled)


def summary(df: DataFrame, cols: Sequence[str | Column], by: Sequence[str] = (), probs: Sequence[float] = QUARTILES,
            cells: int = CELLS, few: int = FEW) -> DataFrame:
    """The columns of ``by``, __c, n, mean, sd, least, most, q: count, mean, sample sd, ends and exact quantiles (linear
    interpolation between neighbouring values) of the non-null values of every column in every group.

    ``q`` is an array in the order of ``probs``, null where a column has no value. A null group is a group
    of its own. Without ``by`` there is one row per column, also for an empty table. NaN counts as the
    largest value."""
    rows = long_rows(df, cols, by)
    table = Kept(moments(df, cols, by))
    first = table.df
    at = F.struct(*[F.struct(F.lit(float(p)).alias("p"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for p in probs])
    places = F.array(*[at[f"col{i + 1}"] for i in range(len(probs))])
    below = F.transform(places, lambda x: F.floor(x["at"]).cast("long"))
    above = F.transform(places, lambda x: F.ceil(x["at"]).cast("long"))
    wanted = first.where("n > 0").select(*_AT, F.explode(F.array_distinct(F.concat(below, above))).alias("__rank"), F.col("n").alias("__size"),
                                         F.col("least").alias("__lo"), F.col("most").alias("__hi"))
    found = value_at_ranks(rows, wanted, cells, few).groupBy(*_AT).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__values"))
    values = F.col("__values")

    def between(x: Column) -> Column:
        low, high = F.element_at(values, F.floor(x["at"]).cast("long")), F.element_at(values, F.ceil(x["at"]).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (x["at"] - F.floor(x["at"])))

    q = F.transform(places, between)
    out = first.join(table.hinted(found), _AT, "left").withColumn("q", F.when(values.isNotNull(), q))
    return out.select(*[F.col("__g")[b].alias(b) for b in by], "__c", "n", "mean", "sd", "least", "most", "q")
