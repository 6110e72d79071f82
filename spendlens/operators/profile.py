"""Profiling: schema, missing values, duplicates, numeric summaries, frequencies.

Each report is one aggregate pass over the table (all columns at once),
unpivoted into rows afterwards; exact quantiles add the counting passes of ``ranks``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.util import as_double, rows_from_one_row, small, with_stats
from spendlens.operators import ranks


def schema_info(df: DataFrame) -> DataFrame:
    """PROF1: position, column, data_type, non_null, n_rows (``df.info()``)."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(F.col(c)).alias(f"__c{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    return rows_from_one_row(one, [
        F.struct(F.lit(i).cast("long").alias("position"), F.lit(c).alias("column"),
                 F.lit(types[c]).alias("data_type"), F.col(f"__c{i}").alias("non_null"),
                 F.col("__n").alias("n_rows"))
        for i, c in enumerate(cols)])


def missing_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """PROF2 (+FLT4): missing count and percent of rows per column."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"__m{i}") for i, c in enumerate(cols)])
    out = rows_from_one_row(one, [
        F.struct(F.lit(i).cast("long").alias("position"), F.lit(c).alias("column"),
                 F.coalesce(F.col(f"__m{i}"), F.lit(0)).cast("long").alias("missing_count"),
                 as_double(F.try_divide(F.col(f"__m{i}") * 100.0, F.col("__n"))).alias("missing_pct"))
        for i, c in enumerate(cols)])
    return out.filter(F.col("missing_count") > 0) if only_missing else out


def completeness(df: DataFrame) -> DataFrame:
    """PROF3: rows, columns, missing cells and percent of complete cells."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0)).alias("total_missing"))
    k = len(cols)
    return one.select(
        F.col("n_rows").cast("long").alias("n_rows"), F.lit(k).cast("long").alias("n_columns"),
        F.coalesce(F.col("total_missing"), F.lit(0)).cast("long").alias("total_missing"),
        as_double((F.lit(1.0) - F.try_divide(F.col("total_missing").cast("double"), F.col("n_rows") * k)) * 100)
        .alias("completeness_pct"))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """PROF4: rows that repeat an earlier row (every copy after the first).

    Rows are first counted by two 64-bit hashes (16 bytes cross the shuffle, and
    map-side aggregation collapses a row repeated a billion times to one per
    task); only rows whose hashes repeat are then grouped by their columns.
    Nulls compare equal, as in pandas.
    """
    cols = list(cols or df.columns)
    hashed = df.select(*cols, F.xxhash64(*cols).alias("__h1"), F.xxhash64(F.lit(1), *reversed(cols)).alias("__h2"))
    again = hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select("__h1", "__h2")
    g = hashed.join(again, ["__h1", "__h2"], "left_semi").groupBy(*cols).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str | None = None,
             method: str = "exact", accuracy: int = 100000) -> DataFrame:
    """PROF5 / AGG4: count, mean, sample sd, min, quartiles, max per column (per group).

    Quartiles are exact, by selection in passes shared by all columns and groups (``ranks``);
    ``method="approx"`` takes ``percentile_approx`` in the one pass of the other numbers."""
    by = [by] if isinstance(by, str) else list(by or [])
    if method == "exact":
        out = ranks.summary(df, cols, by)
    else:
        aggs = [F.percentile_approx(F.col(c).cast("double"), list(ranks.QUARTILES), accuracy).cast("array<double>").alias(f"q{i}")
                for i, c in enumerate(cols)]
        near = df.groupBy(*by).agg(*aggs).select(
            ranks.group_key(by).alias("__g"), F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(f"q{i}").alias("q")) for i in range(len(cols))])))
        out = ranks.moments(df, cols, by).join(near, ["__g", "__c"]).select(*[F.col("__g")[b].alias(b) for b in by], "*")
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(*by, F.element_at(names, F.col("__c") + 1).alias("column"), F.col("n").cast("long").alias("count"), "mean",
                      F.col("sd").alias("std"), F.col("least").alias("min"), F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                      F.col("q")[2].alias("p75"), F.col("most").alias("max"))


def value_counts(df: DataFrame, c: str, labels: Sequence[str] | None = None,
                 base: str = "non_null") -> DataFrame:
    """PROF6 / PROF7: count and percent per value, nulls left out.

    ``labels`` keeps categories with zero rows (an ordered category).
    ``base="non_null"`` is the pie-chart share, ``base="all"`` the text share
    over all rows, nulls included.
    """
    x = F.col(c)
    counts = (df.groupBy(x.alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    if labels is not None:
        lab = df.sparkSession.createDataFrame([(v,) for v in labels], "value string")
        counts = lab.join(counts.filter(F.col("value").isNotNull()), "value", "left") \
            .select("value", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
        total_src = counts
    else:
        total_src = counts.filter(F.col("value").isNotNull())
    if base == "all":
        total = df.agg(F.count(F.lit(1)).alias("__total"))
    else:
        total = total_src.agg(F.sum("count").alias("__total"))
    out = (counts.filter(F.col("value").isNotNull()).crossJoin(small(total))
           .select(F.col("value").cast("string").alias("value"), F.col("count").cast("long").alias("count"),
                   as_double(F.try_divide(F.col("count") * 100.0, F.col("__total"))).alias("pct")))
    return out


def center_spread(df: DataFrame, c: str) -> DataFrame:
    """PROF8: mean, median, sample sd of one column."""
    return ranks.summary(df, [c], probs=(0.5,)).select("mean", F.col("q")[0].alias("median"), F.col("sd").alias("std"))


def dataset_facts(df: DataFrame, target: str = "spending_score", age: str = "age",
                  income: str = "annual_income_k") -> DataFrame:
    """PROF9: the dataset fact table of the reports as (metric, value) rows."""
    y = F.col(target).cast("double")
    one = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"),
                 F.stddev_samp(y).alias("sd"), F.avg(F.col(age).cast("double")).alias("ma"),
                 F.avg(F.col(income).cast("double")).alias("mi"))
    one = with_stats(one, ranks.summary(df, [target], probs=(0.5,)).select(F.col("q")[0].alias("md")))
    facts = [("total_customers", F.col("n")), ("features", F.lit(len(df.columns) - 1)),
             ("mean_spending_score", F.col("my")), ("median_spending_score", F.col("md")),
             ("std_spending_score", F.col("sd")), ("mean_age", F.col("ma")),
             ("mean_annual_income", F.col("mi"))]
    return rows_from_one_row(one, [F.struct(F.lit(i).cast("long").alias("position"), F.lit(m).alias("metric"),
                                            as_double(v).alias("value")) for i, (m, v) in enumerate(facts)])


def head(df: DataFrame, n: int = 5, key: str = "customer_id") -> DataFrame:
    """PRJ1: first n rows in key order (a top-k, no full sort)."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)
