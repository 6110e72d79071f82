"""Feature derivation (FEA1-FEA12) as column expressions.

Min-max statistics either come frozen (a dict from a fitted pipeline, used
as literals) or from a one-row aggregate of the same frame, cross-joined as
a broadcast: the plan stays lazy and ``df`` is never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions import bands
from spendlens.functions.util import as_double, small, with_stats
from spendlens.schema import AGE, AGE_GROUP, INCOME, INCOME_GROUP


def minmax_scaled(x: Column, lo: Column, hi: Column) -> Column:
    """FEA7: (x - min) / (max - min); 0 where max = min (constant column)."""
    return F.when(hi == lo, F.lit(0.0)).otherwise((x - lo).cast("double") / (hi - lo))


def derive_features(df: DataFrame, bands_mode: str = "closed", stats: dict | None = None,
                    age: str = AGE, income: str = INCOME) -> DataFrame:
    """FEA10: add the nine derived columns.

    ``bands_mode="closed"``: age/income outside the band edges -> null group
    (table rule); ``"open"``: first and last band are open-ended (single
    customer rule). ``stats`` = {"income_min": .., "income_max": ..} freezes
    the min-max statistics; without it they come from ``df`` itself.
    """
    # Integer columns of any width multiply as 64-bit numbers, doubles as doubles.
    one = F.lit(1).cast("bigint")
    a, inc = F.col(age) * one, F.col(income) * one
    open_ends = bands_mode == "open"
    if stats is None:
        st = df.agg(F.min(inc).alias("__inc_min"), F.max(inc).alias("__inc_max"))
        base = with_stats(df, st)
        lo, hi = F.col("__inc_min"), F.col("__inc_max")
    else:
        base = df
        lo, hi = F.lit(stats["income_min"]), F.lit(stats["income_max"])
    out = base.withColumns({
        AGE_GROUP: bands.age_group(a, open_ends),
        INCOME_GROUP: bands.income_group(inc, open_ends),
        "income_age_ratio": F.try_divide(inc.cast("double"), a + 1),
        "age_squared": a * a,
        "income_squared": inc * inc,
        "age_income_interaction": a * inc,
        "spending_capacity": minmax_scaled(inc, lo, hi),
        "young_high_income": F.coalesce((a < 35) & (inc > 70), F.lit(False)).cast("int"),
        "senior_low_income": F.coalesce((a > 50) & (inc < 50), F.lit(False)).cast("int"),
    })
    return out.drop("__inc_min", "__inc_max")


def equal_width_edges(mn: Column, mx: Column, k: int) -> list[Column]:
    """Edges of ``pd.cut(x, bins=k)``: k equal-width right-closed intervals on
    [min, max], lowest edge lowered by 0.1 % of the range; a constant column
    is widened by 0.1 % of its value (0.001 at zero) on both sides."""
    mnd, mxd = mn.cast("double"), mx.cast("double")
    pad = F.when(mnd == 0, F.lit(0.001)).otherwise(F.abs(mnd) * 0.001)
    lo = F.when(mnd == mxd, mnd - pad).otherwise(mnd)
    hi = F.when(mnd == mxd, mxd + pad).otherwise(mxd)
    step = (hi - lo) / k
    edges = [lo + F.lit(float(i)) * step for i in range(k)] + [hi]
    edges[0] = F.when(mnd == mxd, lo).otherwise(lo - (hi - lo) * 0.001)
    return edges


def equal_width_bin(x: Column, edges: list[Column]) -> Column:
    """0-based right-closed bin of ``x`` between precomputed edges."""
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > edges[i]) & (x <= edges[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def with_equal_width_bins(df: DataFrame, c: str, k: int = 5, name: str | None = None) -> DataFrame:
    """FEA12: add ``{name}`` (interval text) and ``{name}_index`` for ``pd.cut(x, bins=k)``."""
    name = name or f"{c}_bin"
    st = df.agg(F.min(c).alias("__mn"), F.max(c).alias("__mx"))
    base = with_stats(df, st)
    edges = equal_width_edges(F.col("__mn"), F.col("__mx"), k)
    idx = equal_width_bin(F.col(c).cast("double"), edges)
    lo_text = F.element_at(F.array(*[bands.round_frac(e) for e in edges[:-1]]), idx + 1)
    hi_text = F.element_at(F.array(*[bands.round_frac(e) for e in edges[1:]]), idx + 1)
    return (base.withColumn(f"{name}_index", idx.cast("long"))
            .withColumn(name, bands.interval_label(lo_text, hi_text))
            .drop("__mn", "__mx"))


def equal_width_bin_table(df: DataFrame, c: str, k: int = 5) -> DataFrame:
    """FEA12 as a table: bin, edges, label and row count, empty bins kept."""
    st = df.agg(F.min(c).alias("__mn"), F.max(c).alias("__mx"))
    edges = equal_width_edges(F.col("__mn"), F.col("__mx"), k)
    spark = df.sparkSession
    bins = spark.range(k).withColumnRenamed("id", "bin").crossJoin(small(st))
    lo = F.element_at(F.array(*edges[:-1]), F.col("bin").cast("int") + 1)
    hi = F.element_at(F.array(*edges[1:]), F.col("bin").cast("int") + 1)
    bins = bins.select("bin", lo.alias("bin_lo"), hi.alias("bin_hi"))
    counts = (with_equal_width_bins(df.select(c), c, k, "__b")
              .groupBy(F.col("__b_index").alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    return (small(bins).join(counts, "bin", "left")
            .select(F.col("bin").cast("long"), as_double("bin_lo").alias("bin_lo"), as_double("bin_hi").alias("bin_hi"),
                    bands.interval_label(bands.round_frac(F.col("bin_lo")), bands.round_frac(F.col("bin_hi")))
                    .alias("label"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def band_counts(df: DataFrame, group_col: Column, labels, name: str) -> DataFrame:
    """Rows per band label, empty bands kept (ordered category counts)."""
    lab = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], f"position long, {name} string")
    counts = df.groupBy(group_col.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return (lab.join(counts.filter(F.col(name).isNotNull()), name, "left")
            .select("position", name, F.coalesce("count", F.lit(0)).cast("long").alias("count")))
