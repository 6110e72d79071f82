"""Exploratory statistics (AGG1-AGG17): the numbers behind every chart.

All of them are aggregates. Statistics a second pass needs (min/max,
quartiles, per-group bandwidth) are a small aggregate joined back: one row
(broadcast, bounded) or one row per group (left to AQE, which broadcasts it
only when its measured size is below the threshold).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.joins import join_group_stats, settled
from spendlens.functions.util import as_double, rows_from_one_row, small, with_stats
from spendlens.operators import ranks
from spendlens.operators.split import key_hash


# ---------------------------------------------------------------- correlation
def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG1: Pearson matrix in long form (row_column, column, corr), one pass.
    Pairs with a null are left out pair by pair, as pandas does."""
    # The upper triangle is computed, the lower one mirrors it.
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"__r{i}_{j}")
                   for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j])
    return rows_from_one_row(one, [
        F.struct(F.lit(a).alias("row_column"), F.lit(b).alias("column"), F.col(f"__r{min(i, j)}_{max(i, j)}").alias("corr"))
        for i, a in enumerate(cols) for j, b in enumerate(cols)])


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """AGG2: correlation of each column (target included) with the target, descending."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"__r{i}")
                   for i, c in enumerate(cols)])
    out = rows_from_one_row(one, [
        F.struct(F.lit(c).alias("column"), as_double(F.col(f"__r{i}")).alias("corr")) for i, c in enumerate(cols)])
    return out.orderBy(F.col("corr").desc_nulls_last(), "column")


def strength_label(r: Column) -> Column:
    """weak < 0.3 <= moderate < 0.7 <= strong, by absolute value."""
    a = F.abs(r)
    return F.when(a < 0.3, "weak").when(a < 0.7, "moderate").otherwise("strong")


def corr_labels(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """AGG3: the report's correlation wording per column against the target.
    Direction text is stated from the sign alone (the reference's wording is
    inverted for some signs; see README)."""
    base = corr_with_target(df, cols, target).filter(F.col("column") != target)
    r = F.col("corr")
    a = F.abs(r)
    return base.select(
        "column", "corr",
        strength_label(r).alias("strength"),
        F.when(r < 0, "negative").otherwise("positive").alias("direction"),
        F.when(a < 0.3, "minor").otherwise("significant").alias("importance"),
        F.when(a < 0.3, "less").otherwise("more").alias("factor"),
        F.when(r < 0, "lower").otherwise("higher").alias("tendency"),
    )


# ------------------------------------------------------------- group summaries
def group_spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """AGG5: mean, count and sample sd of ``value`` per group (null groups dropped)."""
    x = F.col(value).cast("double")
    return (df.filter(F.col(by).isNotNull()).groupBy(by)
            .agg(as_double(F.avg(x)).alias("mean"), F.count(x).cast("long").alias("count"),
                 as_double(F.stddev_samp(x)).alias("std")))


def band_means(df: DataFrame, band: Column, labels: Sequence[str], value: str, name: str = "band") -> DataFrame:
    """AGG5 / AGG6 per band: mean, count and sample sd of ``value``; every band
    listed in label order (mean null when empty)."""
    lab = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], f"position long, {name} string")
    x = F.col(value).cast("double")
    g = (df.groupBy(band.alias(name))
         .agg(F.avg(x).alias("mean"), F.count(x).alias("count"), F.stddev_samp(x).alias("std")))
    return (lab.join(g.filter(F.col(name).isNotNull()), name, "left")
            .select("position", name, as_double("mean").alias("mean"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"), as_double("std").alias("std")))


# ------------------------------------------------------------------ histogram
def _hist_range(mn: Column, mx: Column):
    lo = F.when(mn == mx, mn - 0.5).otherwise(mn)
    hi = F.when(mn == mx, mx + 0.5).otherwise(mx)
    return lo, hi


def hist_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """NumPy's equal-width bin of ``x`` in [lo, hi]: last bin closed on the right,
    index from the scaled offset, then checked against the actual edges."""
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi).otherwise(lo + i.cast("double") * step)

    raw = F.least(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1)).cast("long")
    return (F.when(x < edge(raw), raw - 1)
            .when((raw < bins - 1) & (x >= edge(raw + 1)), raw + 1)
            .otherwise(raw))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """AGG11: counts in ``bins`` equal-width bins between min and max, empty bins kept."""
    x = F.col(value).cast("double")
    src = df.select(x.alias("__x")).filter(F.col("__x").isNotNull())
    st = src.agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    lo, hi = _hist_range(F.col("__mn"), F.col("__mx"))
    st = st.select(lo.alias("__lo"), hi.alias("__hi"))
    counts = (with_stats(src, st)
              .groupBy(hist_bin(F.col("__x"), F.col("__lo"), F.col("__hi"), bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    step = (F.col("__hi") - F.col("__lo")) / bins
    grid = (df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(small(st))
            .select("bin", (F.col("__lo") + F.col("bin").cast("double") * step).alias("bin_lo"),
                    F.when(F.col("bin") == bins - 1, F.col("__hi"))
                    .otherwise(F.col("__lo") + (F.col("bin") + 1).cast("double") * step).alias("bin_hi")))
    return (grid.join(counts, "bin", "left")
            .select(F.col("bin").cast("long"), as_double("bin_lo").alias("bin_lo"), as_double("bin_hi").alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# -------------------------------------------------------------------- box plot
def box_stats(df: DataFrame, value: str, by: str | Column | None = None, whis: float = 1.5,
              method: str = "exact", accuracy: int = 100000) -> DataFrame:
    """AGG12 / AGG13: quartiles (linear interpolation), IQR, whiskers at the
    most extreme values within ``whis`` IQR, outlier count; per group if ``by``.

    Exact quartiles come by selection (``ranks``); ``method="approx"`` takes
    ``percentile_approx``. The fences go back onto the rows (broadcast behind a
    row-count check, salted shuffle join beyond it) for the whisker and outlier pass,
    a partial aggregate that leaves one row per group and task.
    """
    x = F.col(value).cast("double")
    cols = [x.alias("__x")]
    keys = []
    if by is not None:
        g = F.col(by) if isinstance(by, str) else by
        cols.append(g.alias("group"))
        keys = ["group"]
    src = df.select(*cols).filter(F.col("__x").isNotNull())
    if keys:
        src = src.filter(F.col("group").isNotNull())
    if method == "exact":
        st = ranks.summary(src, ["__x"], keys)
    else:
        q = F.percentile_approx("__x", [0.25, 0.5, 0.75], accuracy).cast("array<double>")
        st = src.groupBy(*keys).agg(F.count("__x").alias("n"), F.avg("__x").alias("mean"), F.min("__x").alias("least"), F.max("__x").alias("most"), q.alias("q"))
    st = st.select(*keys, "n", "mean", F.col("least").alias("min"), F.col("most").alias("max"), F.col("q")[0].alias("q1"),
                   F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    st = st.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("__lf", F.col("q1") - whis * F.col("iqr")) \
        .withColumn("__uf", F.col("q3") + whis * F.col("iqr"))
    joined = join_group_stats(src, st, keys)
    xx = F.col("__x")
    aggs = [F.first(c).alias(c) for c in ("n", "mean", "min", "max", "q1", "median", "q3", "iqr")] + [
        F.min(F.when(xx >= F.col("__lf"), xx)).alias("lower_whisker"),
        F.max(F.when(xx <= F.col("__uf"), xx)).alias("upper_whisker"),
        F.sum(F.when((xx < F.col("__lf")) | (xx > F.col("__uf")), 1).otherwise(0)).alias("n_outliers")]
    w = joined.groupBy(*keys).agg(*aggs) if keys else joined.agg(*aggs)
    w = w.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))
    return w.select(*keys, F.col("n").cast("long"), as_double("mean").alias("mean"), as_double("min").alias("min"),
                    as_double("q1").alias("q1"), as_double("median").alias("median"), as_double("q3").alias("q3"),
                    as_double("iqr").alias("iqr"), as_double("lower_whisker").alias("lower_whisker"),
                    as_double("upper_whisker").alias("upper_whisker"), F.col("n_outliers").cast("long"),
                    as_double("max").alias("max"))


# --------------------------------------------------------------------- density
#: Bandwidths beyond which a Gaussian kernel (below 1.3e-14 of its peak) is left out.
KERNEL_REACH = 8.0


def density(df: DataFrame, value: str, by: str | None = None, gridsize: int = 100,
            cut: float = 2.0, method: str = "linear", fine_bins: int = 4096) -> DataFrame:
    """AGG14: Gaussian kernel density on a ``gridsize``-point grid (violin plot).

    Bandwidth by Scott's rule, ``sd * n^(-1/5)`` with the sample sd; the grid
    runs ``cut`` bandwidths past the data.

    A binned convolution: one aggregate with two sums deals every value to the two of ``fine_bins + 1``
    evenly spaced nodes that it lies between, in proportion to its nearness
    (linear binning, whose error falls with the square of the spacing), and the kernel, cut off at
    ``KERNEL_REACH`` bandwidths, is then laid over the few nodes of each group. So the
    work on rows does not depend on the grid, and the work on the grid not on the rows or on
    how many values are distinct. ``method="binned"`` puts a value's whole weight at the centre of its
    bin. A constant column has bandwidth 0 and a null density.

    ``method="exact"`` moves and leaves out nothing: rows are counted per distinct value (a partial and a final
    aggregate), and every grid point is one sum of the whole kernels of all values of its group. Its work on the grid
    grows with the distinct values.
    """
    if method not in ("exact", "linear", "binned"):
        raise ValueError("method is 'exact', 'linear' or 'binned'")
    x = F.col(value).cast("double")
    keys = [by] if by else []
    src = df.select(*keys, x.alias("__x")).filter(F.col("__x").isNotNull())
    if by:
        src = src.filter(F.col(by).isNotNull())
    st = src.groupBy(*keys).agg(F.count("__x").alias("__n"), F.stddev_samp("__x").alias("__sd"),
                                F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    st = st.withColumn("__h", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))) \
        .withColumn("__lo", F.col("__mn") - cut * F.col("__h")) \
        .withColumn("__step", (F.col("__mx") + cut * F.col("__h") - F.col("__lo")) / (gridsize - 1))
    st, few = settled(st)
    if method == "exact":
        counted = src.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
        # One sum per grid point over the counted values: no row is multiplied by the grid.
        sums = [F.expr(f"sum(__c * exp(-0.5D * power(try_divide(__lo + {float(p)}D * __step - __x, __h), 2)))").alias(f"__s{p}")
                for p in range(gridsize)]
        one = join_group_stats(counted, st, keys, small=few).groupBy(*keys).agg(
            F.first("__lo").alias("__lo"), F.first("__step").alias("__step"),
            F.first(F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi)).alias("__norm"), *sums)
        points = F.array(*[F.struct(F.lit(p).cast("long").alias("point"), F.col(f"__s{p}").alias("__s")) for p in range(gridsize)])
        return one.select(*keys, "__lo", "__step", "__norm", F.inline(points)).select(
            *keys, "point", (F.col("__lo") + F.col("point").cast("double") * F.col("__step")).alias("x"),
            F.try_divide("__s", "__norm").alias("density"))
    rows = join_group_stats(src, st.select(*keys, "__mn", "__mx"), keys, small=few)
    spacing = (F.col("__mx") - F.col("__mn")) / fine_bins
    place = F.when(F.col("__mx") == F.col("__mn"), F.lit(0.0)).otherwise((F.col("__x") - F.col("__mn")) / spacing)
    cell = F.least(F.floor(place), F.lit(fine_bins - 1)).cast("long")
    # Two sums per occupied cell; at most ``fine_bins`` cells in a group.
    cells = rows.groupBy(*keys, cell.alias("__cell")).agg(F.count(F.lit(1)).cast("double").alias("__all"), F.sum(place - cell).alias("__right"))
    if method == "linear":
        ends = F.array(F.struct(F.col("__cell").cast("double").alias("__at"), (F.col("__all") - F.col("__right")).alias("__w")),
                       F.struct((F.col("__cell") + 1).cast("double").alias("__at"), F.col("__right").alias("__w")))
        cells = cells.select(*keys, F.inline(ends)).groupBy(*keys, "__at").agg(F.sum("__w").alias("__w"))
    else:
        cells = cells.select(*keys, (F.col("__cell") + 0.5).alias("__at"), F.col("__all").alias("__w"))
    # Each node reaches the points within KERNEL_REACH bandwidths: at most ``gridsize`` of them, for at most fine_bins + 1 nodes a group.
    reach = KERNEL_REACH * F.col("__h")
    centre = F.col("__mn") + F.col("__at") * F.when(F.col("__mx") == F.col("__mn"), F.lit(0.0)).otherwise(spacing)
    first = F.greatest(F.lit(0), F.ceil((centre - reach - F.col("__lo")) / F.col("__step")).cast("int"))
    last = F.least(F.lit(gridsize - 1), F.floor((centre + reach - F.col("__lo")) / F.col("__step")).cast("int"))
    near = join_group_stats(cells, st, keys, small=few).where(F.col("__h") > 0).select(*keys, "__w", "__lo", "__step", "__h", centre.alias("__t"), first.alias("__p0"), last.alias("__p1"))
    points = near.where("__p0 <= __p1").select(*keys, "__w", "__lo", "__step", "__h", "__t", F.explode(F.sequence("__p0", "__p1")).alias("__p"))
    z = (F.col("__lo") + F.col("__p").cast("double") * F.col("__step") - F.col("__t")) / F.col("__h")
    sums = points.groupBy(*keys, F.col("__p").cast("long").alias("point")).agg(F.sum(F.col("__w") * F.exp(z * z * -0.5)).alias("__s"))
    grid = st.select(*keys, "__lo", "__step", "__h", (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi)).alias("__norm"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gridsize - 1).cast("long"))).alias("point"))
    out = grid.join(small(sums) if few else sums, [*keys, "point"], "left")
    # Without a bandwidth the density is undefined.
    total = F.when(F.col("__h") > 0, F.coalesce("__s", F.lit(0.0)))
    return out.select(*keys, "point", (F.col("__lo") + F.col("point").cast("double") * F.col("__step")).alias("x"),
                      F.try_divide(total, F.col("__norm")).alias("density"))


# ------------------------------------------------------------------ trend line
def trend_line(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """AGG15: least-squares line of ``y`` on each ``x``: slope, intercept, r2, n."""
    yy = F.col(y).cast("double")
    aggs = []
    for i, c in enumerate(xs):
        xx = F.col(c).cast("double")
        aggs += [F.regr_slope(yy, xx).alias(f"__s{i}"), F.regr_intercept(yy, xx).alias(f"__i{i}"),
                 F.regr_r2(yy, xx).alias(f"__r{i}"), F.regr_count(yy, xx).alias(f"__n{i}")]
    one = df.agg(*aggs)
    return rows_from_one_row(one, [
        F.struct(F.lit(c).alias("x_column"), as_double(F.col(f"__s{i}")).alias("slope"),
                 as_double(F.col(f"__i{i}")).alias("intercept"), as_double(F.col(f"__r{i}")).alias("r2"),
                 F.col(f"__n{i}").cast("long").alias("n"))
        for i, c in enumerate(xs)])


Z95 = 1.959963984540054  # two-sided 95 % normal quantile


def trend_band(df: DataFrame, x: str, y: str, points: int = 100, z: float = Z95) -> DataFrame:
    """AGG16: fitted line and its 95 % band on a grid over the x range.

    Closed form ``yhat +- z * s * sqrt(1/n + (x0 - xbar)^2 / Sxx)``; ``bootstrap_band``
    is the resampled band that plotting libraries draw.
    """
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    st = df.agg(F.regr_slope(yy, xx).alias("b"), F.regr_intercept(yy, xx).alias("a"),
                F.regr_count(yy, xx).alias("n"), F.regr_avgx(yy, xx).alias("xbar"),
                F.regr_sxx(yy, xx).alias("sxx"), F.regr_syy(yy, xx).alias("syy"),
                F.regr_sxy(yy, xx).alias("sxy"),
                F.min(F.when(yy.isNotNull(), xx)).alias("mn"), F.max(F.when(yy.isNotNull(), xx)).alias("mx"))
    g = df.sparkSession.range(points).withColumnRenamed("id", "point").crossJoin(small(st))
    x0 = F.col("mn") + F.col("point").cast("double") * (F.col("mx") - F.col("mn")) / (points - 1)
    fit = F.col("a") + F.col("b") * x0
    sse = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    # Undefined for a constant x or fewer than three rows: null.
    s = F.sqrt(F.try_divide(sse, F.when(F.col("n") > 2, F.col("n") - 2)))
    half = F.lit(z) * s * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide((x0 - F.col("xbar")) ** 2, F.col("sxx")))
    return g.select(F.col("point").cast("long"), as_double(x0).alias("x"), as_double(fit).alias("fit"),
                    as_double(fit - half).alias("lower"), as_double(fit + half).alias("upper"))


#: Resamples whose counts come from one 128-bit hash, 32 bits each.
DRAWS = 4


def poisson_ends(least: float = 2.0 ** -33) -> list[float]:
    """P(X <= k) of a Poisson variable with mean 1, up to the k beyond which less than ``least`` lies."""
    ends, term, total = [], math.exp(-1.0), 0.0
    while True:
        total += term
        if 1.0 - total < least:
            return ends
        ends.append(total)
        term /= len(ends)


def bootstrap_band(df: DataFrame, x: str, y: str, key: str, points: int = 100, n_boot: int = 1000, level: float = 0.95,
                   seed: int = 42) -> DataFrame:
    """AGG16 as plotting libraries draw it: the fitted line on a grid over the x range and, per grid point, the
    percentiles of the lines of ``n_boot`` resamples.

    A Poisson bootstrap: a resample takes each row as often as a Poisson number with mean 1 says, drawn
    by hashing seed, row key and resample, so a rerun on other partitions gives the same band. One
    pass adds every row to the five moments of every resample; each task sends ``n_boot`` rows on,
    however many it read. Moments are taken about the means. Rows with a null x or y don't count;
    a resample without two different x is left out; a constant x or an empty table gives null bands."""
    src = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__k"), F.col(x).cast("double").alias("__x"),
                    F.col(y).cast("double").alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    st = src.agg(F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"),
                 F.regr_slope("__y", "__x").alias("__b"), F.regr_intercept("__y", "__x").alias("__a"))
    rows = with_stats(src, st).select("__k", (F.col("__x") - F.col("__mx")).alias("__x"), (F.col("__y") - F.col("__my")).alias("__y"))
    chunks = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // DRAWS) - 1))).alias("__chunk"))
    text = F.md5(F.concat_ws("|", F.lit("boot"), F.lit(str(seed)), F.col("__k"), F.col("__chunk").cast("string")))
    drawn = chunks.select("__x", "__y", "__chunk", text.alias("__t"))
    numbers = F.array(*[F.conv(F.substring("__t", 8 * j + 1, 8), 16, 10).cast("double") / float(1 << 32) for j in range(DRAWS)])
    each = drawn.select("__x", "__y", "__chunk", F.posexplode(numbers).alias("__j", "__u"))
    weight = F.lit(len(poisson_ends()))
    for k, end in reversed(list(enumerate(poisson_ends()))):
        weight = F.when(F.col("__u") < end, F.lit(k)).otherwise(weight)
    each = each.select("__x", "__y", (F.col("__chunk") * DRAWS + F.col("__j")).alias("__boot"), weight.cast("double").alias("__w"))
    w, xx, yy = F.col("__w"), F.col("__x"), F.col("__y")
    sums = each.where((w > 0) & (F.col("__boot") < n_boot)).groupBy("__boot").agg(
        F.sum(w).alias("s"), F.sum(w * xx).alias("sx"), F.sum(w * yy).alias("sy"), F.sum(w * xx * xx).alias("sxx"), F.sum(w * xx * yy).alias("sxy"))
    slope = F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"))
    lines = sums.select(slope.alias("__slope"), F.try_divide(F.col("sy") - slope * F.col("sx"), F.col("s")).alias("__at")).where("__slope IS NOT NULL")
    grid = st.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point"))
    grid = grid.withColumn("x", F.col("__lo") + F.col("point").cast("double") * (F.col("__hi") - F.col("__lo")) / (points - 1))
    # points x n_boot values.
    spread = grid.crossJoin(small(lines)).groupBy("point").agg(
        F.percentile(F.col("__my") + F.col("__at") + F.col("__slope") * (F.col("x") - F.col("__mx")), [(1 - level) / 2, (1 + level) / 2]).alias("__q"))
    out = grid.join(small(spread), "point", "left")
    return out.select("point", "x", (F.col("__a") + F.col("__b") * F.col("x")).alias("fit"), F.col("__q")[0].alias("lower"), F.col("__q")[1].alias("upper"))


# ------------------------------------------------------------------ grid counts
def with_cells(src: DataFrame, dims: Sequence[str], bins: int) -> DataFrame:
    """Rows with all ``dims`` present, and per dim ``bin_<dim>``, its equal-width cell between least and largest value."""
    src = src.filter(F.lit(True) if not dims else " AND ".join(f"`{d}` IS NOT NULL" for d in dims))
    x = [F.col(d).cast("double") for d in dims]
    st = src.agg(*[f(v).alias(f"__{n}{i}") for i, v in enumerate(x) for n, f in (("mn", F.min), ("mx", F.max))])
    ends = []
    for i in range(len(dims)):
        lo, hi = _hist_range(F.col(f"__mn{i}"), F.col(f"__mx{i}"))
        ends += [lo.alias(f"__lo{i}"), hi.alias(f"__hi{i}")]
    cells = [hist_bin(v, F.col(f"__lo{i}"), F.col(f"__hi{i}"), bins).alias(f"bin_{d}") for i, (d, v) in enumerate(zip(dims, x))]
    return with_stats(src, st.select(*ends)).select(*src.columns, *cells)


def grid_counts(df: DataFrame, dims: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """AGG17: the point cloud at scale: equal-width cells over ``dims`` (2 or 3)
    with row count and mean ``value`` per non-empty cell."""
    placed = with_cells(df.select(*dict.fromkeys([*dims, value])), dims, bins)
    return (placed.groupBy(*[f"bin_{d}" for d in dims]).agg(F.count(F.lit(1)).cast("long").alias("count"),
                                                            as_double(F.avg(F.col(value).cast("double"))).alias("mean_value")))


def scatter_sample(df: DataFrame, key: str, dims: Sequence[str], per_cell: int = 5, bins: int = 10, seed: int = 42) -> DataFrame:
    """AGG17 points: of every occupied cell of the grid over ``dims`` the ``per_cell`` rows with the smallest key
    hashes (all where there are fewer), so sparse regions are seen and the size is exact. Adds bin_<dim> and rank_in_cell.

    The hash has a salt of its own, so the sample is independent of the train/test split. The limit on the
    rank is applied in every task before the shuffle, so a cell with most rows moves a few rows per task."""
    placed = with_cells(df, dims, bins).withColumn("__h", key_hash(key, seed, "scatter"))
    smallest = Window.partitionBy(*[f"bin_{d}" for d in dims]).orderBy("__h", key)
    ranked = placed.withColumn("rank_in_cell", F.row_number().over(smallest)).filter(F.col("rank_in_cell") <= per_cell)
    return ranked.withColumn("rank_in_cell", F.col("rank_in_cell").cast("long")).drop("__h")


# ---------------------------------------------------------------- crosstab
#: Most columns a contingency table may have.
MAX_COLUMNS = 1000


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str] | None = None) -> DataFrame:
    """AGG10: contingency table, one column per value of ``cols``; null keys left
    out. Without ``values`` a distinct pass finds them all, so none is lost; more
    than ``MAX_COLUMNS`` is an error."""
    src = df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    if values is None:
        values = [str(r[0]) for r in src.select(F.col(cols).cast("string")).distinct().sort(cols).limit(MAX_COLUMNS + 1).collect()]
        if len(values) > MAX_COLUMNS:
            raise ValueError(f"{cols} has more than {MAX_COLUMNS} values")
    return (src.groupBy(rows).agg(*[F.sum((F.col(cols) == v).cast("long")).alias(v) for v in values]))
