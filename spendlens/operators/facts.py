"""SEG12: every number or label the reports print, as one fact table
(section, metric, value, label). Each section is a small aggregate; the
union is a handful of rows. Pass a persisted input when calling it on a
large table: every section reads it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions import bands
from spendlens.functions.util import as_double, with_stats
from spendlens.operators import eda, models, ranks, residuals, segments
from spendlens.schema import AGE, GENDER, INCOME, TARGET

FACT_SCHEMA = "section string, metric string, value double, label string"


def fact(section: str, metric: str | Column, value: Column, label: Column | None = None) -> Column:
    m = F.lit(metric) if isinstance(metric, str) else metric
    return F.struct(F.lit(section).alias("section"), m.alias("metric"), as_double(value).alias("value"),
                    (label if label is not None else F.lit(None).cast("string")).alias("label"))


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*structs)))


def report_facts(customers: DataFrame, pred: DataFrame, best: DataFrame) -> DataFrame:
    """``customers``: the base table; ``pred``: long predictions of the chosen
    model (split, actual, predicted, age, income); ``best``: the chosen model's
    row of the comparison table (MOD11/MOD12).

    Three passes in all: one conditional aggregate over the customers (dataset
    facts, correlations, open-ended band means), one grouped by gender, one
    conditional aggregate over the predictions (residual bias, segment sizes,
    high and low spenders).
    """
    y = F.col(TARGET).cast("double")
    a, inc = F.col(AGE).cast("double"), F.col(INCOME).cast("double")
    age_band = bands.cut(AGE, bands.AGE_EDGES, bands.AGE_LABELS, open_ends=True)
    inc_band = bands.cut(INCOME, bands.INCOME_EDGES, bands.INCOME_LABELS, open_ends=True)
    band_aggs = [F.avg(F.when(age_band == lab, y)).alias(f"ab{i}") for i, lab in enumerate(bands.AGE_LABELS)]
    band_aggs += [F.avg(F.when(inc_band == lab, y)).alias(f"ib{i}") for i, lab in enumerate(bands.INCOME_LABELS)]
    one = customers.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"),
                        F.stddev_samp(y).alias("sd"), F.avg(a).alias("ma"), F.avg(inc).alias("mi"),
                        F.corr(a, y).alias("ca"), F.corr(inc, y).alias("ci"), *band_aggs)
    one = with_stats(one, ranks.summary(customers, [TARGET], probs=(0.5,)).select(F.col("q")[0].alias("md")))

    def corr_label(c):
        return F.concat_ws(" ", eda.strength_label(F.col(c)), F.when(F.col(c) < 0, "negative").otherwise("positive"))
    parts = [_rows(one, [
        fact("dataset", "total_customers", F.col("n")),
        fact("dataset", "features", F.lit(len(customers.columns) - 1)),
        fact("dataset", "mean_spending_score", F.col("my")),
        fact("dataset", "median_spending_score", F.col("md")),
        fact("dataset", "std_spending_score", F.col("sd")),
        fact("dataset", "mean_age", F.col("ma")),
        fact("dataset", "mean_annual_income", F.col("mi")),
        fact("correlation", "age", F.col("ca"), corr_label("ca")),
        fact("correlation", "annual_income_k", F.col("ci"), corr_label("ci")),
    ] + [fact("age_band", lab, F.col(f"ab{i}")) for i, lab in enumerate(bands.AGE_LABELS)]
      + [fact("income_band", lab, F.col(f"ib{i}")) for i, lab in enumerate(bands.INCOME_LABELS)])]
    # Gender (AGG5).
    gs = eda.group_spread(customers, GENDER, TARGET)
    parts.append(gs.select(F.inline(F.array(fact("gender", F.concat(F.col(GENDER), F.lit("_mean")), F.col("mean")),
                                            fact("gender", F.concat(F.col(GENDER), F.lit("_count")), F.col("count"))))))
    # Best model (MOD10-MOD12, MOD17).
    r2 = F.col("test_r2")
    parts.append(_rows(best, [fact("model", m, F.col(m), F.col("model")) for m in
                              ("train_rmse", "test_rmse", "train_mae", "test_mae", "train_r2", "test_r2")] +
                       [fact("model", "performance", r2 * 100, models.performance_label(r2))]))
    # Predictions: residual bias (RES6), segment sizes (SEG5), high/low spenders (AGG9).
    p = F.col("predicted")
    seg = segments.segment(p, "cut", "segment")
    cat = segments.segment(p, "cut", "category")
    hi, lo = cat.isin(*segments.HIGH_CATEGORIES), cat.isin(*segments.LOW_CATEGORIES)
    res = F.when(F.col("split") == "test", F.col("actual") - p)
    pa = pred.agg(F.avg(res).alias("mres"),
                  *[F.sum((seg == lab).cast("long")).alias(f"s{i}") for i, lab in enumerate(bands.SEGMENT_LABELS)],
                  F.sum(hi.cast("long")).alias("hn"), F.avg(F.when(hi, a)).alias("ha"), F.avg(F.when(hi, inc)).alias("hi"),
                  F.sum(lo.cast("long")).alias("ln"), F.avg(F.when(lo, a)).alias("la"), F.avg(F.when(lo, inc)).alias("li"))
    m = F.abs(F.col("mres"))
    bias = F.concat_ws(", ", F.when(m < residuals.RANDOM_BELOW, "random").otherwise("some systematic"),
                       F.when(m < residuals.NORMAL_BELOW, "normal").otherwise("some deviation"))
    parts.append(_rows(pa, [fact("residuals", "mean_residual", F.col("mres"), bias)]
                       + [fact("segments", lab, F.coalesce(F.col(f"s{i}"), F.lit(0)))
                          for i, lab in enumerate(bands.SEGMENT_LABELS)]
                       + [fact("spenders", "high_customers", F.coalesce(F.col("hn"), F.lit(0)), F.lit(segments.HIGH_FOCUS)),
                          fact("spenders", "high_mean_age", F.col("ha")),
                          fact("spenders", "high_mean_income", F.col("hi")),
                          fact("spenders", "low_customers", F.coalesce(F.col("ln"), F.lit(0)), F.lit(segments.LOW_FOCUS)),
                          fact("spenders", "low_mean_age", F.col("la")),
                          fact("spenders", "low_mean_income", F.col("li"))]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
