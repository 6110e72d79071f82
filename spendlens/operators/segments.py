"""Scoring output: segments, segment profiles, marketing focus (SEG2-SEG11, AGG7-AGG10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions import bands
from spendlens.functions.util import as_double, small
from spendlens.schema import AGE, GENDER, INCOME, KEY, TARGET

# The marketing focus texts of the reports, by segment group.
HIGH_FOCUS = "Premium products, loyalty programs, exclusive offers"
LOW_FOCUS = "Discount campaigns, budget-friendly options, value propositions"
HIGH_CATEGORIES = ("High", "Very High")
LOW_CATEGORIES = ("Low",)


def segment(score: Column | str, mode: str = "cut", labels: str | Sequence[str] | None = None) -> Column:
    """SEG2-SEG4: ``mode="cut"`` right-closed (0,30],(30,50],(50,70],(70,100], null
    outside; ``mode="threshold"`` left-closed <30, <50, <70, else, never null."""
    if mode == "cut":
        return bands.score_band(score, labels or "segment")
    return bands.score_threshold(score, labels or "threshold")


def segment_counts(df: DataFrame, seg: str, labels: Sequence[str]) -> DataFrame:
    """SEG5: customers per segment, empty segments kept, share of segmented rows."""
    lab = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], f"position long, {seg} string")
    g = df.filter(F.col(seg).isNotNull()).groupBy(seg).agg(F.count(F.lit(1)).alias("count"))
    j = lab.join(g, seg, "left").select("position", seg, F.coalesce("count", F.lit(0)).cast("long")
                                               .alias("count"))
    tot = g.agg(F.sum("count").alias("__t"))
    return j.crossJoin(small(tot)).select("position", seg, "count",
                                          as_double(F.try_divide(F.col("count") * 100.0, F.col("__t"))).alias("pct"))


def segment_profile(df: DataFrame, seg: str, labels: Sequence[str], age: str = AGE, income: str = INCOME,
                    gender: str = GENDER) -> DataFrame:
    """AGG7: mean age, mean income (2 digits, half-even) and most frequent
    gender per segment; empty segments kept with N/A. Mode ties go to the
    smallest value. ``mode`` keeps a value -> count map per group, bounded
    by the distinct genders."""
    lab = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], f"position long, {seg} string")
    g = (df.filter(F.col(seg).isNotNull()).groupBy(seg)
         .agg(F.bround(F.avg(F.col(age).cast("double")), 2).alias("mean_age"),
              F.bround(F.avg(F.col(income).cast("double")), 2).alias("mean_income"),
              F.mode(F.col(gender), True).alias("top_gender")))
    return (lab.join(g, seg, "left")
            .select("position", seg, as_double("mean_age").alias("mean_age"), as_double("mean_income").alias("mean_income"),
                    F.coalesce("top_gender", F.lit("N/A")).alias("top_gender")))


def high_low_summary(df: DataFrame, category: str, age: str = AGE, income: str = INCOME) -> DataFrame:
    """AGG9 + SEG11: high (High, Very High) and low (Low) customers: count,
    mean age, mean income and the marketing focus; one conditional aggregate."""
    c = F.col(category)
    hi, lo = c.isin(*HIGH_CATEGORIES), c.isin(*LOW_CATEGORIES)
    a, inc = F.col(age).cast("double"), F.col(income).cast("double")
    one = df.agg(F.sum(hi.cast("long")).alias("hn"), F.avg(F.when(hi, a)).alias("ha"),
                 F.avg(F.when(hi, inc)).alias("hi"), F.sum(lo.cast("long")).alias("ln"),
                 F.avg(F.when(lo, a)).alias("la"), F.avg(F.when(lo, inc)).alias("li"))
    return one.select(F.inline(F.array(
        F.struct(F.lit("high").alias("group"), F.coalesce("hn", F.lit(0)).cast("long").alias("customers"),
                 as_double("ha").alias("mean_age"), as_double("hi").alias("mean_income"), F.lit(HIGH_FOCUS).alias("focus")),
        F.struct(F.lit("low").alias("group"), F.coalesce("ln", F.lit(0)).cast("long").alias("customers"),
                 as_double("la").alias("mean_age"), as_double("li").alias("mean_income"), F.lit(LOW_FOCUS).alias("focus")))))


def marketing_focus(df: DataFrame, category: str) -> DataFrame:
    """SEG11: focus text per customer from its spending category (broadcast
    join against a literal table of four rows)."""
    spark = df.sparkSession
    lit = spark.createDataFrame([(v, HIGH_FOCUS) for v in HIGH_CATEGORIES] +
                                [(v, LOW_FOCUS) for v in LOW_CATEGORIES], f"{category} string, focus string")
    return df.join(small(lit), category, "left")


def prediction_table(df: DataFrame, predicted: str = "predicted", segment_col: str = "segment",
                     key: str = KEY, age: str = AGE, gender: str = GENDER, income: str = INCOME,
                     target: str = TARGET) -> DataFrame:
    """SEG8 / PRJ5: the exported per-customer table with the reference's names."""
    return df.select(
        F.col(key).alias("CustomerID"), F.col(age).alias("Age"), F.col(gender).alias("Gender"),
        F.col(income).alias("Annual_Income_k"), F.col(target).alias("Actual_Spending_Score"),
        as_double(predicted).alias("Predicted_Spending_Score"), F.col(segment_col).alias("Customer_Segment"),
        as_double(F.abs(F.col(target) - F.col(predicted))).alias("Prediction_Error"))
