"""Residual analysis on a long prediction table (RES1-RES7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.util import as_double
from spendlens.operators import eda


def choose(pred: DataFrame, model: str | DataFrame, split: str | None = "test") -> DataFrame:
    """RES7: the rows of one model (by name, or the one-row best-model frame)."""
    if isinstance(model, DataFrame):
        # One row (a top-1 frame), capped again here: the broadcast is bounded.
        out = pred.join(F.broadcast(model.select("model").limit(1)), "model", "left_semi")
    else:
        out = pred.filter(F.col("model") == model)
    return out.filter(F.col("split") == split) if split else out


def residuals(pred: DataFrame) -> DataFrame:
    """RES1 / RES3: residual = actual - predicted."""
    return pred.withColumn("residual", F.col("actual") - F.col("predicted"))


def perfect_fit_line(pred: DataFrame) -> DataFrame:
    """RES2: ends of the y = x line over actual and predicted values together."""
    return pred.agg(as_double(F.least(F.min("actual"), F.min("predicted"))).alias("line_min"),
                    as_double(F.greatest(F.max("actual"), F.max("predicted"))).alias("line_max"),
                    F.count(F.lit(1)).cast("long").alias("n"))


def residual_histogram(pred: DataFrame, bins: int = 20) -> DataFrame:
    """RES4: residual histogram."""
    return eda.histogram(residuals(pred), "residual", bins)


# Residual wording thresholds of the reports.
RANDOM_BELOW = 5.0
NORMAL_BELOW = 3.0


def residual_bias(pred: DataFrame) -> DataFrame:
    """RES6: mean residual and the two bias labels."""
    r = residuals(pred)
    one = r.agg(F.avg("residual").alias("m"), F.count("residual").alias("n"))
    a = F.abs(F.col("m"))
    return one.select(F.col("n").cast("long"), as_double("m").alias("mean_residual"),
                      F.when(a < RANDOM_BELOW, "random").otherwise("some systematic").alias("pattern"),
                      F.when(a < NORMAL_BELOW, "normal").otherwise("some deviation").alias("shape"))
