"""Model training and evaluation (MOD1-MOD18).

Two families:

* closed-form least squares on one or two inputs, written as aggregates
  (``covar_pop`` / ``var_pop``) so the coefficients stay a lazy one-row
  frame and SQL can repeat them;
* ``pyspark.ml`` regressors on the twelve scaled features: linear
  (l-bfgs, which splits collinear weights equally like a minimum-norm
  solve), random forest and gradient-boosted trees, with grid search over
  hash folds.

Metrics for any number of models and both splits are one grouped aggregate.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.util import as_double, small

# ------------------------------------------------------- closed-form OLS

def closed_form_coefficients(df: DataFrame, y: str, models: Mapping[str, Sequence[str]],
                             where: Column | None = None) -> DataFrame:
    """One row with ``{model}_b0``, ``{model}_b1`` [, ``{model}_b2``] per model.

    One input: slope = cov(x, y) / var(x). Two inputs: the 2x2 normal
    equations on population (co)variances, solved by Cramer's rule.
    Rows with a null in ``y`` or the model's inputs are left out per model; a
    constant or collinear input gives null coefficients.
    """
    src = df.filter(where) if where is not None else df
    aggs, outs = [], []
    yy = F.col(y).cast("double")
    for m, xs in models.items():
        ok = yy.isNotNull()
        for x in xs:
            ok = ok & F.col(x).isNotNull()
        f = lambda c: F.when(ok, F.col(c).cast("double"))
        fy = F.when(ok, yy)
        aggs.append(F.avg(fy).alias(f"{m}__my"))
        for i, x in enumerate(xs):
            aggs += [F.avg(f(x)).alias(f"{m}__m{i}"), F.covar_pop(f(x), fy).alias(f"{m}__c{i}y")]
            for j in range(i, len(xs)):
                aggs.append(F.covar_pop(f(x), f(xs[j])).alias(f"{m}__c{i}{j}"))
        c = lambda n: F.col(f"{m}__{n}")
        if len(xs) == 1:
            b = [F.try_divide(c("c0y"), c("c00"))]
        elif len(xs) == 2:
            det = c("c00") * c("c11") - c("c01") * c("c01")
            b = [F.try_divide(c("c11") * c("c0y") - c("c01") * c("c1y"), det),
                 F.try_divide(c("c00") * c("c1y") - c("c01") * c("c0y"), det)]
        else:
            raise ValueError("closed form covers one or two inputs; use fit_ols for more")
        b0 = c("my")
        for i, bi in enumerate(b):
            b0 = b0 - bi * c(f"m{i}")
        outs.append(b0.alias(f"{m}_b0"))
        outs += [bi.alias(f"{m}_b{i + 1}") for i, bi in enumerate(b)]
    return src.agg(*aggs).select(*outs)


def closed_form_predictions(df: DataFrame, coefs: DataFrame | dict, y: str, models: Mapping[str, Sequence[str]],
                            keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions (model, model_order, *keep, actual, predicted): one scan
    of ``df`` computes every model, ``inline`` unpivots them. ``coefs`` is the
    one-row frame (joined as a broadcast) or its frozen values (literals)."""
    if isinstance(coefs, dict):
        j, b = df, (lambda n: F.lit(coefs[n]).cast("double"))
    else:
        j, b = df.crossJoin(small(coefs)), (lambda n: F.col(n))
    structs = []
    for k, (m, xs) in enumerate(models.items()):
        p = b(f"{m}_b0")
        for i, x in enumerate(xs):
            p = p + b(f"{m}_b{i + 1}") * F.col(x).cast("double")
        structs.append(F.struct(F.lit(m).alias("model"), F.lit(k).cast("long").alias("model_order"),
                                p.alias("predicted")))
    return j.select(*keep, F.col(y).cast("double").alias("actual"), F.inline(F.array(*structs))) \
        .select("model", "model_order", *keep, "actual", "predicted")


# ---------------------------------------------------------------- metrics
def regression_metrics(pred: DataFrame, by: Sequence[str] = ("model", "model_order", "split"),
                       actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MOD10: RMSE, MAE and R2 per group in one aggregate.
    R2 = 1 - SSE / SST with SST around the group's own mean; a constant target
    gives 1 for a perfect fit and 0 otherwise (sklearn's finite rule)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    src = pred.filter(y.isNotNull() & p.isNotNull())
    g = src.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("__mse"),
                             F.avg(F.abs(e)).alias("__mae"), F.sum(e * e).alias("__sse"),
                             (F.var_pop(y) * F.count(y)).alias("__sst"))
    r2 = F.when(F.col("__sst") == 0, F.when(F.col("__sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
        .otherwise(F.lit(1.0) - F.col("__sse") / F.col("__sst"))
    return g.select(*by, F.col("n").cast("long"), as_double(F.sqrt("__mse")).alias("rmse"), as_double("__mae").alias("mae"),
                    as_double(r2).alias("r2"))


def model_comparison(metrics: DataFrame) -> DataFrame:
    """MOD11: one row per model with train/test RMSE, MAE and R2."""
    def pick(split, m):
        return F.max(F.when(F.col("split") == split, F.col(m))).alias(f"{split}_{m}")
    return metrics.groupBy("model", "model_order").agg(
        pick("train", "rmse"), pick("test", "rmse"), pick("train", "mae"), pick("test", "mae"),
        pick("train", "r2"), pick("test", "r2"))


def best_model(comparison: DataFrame) -> DataFrame:
    """MOD12: highest test R2; ties go to the first model in order."""
    return comparison.orderBy(F.col("test_r2").desc_nulls_last(), F.col("model_order").asc()).limit(1)


# Performance wording of the reports (lowest label is a parameter).
PERFORMANCE_CUTS = ((0.7, "Excellent"), (0.5, "Good"), (0.3, "Moderate"))


def performance_label(r2: Column, lowest: str = "Poor") -> Column:
    """MOD17: > 0.7 Excellent, > 0.5 Good, > 0.3 Moderate, else ``lowest``."""
    expr = None
    for cut, lab in PERFORMANCE_CUTS:
        expr = F.when(r2 > cut, lab) if expr is None else expr.when(r2 > cut, lab)
    return expr.otherwise(lowest)


def alignment_label(r2: Column) -> Column:
    """MOD18: R2 > 0.5 good, else moderate."""
    return F.when(r2 > 0.5, "good").otherwise("moderate")


# ------------------------------------------------------------ pyspark.ml fits
FEATURES_COL = "features"


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES_COL) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


class OlsModel:
    """Least squares on named columns: prediction = intercept + sum(coef * column).

    Fitted from one aggregate pass (means and population co-moments of the
    k inputs and the label, k*(k+3)/2 + 2 numbers) and a k x k minimum-norm
    solve on the driver: the SVD least-squares answer, so exactly collinear
    inputs share their weight equally. The matrix grows with the number of
    features, not rows.
    """

    def __init__(self, features: Sequence[str], coefficients, intercept: float, label: str = "label"):
        self.features = list(features)
        self.coefficients = [float(c) for c in coefficients]
        self.intercept = float(intercept)
        self.label = label

    def predict_col(self) -> Column:
        expr = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients):
            expr = expr + F.lit(c) * F.col(f).cast("double")
        return expr

    def transform(self, df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
        return df.withColumn(prediction_col, self.predict_col())

    def to_dict(self) -> dict:
        return {"features": self.features, "coefficients": self.coefficients, "intercept": self.intercept,
                "label": self.label}

    @classmethod
    def from_dict(cls, d: dict) -> "OlsModel":
        return cls(d["features"], d["coefficients"], d["intercept"], d.get("label", "label"))


def fit_ols(train: DataFrame, features: Sequence[str], label: str, rcond: float = 1e-10) -> OlsModel:
    """MOD1: ordinary least squares with intercept (sklearn's LinearRegression)."""
    import numpy as np
    k = len(features)
    ok = F.col(label).isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    src = train.filter(ok)
    x = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    aggs = [F.avg(y).alias("my")] + [F.avg(xi).alias(f"m{i}") for i, xi in enumerate(x)]
    aggs += [F.covar_pop(x[i], y).alias(f"cy{i}") for i in range(k)]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    r = src.agg(*aggs).first()
    cxx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cxx[i, j] = cxx[j, i] = r[f"c{i}_{j}"] or 0.0
    cxy = np.array([r[f"cy{i}"] or 0.0 for i in range(k)])
    b = np.linalg.lstsq(cxx, cxy, rcond=rcond)[0] if k else np.zeros(0)
    intercept = (r["my"] or 0.0) - float(sum(b[i] * (r[f"m{i}"] or 0.0) for i in range(k)))
    return OlsModel(features, b, intercept, label)


def forest_estimator(label: str, features: str = FEATURES_COL, seed: int = 42, **kw) -> RandomForestRegressor:
    """MOD2: bootstrap forest over all features at each split."""
    # Node ids cached and checkpointed every 10 iterations (when the cluster names a
    # checkpoint folder): deep trees keep a short lineage and survive lost executors.
    est = RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed, featureSubsetStrategy="all",
                                maxBins=kw.pop("maxBins", 256), cacheNodeIds=True, checkpointInterval=10)
    return est.setParams(**kw) if kw else est


def boosting_estimator(label: str, features: str = FEATURES_COL, seed: int = 42, **kw) -> GBTRegressor:
    """MOD3: squared-loss boosting. Fit on the label minus its mean (see fit_boosting)."""
    est = GBTRegressor(featuresCol=features, labelCol=label, seed=seed, lossType="squared",
                       maxBins=kw.pop("maxBins", 256), cacheNodeIds=True, checkpointInterval=10)
    return est.setParams(**kw) if kw else est


def min_instances(min_samples_split: int, min_samples_leaf: int) -> int:
    """Spark has no minimum-rows-to-split: a leaf minimum of max(l, ceil(s/2)) keeps both rules."""
    return max(min_samples_leaf, math.ceil(min_samples_split / 2))


def depth(max_depth) -> int:
    """Unlimited depth becomes 30, Spark's limit."""
    return 30 if max_depth is None else int(max_depth)


# The reference's grids (D7), parameter names as in the reference.
FOREST_GRIDS = {
    "full": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None],
             "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "fast": {"n_estimators": [50, 100], "max_depth": [5, 10, None], "min_samples_split": [2, 5]},
}
BOOSTING_GRIDS = {
    "full": {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.2],
             "subsample": [0.8, 1.0]},
    "fast": {"n_estimators": [50, 100], "max_depth": [3, 5], "learning_rate": [0.1, 0.2]},
}
FOLDS = {"full": 5, "fast": 3}


def _settings(grid: Mapping[str, list]) -> list[dict]:
    """Settings in the reference's order: names sorted, last name fastest."""
    names = sorted(grid)
    return [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]


def forest_param_maps(est: RandomForestRegressor, grid: Mapping[str, list]) -> list[dict]:
    """Map forest settings to Spark params; settings that map to the same
    Spark params are kept once (the first)."""
    seen, maps = set(), []
    for s in _settings(grid):
        p = (int(s.get("n_estimators", 100)), depth(s.get("max_depth")),
             min_instances(s.get("min_samples_split", 2), s.get("min_samples_leaf", 1)))
        if p in seen:
            continue
        seen.add(p)
        maps.append({est.numTrees: p[0], est.maxDepth: p[1], est.minInstancesPerNode: p[2]})
    return maps


def boosting_param_maps(est: GBTRegressor, grid: Mapping[str, list]) -> list[dict]:
    maps = []
    for s in _settings(grid):
        maps.append({est.maxIter: int(s.get("n_estimators", 100)), est.maxDepth: depth(s.get("max_depth", 3)),
                     est.stepSize: float(s.get("learning_rate", 0.1)),
                     est.subsamplingRate: float(s.get("subsample", 1.0))})
    return maps


def grid_search(train: DataFrame, est, param_maps: list[dict], label: str, fold_col: str,
                parallelism: int = 4):
    """MOD4-MOD8: k-fold search on MSE over a fold column, refit on all
    training rows. Returns (CrossValidatorModel, results DataFrame)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mse")
    cv = CrossValidator(estimator=est, estimatorParamMaps=param_maps, evaluator=ev, foldCol=fold_col,
                        parallelism=parallelism, collectSubModels=False)
    k = int(train.agg(F.countDistinct(fold_col)).first()[0])
    cv.setNumFolds(k)
    m = cv.fit(train)
    rows = [({p.name: (float(v) if isinstance(v, float) else int(v)) for p, v in pm.items()}, float(score))
            for pm, score in zip(param_maps, m.avgMetrics)]
    spark = train.sparkSession
    res = spark.createDataFrame(
        [(i, str(sorted(p.items())), -s, i == min(range(len(rows)), key=lambda j: (rows[j][1], j)))
         for i, (p, s) in enumerate(rows)],
        "setting long, params string, mean_neg_mse double, best boolean")
    return m, res


def _coefs(model) -> list[float]:
    c = model.coefficients
    return list(c.toArray()) if hasattr(c, "toArray") else list(c)


def coefficient_table(model, features: Sequence[str]) -> DataFrame:
    """MOD13: linear coefficients, largest absolute value first (12 rows)."""
    from pyspark.sql import SparkSession
    rows = [(f, float(c)) for f, c in zip(features, _coefs(model))]
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, coefficient double")
    return df.orderBy(F.abs("coefficient").desc(), "feature")


def importance_table(model, features: Sequence[str]) -> DataFrame:
    """MOD14 / MOD15: tree importances (sum 1) or absolute linear coefficients,
    with a rank; ``orderBy(...).limit(k)`` gives the top k."""
    from pyspark.sql import SparkSession
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    else:
        vals = [abs(v) for v in _coefs(model)]
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # 12 rows: one small task
    return df.withColumn("rank", F.row_number().over(w).cast("long"))


# The original inputs the report names when it reads the importance table.
ORIGINAL_INPUTS = ("age", "annual_income_k", "gender")


def original_input_importance(importance: DataFrame, inputs: Sequence[str] = ORIGINAL_INPUTS) -> DataFrame:
    """MOD16: the rows of the importance table for the original inputs, with
    their overall rank kept."""
    return importance.filter(F.col("feature").isin(*inputs))
