"""Models: closed forms and OLS against NumPy, metrics against formulas, tree fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.operators import models

RNG = np.random.default_rng(11)


def _data(spark, n=300):
    x1 = RNG.normal(40, 12, n)
    x2 = RNG.normal(60, 25, n)
    y = 5 + 0.3 * x1 - 0.2 * x2 + RNG.normal(0, 3, n)
    pdf = pd.DataFrame({"k": np.arange(n), "x1": x1, "x2": x2, "x3": (x2 - x2.min()) / (x2.max() - x2.min()), "y": y})
    return spark.createDataFrame(pdf), pdf


def test_closed_form_matches_lstsq(spark):
    df, pdf = _data(spark)
    coefs = models.closed_form_coefficients(df, "y", {"m1": ("x1",), "m2": ("x1", "x2")}).first()
    X = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    b = np.linalg.lstsq(X, pdf.y, rcond=None)[0]
    assert (coefs["m2_b0"], coefs["m2_b1"], coefs["m2_b2"]) == pytest.approx(tuple(b), rel=1e-8)
    b1 = np.polyfit(pdf.x1, pdf.y, 1)
    assert (coefs["m1_b1"], coefs["m1_b0"]) == pytest.approx(tuple(b1), rel=1e-8)


def test_fit_ols_min_norm_on_collinear_columns(spark):
    df, pdf = _data(spark)
    from spendlens.operators import scale
    cols = ["x1", "x2", "x3"]
    sdf = scale.standardise(df, cols)
    m = models.fit_ols(sdf, cols, "y")
    Z = sdf.orderBy("k").toPandas()[cols].to_numpy()
    Xc = Z - Z.mean(0)
    b = np.linalg.lstsq(Xc, pdf.y - pdf.y.mean(), rcond=1e-10)[0]
    assert m.coefficients == pytest.approx(b.tolist(), abs=1e-6)
    assert m.coefficients[1] == pytest.approx(m.coefficients[2], abs=1e-6)   # equal split
    pred = m.transform(sdf).select("y", "prediction").toPandas()
    resid = pred.y - pred.prediction
    assert abs(np.dot(resid, Xc[:, 0])) < 1e-6 * len(resid)               # residuals orthogonal


def test_regression_metrics_formulas(spark):
    y = np.array([3.0, 5.0, 2.0, 8.0])
    p = np.array([2.5, 5.5, 2.0, 6.0])
    df = spark.createDataFrame([("m", 0, "test", float(a), float(b)) for a, b in zip(y, p)],
                               "model string, model_order long, split string, actual double, predicted double")
    r = models.regression_metrics(df).first()
    sse = ((y - p) ** 2).sum()
    assert r["rmse"] == pytest.approx(np.sqrt(sse / 4), abs=1e-6)
    assert r["mae"] == pytest.approx(np.abs(y - p).mean(), abs=1e-6)
    assert r["r2"] == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum(), abs=1e-6)


def test_best_model_tie_goes_to_first(spark):
    cmp = spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.5), ("c", 2, 0.4)], "model string, model_order long, test_r2 double")
    assert models.best_model(cmp).first()["model"] == "a"


def test_labels(spark):
    df = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.1,), (0.7,)], "r double")
    got = [r[0] for r in df.select(models.performance_label(F.col("r"))).collect()]
    assert got == ["Excellent", "Good", "Moderate", "Poor", "Good"]
    got = [r[0] for r in df.select(models.alignment_label(F.col("r"))).collect()]
    assert got == ["good", "good", "moderate", "moderate", "good"]


def test_forest_reproducible_and_importances(spark):
    df, _ = _data(spark, 200)
    df = models.assemble(df, ["x1", "x2"]).repartition(2, "k").sortWithinPartitions("k")
    est = models.forest_estimator("y", numTrees=5, maxDepth=3)
    a = est.fit(df).transform(df).select("k", "prediction").orderBy("k").collect()
    b = est.fit(df).transform(df).select("k", "prediction").orderBy("k").collect()
    assert a == b
    imp = models.importance_table(est.fit(df), ["x1", "x2"]).toPandas()
    assert imp["importance"].sum() == pytest.approx(1.0) and imp["rank"].tolist() == [1, 2]


def test_grid_mapping():
    est = models.forest_estimator("y")
    full = models.forest_param_maps(est, models.FOREST_GRIDS["full"])
    fast = models.forest_param_maps(est, models.FOREST_GRIDS["fast"])
    assert len(fast) == 12 and len(full) == 60
    assert models.min_instances(10, 1) == 5 and models.depth(None) == 30
    g = models.boosting_param_maps(models.boosting_estimator("y"), models.BOOSTING_GRIDS["full"])
    assert len(g) == 54


def test_grid_search_small(spark):
    df, _ = _data(spark, 150)
    from spendlens.operators import split
    df = models.assemble(df, ["x1", "x2"]).withColumn("fold", split.fit_split(df, "k", 0.0, folds=3).fold())
    est = models.forest_estimator("y")
    cvm, res = models.grid_search(df, est, models.forest_param_maps(est, {"n_estimators": [5], "max_depth": [2, 4]}),
                                  "y", "fold", 2)
    rows = res.collect()
    assert len(rows) == 2 and sum(r["best"] for r in rows) == 1
    best = max(rows, key=lambda r: r["mean_neg_mse"])
    assert best["best"]


def test_original_input_importance_keeps_rank(spark):
    from spendlens.operators import models
    imp = spark.createDataFrame([("age", 0.5, 1), ("age_squared", 0.3, 2), ("gender", 0.2, 3)],
                                "feature string, importance double, rank long")
    got = [(r["feature"], r["rank"]) for r in models.original_input_importance(imp).orderBy("rank").collect()]
    assert got == [("age", 1), ("gender", 3)]


def test_best_model_uses_all_digits(spark):
    rows = [("first", 0, "test", 0.5000001), ("second", 1, "test", 0.5000004)]
    metrics = spark.createDataFrame(rows, "model string, model_order long, split string, r2 double").selectExpr("*", "0D AS rmse", "0D AS mae")
    assert models.best_model(models.model_comparison(metrics)).first()["model"] == "second"


def test_constant_input_has_null_coefficients(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert tuple(models.closed_form_coefficients(df, "y", {"m": ["x"]}).first()) == (None, None)
