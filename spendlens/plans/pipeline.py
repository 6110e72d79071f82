"""fit / score: the whole pipeline with frozen state.

``fit`` runs fill -> derive -> encode -> split -> scale -> train on a
customer DataFrame and returns a :class:`FittedPipeline` holding every
statistic as a literal (income min/max, code tables, scaler) and the
``pyspark.ml`` models. ``score`` applies it lazily to any DataFrame of new
customers: a narrow plan (no shuffle beyond the optional ordered fill),
no driver step, any number of rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.regression import (GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.util import r6
from spendlens.operators import encode, features, fill, models, projections, scale, segments, split
from spendlens.schema import AGE, GENDER, INCOME, KEY, MODEL_FEATURES, REQUIRED_FOR_SCORING, TARGET
from spendlens.session import checkpoint_dir

MODEL_ORDER = ("linear", "forest", "boosting")
MODEL_NAMES = {"linear": "Linear Regression", "forest": "Random Forest", "boosting": "Gradient Boosting"}
_LOADERS = {"linear": LinearRegressionModel, "forest": RandomForestRegressionModel, "boosting": GBTRegressionModel}
TEXT_FEATURES = (GENDER, "age_group", "income_group")


@dataclass
class FittedPipeline:
    key: str
    target: str
    feature_cols: list[str]
    income_min: float
    income_max: float
    codes: dict | DataFrame    # literals, or a stored table (column, value, code) beyond 10,000 levels
    scaler: dict
    offsets: dict = field(default_factory=dict)   # label offset per model (boosting starts from the mean)
    models: dict = field(default_factory=dict)
    best: str | None = None
    params: dict = field(default_factory=dict)     # chosen settings per model

    # ------------------------------------------------------------ persistence
    def state(self) -> dict:
        return {"key": self.key, "target": self.target, "feature_cols": self.feature_cols,
                "income_min": self.income_min, "income_max": self.income_max,
                "codes": self.codes if isinstance(self.codes, dict) else None,
                "scaler": {k: list(v) for k, v in self.scaler.items()}, "offsets": self.offsets,
                "best": self.best, "params": self.params,
                "models": sorted(n for n, m in self.models.items() if not isinstance(m, models.OlsModel)),
                "ols": {n: m.to_dict() for n, m in self.models.items() if isinstance(m, models.OlsModel)}}

    def save(self, spark, path: str) -> None:
        """State as one JSON line through Spark's writer (any shared file system), models beside it."""
        spark.createDataFrame([(json.dumps(self.state()),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/state")
        if not isinstance(self.codes, dict):
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        for name, m in self.models.items():
            if not isinstance(m, models.OlsModel):
                m.write().overwrite().save(f"{path}/models/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "FittedPipeline":
        st = json.loads(spark.read.text(f"{path}/state").first()[0])
        ms = {n: _LOADERS[n].load(f"{path}/models/{n}") for n in st.pop("models")}
        ms.update({n: models.OlsModel.from_dict(d) for n, d in st.pop("ols", {}).items()})
        st["scaler"] = {k: tuple(v) for k, v in st["scaler"].items()}
        if st["codes"] is None:
            st["codes"] = spark.read.parquet(f"{path}/codes")
        return cls(models=ms, **st)


# ------------------------------------------------------------------ helpers
def _vector(df: DataFrame, fitted: FittedPipeline, pfx: str) -> DataFrame:
    cols = [f"{pfx}{c}" for c in fitted.feature_cols]
    scaled = scale.standardise(df, cols, stats={f"{pfx}{c}": fitted.scaler[c] for c in fitted.feature_cols})
    return models.assemble(scaled, cols, f"{pfx}features")


# ------------------------------------------------------------------ fit
def fit(df: DataFrame, key: str = KEY, target: str = TARGET, which=MODEL_ORDER, preset: str | None = None,
        params: dict | None = None, test_fraction: float = 0.2, seed: int = 42, fit_on: str = "all",
        do_fill: bool = True, parallelism: int = 4, n_buckets: int | None = None):
    """Fit the pipeline. Returns (FittedPipeline, predictions, metrics).

    ``preset`` ("fast"/"full") runs the reference's grid search per tree model;
    otherwise ``params`` = {"forest": {...spark params}, "boosting": {...}} is one fit each.
    ``fit_on="all"`` fits min/max and code tables on every row (the
    reference's order); ``"train"`` on the training side only.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)  # the cluster's folder, when it names one; never a local default
    base = fill.ffill_bfill(df, key, n_buckets=n_buckets) if do_fill else df
    # Several small statistics are read from the filled table: keep it for them.
    sides = split.fit_split(df, key, test_fraction, seed, models.FOLDS.get(preset or "fast", 3))
    base = base.withColumn("split", sides.side()).persist(StorageLevel.MEMORY_AND_DISK)
    src = base.filter(F.col("split") == "train") if fit_on == "train" else base
    mm = src.agg(F.min(INCOME).alias("lo"), F.max(INCOME).alias("hi")).first()
    stats = {"income_min": mm["lo"], "income_max": mm["hi"]}
    feat = features.derive_features(base, stats=stats)
    src_feat = feat.filter(F.col("split") == "train") if fit_on == "train" else feat
    codes = encode.frozen_codes(encode.fit_label_codes(src_feat, list(TEXT_FEATURES)))
    enc = encode.apply_codes(feat, codes, list(TEXT_FEATURES))
    feature_cols = list(MODEL_FEATURES)
    scaler = scale.collect_scaler(enc, feature_cols, where=F.col("split") == "train")
    fitted = FittedPipeline(key, target, feature_cols, stats["income_min"], stats["income_max"], codes, scaler)
    data = models.assemble(scale.standardise(enc, feature_cols, stats=scaler), feature_cols)
    data = data.withColumn("label", F.col(target).cast("double")) \
        .withColumn("fold", sides.fold()) \
        .select(key, "split", "fold", "label", models.FEATURES_COL, GENDER, AGE, INCOME, *feature_cols)
    # Model fits read the training rows many times: keep them, spill if needed.
    # Row order inside partitions is fixed by a sort on the key (tree fits depend on layout).
    data = data.filter(F.col("label").isNotNull()).repartition(key).sortWithinPartitions(key)
    if spark.sparkContext.getCheckpointDir():
        # Written to the cluster's shared checkpoint folder: the fits no longer
        # depend on the fill / encode lineage, and a lost executor costs a re-read.
        data = data.checkpoint(eager=True)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    data.count()
    base.unpersist()
    train = data.filter(F.col("split") == "train")
    params = params or {}
    mean_y = train.agg(F.avg("label")).first()[0]
    for name in which:
        if name == "linear":
            fitted.models[name] = models.fit_ols(train, feature_cols, "label")
            fitted.offsets[name] = 0.0
        elif name == "forest":
            est = models.forest_estimator("label", seed=seed)
            if preset:
                cvm, _ = models.grid_search(train, est, models.forest_param_maps(est, models.FOREST_GRIDS[preset]),
                                            "label", "fold", parallelism)
                fitted.models[name] = cvm.bestModel
            else:
                fitted.models[name] = est.setParams(**params.get("forest", {})).fit(train)
            fitted.offsets[name] = 0.0
        elif name == "boosting":
            est = models.boosting_estimator("label", seed=seed)
            tr = train.withColumn("label", F.col("label") - F.lit(mean_y))
            if preset:
                cvm, _ = models.grid_search(tr, est, models.boosting_param_maps(est, models.BOOSTING_GRIDS[preset]),
                                            "label", "fold", parallelism)
                fitted.models[name] = cvm.bestModel
            else:
                fitted.models[name] = est.setParams(**params.get("boosting", {})).fit(tr)
            fitted.offsets[name] = float(mean_y)
        if hasattr(fitted.models[name], "extractParamMap"):
            fitted.params[name] = {p.name: (v if isinstance(v, (int, float, str, bool)) else str(v))
                                   for p, v in fitted.models[name].extractParamMap().items()
                                   if p.name in ("numTrees", "maxDepth", "minInstancesPerNode", "maxIter",
                                                 "stepSize", "subsamplingRate")}
    pred = predictions(data, fitted)
    metrics = models.regression_metrics(pred)
    cmp = models.model_comparison(metrics)
    best = models.best_model(cmp).first()
    fitted.best = best["model"] if best else None
    return fitted, pred, metrics


def predictions(data: DataFrame, fitted: FittedPipeline) -> DataFrame:
    """Long predictions (model, model_order, key, split, actual, predicted) of every
    fitted model on an assembled frame."""
    out = None
    for k, name in enumerate(MODEL_ORDER):
        if name not in fitted.models:
            continue
        m = fitted.models[name]
        p = m.transform(data).select(
            F.lit(name).alias("model"), F.lit(k).cast("long").alias("model_order"), fitted.key, "split",
            GENDER, AGE, INCOME, F.col("label").alias("actual"),
            (F.col("prediction") + F.lit(fitted.offsets.get(name, 0.0))).alias("predicted"))
        out = p if out is None else out.unionByName(p)
    return out


# ------------------------------------------------------------------ score
def score(df: DataFrame, fitted: FittedPipeline, model: str | None = None, segment_mode: str = "cut",
          labels: str | None = None, recompute_stats: bool = False, unseen: str = "zero",
          bands_mode: str = "closed", do_fill: bool = True, n_buckets: int | None = None) -> DataFrame:
    """SEG9 / SEG10: the input columns plus ``Predicted_Spending_Score`` and
    ``Customer_Segment``.

    ``recompute_stats`` takes income min/max from this batch (the batch page's
    behaviour) instead of the fitted values; ``unseen`` is the encoder rule
    ("zero" per value or "zero_column"); ``bands_mode="open"`` is the
    single-customer rule. Rows are filled in key order when the key is present.
    """
    projections.require_columns(df, REQUIRED_FOR_SCORING)
    name = model or fitted.best
    pfx = "__s_"
    work = df
    src = {c: c for c in REQUIRED_FOR_SCORING}
    if do_fill and fitted.key in df.columns:
        # Fill copies of the model inputs (the caller's columns come back as given).
        src = {c: f"__fill_{c}" for c in REQUIRED_FOR_SCORING}
        work = fill.ffill_bfill(df.withColumns({v: F.col(c) for c, v in src.items()}), fitted.key,
                                cols=list(src.values()), n_buckets=n_buckets)
    work = work.withColumns({f"{pfx}{c}": F.col(src[c]) for c in REQUIRED_FOR_SCORING})
    stats = None if recompute_stats else {"income_min": fitted.income_min, "income_max": fitted.income_max}
    feat = features.derive_features(work, bands_mode, stats, age=f"{pfx}{AGE}", income=f"{pfx}{INCOME}")
    from spendlens.schema import DERIVED
    feat = feat.withColumnsRenamed({d: f"{pfx}{d}" for d in DERIVED})
    if isinstance(fitted.codes, dict):
        codes = {f"{pfx}{c}": v for c, v in fitted.codes.items()}
    else:
        codes = fitted.codes.withColumn("column", F.concat(F.lit(pfx), "column"))
    enc = encode.apply_codes(feat, codes, [f"{pfx}{c}" for c in TEXT_FEATURES], unseen=unseen)
    # The caller's columns, and exactly the model's inputs in the order of the fit, a missing one as 0.
    enc = projections.align_columns(enc, [*df.columns, *[f"{pfx}{c}" for c in fitted.feature_cols]])
    m = fitted.models[name]
    if isinstance(m, models.OlsModel):
        cols = [f"{pfx}{c}" for c in fitted.feature_cols]
        scaled = scale.standardise(enc, cols, stats={f"{pfx}{c}": fitted.scaler[c] for c in fitted.feature_cols})
        scored = models.OlsModel(cols, m.coefficients, m.intercept).transform(scaled, f"{pfx}prediction")
    else:
        m = m.copy()
        m.setFeaturesCol(f"{pfx}features").setPredictionCol(f"{pfx}prediction")
        scored = m.transform(_vector(enc, fitted, pfx))
    p = F.col(f"{pfx}prediction") + F.lit(fitted.offsets.get(name, 0.0))
    seg = segments.segment(p, segment_mode, labels)
    return scored.select(*df.columns, p.alias("Predicted_Spending_Score"), seg.alias("Customer_Segment"))


def assembled(df: DataFrame, fitted: FittedPipeline) -> DataFrame:
    """Features, codes, scaling and the vector for a frame with the base columns
    (frozen statistics); adds ``label`` from the target when present."""
    feat = features.derive_features(df, stats={"income_min": fitted.income_min, "income_max": fitted.income_max})
    enc = encode.apply_codes(feat, fitted.codes, list(TEXT_FEATURES))
    out = models.assemble(scale.standardise(enc, fitted.feature_cols, stats=fitted.scaler), fitted.feature_cols)
    if fitted.target in df.columns:
        out = out.withColumn("label", F.col(fitted.target).cast("double"))
    return out
