"""Model queries (rows-only checks: fitted models have no SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators import registry as R
from .catalog import register
from .q_features import with_split

RUN_TS = "2024-01-31T00:00:00"


def _train_test(spark, sf):
    df = with_split(spark, sf)
    return df.where(F.col("split") == "train"), df.where(F.col("split") == "test")


@register("batch_score")
def batch_score(spark, sf):
    """Fit the logistic-regression pipeline on the train rows and score every
    row: probability, decision, risk band, version and id."""
    everyone = with_split(spark, sf).checkpoint(eager=True)
    train = everyone.where(F.col("split") == "train")
    train_w = MD.with_weights(train)
    total_w = train_w.agg(F.sum("w_balanced")).first()[0]
    model = MD.fit(train_w, MD.model_configs(total_w)[0]["estimator"])
    return MD.batch_score(model, everyone, version="1", name="LogisticRegression", run_ts=RUN_TS)


@register("feature_importance_topk")
def feature_importance_topk(spark, sf):
    """Top-20 features of the random forest (200 trees, depth 10)."""
    train, _ = _train_test(spark, sf)
    train_w = MD.with_weights(train)
    total_w = train_w.agg(F.sum("w_balanced")).first()[0]
    model = MD.fit(train_w, MD.model_configs(total_w)[1]["estimator"])
    return MD.top_features(spark, model, 20)


@register("train_runs")
def train_runs(spark, sf):
    """Fit all three classifiers, evaluate on the test rows, return the run
    log; the best run by ROC-AUC is then taken with ``best_run``."""
    train, test = _train_test(spark, sf)
    _, runs = MD.train_and_log(train, test, data_tag=sf)
    best = R.best_run(runs).select(F.col("run_id").alias("best_run_id"))
    return runs.join(best, runs.run_id == best.best_run_id, "left").select(
        "run_id", "model_type", "status",
        *[F.col("metrics")[m].alias(m) for m in ["accuracy", "precision", "recall", "f1_score", "roc_auc"]],
        F.col("best_run_id").isNotNull().alias("is_best"))
