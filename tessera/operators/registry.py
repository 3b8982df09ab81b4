"""Run log and model-version registry as plain tables.

``runs``: one row per fitted model (run_id, model_type, status, params,
tags, metrics). ``model_versions``: (name, version, stage, run_id,
description). Selection and promotion are aggregates and projections over
those tables; the tables are small (one row per run), the operators do not
assume it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import prefix

PRODUCTION, ARCHIVED = "Production", "Archived"


def runs_from_metrics(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Runs table from a per-model metrics table."""
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    return metrics.select(
        F.md5(F.col(model_col)).alias("run_id"),
        F.col(model_col).alias("model_type"),
        F.lit("FINISHED").alias("status"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                          F.array(*[F.col(n).cast("double") for n in names])).alias("metrics"))


def best_runs(runs: DataFrame, metric: str = S.PRIMARY_METRIC, k: int = 10) -> DataFrame:
    """Finished runs ordered by the metric (descending, nulls last, run id
    breaking ties), top k — the leaderboard the best run is taken from."""
    m = F.col("metrics")[metric]
    return (runs.where(F.col("status") == "FINISHED")
            .select("run_id", "model_type", m.alias(metric))
            .orderBy(F.desc_nulls_last(metric), "run_id").limit(k))


def best_run(runs: DataFrame, metric: str = S.PRIMARY_METRIC) -> DataFrame:
    """The single best finished run: ``max_by`` over (metric, reversed id)
    — one aggregate, no sort. Empty when there is no finished run."""
    m = F.col("metrics")[metric]
    fin = runs.where((F.col("status") == "FINISHED") & m.isNotNull())
    # highest metric; among equal metrics the smallest run id
    best = fin.agg(F.min_by(F.struct("run_id", "model_type", m.alias(metric)),
                            F.struct((-m).alias("neg"), F.col("run_id"))).alias("b"))
    return best.where(F.col("b").isNotNull()).select("b.*")


def require_best_run(runs: DataFrame, metric: str = S.PRIMARY_METRIC):
    """The best finished run as a row; an error when there is none."""
    row = best_run(runs, metric).first()
    if row is None:
        raise ValueError("the run log holds no finished run: train first")
    return row


def initial_versions(runs: DataFrame, name: str) -> DataFrame:
    """Registry in which every finished run was registered in run-id order
    and promoted on arrival: the last version is Production, the others
    Archived."""
    fin = runs.where(F.col("status") == "FINISHED").select("run_id")
    ranked = prefix.running_totals(fin, ["run_id"])
    last = fin.count()
    return ranked.select(
        F.lit(name).alias("name"), F.col("_rank").cast("int").alias("version"),
        F.when(F.col("_rank") == last, PRODUCTION).otherwise(ARCHIVED).alias("stage"),
        "run_id", F.lit(None).cast("string").alias("description"))


def promote(versions: DataFrame, run: DataFrame, name: str) -> DataFrame:
    """Register ``run`` (one row: run_id, model_type) as version max+1 in
    Production; earlier Production versions become Archived. Without a run
    nothing is touched and an error is raised."""
    if run.limit(1).count() == 0:
        raise ValueError(f"cannot promote a version of '{name}': there is no finished run")
    nxt = versions.where(F.col("name") == name).agg(
        F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"] + 1
    new = run.select(
        F.lit(name).alias("name"), F.lit(nxt).cast("int").alias("version"),
        F.lit(PRODUCTION).alias("stage"), "run_id",
        F.concat(F.lit("Best performing "), F.col("model_type"),
                 F.lit(" model selected by ROC-AUC.")).alias("description"))
    old = versions.withColumn(
        "stage", F.when((F.col("name") == name) & (F.col("stage") == PRODUCTION), F.lit(ARCHIVED))
        .otherwise(F.col("stage")))
    return old.unionByName(new)


def serving_version(versions: DataFrame, name: str, stage: str = PRODUCTION) -> DataFrame:
    """Newest version in ``stage``; when none is in that stage, the newest of
    all. Version compared as an integer."""
    v = versions.where(F.col("name") == name)
    key = F.struct((F.col("stage") == stage).alias("in_stage"), F.col("version").cast("int").alias("v"))
    return v.agg(F.max_by(F.struct("name", "version", "stage", "run_id"), key).alias("s")).where(
        F.col("s").isNotNull()).select("s.*")


def production_metrics(serving: DataFrame, runs: DataFrame) -> DataFrame:
    """Serving version joined to its run's metrics (empty map when the run
    is unknown)."""
    return (serving.join(runs.select("run_id", "model_type", "metrics"), "run_id", "left")
            .withColumn("metrics", F.coalesce("metrics", F.create_map().cast("map<string,double>"))))
