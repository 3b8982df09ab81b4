"""The training job: ingest → validate → split/preprocess → train and log →
select and promote → monitor. One SparkSession; each stage extends the
plan of the previous one; the cleaned table, the reference slice and the split
are materialised in the output folder. A rerun with the same ``run_ts``
replaces what that run wrote and leaves other runs alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import expressions as E
from ..operators import clean as C
from ..operators import drift as D
from ..operators import expectations as X
from ..operators import features as FE
from ..operators import models as MD
from ..operators import prefix as P
from ..operators import preprocess as PP
from ..operators import registry as R
from ..operators import split as SP
from ..session import ensure_checkpoint_dir
from ..sources import files as IO
from ..sources.commits import CommitLog


@dataclass
class JobResult:
    validation_failed: int
    runs: DataFrame
    versions: DataFrame
    drift: DataFrame


def run_training_job(spark: SparkSession, raw: DataFrame, out: str, run_ts: str,
                     registry_name: str = "churn-classifier", fail_on_validation: bool = False,
                     order_cols=("load_order",), model_names=None, strict: bool = True) -> JobResult:
    """``strict``: a null in an integer column stops the job, as in the reference."""
    out = out.rstrip("/")
    ensure_checkpoint_dir(spark)
    # 1. ingest: clean, report, persist the processed table and the reference slice
    C.check_required_columns(raw)
    order_cols = list(order_cols)
    # the report's figures are taken while the rows are deduplicated, once
    clean, cleaning = C.clean_with_report(raw, order_cols=order_cols, strict=strict, keep_order=True)
    IO.write_table(clean, f"{out}/processed")
    ordered = spark.read.parquet(f"{out}/processed")
    clean = ordered.drop(*order_cols)
    IO.write_report(cleaning, f"{out}/reports/ingestion", run_ts)
    # the first rows of the file; in id order where the file's order isn't known
    n = clean.count()
    first = P.first_n(ordered, order_cols[0] if order_cols else S.ID_COL, max(1000, n // 5), total=n)
    IO.write_table(first.drop(*order_cols), f"{out}/reference")
    reference = spark.read.parquet(f"{out}/reference")

    # 2. validate: report always written; the gate only raises when asked to
    report = X.run_suite(clean, X.customer_suite())
    IO.write_report(report, f"{out}/reports/validation", run_ts)
    stamped = T.StructType([*report.schema.fields, T.StructField("run_ts", T.StringType())])
    failed = X.gate(spark.read.schema(stamped).json(f"{out}/reports/validation").where(F.col("run_ts") == run_ts),
                    fail_on_error=fail_on_validation)

    # 3. features and split (materialised once)
    labelled = FE.encode_target(FE.engineer_features(clean))
    IO.write_table(SP.stratified_split(labelled), f"{out}/split", partition_by=["split"])
    split = spark.read.parquet(f"{out}/split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    IO.write_report(PP.feature_metadata(split), f"{out}/reports/features", run_ts)

    # 4. train and log
    fitted, runs = MD.train_and_log(train, test, data_tag=run_ts, model_names=model_names)
    (runs.withColumn("job_ts", F.lit("j" + run_ts)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("job_ts").parquet(f"{out}/runs"))
    all_runs = spark.read.parquet(f"{out}/runs").drop("job_ts")
    IO.write_report(runs.select("run_id", "model_type", "status", F.map_entries("metrics").alias("metrics"),
                                F.map_entries("tags").alias("tags")), f"{out}/reports/training", run_ts)

    # 5. select the best run and promote it
    R.require_best_run(all_runs)
    best = R.best_run(all_runs)
    IO.write_report(best, f"{out}/reports/evaluation", run_ts)
    # another job may promote at the same time: each builds on the version it finds; a rerun adds none
    registry = CommitLog(spark, f"{out}/model_versions", S.MODEL_VERSIONS_SCHEMA)
    version = registry.commit(lambda versions: R.promote(versions, best, registry_name), key=f"{registry_name}|{run_ts}")
    promoted = registry.read(version)
    this_job = {r["run_id"]: r["model_type"] for r in runs.select("run_id", "model_type").collect()}
    for run_id, model_type in this_job.items():
        # every fitted model is kept under its run id; serving picks by version
        MD.save(fitted[model_type], f"{out}/models/{run_id}")
    # 6. monitor: drift never blocks the batch
    try:
        drift = D.drift_report(reference, clean).checkpoint()
        retrain = D.retrain_from_runs(drift, all_runs, promoted, registry_name)
        IO.write_report(drift.withColumn("status", F.lit("ok")), f"{out}/reports/drift", run_ts)
        IO.write_report(retrain, f"{out}/reports/retrain", run_ts)
    except Exception as exc:  # reported as a row, flag false
        IO.write_report(spark.createDataFrame([("error", False, str(exc))],
                                              "status string, drift_detected boolean, error string"),
                        f"{out}/reports/drift", run_ts)
    return JobResult(failed, all_runs, promoted, IO.latest_report(spark, f"{out}/reports/drift"))
