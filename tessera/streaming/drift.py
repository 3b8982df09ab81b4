"""Drift of a feed against a fixed, stored reference, while the stream runs.

The reference is profiled once and stored: per numeric feature the number of
values, their mean and sum of squared deviations, per categorical feature the
counts of its values. The stream keeps the same profile for each event-time window as
its state, and emits a window when the watermark has passed it. Each micro-batch scores
the windows it closes against the stored reference and puts one row per window and
feature into the result table.

The result is keyed by window and feature: a window is a partition of the table, and a
micro-batch overwrites only the partitions of the windows it holds. A batch that is
run again after a failure therefore leaves the same rows as if it had run once.

State is one row per window, feature and value, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import expressions as E

NUMERIC, CATEGORICAL = "numeric", "categorical"
PROFILE = ["n", "n_value", "mean_value", "squares"]


def feature_rows(df: DataFrame, numeric: list[str], categorical: list[str], *keep: str) -> DataFrame:
    """One row per row and feature: feature, kind, category (text) or x (double)."""
    none = F.lit(None)
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(NUMERIC).alias("kind"), none.cast("string").alias("category"),
                      E.nan_to_null(F.col(c).cast("double")).alias("x")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("feature"), F.lit(CATEGORICAL).alias("kind"),
                       F.col(c).cast("string").alias("category"), none.cast("double").alias("x")) for c in categorical]
    return df.select(*keep, F.inline(F.array(*cells)))


def _moments() -> list:
    """Counts, mean and squared deviations; they merge without cancellation."""
    return [F.count(F.lit(1)).alias("n"), F.count("x").alias("n_value"), F.avg("x").alias("mean_value"),
            (F.var_pop("x") * F.count("x")).alias("squares")]


def profile(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """feature, kind, category and the moments of a whole table."""
    return feature_rows(df, numeric, categorical).groupBy("feature", "kind", "category").agg(*_moments())


def write_reference(df: DataFrame, numeric: list[str], categorical: list[str], path: str) -> None:
    """Profile and store the reference; one that is there already stays fixed."""
    profile(df, numeric, categorical).write.mode("errorifexists").parquet(path)


def window_profiles(events: DataFrame, numeric: list[str], categorical: list[str], ts_col: str = "ts",
                    window: str = "7 days", watermark: str = "1 day") -> DataFrame:
    """The profile of every event-time window of a stream or table."""
    ts = F.col(ts_col).cast("timestamp").alias("__ts")
    rows = feature_rows(events.select(ts, *numeric, *categorical), numeric, categorical, "__ts")
    return (rows.withWatermark("__ts", watermark)
            .groupBy(F.window("__ts", window).alias("w"), "feature", "kind", "category").agg(*_moments())
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "feature", "kind", "category", *PROFILE))


def score_profiles(windows: DataFrame, reference: DataFrame, threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """One row per window and reference feature: both row counts, both means (numeric),
    the unrounded score and whether it is above the threshold.

    Numeric: ``|mean - mean_ref| / (std_ref + 1e-9)``, the sample deviation. Categorical:
    total variation distance over the values of either side, nulls left out; a side
    without values has share 0 everywhere. A score that can't be computed is null."""
    at = ["window_start", "window_end"]
    rows = windows.where(F.col("kind") == NUMERIC).groupBy(*at, "feature").agg(
        F.sum("n").alias("current_rows"), F.max("mean_value").alias("current_mean"))
    ref_num = reference.where(F.col("kind") == NUMERIC).select(
        "feature", F.col("n").alias("reference_rows"), F.col("mean_value").alias("reference_mean"),
        F.when(F.col("n_value") > 1, F.sqrt(F.col("squares") / (F.col("n_value") - 1))).alias("std"))
    num = rows.join(ref_num, "feature").select(
        *at, "feature", F.lit(NUMERIC).alias("kind"), "current_rows", "reference_rows", "current_mean",
        "reference_mean",
        (F.abs(F.col("current_mean") - F.col("reference_mean")) / (F.col("std") + F.lit(S.DRIFT_EPSILON))).alias("score"))

    here = windows.where(F.col("kind") == CATEGORICAL)
    some = F.col("category").isNotNull()
    totals = here.groupBy(*at, "feature").agg(F.sum("n").alias("current_rows"),
                                              F.sum(F.when(some, F.col("n"))).alias("n_cur"))
    ref_cat = reference.where(F.col("kind") == CATEGORICAL)
    ref_totals = ref_cat.groupBy("feature").agg(F.sum("n").alias("reference_rows"),
                                                F.sum(F.when(some, F.col("n"))).alias("n_ref"))
    shares = (here.where(some).select(*at, "feature", "category", F.col("n").alias("c"))
              .join(totals.select(*at, "feature", "n_cur"), [*at, "feature"])
              .join(ref_cat.where(some).select("feature", "category", F.col("n").alias("r")),
                    ["feature", "category"], "left")
              .join(ref_totals.select("feature", "n_ref"), "feature", "left"))
    p, q = F.col("c") / F.col("n_cur"), F.coalesce(F.try_divide(F.col("r"), F.col("n_ref")), F.lit(0.0))
    # reference values that the window lacks add their whole share
    gaps = shares.groupBy(*at, "feature").agg(F.sum(F.abs(p - q) - q).alias("gap"))
    full = F.when(F.coalesce("n_ref", F.lit(0)) > 0, 1.0).otherwise(0.0)
    cat = (totals.join(ref_totals, "feature").join(gaps, [*at, "feature"], "left").select(
        *at, "feature", F.lit(CATEGORICAL).alias("kind"), "current_rows", "reference_rows",
        F.lit(None).cast("double").alias("current_mean"), F.lit(None).cast("double").alias("reference_mean"),
        ((full + F.coalesce("gap", F.lit(0.0))) / 2).alias("score")))
    return num.unionByName(cat).withColumn("drifted", F.coalesce(F.col("score") > threshold, F.lit(False)))


def put_windows(scored: DataFrame, sink_dir: str, batch_id: int) -> None:
    """Upsert by window: the partitions of the windows in ``scored`` are replaced."""
    (scored.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .withColumn("window", F.date_format("window_start", "'w'yyyyMMdd'T'HHmmss"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(sink_dir))


def start_drift_stream(spark: SparkSession, source_dir: str, schema: T.StructType, reference_path: str,
                       sink_dir: str, checkpoint_dir: str, numeric: list[str], categorical: list[str],
                       ts_col: str = "ts", window: str = "7 days", watermark: str = "1 day",
                       threshold: float = S.DRIFT_THRESHOLD, max_files_per_trigger: int | None = None,
                       available_now: bool = True):
    """Score every closed window of the Parquet feed in ``source_dir`` against
    the reference stored in ``reference_path``. ``max_files_per_trigger`` bounds a
    micro-batch; leave it unset unless files arrive in event-time order."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    profiles = window_profiles(reader.parquet(source_dir), numeric, categorical, ts_col, window, watermark)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        closed = batch.persist()  # the state is read once
        try:
            reference = closed.sparkSession.read.parquet(reference_path)
            put_windows(score_profiles(closed, reference, threshold), sink_dir, batch_id)
        finally:
            closed.unpersist()

    writer = (profiles.writeStream.outputMode("append").foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def window_reports(scored: DataFrame) -> DataFrame:
    """One row per window: rows, drifted features, mean score, flag."""
    named = F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature"))))
    return scored.groupBy("window_start", "window_end").agg(
        F.max("current_rows").alias("current_rows"), F.max("reference_rows").alias("reference_rows"),
        F.count(F.lit(1)).alias("n_features"), F.count_if("drifted").alias("n_drifted_features"),
        F.array_join(named, ",").alias("drifted_features"),
        E.rnd(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("drift_score"),
        F.bool_or("drifted").alias("drift_detected"))
