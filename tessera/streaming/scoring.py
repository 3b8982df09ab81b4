"""Structured Streaming jobs.

* ``start_scoring_stream`` — scoring records arriving as JSON files: each
  micro-batch is validated by the record rules, valid rows are scored by a
  fitted ``PipelineModel`` and rejected rows are quarantined with their
  violations. Both sinks are written under ``batch_id=<id>`` with overwrite,
  so a replayed batch after a failure rewrites the same files (idempotent).
* ``start_window_counts`` — event-time tumbling windows with a watermark:
  per (window, category) counts and moments, append mode, so only closed
  windows are emitted and late rows past the watermark are dropped. The drift of a closed window is the batch function applied to
  these aggregates.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import expressions as E
from ..operators import features as FE
from ..operators import models as MD
from ..operators import rules as R
from ..sources.commits import CommitLog
from ..sources.files import RAW_LINE


class ServingModel:
    """The serving model from the registry table: the newest Production
    version (else the newest), re-resolved once per micro-batch and reloaded
    from ``models_root/<run_id>`` only when the version changed."""

    def __init__(self, spark: SparkSession, versions_path: str, models_root: str, name: str):
        self.versions = CommitLog(spark, versions_path, S.MODEL_VERSIONS_SCHEMA)
        self.models_root, self.name = models_root, name
        self.version, self.model = None, None

    def current(self):
        from ..operators import registry as REG
        row = REG.serving_version(self.versions.read(), self.name).first()
        if row is None:
            raise RuntimeError(f"nothing is registered under '{self.name}' yet: train and register a model")
        if row["version"] != self.version:
            self.model = PipelineModel.load(f"{self.models_root.rstrip('/')}/{row['run_id']}")
            self.version = row["version"]
        return str(self.version), self.model


class _Fixed:
    def __init__(self, model, version):
        self.model, self.version = model, version

    def current(self):
        return self.version, self.model


def start_scoring_stream(spark: SparkSession, source_dir: str, model,
                         valid_dir: str, rejected_dir: str, checkpoint_dir: str,
                         version: str | None, name: str, run_ts: str, available_now: bool = True,
                         max_files_per_trigger: int | None = None):
    """Rejected rows keep the whole record, the line itself where it could not
    be parsed, and the rules they break. ``model`` is a fitted ``PipelineModel`` (with ``version``) or a
    :class:`ServingModel` that follows the registry."""
    source = model if isinstance(model, ServingModel) else _Fixed(model, version)
    # a line that is not JSON keeps its text, so that it can be replayed
    schema = T.StructType([*S.CLEAN_CUSTOMER_SCHEMA.fields, T.StructField(RAW_LINE, T.StringType())])
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_LINE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        version, model = source.current()
        checked = R.apply_request_rules(FE.engineer_features(batch)).persist()
        try:
            valid = checked.where("is_valid")
            scored = MD.batch_score(model, valid, version=version, name=name, run_ts=run_ts)
            scored.write.mode("overwrite").parquet(f"{valid_dir}/batch_id={batch_id}")
            (checked.where("not is_valid")
             .select(*[f.name for f in schema.fields], "violations", "n_violations")
             .write.mode("overwrite").parquet(f"{rejected_dir}/batch_id={batch_id}"))
        finally:
            checked.unpersist()

    writer = (stream.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def window_counts(events: DataFrame, ts_col: str = "ts", category: str = "event_type",
                  value: str = "value", window: str = "7 days", watermark: str = "1 day") -> DataFrame:
    """Watermarked tumbling-window aggregates; works on a stream or a table:
    rows, rows with a value, and mean and sum of squared deviations of the
    values (null without values), which merge without cancellation.
    ``timestamp_ntz`` is cast to ``timestamp`` (UTC session) because
    watermarks need the latter."""
    ts = F.col(ts_col).cast("timestamp").alias(ts_col)
    x = E.nan_to_null(F.col(value).cast("double"))
    ev = events.select(ts, F.col(category).cast("string").alias("category"), x.alias("value"))
    return (ev.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window).alias("w"), "category")
            .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"),
                 F.avg("value").alias("mean_value"),
                 (F.var_pop("value") * F.count("value")).alias("squares"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "category", "n", "n_value", "mean_value", "squares"))


def start_window_counts(spark: SparkSession, source_dir: str, schema, sink_dir: str,
                        checkpoint_dir: str, max_files_per_trigger: int | None = None, **kw):
    """``max_files_per_trigger`` bounds a micro-batch. Leave it unset unless
    files arrive in event-time order: between micro-batches the watermark
    moves on, and rows that come later than it allows are dropped."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    return (window_counts(stream, **kw).writeStream.outputMode("append")
            .format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
