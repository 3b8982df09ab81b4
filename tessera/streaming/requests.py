"""Scoring requests as a stream: each request is answered once.

A request is a JSON line with a ``request_id``, the time it was received and the
fields of a record. Clients repeat requests they got no answer to, so the stream
keeps the ids it has seen as keyed state and lets a request through the first time only;
an id is forgotten when the watermark has left its time behind by ``keep_ids``. Lines that
can't be read, and requests without id or time, have nothing to be recognised by: they go
round the state and are all kept among the rejected ones, with the line itself where
it could not be parsed.

Both tables are written per micro-batch under ``batch_id=<id>`` with overwrite; a batch that is
run again rewrites the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import models as MD
from ..operators import rules as R
from ..sources import files as IO
from .scoring import ServingModel, _Fixed

UNREADABLE, UNIDENTIFIED = "unreadable", "unidentified"


def first_of_each(lines: DataFrame, keep_ids: str = "1 day") -> DataFrame:
    """The requests to handle, from a stream of request lines: the first of each
    id, and everything that has no id or time. ``reason`` says why a line is odd."""
    reason = (F.when(F.col(IO.RAW_LINE).isNotNull(), UNREADABLE)
              .when(F.col("request_id").isNull() | F.col("received_at").isNull(), UNIDENTIFIED))
    lines = lines.withColumn("reason", reason)
    known = (lines.where("reason is null").withWatermark("received_at", keep_ids)
             .dropDuplicatesWithinWatermark(["request_id"]))
    return known.unionByName(lines.where("reason is not null"))


def start_request_stream(spark: SparkSession, source_dir: str, model, scored_dir: str, rejected_dir: str,
                         checkpoint_dir: str, version: str | None, name: str, run_ts: str, keep_ids: str = "1 day",
                         max_files_per_trigger: int | None = None, available_now: bool = True):
    """Score the requests in ``source_dir``. ``model`` is a fitted ``PipelineModel``
    (with ``version``) or a :class:`ServingModel` that follows the registry. Requests received
    earlier than the watermark (the newest less ``keep_ids``) come too late and are dropped;
    the progress of the query counts them (``numRowsDroppedByWatermark``)."""
    source = model if isinstance(model, ServingModel) else _Fixed(model, version)
    lines = IO.read_requests(spark, source_dir, stream=True, max_files_per_trigger=max_files_per_trigger)
    record = [c for c in lines.columns]

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        version, model = source.current()
        checked = R.apply_request_rules(FE.engineer_features(batch)).persist()
        try:
            fine = F.col("reason").isNull() & F.col("is_valid")
            (MD.batch_score(model, checked.where(fine), version=version, name=name, run_ts=run_ts, id_col="request_id")
             .write.mode("overwrite").parquet(f"{scored_dir}/batch_id={batch_id}"))
            (checked.where(~fine)
             .select(*record, F.coalesce("reason", F.lit("invalid")).alias("reason"),
                     F.when(F.col("reason").isNull() | (F.col("reason") != UNREADABLE), F.col("violations"))
                     .alias("violations"))
             .write.mode("overwrite").parquet(f"{rejected_dir}/batch_id={batch_id}"))
        finally:
            checked.unpersist()

    writer = (first_of_each(lines, keep_ids).writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
