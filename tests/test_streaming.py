import statistics

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators import drift as D
from tessera.operators import models as MD

from tessera.operators import rules as RU
from tessera.plans.catalog import all_queries
from tessera.plans import q_stream as QS
from tessera.plans.q_clean import clean_dirty
from tessera.plans.q_features import with_split
from tessera.sources import tables as TB
from tessera.streaming import scoring as ST
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("parts", [1, 6, 16])
def test_closed_windows_hold_all_their_rows(spark, parts):
    """However many tasks write the feed, every closed window equals the batch."""
    streamed = QS._replayed(spark, SF_SMALL, parts)
    batch = ST.window_counts(TB.table(spark, SF_SMALL, "events"))
    cols = ["window_start", "category", "n", "n_value", "mean_value", "squares"]
    got = sorted(tuple(r) for r in streamed.select(*cols).collect())
    closed = {r[0] for r in got}
    want = sorted(tuple(r) for r in batch.where(F.col("window_start").isin(list(closed))).select(*cols).collect())
    assert got and [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4:] == pytest.approx(w[4:]) for g, w in zip(got, want))
    # the newest window is still open under the watermark and is held back
    all_windows = {r[0] for r in batch.select("window_start").distinct().collect()}
    assert len(all_windows) == len(closed) + 1


def test_window_moments_without_cancellation_and_with_nulls(spark):
    rows = [("2024-01-02 00:00:00", "a", v) for v in (1e9, 1e9 + 1, 1e9 + 2, None)]
    rows += [("2024-01-02 00:00:00", "b", 1e9 + 4), ("2024-01-03 00:00:00", "c", None)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn(
        "ts", F.to_timestamp("ts"))
    got = D.window_moments(ST.window_counts(events)).first()
    assert got["m"] == 1e9 + 1.75 and got["s"] == pytest.approx(statistics.stdev([0, 1, 2, 4]))


def test_rejected_records_are_kept_whole(spark, tmp_path):
    feed = tmp_path / "feed"
    clean_dirty(spark, SF_SMALL).limit(30).coalesce(1).write.json(str(feed))
    (feed / "bad.json").write_text("{this is not json\n")
    fitted = MD.fit_preprocessing(with_split(spark, SF_SMALL))
    model = PipelineModel(stages=[*fitted.stages, LogisticRegression(maxIter=2).fit(
        fitted.transform(with_split(spark, SF_SMALL)))])
    q = ST.start_scoring_stream(spark, str(feed), model, str(tmp_path / "v"), str(tmp_path / "r"),
                                str(tmp_path / "c"), version="1", name="m", run_ts="t")
    q.awaitTermination()
    rejected = spark.read.parquet(str(tmp_path / "r"))
    assert set(S.CUSTOMER_COLUMNS) <= set(rejected.columns)
    assert rejected.where("_corrupt_record = '{this is not json'").count() == 1
    assert rejected.count() + spark.read.parquet(str(tmp_path / "v")).count() == 31


def test_stream_scoring_splits_like_the_batch_rules(spark):
    out = all_queries()["stream_score"].build(spark, SF_SMALL)
    got = {r["customerID"]: r["status"] for r in out.collect()}
    checked = RU.apply_request_rules(clean_dirty(spark, SF_SMALL))
    want = {r["customerID"]: ("scored" if r["is_valid"] else "quarantined") for r in checked.collect()}
    assert got == want
    assert set(r["risk_level"] for r in out.where("status = 'scored'").collect()) <= {"Low", "Medium", "High"}


def test_stream_window_drift_equals_batch_on_closed_windows(spark):
    streamed = {(r["window_start"], r["feature"]): r["drift_score"]
                for r in all_queries()["stream_window_drift"].build(spark, SF_SMALL).collect()}
    ev = TB.table(spark, SF_SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r["window_start"].replace(tzinfo=None), r["feature"]): r["drift_score"]
             for r in D.windowed_drift(ev, "ts", "value", "event_type").collect()}
    assert streamed and set(streamed) < set(batch)
    for k, v in streamed.items():
        assert abs(v - batch[k]) <= 1e-4
