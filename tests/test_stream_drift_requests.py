"""Drift of a running stream against a stored reference; the request stream."""

import datetime as dt
import json
import math
import statistics
import time

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tessera.operators import models as MD
from tessera.plans import q_stream as QS
from tessera.plans.q_clean import clean_base
from tessera.plans.q_features import with_split
from tessera.sources import files as IO
from tessera.sources import tables as TB
from tessera.streaming import drift as SD
from tessera.streaming import requests as SR
from tests.conftest import SF_SMALL

NUM, CAT = ["value"], ["event_type"]


def _feed(spark, path, frames):
    """Files that arrive one after another, in event-time order."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source goes by modification time


def _weeks(spark):
    ev = TB.table(spark, SF_SMALL, "events")
    week = F.window(F.col("ts").cast("timestamp"), "7 days").start
    starts = [r[0] for r in ev.select(week.alias("w")).distinct().orderBy("w").collect()]
    return ev, week, starts


def _start(spark, ev, tmp, **kw):
    return SD.start_drift_stream(spark, f"{tmp}/in", ev.schema, f"{tmp}/ref", f"{tmp}/out", f"{tmp}/ckpt", NUM, CAT,
                                 max_files_per_trigger=1, **kw)


def _rows(spark, path):
    return sorted((r.window_start, r.feature, r.current_rows, round(r.score, 9), r.drifted)
                  for r in spark.read.parquet(path).collect())


def test_windows_are_scored_while_the_stream_runs_and_a_restart_adds_nothing(spark, tmp_path):
    ev, week, starts = _weeks(spark)
    parts = [ev.where(week == F.lit(w)) for w in starts]
    SD.write_reference(parts[0], NUM, CAT, f"{tmp_path}/ref")
    _feed(spark, f"{tmp_path}/in", parts[:3])
    _start(spark, ev, tmp_path).awaitTermination()
    early = _rows(spark, f"{tmp_path}/out")
    assert {r[0] for r in early} == set(starts[:2])  # the third week isn't over for the watermark
    # nothing new: a restart from the checkpoint leaves the table as it is
    _start(spark, ev, tmp_path).awaitTermination()
    assert _rows(spark, f"{tmp_path}/out") == early
    _feed(spark, f"{tmp_path}/in", parts[3:])
    _start(spark, ev, tmp_path).awaitTermination()
    late = _rows(spark, f"{tmp_path}/out")
    assert late[:len(early)] == early and len(late) == len(set(r[:2] for r in late))
    # the batch over the whole table says the same of the closed windows
    batch = SD.score_profiles(SD.window_profiles(ev, NUM, CAT), spark.read.parquet(f"{tmp_path}/ref"))
    want = sorted((r.window_start, r.feature, r.current_rows, round(r.score, 9), r.drifted) for r in batch.collect())
    assert late == [r for r in want if r[0] in {x[0] for x in late}] and len(late) >= 2 * (len(starts) - 2)


def test_a_batch_that_failed_after_writing_is_replayed_without_double_rows(spark, tmp_path, monkeypatch):
    ev, week, starts = _weeks(spark)
    SD.write_reference(ev.where(week == F.lit(starts[0])), NUM, CAT, f"{tmp_path}/ref")
    _feed(spark, f"{tmp_path}/in", [ev.where(week == F.lit(w)) for w in starts[:3]])
    put, calls = SD.put_windows, []

    def fails_once(scored, sink, batch_id):
        put(scored, sink, batch_id)
        calls.append(batch_id)
        if len(calls) == 3:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(SD, "put_windows", fails_once)
    with pytest.raises(Exception, match="lost after the write"):
        _start(spark, ev, tmp_path).awaitTermination()
    _start(spark, ev, tmp_path).awaitTermination()
    assert calls[3] == calls[2]  # the same batch again
    rows = _rows(spark, f"{tmp_path}/out")
    assert len(rows) == len(set(r[:2] for r in rows)) == 4


def test_the_reference_stays_fixed(spark, tmp_path):
    ev, _, _ = _weeks(spark)
    SD.write_reference(ev, NUM, CAT, f"{tmp_path}/ref")
    with pytest.raises(Exception, match="already exists"):
        SD.write_reference(ev.limit(1), NUM, CAT, f"{tmp_path}/ref")


def test_scores_by_hand(spark):
    def at(day):
        return dt.datetime(2024, 1, 4) + dt.timedelta(days=day)
    schema = "ts timestamp, value double, kind string, other string"
    ref = spark.createDataFrame([(at(0), 1.0, "a", None), (at(0), 3.0, "a", None), (at(0), None, "b", None),
                                 (at(0), float("nan"), None, None)], schema)
    cur = spark.createDataFrame([(at(0), 5.0, "c", "x"), (at(1), 7.0, "a", "x"), (at(8), None, None, "x")], schema)
    scored = SD.score_profiles(SD.window_profiles(cur, ["value"], ["kind", "other"]),
                               SD.profile(ref, ["value"], ["kind", "other"]))
    got = {(r.window_start.day, r.feature): (r.current_rows, r.reference_rows, r.score, r.drifted)
           for r in scored.collect()}
    s = statistics.stdev([1, 3])
    assert got[4, "value"] == (2, 4, pytest.approx(4 / (s + 1e-9)), True)
    assert got[4, "kind"] == (2, 4, pytest.approx((abs(2 / 3 - 1 / 2) + 1 / 3 + 1 / 2) / 2), True)
    assert got[4, "other"] == (2, 4, pytest.approx(0.5), True)  # the reference has no values
    assert got[11, "value"] == (1, 4, None, False)
    assert got[11, "kind"] == (1, 4, pytest.approx(0.5), True)  # the window has no values
    report = {r.window_start.day: r for r in SD.window_reports(scored).collect()}
    assert report[4].drifted_features == "kind,other,value" and report[4].drift_detected
    assert report[11].n_features == 3 and report[11].current_rows == 1


# -- requests -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model(spark):
    df = with_split(spark, SF_SMALL)
    fitted = MD.fit_preprocessing(df)
    return PipelineModel(stages=[*fitted.stages, LogisticRegression(maxIter=2).fit(fitted.transform(df))])


def _run(spark, tmp, model, keep="1 day"):
    q = SR.start_request_stream(spark, f"{tmp}/in", model, f"{tmp}/scored", f"{tmp}/rejected", f"{tmp}/ckpt",
                                version="1", name="m", run_ts="t", keep_ids=keep, max_files_per_trigger=1)
    q.awaitTermination()


def _record(spark, i=0):
    row = clean_base(spark, SF_SMALL).orderBy("customerID").collect()[i].asDict()
    return {k: v for k, v in row.items() if k not in ("customerID", "Churn")}


def _put(tmp, name, lines):
    (tmp / "in").mkdir(exist_ok=True)
    (tmp / "in" / name).write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n")
    time.sleep(1.1)


def test_repeated_requests_are_scored_once_also_after_a_restart(spark, tmp_path, model):
    fine = _record(spark)
    ask = lambda i, minute, **k: {"request_id": f"r{i}", "received_at": f"2024-03-01T00:{minute:02d}:00", **fine, **k}
    _put(tmp_path, "a.json", [ask(1, 0), ask(1, 0), ask(2, 1), ask(3, 1, tenure=-1), "{cut off", "{cut off",
                              {"received_at": "2024-03-01T00:01:00", **fine}])
    _put(tmp_path, "b.json", [ask(2, 2), ask(4, 2), ask(5, 3, tenure="many")])
    _run(spark, tmp_path, model)
    _put(tmp_path, "c.json", [ask(1, 5), ask(4, 5), ask(6, 5), ask(3, 6)])
    _run(spark, tmp_path, model)
    scored = [r.request_id for r in spark.read.parquet(f"{tmp_path}/scored").collect()]
    assert sorted(scored) == ["r1", "r2", "r4", "r6"]
    rejected = spark.read.parquet(f"{tmp_path}/rejected").collect()
    assert sorted((r.reason, r.request_id or "") for r in rejected) == [
        ("invalid", "r3"), ("unidentified", ""), ("unreadable", ""), ("unreadable", ""), ("unreadable", "r5")] or sorted(
        (r.reason, r.request_id or "") for r in rejected) == [
        ("invalid", "r3"), ("unidentified", ""), ("unreadable", ""), ("unreadable", ""), ("unreadable", "")]
    lines = [r[IO.RAW_LINE] for r in rejected if r.reason == "unreadable"]
    assert lines.count("{cut off") == 2 and any('"many"' in line for line in lines)
    assert [r.violations for r in rejected if r.reason == "invalid"] == ["tenure_negative"]


def test_ids_are_forgotten_behind_the_watermark(spark, tmp_path, model):
    fine = _record(spark)
    ask = lambda i, hour: {"request_id": f"r{i}", "received_at": f"2024-03-01T{hour:02d}:00:00", **fine}
    for n, asked in enumerate([[ask(1, 0)], [ask(2, 5)], [ask(3, 6)], [ask(1, 7), ask(2, 7)], [ask(4, 8)], [ask(5, 1)]]):
        _put(tmp_path, f"{n}.json", asked)
    _run(spark, tmp_path, model, keep="2 hours")
    scored = sorted(r.request_id for r in spark.read.parquet(f"{tmp_path}/scored").collect())
    # r1 is forgotten by 07:00, r2 is not; r5 is older than the watermark
    assert scored == ["r1", "r1", "r2", "r3", "r4"]


def test_read_requests_as_a_table(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"request_id": "x", "tenure": 3}) + "\n[broken\n")
    rows = IO.read_requests(spark, str(tmp_path)).collect()
    assert sorted((r.request_id or "", r.tenure or 0, r[IO.RAW_LINE] or "") for r in rows) == [
        ("", 0, "[broken"), ("x", 3, "")]


def test_request_feed_holds_every_customer(spark, tmp_path):
    customers = clean_base(spark, SF_SMALL)
    QS.request_lines(customers).write.text(str(tmp_path / "f"))
    feed = IO.read_requests(spark, str(tmp_path / "f"))
    assert feed.count() > customers.count() and math.isclose(
        feed.where("request_id is not null").select("request_id").distinct().count() / customers.count(), 0.89, abs_tol=0.09)
