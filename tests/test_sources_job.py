import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.plans.job import run_training_job
from tessera.sources import files as IO
from tessera.sources import synthetic as SY


def test_generator_shape_determinism_and_rates(spark):
    a = SY.generate_customers(spark, 2000, seed=42)
    assert a.columns == S.CUSTOMER_COLUMNS
    rows = sorted(map(tuple, a.collect()))
    b = SY.generate_customers(spark, 2000, seed=42).repartition(7)
    assert sorted(map(tuple, b.collect())) == rows
    assert a.where("TotalCharges = ' '").count() == 11
    assert a.where("tenure < 6").count() == 2000 // 3
    rate = a.agg(F.avg((F.col("Churn") == "Yes").cast("double"))).first()[0]
    assert 0.20 <= rate <= 0.55
    assert a.select("customerID").distinct().count() == 2000


def test_missing_input_names_the_stage(spark):
    import pytest
    with pytest.raises(FileNotFoundError, match="ingestion"):
        IO.read_table(spark, "/nonexistent/x.csv", S.RAW_CUSTOMER_SCHEMA)


def test_csv_scan_keeps_blank_as_text_and_na_as_null(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    p = os.path.join(d, "raw.csv")
    with open(p, "w") as f:
        f.write("a,b\n1, \n2,NA\n")
    df = IO.read_table(spark, p, "a int, b string")
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, " "), (2, None)]


def test_load_or_generate_then_reads_back(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-gen-"), "raw")
    first = IO.load_or_generate(spark, path, n=300)
    assert first.count() == 300
    again = IO.load_or_generate(spark, path, n=999)   # present: read, not regenerated
    assert again.count() == 300


def test_latest_report_defaults_and_selection(spark):
    root = tempfile.mkdtemp(prefix="tessera-rep-")
    missing = IO.latest_report(spark, os.path.join(root, "none"))
    given = missing.first().asDict()
    assert given["status"] == "no_reports_directory" and given["method"] == "none"
    assert given["drift_detected"] is False and given["drift_score"] == 0.0 and given["current_rows"] == 0
    d = os.path.join(root, "drift")
    os.makedirs(d)
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write(json.dumps({"method": "m", "drift_score": 0.1, "drift_detected": False, "run_ts": "20240101"}) + "\n")
        f.write(json.dumps({"method": "m", "drift_score": 0.4, "drift_detected": True, "run_ts": "20240201"}) + "\n")
        f.write("{not json\n")
    r = IO.latest_report(spark, d).first()
    assert r["status"] == "ok" and r["drift_score"] == 0.4 and r["parse_errors"] == 1
    assert IO.latest_report(spark, d).columns == missing.columns
    e = os.path.join(root, "bad")
    os.makedirs(e)
    with open(os.path.join(e, "a.json"), "w") as f:
        f.write("{not json\n")
    assert IO.latest_report(spark, e).first()["status"] == "unreadable"
    IO.write_report(spark.createDataFrame([("error", False, "x" * 900)],
                                          "status string, drift_detected boolean, error string"), e, "2024")
    r = IO.latest_report(spark, e).first()
    assert (r["status"], len(r["error"]), r["method"]) == ("error", 900, "none")


def test_training_job_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="tessera-job-")
    raw = SY.generate_customers(spark, 1500, seed=7).withColumn("load_order", F.lit(1))
    for ts in ("2024-01-01T00:00:00", "2024-02-01T00:00:00"):
        res = run_training_job(spark, raw, out, ts, model_names=["LogisticRegression"])
    versions = {r["version"]: r["stage"] for r in res.versions.collect()}
    assert versions == {1: "Archived", 2: "Production"}
    assert res.runs.count() == 2
    assert res.drift.first()["status"] == "ok"
    assert res.validation_failed >= 0
    assert os.path.isdir(os.path.join(out, "models"))


def test_job_rerun_replaces_its_own_rows(spark, monkeypatch):
    from tessera.operators import drift as D
    out = tempfile.mkdtemp(prefix="tessera-rerun-")
    raw = SY.generate_customers(spark, 1200, seed=5).withColumn("load_order", F.lit(1))
    run = lambda ts: run_training_job(spark, raw, out, ts, model_names=["LogisticRegression"])
    run("2024-01-01T00:00:00")
    validation = spark.read.json(f"{out}/reports/validation").count()
    run("2024-02-01T00:00:00")

    def broken(*a, **k):
        raise RuntimeError("no reference " + "x" * 600)
    monkeypatch.setattr(D, "drift_report", broken)
    res = run("2024-02-01T00:00:00")
    assert {r["version"]: r["stage"] for r in res.versions.collect()} == {1: "Archived", 2: "Production"}
    assert res.runs.count() == res.runs.select("run_id").distinct().count() == 2
    assert spark.read.json(f"{out}/reports/validation").count() == 2 * validation
    latest = res.drift.first()
    assert latest["status"] == "error" and latest["drift_detected"] is False and len(latest["error"]) > 600
    for report in ("ingestion", "validation", "training", "evaluation", "drift"):
        assert spark.read.json(f"{out}/reports/{report}").count() > 0


def test_stream_follows_the_registry(spark):
    from tessera.streaming import scoring as ST
    out = tempfile.mkdtemp(prefix="tessera-serve-")
    raw = SY.generate_customers(spark, 1200, seed=11).withColumn("load_order", F.lit(1))
    run_training_job(spark, raw, out, "2024-03-01T00:00:00", model_names=["LogisticRegression"])
    feed = os.path.join(out, "feed")
    spark.read.parquet(os.path.join(out, "processed")).limit(50).write.json(feed)
    serving = ST.ServingModel(spark, os.path.join(out, "model_versions"), os.path.join(out, "models"),
                              "churn-classifier")
    q = ST.start_scoring_stream(spark, feed, serving, os.path.join(out, "valid"), os.path.join(out, "rejected"),
                                os.path.join(out, "_ckpt"), version=None, name="LogisticRegression",
                                run_ts="2024-03-02T00:00:00")
    q.awaitTermination()
    scored = spark.read.parquet(os.path.join(out, "valid"))
    assert scored.count() > 0
    assert {r["model_version"] for r in scored.select("model_version").distinct().collect()} == {"1"}
