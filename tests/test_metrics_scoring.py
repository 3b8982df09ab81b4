import random

import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import expressions as E
from tessera.operators import metrics as M
from tessera.operators import prefix as P
from tessera.operators import registry as R
from tessera.operators import rules as RU


def _preds(spark, rows):
    return spark.createDataFrame(rows, "model string, label int, score double").withColumn(
        "prediction", E.decision("score").cast("int"))


def _pairwise_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_exact_auc_with_ties_matches_pairwise_count(spark, buckets):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 1), rnd.randint(0, 20) / 20) for _ in range(500)]
    preds = _preds(spark, [("m", y, s) for y, s in pairs])
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        got = M.roc_auc(preds).first()["roc_auc"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == round(_pairwise_auc(pairs), 6)


def test_metrics_and_zero_division(spark):
    preds = _preds(spark, [("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.2), ("a", 0, 0.1),
                           ("never", 1, 0.1), ("never", 0, 0.2)])
    out = {r["model"]: r for r in M.evaluate(preds).collect()}
    a = out["a"]
    assert (a["tp"], a["fp"], a["fn"], a["tn"]) == (1, 1, 1, 1)
    assert a["accuracy"] == 0.5 and a["precision"] == 0.5 and a["recall"] == 0.5 and a["f1_score"] == 0.5
    assert a["roc_auc"] == 0.75
    n = out["never"]
    assert n["precision"] == 0.0 and n["recall"] == 0.0 and n["f1_score"] == 0.0


@pytest.mark.parametrize("score,band,decision", [
    (0.10, "Low", False), (0.29, "Low", False), (0.30, "Medium", False), (0.45, "Medium", False),
    (0.59, "Medium", True if 0.59 >= 0.5 else False), (0.60, "High", True), (0.75, "High", True),
    (0.99, "High", True), (0.5, "Medium", True),
])
def test_risk_band_edges(spark, score, band, decision):
    r = spark.createDataFrame([(score,)], "p double").select(
        E.risk_band("p").alias("b"), E.decision("p").alias("d")).first()
    assert r["b"] == band and r["d"] == decision


def test_record_rules_quarantine(spark):
    good = (("Female", 1, "No", "Yes", 7, "Yes", "Yes", "Fiber optic", "No", "No", "Yes", "No", "Yes", "No",
             "One year", "No", "Credit card (automatic)", 81.40, 569.80))
    bad = [list(good) for _ in range(4)]
    bad[0][0] = "other"
    bad[1][14] = "Weekly"
    bad[2][4] = -1
    bad[3][17] = None
    df = spark.createDataFrame([good] + [tuple(b) for b in bad], S.REQUEST_SCHEMA).withColumn(
        "customerID", F.monotonically_increasing_id().cast("string"))
    valid, rejected = RU.split_valid(df)
    assert valid.count() == 1
    got = sorted(r["violations"] for r in rejected.collect())
    assert got == sorted(["gender_invalid", "Contract_invalid", "tenure_negative", "MonthlyCharges_missing"])


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_totals_match_cumsum_and_ignore_partitioning(spark, parts):
    rnd = random.Random(parts)
    rows = [(g, i, rnd.randint(0, 9)) for g in ("a", "b") for i in rnd.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(parts)
    got = {(r["g"], r["k"]): (r["_rank"], r["v_cum"]) for r in
           P.running_totals(df, ["k"], ["v"], partition_cols=["g"], n_buckets=7).collect()}
    for g in ("a", "b"):
        run = 0
        for rank, (_, k, v) in enumerate(sorted(r for r in rows if r[0] == g), start=1):
            run += v
            assert got[(g, k)] == (rank, run)


def test_first_n_and_nth_key(spark):
    df = spark.createDataFrame([(f"id{i:04d}",) for i in range(500)], "k string").repartition(5)
    assert P.nth_key(df, "k", 137) == "id0136"
    assert P.first_n(df, "k", 20).count() == 20
    assert P.first_n(df, "k", 1000).count() == 500


@pytest.mark.parametrize("force_fallback", [False, True])
def test_nth_key_exact_with_duplicates_and_nulls(spark, monkeypatch, force_fallback):
    if force_fallback:
        monkeypatch.setattr(P, "_WINDOW_ROWS", -1)
    monkeypatch.setattr(P, "_SAMPLE_KEYS", 300)  # sample a fraction, as at scale
    rnd = random.Random(11)
    vals = [rnd.randint(0, 3000) for _ in range(20_000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "k int").repartition(6)
    ordered = sorted(v for v in vals if v is not None)
    for n in (1, 2, 777, 10_000, 19_999, 20_000):
        assert P.nth_key(df, "k", n) == ordered[n - 1], n
    assert P.nth_key(df, "k", 20_001) is None


def test_nth_key_hot_key_settled_by_pivots(spark, monkeypatch):
    # one key holds a third of the rows; the window around it is far larger
    # than the rank window, so the pivots must settle it (no fallback)
    monkeypatch.setattr(P, "_WINDOW_ROWS", 100)
    monkeypatch.setattr(P, "_SAMPLE_KEYS", 500)
    monkeypatch.setattr(P, "running_totals", None)  # fallback would fail loudly
    rnd = random.Random(3)
    vals = [1500] * 7000 + [rnd.randint(0, 3000) for _ in range(14_000)]
    df = spark.createDataFrame([(v,) for v in vals], "k int").repartition(5)
    ordered = sorted(vals)
    start = ordered.index(1500)
    for n in (start + 1, start + 3500, start + 7000):
        assert P.nth_key(df, "k", n) == 1500


def test_registry_best_run_promotion_and_serving(spark):
    runs = spark.createDataFrame([
        ("r1", "A", "FINISHED", None, None, None, {"roc_auc": 0.80}),
        ("r2", "B", "FINISHED", None, None, None, {"roc_auc": 0.90}),
        ("r3", "C", "FAILED", None, None, None, {"roc_auc": 0.99}),
        ("r0", "D", "FINISHED", None, None, None, {"roc_auc": 0.90}),
    ], S.RUNS_SCHEMA)
    best = R.best_run(runs).first()
    assert best["run_id"] == "r0"  # ties → smallest run id; failed runs ignored
    versions = R.initial_versions(runs, "m")
    assert sorted((r["version"], r["stage"]) for r in versions.collect()) == [(1, "Archived"), (2, "Archived"), (3, "Production")]
    promoted = R.promote(versions, R.best_run(runs), "m")
    stages = {r["version"]: r["stage"] for r in promoted.collect()}
    assert stages == {1: "Archived", 2: "Archived", 3: "Archived", 4: "Production"}
    sv = R.serving_version(promoted, "m").first()
    assert sv["version"] == 4 and sv["run_id"] == "r0"
    none_prod = promoted.withColumn("stage", F.lit("Staging"))
    assert R.serving_version(none_prod, "m").first()["version"] == 4  # newest of all
    assert R.best_run(runs.where("status = 'FAILED'")).count() == 0


def test_percent_display(spark):
    df = spark.createDataFrame([(0.87654,), (3.14159,)], "v double")
    assert [r[0] for r in df.select(E.percent_text("v")).collect()] == ["87.65%", "3.1416"]
