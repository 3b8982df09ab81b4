"""Commits, observed report, whole value lists, allowed tables, exact small-sample test,
retraining from the run log, feature report, offsets, CSV splitting."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators import clean as C
from tessera.operators import drift as D
from tessera.operators import expectations as X
from tessera.operators import prefix as P
from tessera.operators import preprocess as PP
from tessera.operators import registry as R
from tessera.operators import rules as RU
from tessera.plans.q_features import with_split
from tessera.sources import files as IO
from tessera.sources import tables as TB
from tessera.sources.commits import CommitConflict, CommitLog
from tests.conftest import SF_SMALL


# -- commits ---------------------------------------------------------------------------
def _run(spark, run_id, auc=0.8, start="2024-01-01", model="m"):
    return spark.createDataFrame([(run_id, model, "FINISHED", start, {}, {}, {"roc_auc": auc})], S.RUNS_SCHEMA)


def _log(spark, tmp_path):
    return CommitLog(spark, str(tmp_path / "versions"), S.MODEL_VERSIONS_SCHEMA)


def _stages(log):
    return {r.version: (r.run_id, r.stage) for r in log.read().collect()}


def test_two_promotions_from_one_snapshot_both_stay(spark, tmp_path):
    log, other = _log(spark, tmp_path), _log(spark, tmp_path)
    log.commit(lambda v: R.promote(v, _run(spark, "first"), "churn"))
    met = []

    def slow(versions):
        """While this one is under way another job promotes its own run."""
        out = R.promote(versions, _run(spark, "slow"), "churn")
        if not met:
            met.append(other.commit(lambda v: R.promote(v, _run(spark, "quick"), "churn")))
        return out

    assert log.commit(slow) == 3 and met == [2]
    assert _stages(log) == {1: ("first", "Archived"), 2: ("quick", "Archived"), 3: ("slow", "Production")}
    assert [e["parent"] for e in log.entries()] == [0, 1, 2]
    folders = {p.name for p in (tmp_path / "versions").iterdir()} - {"_commits", "_drafts"}
    assert folders == {e["folder"] for e in log.entries()}  # what lost the race is gone
    assert log.read(1).count() == 1 and log.read(2).count() == 2


def test_a_key_commits_once_and_an_empty_log_reads_as_empty(spark, tmp_path):
    log = _log(spark, tmp_path)
    assert log.read().count() == 0 and log.version() == 0
    for _ in range(2):
        assert log.commit(lambda v: R.promote(v, _run(spark, "a"), "churn"), key="job-1") == 1
    assert log.version() == 1
    with pytest.raises(CommitConflict):
        log.commit(lambda v: (log.commit(lambda w: w), v)[1], attempts=3)


# -- cleaning report from the write ------------------------------------------------------
def test_observed_report_equals_the_separate_one(spark, dirty_raw):
    for raw, order in ((TB.customers_dirty(spark, SF_SMALL), ["load_order"]), (dirty_raw, ["load_order"]),
                       (dirty_raw.limit(0), ["load_order"])):
        clean, report = C.clean_with_report(raw, order_cols=order)
        assert report.collect() == C.cleaning_report(raw, order_cols=order).collect()
        assert sorted(map(repr, clean.collect())) == sorted(map(repr, C.clean_customers(raw, order_cols=order).collect()))


# -- value lists ---------------------------------------------------------------------------
def test_every_value_of_every_suite_is_listed(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), (F.col("id") % 5000).cast("string")).alias("a"),
                                    F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("b"))
    suite = [X.NotNull("a"), X.InSet("a", values=["v1", "v2"]), X.InSet("b", values=[0, 1]), X.InSet("gone", values=["x"])]
    got = X.suite_values(df, suite).collect()
    a = {r.value: (r.kind, r.n) for r in got if r.rule_id == 2}
    assert len(a) == 5000 and a["v1"] == ("expected", 4) and a["v4999"] == ("unexpected", 4)
    b = {r.value: r.kind for r in got if r.rule_id == 3}
    assert b == {str(i): "expected" if i < 2 else "unexpected" for i in range(7)}
    assert {r.rule_id for r in got} == {2, 3}
    assert X.suite_values(df, [X.NotNull("a")]).count() == 0
    report = {r.rule_id: r.success for r in X.run_suite(df, suite).collect()}
    assert report[2] is False


def test_allowed_values_from_a_table_of_a_million(spark):
    allowed = spark.range(1_000_000).select((F.col("id") * 2).alias("ok")).union(spark.createDataFrame([(None,)], "ok long"))
    df = spark.createDataFrame([(0,), (2,), (2,), (3,), (3,), (3,), (1_999_998,), (2_000_000,), (None,)], "x long")
    bad = RU.not_in_table(df, "x", allowed, "ok")
    assert sorted((r.value, r.n) for r in bad.collect()) == [("2000000", 1), ("3", 3)]
    plan = bad._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and len(plan) < 20_000  # no list of values
    rule = RU.in_table_rule(df, "x", allowed, "ok").first()
    assert (rule.success, rule.unexpected_values, rule.unexpected_rows, rule.commonest) == (False, 2, 4, "3")
    fine = RU.in_table_rule(df.where("x = 2"), "x", allowed, "ok").first()
    assert (fine.success, fine.unexpected_rows, fine.commonest) == (True, 0, None)


# -- exact small-sample test -------------------------------------------------------------------
def test_exact_ks_against_all_orders():
    for n1, n2 in itertools.product(range(1, 7), range(1, 7)):
        counts: dict = {}
        for at in itertools.combinations(range(n1 + n2), n1):
            i = j = worst = 0
            for k in range(n1 + n2):
                i, j = (i + 1, j) if k in at else (i, j + 1)
                worst = max(worst, abs(i * n2 - j * n1))
            counts[worst] = counts.get(worst, 0) + 1
        total = math.comb(n1 + n2, n1)
        for steps in range(0, n1 * n2 + 1):
            want = sum(c for w, c in counts.items() if w >= steps) / total
            assert D.ks_exact(steps, n1, n2) == pytest.approx(want, abs=1e-12)
    assert D.ks_exact(12 * 12, 12, 12) == pytest.approx(2 / math.comb(24, 12))


def test_exact_ks_of_larger_samples_nears_the_asymptotic_value(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame([(float(x),) for x in rng.normal(size=900)], "x double")
    cur = spark.createDataFrame([(float(x),) for x in rng.normal(0.1, 1, 700)] + [(None,), (float("nan"),)], "x double")
    r = D.small_sample_drift(ref, cur, ["x"]).first()
    near = D.distribution_distances(ref, cur, ["x"], []).first()
    assert (r.n1, r.n2, r.method) == (900, 700, "exact") and r.ks_statistic == near.ks_statistic
    assert r.ks_pvalue == pytest.approx(near.ks_pvalue, rel=0.1)
    assert D.small_sample_drift(ref, cur.limit(0), ["x"]).first().drifted is False


def test_log_gamma_for_any_argument(spark):
    xs = [0.0, 0.5, 1.0, 7.5, 100.0, 12345.5, 5e7, 1e12]
    got = spark.createDataFrame([(x,) for x in xs], "a double").select("a", D.log_gamma_plus_one(F.col("a")).alias("g")).collect()
    for r in got:
        assert r.g == pytest.approx(math.lgamma(r.a + 1), rel=1e-13, abs=1e-12)
    wide = spark.createDataFrame([(1.0e8, 100_000_000)], "x double, dof long")
    assert wide.select(D.chi2_pvalue(F.col("x"), F.col("dof"))).first()[0] == pytest.approx(0.5, abs=0.01)


# -- run log, reports -----------------------------------------------------------------------------
def test_retraining_follows_the_run_log(spark):
    runs = _run(spark, "r1", 0.80, "2024-01-01").unionByName(_run(spark, "r2", 0.79, "2024-02-01")).unionByName(
        _run(spark, "other", 0.1, "2024-09-01", "another"))
    versions = spark.createDataFrame([("churn", 1, "Production", "r1", None)], S.MODEL_VERSIONS_SCHEMA)
    report = spark.createDataFrame([(False, "", 0.1, 0)],
                                   "drift_detected boolean, drifted_features string, drift_score double, n_drifted_features long")
    assert D.retrain_from_runs(report, runs, versions, "churn").first().retrain is False
    worse = runs.unionByName(_run(spark, "r3", 0.70, "2024-03-01"))
    got = D.retrain_from_runs(report, worse, versions, "churn").first()
    assert got.retrain is True and got.reason == "ROC-AUC fell from 0.8000 to 0.7000"
    assert D.auc_history(runs.limit(0), versions, "churn").first().baseline is None
    assert D.retrain_from_runs(report, worse, versions.limit(0), "churn").first().retrain is False


def test_feature_report_names_every_output(spark):
    split = with_split(spark, SF_SMALL).withColumn("label_unmapped", F.col("tenure") == 3)
    r = PP.feature_metadata(split).first()
    train = split.where("split = 'train'")
    assert r.numerical_features == PP.NUM_FEATURES and r.categorical_features == list(S.CATEGORICAL_FEATURES)
    names = [f"numerical__{c}" for c in PP.NUM_FEATURES]
    for c in S.CATEGORICAL_FEATURES:
        names += [f"categorical__{c}_{v[0]}" for v in sorted(train.select(c).where(f"{c} is not null").distinct().collect())]
    assert r.output_features == names and r.n_output_features == len(names)
    assert r.train_rows == train.count() and r.labels_unmapped == split.where("tenure = 3").count()


def test_running_totals_without_broadcast(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.lit(1).alias("v"))
    want = sorted(map(tuple, P.running_totals(df, ["k"], ["v"], ["g"], n_buckets=7).collect()))
    monkeypatch.setattr(P, "_BROADCAST_OFFSETS", 0)
    assert sorted(map(tuple, P.running_totals(df, ["k"], ["v"], ["g"], n_buckets=7).collect())) == want


def test_csv_is_splittable_unless_fields_hold_line_breaks(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    spark.createDataFrame([("a\nb", 1), ("c", 2)], "t string, n int").coalesce(1).write.option("header", True).option(
        "quoteAll", True).csv(path)
    schema = "t string, n int"
    from pyspark.sql import types as T
    typed = T.StructType.fromDDL(schema)
    assert {r.t for r in IO.read_table(spark, path, typed, "csv", multi_line=True).collect()} == {"a\nb", "c"}
    big = str(tmp_path / "big.csv")
    spark.range(200_000).select(F.col("id").cast("string").alias("t"), F.col("id").cast("int").alias("n")).coalesce(1).write.option(
        "header", True).csv(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert IO.read_table(spark, big, typed, "csv").rdd.getNumPartitions() > 3
        assert IO.read_table(spark, big, typed, "csv").count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_training_rows_fill_every_wave_and_lie_sorted(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array
    from tessera.operators import models as MD
    assert MD.training_partitions(4_320_000, 12) == 24  # 18 would leave half the cores idle in a second wave
    assert [MD.training_partitions(n, 12) for n in (100, 12_000, 720_000)] == [1, 6, 12]
    monkeypatch.setattr(MD, "SORTED_ROWS", 100)
    rows = [(float(i * 37 % 101), "ab"[i % 2], i % 3 % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, c string, label int").repartition(3)
    prep = MD.fit_preprocessing(df, ["x"], ["c"])
    vectors = MD.training_vectors(prep, df)
    try:
        parts = vectors.select(vector_to_array("features").alias("v")).rdd.glom().collect()
    finally:
        vectors.unpersist()
    assert sum(map(len, parts)) == 300 and all([r.v for r in p] == sorted(r.v for r in p) for p in parts)
    forest = MD.model_configs(1.0)[1]["estimator"]
    assert forest.getCacheNodeIds() and forest.getCheckpointInterval() == -1


def test_test_rows_are_scored_once(spark, monkeypatch):
    from tessera.operators import metrics as M
    from tessera.operators import models as MD
    from tessera.plans.q_models import _train_test
    seen, evaluate = [], M.evaluate
    monkeypatch.setattr(M, "evaluate", lambda preds: (seen.append(preds), evaluate(preds))[1] if preds.is_cached else 1 / 0)
    train, test = _train_test(spark, "/root/testdata/sf0.001")
    _, runs = MD.train_and_log(train, test, "t", ["LogisticRegression"])
    assert len(seen) == runs.count() == 1 and not seen[0].is_cached
