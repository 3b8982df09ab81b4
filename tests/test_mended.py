"""Cases that went wrong once: tails, null ids, empty registries, NaN, names."""

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators import drift as D
from tessera.operators import models as MD
from tessera.operators import registry as R
from tessera.operators import rules as RU
from tessera.operators import split as SP
from tessera.plans.q_features import with_split
from tests.conftest import SF_SMALL


def upper_tail(x: float, dof: int) -> float:
    """Finite sums for even and odd degrees of freedom."""
    y, term = x / 2, 0.0
    if dof % 2 == 0:
        return math.fsum(math.exp(-y + k * math.log(y) - math.lgamma(k + 1)) for k in range(dof // 2))
    return math.erfc(math.sqrt(y)) + math.fsum(
        math.exp(-y + (k - 0.5) * math.log(y) - math.lgamma(k + 0.5)) for k in range(1, (dof - 1) // 2 + 1)) + term


def test_chi_square_tail_for_any_degrees_of_freedom(spark):
    cases = [(x, d) for d in (1, 2, 3, 7, 30, 249, 250, 1001, 5000) for x in (0.01, 0.5, 3.8, 60.0, 199.0, 210.0, 900.0, 5200.0)]
    frame = spark.createDataFrame(cases, "x double, dof long")
    for r in frame.withColumn("p", D.chi2_pvalue(F.col("x"), F.col("dof"))).collect():
        assert r.p == pytest.approx(upper_tail(r.x, r.dof), abs=1e-9), (r.x, r.dof)
    assert upper_tail(210.0, 250) == pytest.approx(0.969, abs=1e-3)


def test_both_kinds_of_drift_test_are_asked_for_by_name(spark):
    ref = spark.range(3000).selectExpr("cast(id as double) as x", "cast(id % 260 as string) as c")
    cur = spark.range(3000).selectExpr("cast(id as double) + 400 as x", "cast((id * 7) % 260 as string) as c")
    rows = {t: {r["feature"]: r for r in D.distribution_distances(ref, cur, ["x"], ["c"], test=t).collect()}
            for t in ("pvalue", "distance")}
    assert rows["pvalue"]["x"]["test"] == "ks" and rows["distance"]["x"]["test"] == "wasserstein"
    assert rows["pvalue"]["c"]["chi2_pvalue"] == rows["distance"]["c"]["chi2_pvalue"] > 0.9
    assert not rows["pvalue"]["c"]["drifted"] and rows["distance"]["x"]["drifted"]
    with pytest.raises(ValueError):
        D.distribution_distances(ref, cur, ["x"], ["c"], test="auto")


def test_missing_counts_nan_and_rows(spark):
    ref = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, None)], "x double, c string")
    got = {r["column"]: r["reference_nulls"] for r in D.missing_values(ref, ref).collect()}
    assert got == {"x": 2, "c": 1}
    assert {r["side"]: (r["n_rows"], r["rows_with_missing"]) for r in D.rows_with_missing(ref, ref).collect()} == {
        "reference": (3, 2), "current": (3, 2)}


def test_retrain_when_auc_falls(spark):
    report = spark.createDataFrame([(False, "", 0.1, 0)],
                                   "drift_detected boolean, drifted_features string, drift_score double, n_drifted_features int")
    assert D.retrain_decision(report).first()["reason"] == "no drift"
    assert not D.retrain_decision(report, 0.84, 0.80).first()["retrain"]
    got = D.retrain_decision(report, 0.84, 0.79).first()
    assert got["retrain"] and got["reason"] == "ROC-AUC fell from 0.8400 to 0.7900"


def test_split_takes_rows_without_id(spark):
    rows = [(f"c{i}", i % 2) for i in range(200)] + [(None, 1), (None, 0)]
    got = SP.stratified_split(spark.createDataFrame(rows, "customerID string, label int"))
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert n["train"] + n["test"] == 202 and n["test"] == 41


def test_promotion_without_a_run_leaves_the_registry_alone(spark):
    runs = spark.createDataFrame([("r1", "A", "FAILED", None, None, None, {"roc_auc": 0.8})], S.RUNS_SCHEMA)
    versions = spark.createDataFrame([("m", 1, "Production", "r0", None)], S.MODEL_VERSIONS_SCHEMA)
    with pytest.raises(ValueError):
        R.promote(versions, R.best_run(runs), "m")
    with pytest.raises(ValueError):
        R.require_best_run(runs)


def test_nan_charges_break_the_rules(spark):
    row = tuple({"MonthlyCharges": float("nan"), "TotalCharges": float("nan"), "gender": "Female",
                 "Contract": "One year"}.get(f.name, "No" if f.dataType.simpleString() == "string" else 1)
                for f in S.REQUEST_SCHEMA.fields)
    got = RU.apply_request_rules(spark.createDataFrame([row], S.REQUEST_SCHEMA)).first()
    assert got["violations"] == "MonthlyCharges_not_positive,TotalCharges_negative"


def test_preprocessing_names_width_and_unknown_levels(spark, tmp_path):
    df = with_split(spark, SF_SMALL).checkpoint()
    model = MD.fit(df, LogisticRegression(maxIter=3, labelCol="label"))
    names = MD.feature_names(model)
    odd = df.limit(2).withColumn("Contract", F.lit("never seen")).withColumn("MonthlyCharges", F.lit(None).cast("double"))
    vectors = [r["features"].toArray() for r in model.transform(odd).collect()]
    assert {len(v) for v in vectors} == {len(names)} and len(set(names)) == len(names)
    at = [i for i, n in enumerate(names) if n.startswith("categorical__Contract_")]
    assert at and all(v[i] == 0 for v in vectors for i in at)
    assert not any(math.isnan(x) for v in vectors for x in v)
    # mode for null levels, median for null numbers, population scaling
    null = df.limit(1).withColumn("Contract", F.lit(None).cast("string"))
    assert sum(model.transform(null).first()["features"].toArray()[i] for i in at) == 1
    scaled = model.transform(df).selectExpr("avg(numerical__tenure) as m", "stddev_pop(numerical__tenure) as s").first()
    assert scaled["m"] == pytest.approx(0, abs=1e-9) and scaled["s"] == pytest.approx(1)
    top = MD.top_features(spark, model, 5).collect()
    assert all(not r["feature"].startswith("feature_") for r in top)
    MD.save(model, str(tmp_path / "m"))
    again = MD.load(str(tmp_path / "m")).transform(odd).collect()
    assert [r["features"] for r in again] == [r["features"] for r in model.transform(odd).collect()]


def test_clean_keeps_file_order_and_asks_for_it(spark, dirty_raw):
    from tessera.operators import clean as C
    kept = C.clean_customers(dirty_raw, order_cols=["load_order"], keep_order=True)
    assert [r["customerID"] for r in kept.orderBy("load_order").collect()] == ["K-31", "K-08", "K-77"]
    with pytest.raises(ValueError, match="no order column"):
        C.clean_customers(dirty_raw.drop("load_order"), order_cols=["load_order"])


def test_every_listed_value_is_counted(spark):
    df = spark.range(5000).selectExpr("cast(id as string) as c").unionByName(
        spark.createDataFrame([("1",), (None,)], "c string"))
    got = RU.listed_values(df, [("c", ["1", "2"])])
    assert got.count() == 5000
    assert {(r["value"], r["n"]) for r in got.where("expected").collect()} == {("1", 2), ("2", 1)}
