import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import drift as D


def _customers(spark, n, seed, shift=0.0, contract=None):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((f"C{i}", rnd.randint(0, 72) + int(shift * 0.75), 20 + rnd.random() * 100 + shift,
                     rnd.random() * 5000, rnd.randint(0, 1), rnd.choice(["Male", "Female"]),
                     rnd.choice(["Yes", "No"]), rnd.choice(["Yes", "No"]),
                     contract or rnd.choice(["Month-to-month", "One year", "Two year"]),
                     rnd.choice(["DSL", "Fiber optic", "No"]),
                     rnd.choice(["Electronic check", "Mailed check"])))
    return spark.createDataFrame(rows, "customerID string, tenure int, MonthlyCharges double, TotalCharges double, "
                                       "SeniorCitizen int, gender string, Partner string, Dependents string, "
                                       "Contract string, InternetService string, PaymentMethod string")


@pytest.fixture(scope="module")
def reference(spark):
    return _customers(spark, 500, 42).cache()


def test_similar_data_does_not_drift(spark, reference):
    rep = D.drift_report(reference, _customers(spark, 300, 99)).first()
    assert not rep["drift_detected"]
    assert rep["reference_rows"] == 500 and rep["current_rows"] == 300
    assert rep["n_features"] == 10


def test_heavy_drift_is_found(spark, reference):
    cur = _customers(spark, 500, 7, shift=95.0, contract="One year")
    rep = D.drift_report(reference, cur).first()
    assert rep["drift_detected"]
    assert rep["drifted_features"].split(",")[:2] == ["tenure", "MonthlyCharges"]
    assert "Contract" in rep["drifted_features"]


def test_absent_column_is_skipped(spark, reference):
    cur = _customers(spark, 100, 1).drop("gender", "tenure")
    num = {r["feature"] for r in D.numeric_drift(reference, cur).collect()}
    cat = {r["feature"] for r in D.categorical_drift(reference, cur).collect()}
    assert "tenure" not in num and "gender" not in cat


def test_tvd_counts_categories_missing_on_one_side(spark):
    ref = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "g string")
    cur = spark.createDataFrame([("c",), ("a",)], "g string")
    r = D.categorical_drift(ref, cur, ["g"]).first()
    # p_ref = a 2/3, b 1/3 ; p_cur = a 1/2, c 1/2 → ½(1/6 + 1/3 + 1/2) = 0.5
    assert r["total_variation_distance"] == 0.5 and r["drifted"]


def test_numeric_score_formula(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    cur = spark.createDataFrame([(3.0,), (4.0,)], "x double")
    r = D.numeric_drift(ref, cur, ["x"]).first()
    assert r["drift_score"] == round(1.5 / (1.0 + 1e-9), 4)
    assert r["reference_mean"] == 2.0 and r["current_mean"] == 3.5


def test_missing_values_compare(spark):
    ref = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    cur = spark.createDataFrame([(None, None), (None, "x"), (3, "y")], "a int, b string")
    got = {r["column"]: (r["reference_nulls"], r["current_nulls"]) for r in D.missing_values(ref, cur).collect()}
    assert got == {"a": (0, 2), "b": (1, 1)}


def test_distribution_distances_against_brute_force(spark):
    rnd = random.Random(3)
    a = [rnd.randint(0, 20) * 1.0 for _ in range(200)]
    b = [rnd.randint(5, 30) * 1.0 for _ in range(150)]
    ref = spark.createDataFrame([(x, "p" if x < 10 else "q") for x in a], "x double, c string")
    cur = spark.createDataFrame([(x, "p" if x < 10 else "r") for x in b], "x double, c string")
    out = {r["feature"]: r for r in D.distribution_distances(ref, cur, ["x"], ["c"], n_buckets=4).collect()}
    vals = sorted(set(a) | set(b))
    fa = lambda v: sum(1 for x in a if x <= v) / len(a)
    fb = lambda v: sum(1 for x in b if x <= v) / len(b)
    w1 = sum((vals[i + 1] - vals[i]) * abs(fa(vals[i]) - fb(vals[i])) for i in range(len(vals) - 1))
    ks = max(abs(fa(v) - fb(v)) for v in vals)
    mean = sum(a) / len(a)
    sd = (sum((x - mean) ** 2 for x in a) / len(a)) ** 0.5
    assert out["x"]["wasserstein_normed"] == pytest.approx(w1 / sd, abs=1e-6)
    assert out["x"]["ks_statistic"] == pytest.approx(ks, abs=1e-6)
    assert 0 < out["c"]["jensen_shannon"] <= 1
    import math
    en = len(a) * len(b) / (len(a) + len(b))
    lam = (math.sqrt(en) + 0.12 + 0.11 / math.sqrt(en)) * ks
    q = 1.0 if lam < 0.3 else min(1.0, max(0.0, sum(2 * (-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam)
                                                   for j in range(1, 101))))
    assert out["x"]["ks_pvalue"] == pytest.approx(q, abs=1e-6)
    assert out["x"]["test"] == "ks" and out["x"]["drifted"] == (q < 0.05)


def test_windowed_drift_first_window_is_zero(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=6 * i), float(i % 7), "a" if i < 40 else "b") for i in range(80)]
    ev = spark.createDataFrame(rows, "ts timestamp_ntz, value double, event_type string")
    out = D.windowed_drift(ev, "ts", "value", "event_type").orderBy("window_start", "feature").collect()
    first = [r for r in out if r["window_start"] == out[0]["window_start"]]
    assert all(r["drift_score"] == 0.0 for r in first)
    assert any(r["drifted"] for r in out if r["feature"] == "event_type")


@pytest.mark.parametrize("x,dof,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.0705, 5, 0.05),
                                     (18.307, 10, 0.05), (0.0, 3, 1.0), (2.0, 2, 0.367879)])
def test_chi2_pvalue_matches_tables(spark, x, dof, p):
    df = spark.createDataFrame([(x, dof)], "x double, dof long")
    got = df.select(D.chi2_pvalue(F.col("x"), F.col("dof")).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=2e-5)


def test_chisquare_flags_a_new_category(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "g string")
    same = spark.createDataFrame([("a",)] * 48 + [("b",)] * 52, "g string")
    new = spark.createDataFrame([("a",)] * 50 + [("c",)] * 50, "g string")
    r1 = D.distribution_distances(ref, same, [], ["g"]).first()
    r2 = D.distribution_distances(ref, new, [], ["g"]).first()
    assert r1["test"] == "chisquare" and not r1["drifted"] and r1["chi2_pvalue"] > 0.5
    assert r2["drifted"] and r2["chi2_pvalue"] == 0.0


def test_drift_report_with_one_kind_of_feature(spark):
    from tessera.operators import drift as D
    ref = spark.createDataFrame([("Yes", 1.0), ("No", 2.0)], "Partner string, MonthlyCharges double")
    cur = spark.createDataFrame([("Yes", 1.0), ("Yes", 9.0), ("No", 2.0)], "Partner string, MonthlyCharges double")
    cat_only = D.drift_report(ref.drop("MonthlyCharges"), cur.drop("MonthlyCharges"), categorical=["Partner"]).first()
    assert (cat_only["n_features"], cat_only["reference_rows"], cat_only["current_rows"]) == (1, 2, 3)
    num_only = D.drift_report(ref, cur, numeric=["MonthlyCharges"], categorical=["absent"]).first()
    assert (num_only["n_features"], num_only["reference_rows"], num_only["current_rows"]) == (1, 2, 3)
    none = D.drift_report(ref, cur, numeric=["absent"], categorical=["absent"]).first()
    assert (none["n_features"], none["drift_detected"], none["reference_rows"], none["current_rows"]) == (0, False, 2, 3)
