import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import expressions as E
from tessera.operators import clean as C
from tessera.operators import profile as PR


def _by_id(df):
    return {r["customerID"]: r for r in df.collect()}


def test_missing_total_charges_imputed_with_tenure_times_monthly(sample_raw):
    clean = _by_id(C.clean_customers(sample_raw))
    assert clean["K-08"]["TotalCharges"] == 0.0  # tenure 0 × 33.25
    assert clean["K-31"]["TotalCharges"] == pytest.approx(569.80)
    rep = C.cleaning_report(sample_raw).first()
    assert rep["missing_total_charges_before"] == 1
    assert rep["missing_total_charges_imputed"] == 1
    assert rep["null_cells_after"] == 0


def test_duplicate_removed_first_row_kept_and_stripped(dirty_raw):
    clean = C.clean_customers(dirty_raw, order_cols=["load_order"])
    rows = _by_id(clean)
    assert len(rows) == 3
    assert rows["K-31"]["gender"] == "Female"          # spaces and tab stripped
    assert rows["K-31"]["Churn"] == "No"             # first copy kept, not the appended one
    rep = C.cleaning_report(dirty_raw, order_cols=["load_order"]).first()
    assert rep["duplicates_removed"] == 1
    assert rep["rows_before"] == 4 and rep["rows_after"] == 3
    assert "load_order" not in clean.columns


def test_churn_remap(spark):
    raw = spark.createDataFrame(
        [(f"C{i}", v) for i, v in enumerate(["Yes", "No", "1", "0", " Yes ", "maybe", None])],
        "customerID string, Churn string")
    got = [r["Churn"] for r in C.clean_customers(raw, charges_col="none").orderBy("customerID").collect()]
    assert got == ["Yes", "No", "Yes", "No", "Yes", "No", "No"]


@pytest.mark.parametrize("text,expected", [
    ("12.5", 12.5), (" 12.5\t", 12.5), ("-3", -3.0), (".5", 0.5), ("1e3", 1000.0),
    (" ", None), ("", None), ("abc", None), ("1.5d", None), ("NaN", None), ("1_000", None), (None, None),
])
def test_to_number_edge_cases(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(E.to_number("t").alias("x")).first()["x"] == expected


def test_strict_cast_raises_on_null_int(spark):
    raw = spark.createDataFrame([("C1", None)], "customerID string, tenure int")
    with pytest.raises(Exception):
        C.clean_customers(raw, charges_col="none", label_col="none", strict=True).collect()


def test_required_columns(sample_raw):
    C.check_required_columns(sample_raw)
    with pytest.raises(ValueError, match="tenure"):
        C.check_required_columns(sample_raw.drop("tenure"))


def test_null_profile_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    prof = {r["column"]: r["null_count"] for r in PR.null_profile(df).collect()}
    assert prof == {"x": 2, "s": 1}


def test_dedup_invariant_to_partitioning(dirty_raw):
    base = sorted(map(tuple, C.clean_customers(dirty_raw, order_cols=["load_order"]).collect()))
    for n in (1, 3, 16):
        again = C.clean_customers(dirty_raw.repartition(n), order_cols=["load_order"])
        assert sorted(map(tuple, again.collect())) == base
