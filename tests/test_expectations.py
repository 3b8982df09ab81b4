import pytest
from pyspark.sql import functions as F

from tessera.operators import expectations as X


def _report(df, rules=None):
    rep = X.run_suite(df, rules or X.customer_suite())
    return {(r["expectation_type"], r["column"]): r for r in rep.collect()}, rep


def test_valid_table_passes_everything_but_min_rows(valid_clean):
    rows, rep = _report(valid_clean)
    assert len(rows) == 47
    failed = [k for k, r in rows.items() if not r["success"]]
    assert failed == [("expect_table_row_count_to_be_between", None)]
    assert _report(valid_clean, X.customer_suite(min_rows=5))[1].where("not success").count() == 0


def test_invalid_table_fails_the_right_rules(invalid_clean):
    rows, _ = _report(invalid_clean, X.customer_suite(min_rows=5))
    assert not rows[("expect_column_values_to_be_in_set", "Churn")]["success"]
    assert rows[("expect_column_values_to_be_in_set", "Churn")]["details"] == "Unexpected values: ['Perhaps']"
    assert not rows[("expect_column_values_to_be_between", "tenure")]["success"]
    assert rows[("expect_column_values_to_be_between", "tenure")]["details"] == "1 values outside [0, None]"
    assert not rows[("expect_column_values_to_not_be_null", "TotalCharges")]["success"]
    assert rows[("expect_column_values_to_not_be_null", "TotalCharges")]["observed_value"] == "1 nulls"
    assert not rows[("expect_column_values_to_be_in_set", "Contract")]["success"]


def test_observed_values_text(valid_clean):
    rows, _ = _report(valid_clean)
    assert rows[("expect_column_values_to_be_in_set", "gender")]["observed_value"] == "['Female', 'Male']"
    assert rows[("expect_column_values_to_be_between", "MonthlyCharges")]["observed_value"] == "min=19.90, max=88.60"
    assert rows[("expect_column_mean_to_be_between", "tenure")]["observed_value"] == "25.8000"
    assert rows[("expect_column_values_to_be_of_type", "tenure")]["observed_value"] == "int"


def test_missing_column_is_a_failed_row_not_an_error(valid_clean):
    rows, _ = _report(valid_clean.drop("Contract"))
    r = rows[("expect_column_values_to_be_in_set", "Contract")]
    assert not r["success"] and r["observed_value"] == "COLUMN_NOT_FOUND"
    assert not rows[("expect_column_to_exist", "Contract")]["success"]


def test_uniqueness_is_real(valid_clean):
    dup = valid_clean.unionByName(valid_clean.limit(1))
    rows, _ = _report(dup, X.customer_suite(min_rows=1))
    assert not rows[("expect_column_unique_value_count_to_be_between", "customerID")]["success"]
    u = X.run_suite(dup, [X.Unique("customerID")]).first()
    assert not u["success"] and u["observed_value"] == "1 duplicate rows"


def test_summary_and_gate(invalid_clean):
    rep = X.run_suite(invalid_clean, X.customer_suite(min_rows=5))
    s = X.summarize(rep).first()
    assert s["total"] == 47 and s["passed"] + s["failed"] == 47 and s["failed"] == 4
    assert s["success_rate"] == round(43 / 47, 4)
    assert X.gate(rep, fail_on_error=False) == 4
    with pytest.raises(X.ValidationFailed):
        X.gate(rep)


def test_custom_predicate_rule(valid_clean):
    r = X.run_suite(valid_clean, [X.Predicate(expr="TotalCharges >= MonthlyCharges", name="charges")]).first()
    assert r["success"]


def test_empty_suite_summary_is_zero(spark):
    rep = spark.createDataFrame([], "success boolean")
    assert X.summarize(rep).first()["success_rate"] == 0.0


@pytest.mark.parametrize("separate", [True, False])
def test_in_set_lists_are_bounded_and_counts_exact(spark, monkeypatch, separate):
    monkeypatch.setattr(X, "LIST_VALUES", 5)
    monkeypatch.setattr(X, "LIST_SLICES", 3)
    # a hot allowed value (a third of the rows) and 40 distinct unexpected ones
    rows = [("ok",)] * 60 + [(f"x{i:02d}",) for i in range(40) for _ in range(3)] + [(None,)] * 5
    df = spark.createDataFrame(rows, "c string").repartition(4)
    rep = X.run_suite(df, [X.InSet("c", values=["ok", "x07"])], separate_distinct=separate).collect()
    assert len(rep) == 1 and not rep[0]["success"]
    assert rep[0]["observed_value"] == "['ok', 'x00', 'x01', 'x02', 'x03'] + 36 more"
    assert rep[0]["details"] == "Unexpected values: ['x00', 'x01', 'x02', 'x03', 'x04'] + 34 more"
    allowed = X.run_suite(df.where("c = 'ok' or c is null"), [X.InSet("c", values=["ok"])]).collect()[0]
    assert allowed["success"] and allowed["observed_value"] == "['ok']"
    assert allowed["details"] == "All values in expected set"
