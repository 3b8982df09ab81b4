import pytest
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import expressions as E
from tessera.operators import features as FE
from tessera.operators import preprocess as PP
from tessera.operators import split as SP
from tessera.plans.q_clean import features_base
from tests.conftest import SF_MEDIUM

VALID_CUSTOMER = dict(gender="Female", SeniorCitizen=1, Partner="No", Dependents="Yes", tenure=7,
                      PhoneService="Yes", MultipleLines="Yes", InternetService="Fiber optic", OnlineSecurity="No",
                      OnlineBackup="No", DeviceProtection="Yes", TechSupport="No", StreamingTV="No",
                      StreamingMovies="No", Contract="One year", PaperlessBilling="No",
                      PaymentMethod="Credit card (automatic)", MonthlyCharges=81.40, TotalCharges=569.80)


def test_engineered_features_of_one_customer(spark):
    df = spark.createDataFrame([tuple(VALID_CUSTOMER.values())], S.REQUEST_SCHEMA)
    r = FE.engineer_features(df).first()
    assert r["tenure_months_squared"] == 49.0
    assert r["avg_monthly_spend"] == pytest.approx(569.80 / 8)
    assert r["has_any_addon"] == 1
    assert r["services_count"] == 4
    assert r["is_long_term_contract"] == 1


def test_feature_nulls_behave_like_pandas_isin(spark):
    df = spark.createDataFrame([(None, None, -1, 5.0)], "Contract string, OnlineBackup string, tenure int, TotalCharges double")
    r = df.select(E.is_long_term_contract().alias("lt"), E.has_any_addon(["OnlineBackup"]).alias("a"),
                  E.avg_monthly_spend().alias("s")).first()
    assert r["lt"] == 0 and r["a"] == 0 and r["s"] is None  # division by zero gives null, not an error


def test_label_encoding_reports_unmapped(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("Maybe",)], "Churn string")
    rows = FE.encode_target(df).collect()
    assert [r["label"] for r in rows] == [1, 0, 0]
    assert [r["label_unmapped"] for r in rows] == [False, False, True]


def test_allocation_largest_remainder():
    assert SP.allocate({0: 885, 1: 615}, 0.2) == {0: 177, 1: 123}
    k = SP.allocate({0: 5, 1: 3, 2: 2}, 0.25)   # ceil(2.5) = 3 test rows
    assert sum(k.values()) == 3


@pytest.fixture(scope="module")
def labelled(spark):
    return features_base(spark, SF_MEDIUM).withColumn("label", E.encode_label("Churn")).cache()


def test_split_sizes_and_stratification(labelled):
    out = SP.stratified_split(labelled)
    counts = {(r["label"], r["split"]): r["n"] for r in
              out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = labelled.count()
    n_test = counts[(0, "test")] + counts[(1, "test")]
    assert n_test == -(-n * 2 // 10)
    pos = counts[(1, "test")] + counts[(1, "train")]
    assert abs(counts[(1, "test")] / n_test - pos / n) < 0.01


def test_split_repeatable_and_partition_invariant(labelled):
    a = {r["customerID"]: r["split"] for r in SP.stratified_split(labelled).collect()}
    for parts in (1, 3, 16):
        b = {r["customerID"]: r["split"] for r in SP.stratified_split(labelled.repartition(parts)).collect()}
        assert a == b
    c = {r["customerID"]: r["split"] for r in SP.stratified_split(labelled, seed=7).collect()}
    assert a != c


def test_median_and_mode_statistics(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (10.0, "a"), (None, None)], "x double, c string")
    med = {r["feature"]: r["median"] for r in PP.medians(df, ["x"]).collect()}
    assert med["x"] == 2.5  # interpolated between the middle values
    mode = {r["feature"]: r["mode"] for r in PP.modes(df, ["c"]).collect()}
    assert mode["c"] == "a"  # tie → smallest value


def test_vocabulary_and_unknown_levels(spark):
    train = spark.createDataFrame([("1", "b"), ("2", "a")], "customerID string, c string")
    vocab = PP.vocabulary(train, ["c"])
    assert [(r["value"], r["slot"]) for r in vocab.orderBy("slot").collect()] == [("a", 0), ("b", 1)]
    scored = spark.createDataFrame([("3", "zzz"), ("4", "b")], "customerID string, c string")
    got = {r["customerID"]: r["name"] for r in PP.one_hot_long(scored, vocab, cols=["c"]).collect()}
    assert got == {"4": "categorical__c_b"}


def test_one_hot_salted_join_equals_broadcast(spark, monkeypatch):
    # a hot level (a third of the rows) and many rare ones
    rows = [(str(i), "hot" if i % 3 == 0 else f"v{i % 40}") for i in range(3000)]
    df = spark.createDataFrame(rows, "customerID string, c string").repartition(4)
    vocab = PP.vocabulary(df.where("customerID % 2 = 0"), ["c"])
    small = sorted(tuple(r) for r in PP.one_hot_long(df, vocab, cols=["c"]).collect())
    monkeypatch.setattr(PP, "BROADCAST_LEVELS", 0)
    salted = sorted(tuple(r) for r in PP.one_hot_long(df, vocab, cols=["c"], salt_buckets=5).collect())
    levels = {v for i, v in rows if int(i) % 2 == 0}
    assert salted == small
    assert small == sorted((i, "c", f"categorical__c_{v}") for i, v in rows if v in levels)


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    w = {r["label"]: r["weight"] for r in PP.class_weights(df).collect()}
    assert w == {0: round(4 / 6, 6), 1: 2.0}


def test_split_narrowing_path_matches_brute_force(spark, monkeypatch):
    import hashlib
    monkeypatch.setattr(SP, "_DIGITS", 1)       # 16 buckets per step
    monkeypatch.setattr(SP, "_FINAL_ROWS", 3)   # force several narrowing steps
    ids = [f"id{i}" for i in range(400)]
    df = spark.createDataFrame([(i, n % 3 == 0) for n, i in enumerate(ids)], "customerID string, label boolean") \
        .withColumn("label", F.col("label").cast("int"))
    got = {r["customerID"]: r["split"] for r in SP.stratified_split(df).collect()}
    rows = [(i, int(n % 3 == 0)) for n, i in enumerate(ids)]
    counts = {0: sum(1 for _, y in rows if y == 0), 1: sum(1 for _, y in rows if y == 1)}
    quota = SP.allocate(counts, 0.2)
    want = {}
    for y in (0, 1):
        members = sorted((hashlib.md5(("42" + i).encode()).hexdigest(), i) for i, yy in rows if yy == y)
        for rank, (_, i) in enumerate(members, start=1):
            want[i] = "test" if rank <= quota[y] else "train"
    assert got == want
