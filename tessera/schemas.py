"""Schemas and the fixed values the customer-churn data model depends on.

Everything below the "fixed values" marker must keep these exact values:
results (rule outcomes, feature counts, bands) are defined by them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay as written; results depend on them)
# ---------------------------------------------------------------------------

# The 21 customer columns, in table order.
CUSTOMER_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]

# Allowed values per categorical column.
GENDER_VALUES = ["Male", "Female"]
YES_NO = ["Yes", "No"]
YES_NO_NO_PHONE = ["Yes", "No", "No phone service"]
YES_NO_NO_INTERNET = ["Yes", "No", "No internet service"]
INTERNET_SERVICE_VALUES = ["DSL", "Fiber optic", "No"]
CONTRACT_VALUES = ["Month-to-month", "One year", "Two year"]
PAYMENT_METHOD_VALUES = [
    "Electronic check", "Mailed check",
    "Bank transfer (automatic)", "Credit card (automatic)",
]
CHURN_VALUES = ["Yes", "No"]

# Columns that must never be null.
CRITICAL_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "tenure", "MonthlyCharges",
    "TotalCharges", "Churn", "Contract", "InternetService",
]

# Categorical columns checked against their allowed set, in suite order.
IN_SET_RULES = [
    ("Churn", CHURN_VALUES),
    ("gender", GENDER_VALUES),
    ("Partner", YES_NO),
    ("Dependents", YES_NO),
    ("PhoneService", YES_NO),
    ("MultipleLines", YES_NO_NO_PHONE),
    ("InternetService", INTERNET_SERVICE_VALUES),
    ("OnlineSecurity", YES_NO_NO_INTERNET),
    ("OnlineBackup", YES_NO_NO_INTERNET),
    ("DeviceProtection", YES_NO_NO_INTERNET),
    ("TechSupport", YES_NO_NO_INTERNET),
    ("StreamingTV", YES_NO_NO_INTERNET),
    ("StreamingMovies", YES_NO_NO_INTERNET),
    ("Contract", CONTRACT_VALUES),
    ("PaperlessBilling", YES_NO),
    ("PaymentMethod", PAYMENT_METHOD_VALUES),
]

# Type rules (column, expected type family) and range rules (column, lo, hi).
TYPE_RULES = [("TotalCharges", "float"), ("MonthlyCharges", "float"),
              ("tenure", "int"), ("SeniorCitizen", "int")]
RANGE_RULES = [("tenure", 0, None), ("TotalCharges", 0.0, None),
               ("MonthlyCharges", 0.0, 200.0), ("SeniorCitizen", 0, 1)]
MEAN_RULES = [("tenure", 1.0, 71.0), ("MonthlyCharges", 10.0, 200.0)]
MIN_ROWS = 100

# Feature lists used by preprocessing and drift.
NUMERICAL_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"]
CATEGORICAL_FEATURES = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod",
]
ENGINEERED_FEATURES = [
    "tenure_months_squared", "avg_monthly_spend", "has_any_addon",
    "services_count", "is_long_term_contract",
]
ADDON_COLUMNS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection",
                 "TechSupport", "StreamingTV", "StreamingMovies"]
SERVICE_COLUMNS = ["PhoneService", "MultipleLines", "InternetService",
                   "OnlineSecurity", "OnlineBackup", "DeviceProtection",
                   "TechSupport", "StreamingTV", "StreamingMovies"]
ACTIVE_SERVICE_VALUES = ["Yes", "DSL", "Fiber optic"]
LONG_TERM_CONTRACTS = ["One year", "Two year"]
TARGET_COL = "Churn"
ID_COL = "customerID"

# Drift monitoring defaults.
DRIFT_NUMERICAL = ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"]
DRIFT_CATEGORICAL = ["gender", "Partner", "Dependents", "Contract",
                     "InternetService", "PaymentMethod"]
DRIFT_THRESHOLD = 0.3
DRIFT_EPSILON = 1e-9

# Scoring.
DECISION_THRESHOLD = 0.5
RISK_LOW_BELOW = 0.30
RISK_MEDIUM_BELOW = 0.60

# Dashboard grading: metric -> (good, fair) cut-offs; drift colour bands.
METRIC_GRADES = {
    "roc_auc": (0.85, 0.75),
    "f1_score": (0.75, 0.65),
    "accuracy": (0.85, 0.75),
    "precision": (0.80, 0.65),
    "recall": (0.75, 0.60),
}
DRIFT_BAND_LOW_BELOW = 0.15
DRIFT_BAND_MEDIUM_BELOW = 0.30

# Split and model defaults.
TEST_SIZE = 0.2
SEED = 42
PRIMARY_METRIC = "roc_auc"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

_STRING_COLS = set(CUSTOMER_COLUMNS) - {"SeniorCitizen", "tenure", "MonthlyCharges"}

# Raw table as it arrives: TotalCharges and Churn stay text (blank charges,
# "1"/"0" labels are legal raw values).
RAW_CUSTOMER_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in _STRING_COLS else
                  (T.DoubleType() if c == "MonthlyCharges" else T.IntegerType()), True)
    for c in CUSTOMER_COLUMNS
])

CLEAN_CUSTOMER_SCHEMA = T.StructType([
    T.StructField(c, T.DoubleType() if c in ("MonthlyCharges", "TotalCharges") else
                  (T.IntegerType() if c in ("SeniorCitizen", "tenure") else T.StringType()), True)
    for c in CUSTOMER_COLUMNS
])

# Scoring request: the customer record without id and label.
REQUEST_SCHEMA = T.StructType([
    f for f in CLEAN_CUSTOMER_SCHEMA.fields if f.name not in (ID_COL, TARGET_COL)
])

EXPECTATION_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("expectation_type", T.StringType(), False),
    T.StructField("column", T.StringType(), True),
    T.StructField("success", T.BooleanType(), False),
    T.StructField("observed_value", T.StringType(), True),
    T.StructField("details", T.StringType(), True),
])

RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("model_type", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("start_ts", T.StringType(), True),
    T.StructField("params", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
])

MODEL_VERSIONS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("stage", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
])
