from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera import schemas as S  # noqa: E402
from tessera.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app_name="tessera-tests", shuffle_partitions=4)
    yield s


def _row(cid, gender, senior, partner, dep, tenure, phone, lines, internet, sec, backup,
         prot, tech, tv, movies, contract, paperless, payment, monthly, total, churn):
    return (cid, gender, senior, partner, dep, tenure, phone, lines, internet, sec, backup,
            prot, tech, tv, movies, contract, paperless, payment, monthly, total, churn)


SAMPLE_ROWS = [
    _row("K-31", "Female", 1, "No", "Yes", 7, "Yes", "Yes", "Fiber optic", "No", "No", "Yes", "No", "Yes", "No",
         "One year", "No", "Credit card (automatic)", 81.40, "569.80", "No"),
    _row("K-08", "Male", 0, "No", "No", 0, "No", "No phone service", "DSL", "Yes", "Yes", "No", "Yes", "No", "No",
         "Two year", "Yes", "Mailed check", 33.25, " ", "No"),
    _row("K-77", "Male", 0, "Yes", "No", 41, "Yes", "No", "No", "No internet service", "No internet service",
         "No internet service", "No internet service", "No internet service", "No internet service",
         "Month-to-month", "No", "Electronic check", 19.90, "815.90", "Yes"),
]


@pytest.fixture
def sample_raw(spark):
    """Three raw customers; the second has blank TotalCharges and tenure 0."""
    return spark.createDataFrame(SAMPLE_ROWS, S.RAW_CUSTOMER_SCHEMA)


@pytest.fixture
def dirty_raw(spark):
    """Sample plus a repeat of the first row appended last; the first row's
    gender padded with spaces and a tab; load order recorded."""
    rows = [list(r) for r in SAMPLE_ROWS] + [list(SAMPLE_ROWS[0])]
    rows[0][1] = "  Female\t "
    rows[3][20] = "Yes"  # the appended copy differs, so "first" is observable
    data = [tuple(r) + (i,) for i, r in enumerate(rows)]
    schema = T.StructType(S.RAW_CUSTOMER_SCHEMA.fields + [T.StructField("load_order", T.IntegerType())])
    return spark.createDataFrame(data, schema)


VALID_ROWS = [
    ("K-31", "Female", 1, "No", "Yes", 7, "Yes", "Yes", "Fiber optic", "No", "No", "Yes", "No", "Yes", "No",
     "One year", "No", "Credit card (automatic)", 81.40, 569.80, "No"),
    ("K-08", "Male", 0, "No", "No", 2, "No", "No phone service", "DSL", "Yes", "Yes", "No", "Yes", "No", "No",
     "Two year", "Yes", "Mailed check", 33.25, 66.50, "No"),
    ("K-77", "Male", 0, "Yes", "No", 41, "Yes", "No", "No", "No internet service", "No internet service",
     "No internet service", "No internet service", "No internet service", "No internet service",
     "Month-to-month", "No", "Electronic check", 19.90, 815.90, "Yes"),
    ("K-12", "Female", 0, "Yes", "Yes", 66, "Yes", "Yes", "DSL", "Yes", "No", "Yes", "Yes", "Yes", "No",
     "Two year", "Yes", "Bank transfer (automatic)", 74.15, 4893.90, "No"),
    ("K-90", "Female", 0, "No", "No", 13, "Yes", "No", "Fiber optic", "No", "Yes", "No", "No", "No", "Yes",
     "Month-to-month", "Yes", "Electronic check", 88.60, 1151.80, "Yes"),
]


@pytest.fixture
def valid_clean(spark):
    return spark.createDataFrame(VALID_ROWS, S.CLEAN_CUSTOMER_SCHEMA)


@pytest.fixture
def invalid_clean(spark):
    rows = [list(r) for r in VALID_ROWS]
    rows[4][20] = "Perhaps"
    rows[0][5] = -3
    rows[1][19] = None
    rows[2][15] = "Weekly"
    return spark.createDataFrame([tuple(r) for r in rows], S.CLEAN_CUSTOMER_SCHEMA)
