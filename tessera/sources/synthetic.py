"""Seeded synthetic customer table as a distributed source.

Rows come from ``spark.range(n)``; every random draw is a uniform derived
from ``xxhash64(seed, column, id)``, so the table is the same for any
partitioning and any number of executors (``rand(seed)`` is not). Exact
counts ("a third of the rows", "11 blank charges") are cut with the
bucketed rank over the hash, not with a driver-side shuffle of indices.

It reproduces the reference generator's distributions, not its exact
numpy draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prefix

# ---------------------------------------------------------------------------
# Category weights and bounds of the generator
# ---------------------------------------------------------------------------
GENDER_P = [("Male", 0.505), ("Female", 0.495)]
SENIOR_P = [(0, 0.838), (1, 0.162)]
PARTNER_P = [("Yes", 0.483), ("No", 0.517)]
DEPENDENTS_P = [("Yes", 0.299), ("No", 0.701)]
PHONE_P = [("Yes", 0.904), ("No", 0.096)]
MULTIPLE_LINES_YES = 0.421
INTERNET_P = [("DSL", 0.344), ("Fiber optic", 0.44), ("No", 0.216)]
ADDON_YES = {"OnlineSecurity": 0.286, "OnlineBackup": 0.344, "DeviceProtection": 0.343,
             "TechSupport": 0.289, "StreamingTV": 0.384, "StreamingMovies": 0.389}
CONTRACT_P = [("Month-to-month", 0.551), ("One year", 0.209), ("Two year", 0.240)]
PAPERLESS_P = [("Yes", 0.592), ("No", 0.408)]
PAYMENT_P = [("Electronic check", 0.337), ("Mailed check", 0.228),
             ("Bank transfer (automatic)", 0.219), ("Credit card (automatic)", 0.216)]
NEW_TENURE = (0, 6)        # [lo, hi) months for the newest third
OLD_TENURE = (24, 72)      # [lo, hi) months for the rest
MONTHLY_RANGE = (18.0, 118.75)
TOTAL_NOISE_SD = 50.0
TOTAL_CLIP = (18.8, 8684.8)
N_BLANK_TOTAL = 11
CHURN_BASE = {"Month-to-month": 0.42, "other": 0.11}
CHURN_FIBER_ADD = 0.10
CHURN_NEW_ADD, CHURN_OLD_SUB, CHURN_NEW_BELOW = 0.15, 0.05, 12
CHURN_CLIP = (0.02, 0.95)


def _u(seed: int, name: str) -> Column:
    """Uniform in [0, 1) from 53 bits of xxhash64(seed, name, id)."""
    h = F.xxhash64(F.lit(seed), F.lit(name), F.col("id"))
    return F.shiftright(h, 11).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def _choice(u: Column, pairs) -> Column:
    expr, acc = None, 0.0
    for value, p in pairs[:-1]:
        acc += p
        expr = (F.when(u < acc, F.lit(value)) if expr is None else expr.when(u < acc, F.lit(value)))
    return expr.otherwise(F.lit(pairs[-1][0]))


def generate_customers(spark: SparkSession, n: int = 7043, seed: int = 42) -> DataFrame:
    base = spark.range(1, n + 1).withColumn("_rank_key", F.xxhash64(F.lit(seed), F.lit("order"), F.col("id")))
    # the newest third of customers and the blank-charge rows: exact counts
    cut_new = prefix.nth_key(base, "_rank_key", n // 3) if n // 3 else None
    blank_key = F.xxhash64(F.lit(seed), F.lit("blank"), F.col("id"))
    cut_blank = prefix.nth_key(base.select(blank_key.alias("b")), "b", min(N_BLANK_TOTAL, n))
    is_new = (F.col("_rank_key") <= F.lit(cut_new)) if cut_new is not None else F.lit(False)
    internet = _choice(_u(seed, "internet"), INTERNET_P)
    phone = _choice(_u(seed, "phone"), PHONE_P)
    t_new = F.floor(F.lit(NEW_TENURE[0]) + _u(seed, "tenure") * (NEW_TENURE[1] - NEW_TENURE[0]))
    t_old = F.floor(F.lit(OLD_TENURE[0]) + _u(seed, "tenure") * (OLD_TENURE[1] - OLD_TENURE[0]))
    df = base.select(
        "id",
        F.concat(F.lit("CUST-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("customerID"),
        _choice(_u(seed, "gender"), GENDER_P).alias("gender"),
        _choice(_u(seed, "senior"), SENIOR_P).cast("int").alias("SeniorCitizen"),
        _choice(_u(seed, "partner"), PARTNER_P).alias("Partner"),
        _choice(_u(seed, "dependents"), DEPENDENTS_P).alias("Dependents"),
        F.when(is_new, t_new).otherwise(t_old).cast("int").alias("tenure"),
        phone.alias("PhoneService"),
        F.when(phone == "No", "No phone service").otherwise(
            F.when(_u(seed, "lines") < MULTIPLE_LINES_YES, "Yes").otherwise("No")).alias("MultipleLines"),
        internet.alias("InternetService"),
        *[F.when(internet == "No", "No internet service").otherwise(
            F.when(_u(seed, c) < p, "Yes").otherwise("No")).alias(c) for c, p in ADDON_YES.items()],
        _choice(_u(seed, "contract"), CONTRACT_P).alias("Contract"),
        _choice(_u(seed, "paperless"), PAPERLESS_P).alias("PaperlessBilling"),
        _choice(_u(seed, "payment"), PAYMENT_P).alias("PaymentMethod"),
        F.round(F.lit(MONTHLY_RANGE[0]) + _u(seed, "monthly") * (MONTHLY_RANGE[1] - MONTHLY_RANGE[0]), 2)
        .alias("MonthlyCharges"),
        blank_key.alias("_blank"),
    )
    # normal noise by Box–Muller from two uniforms
    z = F.sqrt(-2.0 * F.log(F.lit(1.0) - _u(seed, "n1"))) * F.cos(2 * math.pi * _u(seed, "n2"))
    total = F.least(F.greatest(F.round(F.col("tenure") * F.col("MonthlyCharges") + z * TOTAL_NOISE_SD, 2),
                               F.lit(TOTAL_CLIP[0])), F.lit(TOTAL_CLIP[1]))
    p = F.when(F.col("Contract") == "Month-to-month", CHURN_BASE["Month-to-month"]).otherwise(CHURN_BASE["other"])
    p = F.when(F.col("InternetService") == "Fiber optic", p + CHURN_FIBER_ADD).otherwise(p)
    p = F.when(F.col("tenure") < CHURN_NEW_BELOW, p + CHURN_NEW_ADD).otherwise(p - CHURN_OLD_SUB)
    p = F.least(F.greatest(p, F.lit(CHURN_CLIP[0])), F.lit(CHURN_CLIP[1]))
    return df.select(
        *[c for c in df.columns if c not in ("id", "_blank")],
        F.when(F.col("_blank") <= F.lit(cut_blank), F.lit(" ")).otherwise(total.cast("string")).alias("TotalCharges"),
        F.when(_u(seed, "churn") < p, "Yes").otherwise("No").alias("Churn"),
    )
