"""Column expressions shared by the operators (all Catalyst built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Text accepted as a number: optional sign, digits with optional fraction
# (or a bare fraction), optional exponent, surrounding whitespace allowed.
NUMERIC_TEXT_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Characters removed by strip(): space, tab, newline, carriage return, form
# feed, vertical tab.
WHITESPACE = " \t\n\r\f\x0b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing whitespace (spaces, tabs, newlines)."""
    return F.trim(col(c), F.lit(WHITESPACE))


def to_number(c) -> Column:
    """Text → double; text that is not a plain decimal number becomes null.

    ``try_cast`` alone would also accept forms such as ``1.5d`` or ``NaN``,
    so the text is matched against a number pattern first.
    """
    c = col(c).cast("string")
    return F.when(c.rlike(NUMERIC_TEXT_PATTERN), strip(c).try_cast("double"))


def nan_to_null(c) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_in(c, values) -> Column:
    """Membership that is false (not null) for null input, as pandas ``isin``."""
    if isinstance(c, str):
        vals = ", ".join(sql_str(v) for v in values)
        return F.expr(f"coalesce(`{c}` in ({vals}), false)")
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def rnd(c, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def safe_ratio(num, den) -> Column:
    """num / den, 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(0.0))


# -- engineered features ------------------------------------------------------

def tenure_months_squared(tenure="tenure") -> Column:
    t = col(tenure).cast("double")
    return t * t


def avg_monthly_spend(total="TotalCharges", tenure="tenure") -> Column:
    return F.try_divide(col(total), col(tenure).cast("double") + F.lit(1.0))


def has_any_addon(columns=None) -> Column:
    columns = columns or S.ADDON_COLUMNS
    flags = [is_in(c, ["Yes"]).cast("int") for c in columns]
    return flags[0] if len(flags) == 1 else F.greatest(*flags)


def services_count(columns=None, active=None) -> Column:
    columns = columns or S.SERVICE_COLUMNS
    active = active or S.ACTIVE_SERVICE_VALUES
    total = None
    for c in columns:
        term = is_in(c, active).cast("int")
        total = term if total is None else total + term
    return total


def is_long_term_contract(contract="Contract") -> Column:
    return is_in(contract, S.LONG_TERM_CONTRACTS).cast("int")


def engineered_columns() -> dict[str, Column]:
    return {
        "tenure_months_squared": tenure_months_squared(),
        "avg_monthly_spend": avg_monthly_spend(),
        "has_any_addon": has_any_addon(),
        "services_count": services_count(),
        "is_long_term_contract": is_long_term_contract(),
    }


# -- labels, decisions and bands ----------------------------------------------

def encode_label(c="Churn", positive="Yes", negative="No") -> Column:
    """Yes → 1, No → 0, anything else → 0 (see ``label_unmapped``)."""
    return F.when(col(c) == positive, 1).when(col(c) == negative, 0).otherwise(0)


def label_unmapped(c="Churn", positive="Yes", negative="No") -> Column:
    return ~is_in(c, [positive, negative])


def decision(prob, threshold: float = S.DECISION_THRESHOLD) -> Column:
    return col(prob) >= F.lit(threshold)


def risk_band(prob) -> Column:
    p = col(prob)
    return (F.when(p < S.RISK_LOW_BELOW, "Low")
            .when(p < S.RISK_MEDIUM_BELOW, "Medium")
            .otherwise("High"))


def drift_band(score) -> Column:
    s = col(score)
    return (F.when(s < S.DRIFT_BAND_LOW_BELOW, "low")
            .when(s < S.DRIFT_BAND_MEDIUM_BELOW, "medium")
            .otherwise("high"))


def percent_text(value) -> Column:
    """Dashboard display: values up to 1 as a percentage with 2 decimals,
    larger values with 4 decimals."""
    v = col(value)
    return F.when(v <= 1, F.format_string("%.2f%%", v * 100)).otherwise(F.format_string("%.4f", v))
