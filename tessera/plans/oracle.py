"""DuckDB oracle SQL fragments.

These are independent SQL formulations of the operators, run by the
driver's DuckDB check against the same parquet tables. They share the
customer view text with the Spark side and nothing else.
"""

from __future__ import annotations

from .. import schemas as S
from ..sources import tables as TB

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WS_RE = r"^\s+|\s+$"

_STRING_COLS = [c for c in S.CUSTOMER_COLUMNS
                if c not in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges")]


WS_CHARS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def _strip(c: str) -> str:
    return f"trim({c}, {WS_CHARS})"


def _to_number(c: str) -> str:
    return (f"(case when regexp_matches({c}, '{NUM_RE}') "
            f"then try_cast({_strip(c)} as double) end)")


def clean_ctes(dirty: bool) -> str:
    """CTEs ``raw`` → ``prep`` → ``clean`` (21 clean columns)."""
    raw = TB.oracle_dirty_view() if dirty else TB.oracle_customer_view()
    order = "load_order" if dirty else "1"
    cols = []
    for c in S.CUSTOMER_COLUMNS:
        if c == "TotalCharges":
            cols.append(f"coalesce({_to_number(c)}, cast(tenure as double) * cast(MonthlyCharges as double) + 0.0) as TotalCharges")
        elif c == "Churn":
            cols.append(f"case when {_strip(c)} in ('Yes', '1') then 'Yes' else 'No' end as Churn")
        elif c in _STRING_COLS:
            cols.append(f"{_strip(c)} as {c}")
        else:
            cols.append(c)
    prep_cols = ",\n    ".join(cols)
    clean_cols = ", ".join(
        f"cast({c} as int) as {c}" if c in ("SeniorCitizen", "tenure") else
        f"cast({c} as double) as {c}" if c in ("MonthlyCharges", "TotalCharges") else c
        for c in S.CUSTOMER_COLUMNS)
    return f"""raw as ({raw}),
prep as (
  select {prep_cols},
    {_to_number('TotalCharges')} is null as charges_missing,
    {order} as load_order
  from raw),
firsts as (
  select *, row_number() over (partition by customerID order by load_order) as rn,
         count(*) over (partition by customerID) as copies
  from prep),
clean as (select {clean_cols} from firsts where rn = 1)"""


def features_cte(src: str = "clean") -> str:
    addon = " or ".join(f"coalesce({c} = 'Yes', false)" for c in S.ADDON_COLUMNS)
    active = ", ".join(f"'{v}'" for v in S.ACTIVE_SERVICE_VALUES)
    services = " + ".join(f"cast(coalesce({c} in ({active}), false) as int)" for c in S.SERVICE_COLUMNS)
    return f"""feat as (
  select *,
    cast(tenure as double) * cast(tenure as double) as tenure_months_squared,
    case when cast(tenure as double) + 1.0 = 0 then null else TotalCharges / (cast(tenure as double) + 1.0) end as avg_monthly_spend,
    cast(({addon}) as int) as has_any_addon,
    {services} as services_count,
    cast(coalesce(Contract in ('One year', 'Two year'), false) as int) as is_long_term_contract
  from {src})"""


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
