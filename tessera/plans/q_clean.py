"""Ingestion queries: profile, clean, dedup, cleaning report, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E
from ..operators import clean as C
from ..operators import features as FE
from ..operators import profile as PR
from ..sources import tables as TB
from . import oracle as O
from .catalog import register


def clean_base(spark, sf):
    return C.clean_customers(TB.customers_raw(spark, sf))


def clean_dirty(spark, sf):
    return C.clean_customers(TB.customers_dirty(spark, sf), order_cols=["load_order"])


def features_base(spark, sf):
    return FE.engineer_features(clean_base(spark, sf))


def features_dirty(spark, sf):
    return FE.engineer_features(clean_dirty(spark, sf))


_ENG = ", ".join(S.ENGINEERED_FEATURES)

# -- profile of the raw table after number coercion -------------------------------

_PROFILE_COLS = [c for c in S.CUSTOMER_COLUMNS]


def _profile_union_sql() -> str:
    parts = []
    for i, c in enumerate(_PROFILE_COLS):
        expr = "tc" if c == "TotalCharges" else c
        parts.append(f"select '{c}' as \"column\", {i} as position, "
                     f"cast(count_if({expr} is null) as bigint) as null_count, "
                     f"cast(count(*) as bigint) as rows from r")
    return "\nunion all\n".join(parts)


@register("profile_nulls", oracle=(
    f"with raw as ({TB.oracle_dirty_view()}),\n"
    f"r as (select *, {O._to_number('TotalCharges')} as tc from raw)\n"
    + _profile_union_sql()))
def profile_nulls(spark, sf):
    raw = TB.customers_dirty(spark, sf).withColumn("TotalCharges", E.to_number("TotalCharges"))
    return PR.null_profile(raw, _PROFILE_COLS)


def _column_profile_sql() -> str:
    names = "case typeof(any_value({0})) when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' " \
            "when 'BIGINT' then 'bigint' else lower(typeof(any_value({0}))) end"
    return "\nunion all\n".join(
        f"select {i} as position, '{c}' as \"column\", {names.format(c)} as dtype, "
        f"cast(count_if({c} is null) as bigint) as null_count, cast(count(*) as bigint) as rows from clean"
        for i, c in enumerate(_PROFILE_COLS))


@register("column_profile", oracle=O.with_ctes(O.clean_ctes(True)) + _column_profile_sql())
def column_profile(spark, sf):
    """Type, nulls and rows of each column of the cleaned table."""
    return PR.column_profile(clean_dirty(spark, sf), _PROFILE_COLS)


@register("clean_customers", oracle=O.with_ctes(O.clean_ctes(True)) + "select * from clean")
def clean_customers(spark, sf):
    return clean_dirty(spark, sf)


_CLEANING_REPORT = O.with_ctes(O.clean_ctes(True)) + """
select cast((select count(*) from prep) as bigint) as rows_before,
       cast((select count(*) from clean) as bigint) as rows_after,
       cast((select count(*) from prep) - (select count(*) from clean) as bigint) as duplicates_removed,
       cast((select count_if(charges_missing) from prep) as bigint) as missing_total_charges_before,
       cast((select count_if(charges_missing) from prep) as bigint) as missing_total_charges_imputed,
       cast((select count_if(Churn = 'Yes') from clean) as bigint) as churn_yes,
       cast((select count_if(Churn = 'No') from clean) as bigint) as churn_no,
       (select count(*) from (describe clean))::int as n_columns,
       cast((select """ + " + ".join(f"count_if({c} is null)" for c in S.CUSTOMER_COLUMNS) + """ from clean) as bigint)
         as null_cells_after,
       (select concat_ws(',', """ + ", ".join(
           f"case when count_if({c} is null) > 0 then '{c}=' || count_if({c} is null) end" for c in S.CUSTOMER_COLUMNS) + """)
        from clean) as nulls_by_column
"""


@register("cleaning_report", oracle=_CLEANING_REPORT)
def cleaning_report(spark, sf):
    return C.cleaning_report(TB.customers_dirty(spark, sf), order_cols=["load_order"])


@register("cleaning_report_observed", oracle=_CLEANING_REPORT)
def cleaning_report_observed(spark, sf):
    """The same report without a pass of its own: its figures are observed while
    the cleaned rows are made."""
    return C.clean_with_report(TB.customers_dirty(spark, sf), order_cols=["load_order"])[1]


@register("dedup_first", oracle=f"""
with raw as ({TB.oracle_dirty_view()}),
s as (select {O._strip('customerID')} as customerID, load_order, TotalCharges, Churn from raw),
r as (select *, row_number() over (partition by customerID order by load_order) as rn,
             count(*) over (partition by customerID) as copies from s)
select customerID, load_order, TotalCharges, Churn, cast(copies as bigint) as copies from r where rn = 1
""")
def dedup_first(spark, sf):
    """Keep the first row per stripped id; no other cleaning."""
    raw = TB.customers_dirty(spark, sf).select(
        E.strip("customerID").alias("customerID"), "load_order", "TotalCharges", "Churn")
    return (raw.groupBy("customerID")
            .agg(F.min_by(F.struct("load_order", "TotalCharges", "Churn"),
                          F.struct("load_order", "TotalCharges", "Churn")).alias("r"),
                 F.count(F.lit(1)).alias("copies"))
            .select("customerID", "r.load_order", "r.TotalCharges", "r.Churn", "copies"))


@register("label_distribution", oracle=O.with_ctes(O.clean_ctes(True)) +
          "select Churn, cast(count(*) as bigint) as n from clean group by Churn")
def label_distribution(spark, sf):
    return C.label_distribution(clean_dirty(spark, sf))


@register("engineered_features", oracle=O.with_ctes(O.clean_ctes(True), O.features_cte()) +
          f"select customerID, {_ENG} from feat")
def engineered_features(spark, sf):
    return features_dirty(spark, sf).select("customerID", *S.ENGINEERED_FEATURES)


def _by_contract_aggs():
    aggs = [F.count(F.lit(1)).alias("customers"),
            E.rnd(F.avg((F.col("Churn") == "Yes").cast("double"))).alias("churn_rate")]
    for c in ["tenure", "MonthlyCharges", "TotalCharges"] + S.ENGINEERED_FEATURES:
        aggs.append(E.rnd(F.avg(c)).alias(f"avg_{c}"))
    return aggs


_BY_CONTRACT_SQL = (O.with_ctes(O.clean_ctes(False), O.features_cte()) + """
select Contract, cast(count(*) as bigint) as customers,
       round(avg(cast(Churn = 'Yes' as double)), 6) as churn_rate,
""" + ",\n".join(f"       round(avg({c}), 6) as avg_{c}"
                for c in ["tenure", "MonthlyCharges", "TotalCharges"] + S.ENGINEERED_FEATURES)
    + "\nfrom feat group by Contract")


@register("churn_by_contract", oracle=_BY_CONTRACT_SQL, headline=True)
def churn_by_contract(spark, sf):
    """Flagship: clean → features → churn rate and feature means per contract."""
    return features_base(spark, sf).groupBy("Contract").agg(*_by_contract_aggs())


@register("table_shape", oracle=f"with raw as ({TB.oracle_dirty_view()})\n"
          "select cast(count(*) as bigint) as rows, 22 as columns from raw")
def table_shape(spark, sf):
    """Rows and columns of the raw feed."""
    return PR.shape(TB.customers_dirty(spark, sf))


@register("preview_head", oracle=O.with_ctes(O.clean_ctes(True)) +
          "select clean.* from clean join firsts using (customerID) where rn = 1 order by load_order limit 3")
def preview_head(spark, sf):
    """First three cleaned rows in file order (the limit is the feature)."""
    clean = C.clean_customers(TB.customers_dirty(spark, sf), order_cols=["load_order"], keep_order=True)
    return clean.orderBy("load_order").limit(3).drop("load_order")
