"""Data-quality queries: expectation reports, uniqueness, unexpected values,
record rules with quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import expectations as X
from ..operators import rules as R
from ..sources import tables as TB
from . import oracle as O
from .catalog import register
from .q_clean import clean_dirty

_CLEAN_COLS = list(S.CUSTOMER_COLUMNS)


def _lineitem_suite():
    return [
        X.RowCountBetween(min_value=1),
        X.NotNull("l_orderkey"),
        X.NotNull("l_quantity"),
        X.Between("l_quantity", min_value=1, max_value=50),
        X.Between("l_discount", min_value=0.0, max_value=0.1),
        X.MeanBetween("l_quantity", min_value=20.0, max_value=30.0),
        X.InSet("l_returnflag", values=["A", "N", "R"]),
        X.InSet("l_linestatus", values=["F", "O"]),
        X.Unique(columns=["l_orderkey", "l_linenumber"]),
        X.Predicate(expr="l_extendedprice > 0", name="positive_price"),
        X.OfType("l_linenumber", type_name="int"),
    ]


_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                  "l_linestatus", "l_shipdate"]

_REPORT_SQL = (O.with_ctes(O.clean_ctes(True)) + "select * from (\n"
               + X.suite_sql("clean", _CLEAN_COLS, X.customer_suite()) + "\n)")


@register("expectations_report", oracle=_REPORT_SQL)
def expectations_report(spark, sf):
    """The 47-rule customer suite over the cleaned table, one aggregate pass."""
    return X.run_suite(clean_dirty(spark, sf), X.customer_suite(), separate_distinct=False)


@register("expectations_summary", oracle=f"""
with rep as ({_REPORT_SQL})
select cast(count(*) as bigint) as total, cast(count_if(success) as bigint) as passed,
       cast(count_if(not success) as bigint) as failed,
       case when count(*) > 0 then round(count_if(success) / count(*), 4) else 0.0 end as success_rate
from rep""")
def expectations_summary(spark, sf):
    return X.summarize(expectations_report(spark, sf))


@register("lineitem_expectations", oracle="select * from (\n"
          + X.suite_sql("lineitem", _LINEITEM_COLS, _lineitem_suite()) + "\n)")
def lineitem_expectations(spark, sf):
    """The same rule compiler on a native table."""
    return X.run_suite(TB.table(spark, sf, "lineitem"), _lineitem_suite())


@register("uniqueness_offenders", oracle="""
select l_orderkey, l_linenumber, cast(count(*) as bigint) as n_rows
from lineitem group by l_orderkey, l_linenumber having count(*) > 1""")
def uniqueness_offenders(spark, sf):
    """Keys that occur more than once (partial aggregation before the shuffle)."""
    li = TB.table(spark, sf, "lineitem")
    return (li.groupBy("l_orderkey", "l_linenumber")
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def _unexpected_sql() -> str:
    parts = []
    for c, vals in S.IN_SET_RULES:
        allowed = ", ".join(f"'{v}'" for v in vals)
        parts.append(f"select '{c}' as \"column\", {c} as value from clean "
                     f"where {c} is not null and {c} not in ({allowed})")
    return (O.with_ctes(O.clean_ctes(True)) + "select \"column\", value, cast(count(*) as bigint) as n from (\n"
            + "\nunion all\n".join(parts) + "\n) group by \"column\", value")


@register("unexpected_values", oracle=_unexpected_sql())
def unexpected_values(spark, sf):
    """Every value outside its allowed set, with its count. One unpivot and
    one aggregate for all columns; only offending values reach the shuffle."""
    return R.unexpected_values(clean_dirty(spark, sf), S.IN_SET_RULES)


def _listed_sql() -> str:
    parts = []
    for c, vals in S.IN_SET_RULES:
        allowed = ", ".join(f"'{v}'" for v in vals)
        parts.append(f"select '{c}' as \"column\", cast({c} as varchar) as value, "
                     f"cast({c} as varchar) in ({allowed}) as expected from clean where {c} is not null")
    return (O.with_ctes(O.clean_ctes(True)) + "select \"column\", value, expected, count(*) as n from (\n"
            + "\nunion all\n".join(parts) + "\n) group by all")


@register("in_set_values", oracle=_listed_sql())
def in_set_values(spark, sf):
    """Every value that the in-set rules saw, expected or not, with its count."""
    return R.listed_values(clean_dirty(spark, sf), S.IN_SET_RULES)


@register("record_rules_quarantine", oracle=O.with_ctes(O.clean_ctes(True)) + R.request_rules_sql("clean"))
def record_rules_quarantine(spark, sf):
    """Per-record scoring rules: violations listed per row, valid flag."""
    return R.apply_request_rules(clean_dirty(spark, sf)).select(
        "customerID", "violations", "n_violations", "is_valid")


def _raw_suite():
    return [
        X.RowCountBetween(min_value=1),
        X.CastableTo("TotalCharges", type_name="float"),
        X.CastableTo("tenure", type_name="int"),
        X.InSet("Churn", values=["Yes", "No", "1", "0"]),
        X.NotNull("customerID"),
        X.Unique("customerID"),
    ]


_RAW_COLS = list(S.CUSTOMER_COLUMNS) + ["load_order"]


@register("raw_expectations", oracle=f"with raw as ({TB.oracle_dirty_view()})\nselect * from (\n"
          + X.suite_sql("raw", _RAW_COLS, _raw_suite()) + "\n)")
def raw_expectations(spark, sf):
    """Checks on the raw feed before cleaning: charges text convertible to a
    number, raw label forms, id presence and uniqueness."""
    return X.run_suite(TB.customers_dirty(spark, sf), _raw_suite(), separate_distinct=False)


def _suite_values_sql(src: str, suite) -> str:
    parts = []
    for i, r in enumerate(suite, start=1):
        if isinstance(r, X.InSet):
            allowed = ", ".join(f"'{v}'" for v in r.values)
            parts.append(f"select {i} as rule_id, '{r.column}' as \"column\", case when cast({r.column} as varchar) in ({allowed}) "
                         f"then 'expected' else 'unexpected' end as kind, cast({r.column} as varchar) as value from {src} "
                         f"where {r.column} is not null")
    return "select rule_id, \"column\", kind, value, count(*) as n from (" + " union all ".join(parts) + ") group by all"


@register("lineitem_value_lists", oracle=_suite_values_sql("lineitem", _lineitem_suite()))
def lineitem_value_lists(spark, sf):
    """All values behind the in-set rules of the lineitem suite."""
    return X.suite_values(TB.table(spark, sf, "lineitem"), _lineitem_suite())


@register("raw_value_lists", oracle=f"with raw as ({TB.oracle_dirty_view()}) " + _suite_values_sql("raw", _raw_suite()))
def raw_value_lists(spark, sf):
    """All values behind the in-set rules of the raw feed's suite."""
    return X.suite_values(TB.customers_dirty(spark, sf), _raw_suite())


@register("values_not_in_table", oracle="""
select 'l_partkey' as "column", cast(l_partkey as varchar) as value, count(*) as n
from lineitem where l_partkey not in (select p_partkey from part where p_size <= 40)
group by l_partkey""")
def values_not_in_table(spark, sf):
    """Parts that are ordered but not in the table of allowed parts."""
    allowed = TB.table(spark, sf, "part").where("p_size <= 40")
    return R.not_in_table(TB.table(spark, sf, "lineitem"), "l_partkey", allowed, "p_partkey")


@register("in_table_rule", oracle="""
with bad as (select o_custkey as v, count(*) as n from orders
             where o_custkey not in (select c_custkey from customer where c_acctbal >= 0) group by 1)
select 'expect_column_values_to_be_in_table' as expectation_type, 'o_custkey' as "column", count(*) = 0 as success,
       count(*) as unexpected_values, coalesce(sum(n), 0)::bigint as unexpected_rows,
       (select cast(v as varchar) from bad order by n desc, cast(v as varchar) limit 1) as commonest
from bad""")
def in_table_rule(spark, sf):
    """The in-set rule with customers that have no debt as the allowed table."""
    allowed = TB.table(spark, sf, "customer").where("c_acctbal >= 0")
    return R.in_table_rule(TB.table(spark, sf, "orders"), "o_custkey", allowed, "c_custkey")
